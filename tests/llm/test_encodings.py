"""Exact round trips and library comparisons: SentencePiece, token counts, WARC, media."""

import hashlib
import io
import math
import random
import struct
import wave
import zlib

import numpy as np
import pytest
import zstandard
from oracle import SMALL

from chronoset.llm import media, sentence_piece, token_counts, warc

ODD = ["", " ", "  ", "a", " a", "\n", "\n\n a  b", "a" * 3000, "▁", "<0x41>", "<s>", "=" * 80, " " * 39 + "x", "日本語😀 é\x00\x07", "<|endoftext|> x", "'s it's\r\n\t x y z"]


def texts(seed, n):
    rnd = random.Random(seed)
    alphabet = "aabbceth  in re\n▁éß日本😀\x00\t the on    =="
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_piece.MODEL)
    real = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    everything = [*ODD, *texts(1, 3000), *real]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(everything)] + [(-1, None, "x")], "doc_id long, text string, _ids string")
    got = {r.doc_id: r for r in sentence_piece.tokenize(docs).collect()}
    for k, t in enumerate(everything):
        assert got[k]._ids == sp.encode(t), repr(t[:80])
        assert got[k]._n_tokens == len(got[k]._ids)
        assert hashlib.sha256(sp.decode(got[k]._ids).encode()).hexdigest() == got[k]._decoded_sha256
        assert got[k]._round_trip or "�" in sp.decode(got[k]._ids), repr(t[:80])
    bare = docs.where("text = '' OR text IS NULL")  # batches of empty texts alone
    assert sentence_piece.tokenize(bare).where("_n_tokens = 0").count() == bare.count() > 1
    assert got[-1]._ids == [] and sentence_piece.tokenize(docs.where("false")).count() == 0


def test_very_long_cut_takes_the_other_sort(monkeypatch):
    import sentencepiece

    pieces = sentence_piece.Pieces.load(sentence_piece.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_piece.MODEL)
    many = [*texts(7, 300), "".join(random.Random(3).choices("abcdefgh", k=60_000)), "a b " * 30_000]
    want = sp.encode(many)
    assert [x.tolist() for x in sentence_piece.encode(pieces, many)] == want
    sorts = []
    monkeypatch.setattr(sentence_piece, "PACKED", 1000)
    monkeypatch.setattr(sentence_piece.np, "lexsort", lambda *a, f=sentence_piece.np.lexsort: sorts.append(1) or f(*a))
    assert [x.tolist() for x in sentence_piece.encode(pieces, many)] == want and sorts


def test_token_counts_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.TOKENIZER)
    everything = [*ODD, *texts(2, 2000)]
    docs = spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate(everything)] + [(k, t, "x", 7) for k, t in enumerate(everything)] + [(-1, None, "x", 7)], "doc_id long, text string, content string, _n_tokens int")
    version = token_counts.tokenizer_digest(token_counts.TOKENIZER)
    for name, ranks in (("fast", token_counts.RANKS), ("exact", None)):
        cache = token_counts.DigestCache(spark, str(tmp_path / name))
        got = token_counts.count_tokens(docs, ranks=ranks, cache=cache).collect()
        assert len(got) == docs.count() and {r.content for r in got} == {"x"}
        for r in got:
            assert r._n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids), repr(r.text)
            assert r._n_bytes == len((r.text or "").encode())
        assert cache.read(version).count() == len({t for t in everything} | {""})
        files = sorted((tmp_path / name).rglob("*.parquet"))
        # all hits: nothing is encoded (the ranks' file is not there) and nothing is added
        again = token_counts.count_tokens(docs, ranks="/not/there", cache=cache).collect()
        assert sorted(map(repr, again)) == sorted(map(repr, got)) and sorted((tmp_path / name).rglob("*.parquet")) == files
        # a count that two runs have added is one count
        cache.append(version, cache.read(version))
        assert token_counts.count_tokens(docs, ranks="/not/there", cache=cache).count() == docs.count()
        # another tokenizer version finds nothing
        assert cache.read("other").count() == 0
    assert token_counts.count_tokens(docs.where("false")).count() == 0


def test_token_counts_query_keeps_its_cache(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"text of {tmp_path}")], "doc_id long, text string")
    token_counts.count_tokens(docs).count()
    assert token_counts.count_tokens(docs, ranks="/not/there").count() == 1


@pytest.mark.parametrize("n", [1_000_000, 3_000_000])
def test_token_counts_of_very_long_runs(n):
    count = token_counts.counter(token_counts.TOKENIZER, token_counts.RANKS)
    for unit in (" ", "\n", " \n\t", "a", "!", "é", "a b "):
        text = unit * (n // len(unit)) + "x"
        assert count(text) == len(count.exact.encode(text, add_special_tokens=False).ids), repr(unit)


PAGES = "page_id long, url string, html string, digest string, n string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x") for i, u, h in rows], PAGES)


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>é" + "x" * 1200, "y" * 999
    rows = [(1, "http://a/\r\nX: 1", big), (2, None, big), (9, "u", big), (9, "u2", big), (None, "n", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "u", "z" * 300_000), (8, "u", "\x00\r\n\r\nHTTP/1.1 200\r\n\r\n")]
    rows += [(100 + k, "u", f"<html>{k}" + "common words of a template " * 60) for k in range(50)]
    archives = warc.write_archives(pages_of(spark, rows), archive_bytes=20_000).persist()
    assert archives.count() > 2
    warc.save_files(archives, str(tmp_path / "archives"))
    for source in (archives, warc.load_files(spark, str(tmp_path / "archives"))):
        records = warc.read_archives(source)
        assert records.where("record_type = 'warcinfo'").count() == archives.count()
        got = warc.page_records(warc.checked_revisits(records)).collect()
        assert len(got) == len(rows)
        for r in got:
            payload = [(h or "").encode() for i, _, h in rows if i == r.page_id][0]
            assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
            assert r.payload == (payload if r.record_type == "response" else b"")
        kinds = {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id is None or r.page_id < 10}
        assert kinds == {(1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (None, "revisit", 9), *((k, "response", None) for k in range(3, 9))}
    assert warc.read_archives(warc.write_archives(pages_of(spark, []))).count() == 0


def test_warc_revisits_are_checked(spark):
    payload = b"p" * 2000
    for response in (warc.record(9, "u", b"q" * 2000, None), warc.record(8, "u", payload, None), warc.info_record("x")):
        archive = spark.createDataFrame([("a", bytearray(warc.pack([response, warc.record(1, "u", payload, 9)])))], warc.ARCHIVES)
        with pytest.raises(Exception, match="no response with the payload"):
            warc.checked_revisits(warc.read_archives(archive)).collect()


def foreign_record(kind, block, *headers, version="WARC/1.0"):
    head = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:6f1a>", "WARC-Date: 2020-01-01T00:00:00Z", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_of_other_writers(spark):
    """Streamed frames without a size, other skippable frames, no dictionary, other types and digests, folded and odd headers."""
    http = b"HTTP/1.1 200 OK\r\nno colon here\r\nServer: caf\xe9\r\n\r\n<p>hi"
    sha256 = hashlib.sha256(b"<p>hi").hexdigest()
    records = [
        foreign_record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign_record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http;msgtype=request"),
        foreign_record("response", http, "Content-Type: application/http", "X-Folded: a", " b"),
        foreign_record("response", http, "content-type: application/http", f"WARC-Payload-Digest: sha-256:{sha256}", "WARC-Block-Digest: blake3:00"),
        foreign_record("response", b"1.2.3.4", "Content-Type: text/dns"),
        foreign_record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 9\r\n\r\n2\r\nhi\r\n0\r\n\r\n", "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + "A" * 32),
        foreign_record("revisit", b"", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified"),
        foreign_record("metadata", b"outlink: x\r\n"),
    ]

    def streamed(data, **options):
        stream = zstandard.ZstdCompressor(write_content_size=False, **options).compressobj()
        return stream.compress(data) + stream.flush()

    skip = struct.pack("<II", 0x184D2A53, 3) + b"abc"
    dictionary = zstandard.ZstdCompressionDict(b"WARC-Type WARC-Record-ID " * 40, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = b"".join(streamed(r) + skip for r in records)
    packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    with_dictionary = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + b"".join(streamed(r, dict_data=dictionary) for r in records)
    for content in (plain, with_dictionary):
        assert list(warc.unpack(content)) == records
    got = warc.read_archives(spark.createDataFrame([("a", bytearray(plain))], warc.ARCHIVES)).collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "response", "response", "revisit", "metadata"]
    assert [bytes(r.payload) for r in got[2:5]] == [b"<p>hi", b"<p>hi", b"1.2.3.4"] and got[6].payload_digest is None
    assert warc.page_records(warc.read_archives(spark.createDataFrame([("a", bytearray(plain))], warc.ARCHIVES))).count() == 0
    for bad in (plain[:-1], plain + b"x", plain[: len(streamed(records[0])) - 2], struct.pack("<II", 0x184D2A53, 99)):
        with pytest.raises(warc.ArchiveError):
            list(warc.unpack(bad))


def test_warc_reader_refuses_damage():
    records = [warc.record(k, "http://x/", b"payload %d" % k * 50, None) for k in range(30)]
    good = warc.pack(records)
    assert list(warc.unpack(good)) == records
    for bad in (good[4:], good[:-3], good[:-40] + b"\0" * 40, good + b"junk"):
        with pytest.raises(warc.ArchiveError):
            [warc.parse(r) for r in warc.unpack(bad)]
    r = records[0]
    for bad in (r.replace(b"WARC/1.1", b"WARC/9.9"), r.replace(b"WARC-Date", b"X-Date"), r.replace(b"payload 0", b"payload 1", 1), r[:-4], r.replace(b"Content-Length: ", b"Content-Length: 1", 1), r.replace(b": response", b": weird"), r.replace(b"WARC-Type: response", b"WARC-Type  response")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad)


def plain_pairs(samples):
    """Peaks and pairs by the definition of the transform, in double precision, frame by frame."""
    x = np.frombuffer(samples, np.uint8).astype(float) - 128
    window = np.array([0.5 - 0.5 * math.cos(2 * math.pi * k / 127) for k in range(128)])
    basis = np.exp(-2j * np.pi * np.outer(np.arange(65), np.arange(128)) / 128)
    peaks = []
    for at in range(0, len(x) - 127, 64):
        frame = x[at : at + 128]
        power = np.abs(basis @ ((frame - frame.mean()) * window))
        best = [lo + int(power[lo:hi].argmax()) for lo, hi in ((1, 10), (10, 24), (24, 65))]
        peaks.append([b if power[b] > 1e-3 else 0 for b in best])
    out = []
    for t, own in enumerate(peaks):
        for gap in (1, 2):
            for band in range(3):
                for other in (band, band + 1):
                    if other < 3 and t + gap < len(peaks) and own[band] and peaks[t + gap][other]:
                        out.append(t << 32 | own[band] << 16 | peaks[t + gap][other] << 4 | gap)
    return sorted(out)


def test_fingerprint_against_plain_transform():
    rnd = random.Random(8)
    for n in (192, 384, 1920, 9600):
        for alphabet in ("abcdefgh ijklmnop", "é日x ", "".join(map(chr, range(32, 127)))):
            samples = media.padded("".join(rnd.choices(alphabet, k=n)).encode()[: n - 7])
            assert media.fingerprint(samples).tolist() == plain_pairs(samples)
    assert media.fingerprint(b" " * 192).tolist() == plain_pairs(b" " * 192) == []


def test_media(spark, tmp_path):
    rows = [(0, None), (1, ""), (2, "x" * 192), (3, "x" * 193), (4, "é" * 5000), (5, "é" * 5000), (6, "The quick brown fox. " * 40), (6, "The quick brown fox. " * 40), (7, "long " * 600_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, feature int, _media string")
    media.media_columns(docs).write.parquet(str(tmp_path / "media"))
    found = media.media_digests(spark.read.parquet(str(tmp_path / "media"))).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and {r.feature for r in found} == {1}
    for i, t in rows:
        data, r = (t or "").encode(), got[i]
        with wave.open(io.BytesIO(r._media)) as w:
            payload = w.readframes(w.getnframes())
        assert payload.startswith(data) and set(payload[len(data) :]) <= {32} and len(payload) % 192 == 0 < len(payload) < len(data) + 193
        assert (r._n_bytes, r._payload_bytes, r._media_bytes) == (len(data), len(payload), len(r._media))
        assert r._payload_sha256 == hashlib.sha256(payload).hexdigest() and r._tail_crc32 == zlib.crc32(payload[-16:]) and r._media_sha256 == hashlib.sha256(r._media).hexdigest()
        assert r._pairs == sorted(r._pairs) and r._feature == f"{len(r._pairs)}:{hashlib.sha256(np.array(r._pairs, '<i8').tobytes()).hexdigest()[:32]}"
    assert got[4]._feature == got[5]._feature != got[6]._feature and got[0]._media == got[1]._media
    assert got[6]._pairs == plain_pairs(media.padded(rows[6][1].encode()))
    assert len(got[6]._pairs) > 10 and media.media_digests(media.media_columns(docs.where("false"))).count() == 0
