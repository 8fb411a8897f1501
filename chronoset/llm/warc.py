"""WARC archives compressed by Zstandard with a dictionary (.warc.zst), written and read as Spark tables.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a dictionary as zstd
trains it or a raw one; then comes one frame per record, the first a warcinfo. Archives are rows (name, content), so that they
go to any store that Spark writes to and survive lost executors; save_files and load_files turn them into files and back. An
archive is closed once its records reach `archive_bytes`; a larger record is an archive of its own.

Of pages with equal payloads of at least `min_revisit` bytes, the one with the largest id is the response; the others are
revisits, whose block holds HTTP headers alone. Digests are grouped before pages move; pages are joined to the groups of
two or more, where Spark splits skewed digests. A record's id is made of the page's id and its payload's digest, so that a
revisit can name its response; only rows that repeat both share it.

The reader takes other writers' archives too: with or without a dictionary, frames without a content size, skippable frames
anywhere, all record types, any record ids, and records without digests. It checks the frames, the WARC version, the
mandatory headers, Content-Length against the frame, the HTTP length and every digest whose algorithm is known; it raises
ArchiveError on the first thing that is wrong. checked_revisits then joins revisits to the responses that they name, and fails
where there is none with the same payload digest. An archive has at most 2 GB, as a row of Spark has.

Defined results: null html is an empty payload; pages that share the largest id of a group are all responses; a null id
is written as such and is the smallest; a null url is left out; line ends and other controls in urls are percent-encoded; only
the named columns of pages are read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_of

MIN_REVISIT = 1000
ARCHIVE_BYTES = 8_000_000
DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 32_768, 1_000_000, 3
#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
KINDS = frozenset("warcinfo response resource request metadata revisit conversion continuation".split())
ARCHIVES = "name string, content binary"
RECORDS = "record_id string, record_type string, url string, date string, refers_to_id string, payload_bytes long, payload_digest string"
#: Pages' records are named <urn:page:ID:DIGEST>.
_PAGE = r"^<urn:page:(null|-?[0-9]+):[0-9a-f]+>$"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None, payload_sha1: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{payload_sha1}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if refers_to is given."""
    revisit, digest = refers_to is not None, hashlib.sha1(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    return _written([*head, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}"], block)


def info_record(name: str) -> bytes:
    return _written(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def _written(head: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *head, f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive of the records, with a dictionary trained on its own first records where there are enough."""
    samples, held = [], 0
    for r in records:
        samples.append(r[:100_000])
        held += len(samples[-1])
        if held >= SAMPLE_BYTES:
            break
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except zstandard.ZstdError:  # too few or too small samples
        dictionary = zstandard.ZstdCompressionDict((records[0] if records else b"")[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress
    data = dictionary.as_bytes()
    return b"".join([struct.pack("<II", SKIPPABLE, len(data)), data, *map(compress, records)])


def _frame_end(data: bytes, at: int) -> int:
    """Where the zstd frame that begins at `at` ends: its header, then blocks up to the last, then the checksum."""
    if data[at : at + 4] != FRAME:
        raise ArchiveError(f"no frame at byte {at}")
    try:
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
        place = at + zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as e:
        raise ArchiveError(f"bad frame header at byte {at}: {e}") from e
    while True:
        if place + 3 > len(data):
            raise ArchiveError("the archive ends inside a frame")
        head = int.from_bytes(data[place : place + 3], "little")
        place += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            place += 4 * checksum
            if place > len(data):
                raise ArchiveError("the archive ends inside a frame")
            return place


def unpack(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one per frame; skippable frames after the first are passed over."""
    at, dictionary = 0, None
    while at < len(content):
        magic, size = struct.unpack("<II", content[at : at + 8].ljust(8, b"\0"))
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            data = content[at + 8 : at + 8 + size]
            if len(data) != size:
                raise ArchiveError("a skippable frame is cut short")
            if at == 0 and magic == SKIPPABLE:
                if data[:4] == FRAME:  # a dictionary may be compressed itself
                    data = _decompressed(zstandard.ZstdDecompressor(), data, 0)
                dictionary = zstandard.ZstdCompressionDict(data)
            at += 8 + size
            continue
        end = _frame_end(content, at)
        yield _decompressed(zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor(), content[at:end], at)
        at = end


def _decompressed(decompressor: zstandard.ZstdDecompressor, frame: bytes, at: int) -> bytes:
    """A frame's content, whether or not its header names the size."""
    try:
        stream = decompressor.decompressobj()
        data = stream.decompress(frame)
    except zstandard.ZstdError as e:
        raise ArchiveError(f"bad frame at byte {at}: {e}") from e
    if not stream.eof:
        raise ArchiveError(f"the frame at byte {at} does not end")
    return data


def _headers(lines: bytes, strict: bool) -> dict[str, str]:
    out, last = {}, None
    for line in lines.decode("utf-8" if strict else "latin-1", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:  # folded
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            out[last] = value.strip()
        elif strict:
            raise ArchiveError(f"bad header: {line[:80]}")
    return out


def _digest(header: str) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a labelled digest in hex or base 32; None for algorithms that are not known."""
    name, _, value = header.partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    try:
        return name, bytes.fromhex(value) if len(value) == 2 * hashlib.new(name).digest_size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError as e:
        raise ArchiveError(f"bad digest: {header[:80]}") from e


def _check(what: str, header: str | None, data: bytes) -> None:
    if header and (known := _digest(header)) and hashlib.new(known[0], data).digest() != known[1]:
        raise ArchiveError(f"the {what}'s digest is another")


def parse(data: bytes) -> tuple[str, str, str | None, str, str | None, int | None, str | None, bytes]:
    """(record id, type, url, date, id of the record that it refers to, payload's length, its SHA-1 in hex, payload).

    The payload is the body of an HTTP message, or else the whole block. A revisit has none: length and digest are those of its
    headers, null where these don't name them.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/0.18", b"WARC/1.0", b"WARC/1.1"):
        raise ArchiveError("not a WARC record")
    h = _headers(lines, True)
    if missing := [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if not h.get(n)]:
        raise ArchiveError(f"missing headers: {', '.join(missing)}")
    if not re.fullmatch("[0-9]+", h["content-length"]) or (n := int(h["content-length"])) + 4 != len(rest) or rest[n:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length is not the block's")
    block, kind, length, coded = rest[:n], h["warc-type"].lower(), None, False
    if kind not in KINDS:
        raise ArchiveError(f"unknown type {kind[:40]}")
    _check("block", h.get("warc-block-digest"), block)
    payload = block
    if h.get("content-type", "").lower().startswith("application/http") and kind in ("response", "request", "revisit"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        status, _, http_lines = http.partition(b"\r\n")
        if not gap or (b"HTTP/" not in status if kind == "request" else not status.startswith(b"HTTP/")):
            raise ArchiveError("the block is no HTTP message")
        fields = _headers(http_lines, False)
        coded, length = "transfer-encoding" in fields, fields.get("content-length")
        length = int(length) if length and re.fullmatch("[0-9]+", length) else None
    if kind == "revisit":
        if not h.get("warc-profile"):
            raise ArchiveError("a revisit without a profile")
        known = _digest(h.get("warc-payload-digest", ""))
        return h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], h.get("warc-refers-to"), length, known[1].hex() if known and known[0] == "sha1" else None, b""
    if "warc-truncated" not in h and not coded:
        if length is not None and length != len(payload):
            raise ArchiveError("the payload's length is another")
        _check("payload", h.get("warc-payload-digest"), payload)
    return h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], h.get("warc-refers-to"), len(payload), hashlib.sha1(payload).hexdigest(), payload


def with_references(pages: DataFrame, min_revisit: int = MIN_REVISIT, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to): the page with the same payload that is written in full, null for itself."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), "url", text_of(html).alias("html"))
    large = F.octet_length("html") >= min_revisit
    digest = F.when(large, F.sha2("html", 256)).alias("digest")
    groups = rows.where(large).select("page_id", digest).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = groups.where("n > 1 AND top IS NOT NULL").select("digest", "top")
    joined = rows.select("*", digest).join(groups, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, **options) -> DataFrame:
    """(name, content) of the archives of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"pages-{part:05d}-{made:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([pack([info_record(name), *held])], pa.binary())], ["name", "content"])

        for batch in batches:
            for p, u, h, r in zip(*batch.columns, strict=True):
                new = record(p.as_py(), u.as_py(), h.as_py().encode("utf-8", "replace"), r.as_py())
                if held and size + len(new) > archive_bytes:
                    yield close()
                    made, held, size = made + 1, [], 0
                held.append(new)
                size += len(new)
        if held:
            yield close()

    return with_references(pages, **options).mapInArrow(run, ARCHIVES)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives (name, content); see RECORDS, and `payload` if asked for."""
    names = [f.split()[0] for f in RECORDS.split(", ")] + ["payload"] * with_payload
    kinds = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                try:
                    for data in unpack(content.as_py()):
                        rows.append(parse(data)[: len(names)])
                except ArchiveError as e:
                    raise ArchiveError(f"{name.as_py()}, record {len(rows)}: {e}") from e
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    return archives.select("name", "content").mapInArrow(run, RECORDS + ", payload binary" * with_payload)


def save_files(archives: DataFrame, folder: str) -> None:
    """Write the archives as files of a folder that all executors mount; a repeated task replaces its own files."""

    def save(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            with open(part := f"{folder}/.{row.name}.{uuid.uuid4().hex}", "wb") as f:
                f.write(row.content)
            os.replace(part, f"{folder}/{row.name}")

    archives.foreachPartition(save)


def load_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def checked_revisits(records: DataFrame) -> DataFrame:
    """records, where each revisit that names another record must find one of that id and its payload digest; fails otherwise."""
    full = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), "payload_digest", F.col("payload_bytes").alias("full_bytes")).distinct()
    revisits = records.where("record_type = 'revisit'").join(full, ["refers_to_id", "payload_digest"], "left")
    lost = F.col("full_bytes").isNull() & F.col("refers_to_id").isNotNull() & F.col("payload_digest").isNotNull()
    fault = F.raise_error(F.concat(F.lit("no response with the payload of the revisit "), "record_id")).cast("long")
    length = F.when(lost, fault).otherwise(F.coalesce("full_bytes", "payload_bytes"))
    return records.where("record_type <> 'revisit'").unionByName(revisits.withColumn("payload_bytes", length).select(*records.columns))


def page_records(records: DataFrame) -> DataFrame:
    """The records that write_archives made of pages, with page_id and refers_to as numbers."""
    number = lambda c: F.regexp_extract(c, _PAGE, 1).try_cast("long")
    return records.where(F.rlike("record_id", F.lit(_PAGE))).withColumns({"page_id": number("record_id"), "refers_to": number("refers_to_id")})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(write_archives(table(spark, sf_dir, "pages")), "archives")
    records = stored(read_archives(archives, with_payload=False), "records")
    return page_records(checked_revisits(records)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html AND p.n >= 1000
"""
