"""The queries with SQL, and the pipeline's contract, on the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict
from html import unescape

import numpy as np
import pytest
import sentencepiece
import xxhash
from llm.test_encodings import plain_pairs
from oracle import SMALL, rows_of, rows_of_sql

import corpus_pipeline
from chronoset.llm import decontam, media, queries, sentence_piece, token_counts, toxicity
from chronoset.llm.common import WordHashes, shingles, words


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_with_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SMALL)) == rows_of_sql(queries.ORACLES[name])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, last = docs, None
    for name, stage in corpus_pipeline.STAGES:
        last = stage(spark, kept, SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert last.dtypes == docs.dtypes
            assert set(r.doc_id for r in last.select("doc_id").collect()) <= set(r.doc_id for r in kept.select("doc_id").collect())
            kept = last
    once, again = rows_of(last.select("doc_id", "ids_sha256")), rows_of(corpus_pipeline.run(spark, SMALL).select("doc_id", "ids_sha256"))
    assert once == again and len(once[1]) > 100


def docs_of(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())


def items_of(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]


def result(spark, name, *columns):
    found = queries.QUERIES[name](spark, SMALL)
    assert set(columns) <= set(found.columns)
    return found.select(*columns).collect()


STRIPPED = " \t\n\x0b\x0c\r"


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIPPED))


def hashed_id(doc_id):
    return int.from_bytes(xxhash.xxh64_digest(doc_id.to_bytes(8, "little"), seed=42), "big", signed=True)


def brute_lines(docs):
    """Documents without the lines whose key at least ten of them hold, but for the one of the smallest hashed id."""
    seen = defaultdict(set)
    for i, t in docs:
        for k in {line_key(x) for x in t.split("\n")} - {""}:
            seen[k].add(i)
    first = {k: min(ids, key=hashed_id) for k, ids in seen.items() if len(ids) >= 10}
    return [(i, "\n".join(x for x in t.split("\n") if first.get(line_key(x), i) == i)) for i, t in docs]


def brute_classes(docs):
    """Per id the smallest id of its component of documents with a similarity of 0.8 or more, and its number of links."""
    hashes, label = WordHashes(), {i: i for i, _ in docs}
    sets = [(i, set(shingles(hashes.of(words(t)), 5).tolist())) for i, t in docs]
    pairs = [(i, j) for a, (i, x) in enumerate(sets) for j, y in sets[:a] if x and len(x & y) >= 0.8 * len(x | y) - 1e-9]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return {i: (low, sum(i in p for p in pairs)) for i, low in label.items()}


def brute_leaks(docs, items):
    """(document, item) wherever the whole text has a local alignment of half the item's best score or more."""
    split = [(k, w) for k, w in ((k, words(t)) for k, t in items) if w]
    ids = {w: k for k, w in enumerate({w for _, x in split for w in x})}
    coded = [(k, np.array([ids[w] for w in x])) for k, x in split]
    out = set()
    for i, t in docs:
        window = np.array([ids.get(w, -1) for w in words(t)])
        out |= {(i, k) for k, x in coded if len(window) and np.isin(x, window).sum() * 2 >= len(x) and decontam.align(x, window)[0] >= decontam.THRESHOLD}
    return out


def test_pipeline_against_brute_force(spark):
    docs = docs_of(spark)
    model = toxicity.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    known = toxicity._Weights(model.weights)
    docs = [(i, t) for i, t in docs if model.score(t, known)[0] < 0.5]
    docs = brute_lines(docs)
    classes = brute_classes(docs)
    docs = [(i, t) for i, t in docs if classes[i][0] == i]
    leaks = {i for i, _ in brute_leaks(docs, items_of(spark))}
    docs = [(i, t) for i, t in docs if i not in leaks]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_piece.MODEL)
    want = sorted((i, hashlib.sha256(np.array(sp.encode(t), "<i4").tobytes()).hexdigest()) for i, t in docs)
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "ids_sha256").collect()) == want


def test_pipeline_keeps_one_of_many_copies(spark, tmp_path):
    """Twelve equal documents: their lines stay in one of them, which comes through whole; the others have no words left."""
    text = "\n".join(f"line {k} of a text that many sites have copied word by word" for k in range(30))
    rows = [(k, text, "en", "s", len(text)) for k in range(12)] + [(50, "a text of its own\nwith two lines", "en", "s", 32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_repeated_lines(spark, docs, SMALL), SMALL)
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_benchmark_leaks(spark, docs, SMALL).collect()}
    whole = min(range(12), key=hashed_id)
    assert kept[whole] == text and kept[50] == rows[-1][1] and {kept[k] for k in range(12) if k != whole} == {""}


def test_decontamination_query(spark):
    assert {tuple(r) for r in result(spark, "op1_benchmark_decontamination", "doc_id", "item_id")} == brute_leaks(docs_of(spark), items_of(spark))


def test_html_query(spark):
    html = {r.page_id: r.html or "" for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = result(spark, "op2_html_extraction", "page_id", "url", "text", "n_chars")
    assert len(got) == len(html)
    for r in got:  # these pages have one article each, of blocks alone
        inner = re.search("<article>(.*)</article>", html[r.page_id], re.S)
        want = " ".join(unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner[1])).split()) if inner else ""
        assert (r.text, r.n_chars) == (want, len(want))


def test_token_and_piece_queries(spark):
    from tokenizers import Tokenizer

    library, sp = Tokenizer.from_file(token_counts.TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=sentence_piece.MODEL)
    texts = dict(docs_of(spark))
    for r in result(spark, "op4_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit"):
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert tuple(r)[1:] == (len(texts[r.doc_id].encode()), n, n > 512)
    for r in result(spark, "op5_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "round_trip"):
        ids = sp.encode(texts[r.doc_id])
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True)


def test_model_queries(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    langs = result(spark, "op6_language_id", "doc_id", "held_out", "lang_pred", "score")
    toxic = result(spark, "op7_toxicity", "doc_id", "held_out", "score", "predicted")
    assert len(langs) == len(toxic) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in toxic)
    held = [r for r in langs if r.held_out and rows[r.doc_id].lang]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_join_query(spark):
    assert {r.doc_id: (r.class_id, r.n_links) for r in result(spark, "op9_ngram_jaccard_join", "doc_id", "class_id", "n_links")} == brute_classes(docs_of(spark))


def test_media_query(spark):
    texts = dict(docs_of(spark))
    for r in result(spark, "op10_media_columns", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"):
        payload = media.padded(texts[r.doc_id].encode())
        stored = media.to_wav(payload)
        pairs = np.array(plain_pairs(payload), "<i8")
        assert tuple(r)[1:] == (len(texts[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(pairs)}:{hashlib.sha256(pairs.tobytes()).hexdigest()[:32]}")
