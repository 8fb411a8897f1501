"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's logit is a bias plus the weights of its words and of their beginnings, and the
document's score is the noisy-or of its sentences: 1 - prod(1 - sigmoid(logit)). Weights and bias are
trained from document labels alone; the sentence scores then tell which sentences offend.

Words and beginnings are hashed to `SLOTS` weights, so none is left out; a weight is shrunk the more, the fewer training
documents have it. The model is fitted on the driver on a bounded sample of labelled rows: at most `per_label` toxic rows and
twice as many others, those with the smallest hashed ids (rows with crc32(id as text) mod 5 = 0 are never used), as far as
their texts have at most `sample_bytes` together; tasks send word hashes, not texts. Scoring is one pass over all whole texts
without a shuffle; the model, which has the weights that are not 0, goes along with the tasks.

Defined results: null or empty texts have no sentence and so score 0; labels may be missing or repeated (an id with both labels
counts as two rows); of documents that share an id, one is used for training; with no toxic or no clean training row the model
is empty and each score is near 0. `_score` and `_offending` take the place of columns of these names; all other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import split_of, table, text_of

PER_LABEL, SAMPLE_BYTES, STEPS, L2, SHRINK, RARE = 2000, 16_000_000, 150, 1e-4, 0.01, 4
SLOTS = 1 << 20
#: Tasks that hash the sample, which is bounded.
SAMPLE_TASKS = 8
#: ASCII letters, digits and all bytes of other characters stay; ends of sentences become line ends, the rest blanks.
_SENTENCES = bytes(b if b >= 128 or chr(b).isalnum() else 10 if chr(b) in ".!?\n" else 32 for b in range(256))
_END = re.compile(r"[.!?\n]")
#: The token of the end of a sentence; no text has it, as controls are blanks.
_ENDED = b"\x01"
PREFIXES = (4, 5)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, with _ENDED wherever a sentence ends."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SENTENCES).replace(b"\n", b" \x01 ").split()


def features(word: bytes) -> list[int]:
    """Places of the word and of its beginnings, so that inflected forms count together."""
    return [xxhash.xxh32_intdigest(f) % SLOTS for f in (word, *(b"^" + word[:k] for k in PREFIXES if len(word) > k))]


class _Weights(dict):
    """Word to the sum of its features' weights, remembered; not a number for the end of a sentence."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights
        self[_ENDED] = np.nan

    def __missing__(self, word: bytes) -> float:
        self[word] = w = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def trim(self, most: int = 500_000) -> None:
        if len(self) > most:
            self.clear()
            self[_ENDED] = np.nan


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -12.0

    def sentence_scores(self, text: str | None, known: _Weights) -> np.ndarray:
        """The score of each sentence that has words."""
        found = tokens(text)
        sentence, filled = _numbered(each := np.fromiter(map(known.__getitem__, found), float, len(found)))
        return _sigmoid(self.bias + np.bincount(sentence, each[filled])) if len(filled) else np.empty(0)

    def score(self, text: str | None, known: _Weights) -> tuple[float, list[dict]]:
        """The noisy-or of the sentences, and those that offend by themselves: place, first character, character after the last, score."""
        each = self.sentence_scores(text, known)
        places = np.flatnonzero(each >= 0.5).tolist()
        spans = sentence_spans(text) if places else []
        return float(-np.expm1(np.log1p(-np.minimum(each, 1 - 1e-12)).sum())), [{"place": k, "begin": spans[k][0], "end": spans[k][1], "score": float(each[k])} for k in places]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Where each sentence that has words begins and ends, its end mark included."""
    out, at = [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if tokens(text[at:end].rstrip(".!?\n")):
            out.append((at + len(text[at:end]) - len(text[at:end].lstrip()), end))
        at = end
    return out


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dense number of its sentence, place) of each token that is not the end of one."""
    ends = np.isnan(values)
    filled = np.flatnonzero(~ends)
    sentence = np.cumsum(ends)[filled]
    return (np.cumsum(np.r_[0, np.diff(sentence) != 0]) if len(filled) else sentence), filled


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(32-bit word hashes, number of words of each sentence, (hash, features) of each different word) of a text."""
    found = tokens(text)
    sentence, filled = _numbered(np.array([np.nan if w == _ENDED else 0.0 for w in found]))
    kept = [found[k] for k in filled]
    names = {w: xxhash.xxh32_intdigest(w, seed=1) for w in set(kept)}
    table = np.full((len(names), 2 + len(PREFIXES)), SLOTS, np.uint32)  # SLOTS: no feature
    for k, (w, h) in enumerate(names.items()):
        own = features(w)
        table[k, 0], table[k, 1 : 1 + len(own)] = h, own
    return np.array([names[w] for w in kept], np.uint32), np.bincount(sentence).astype(np.uint32) if kept else np.empty(0, np.uint32), table


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], tables: list[np.ndarray], steps: int = STEPS) -> Model:
    """From (word hashes, words of each sentence, label) and tables of the words' features: Adam on the likelihood of the document
    labels under noisy-or; small and few weights are preferred."""
    labels = np.array([int(y) for _, _, y in rows], float)
    if not len(rows) or labels.min() == labels.max():
        return Model()
    # of the largest array, a place per word of the sample, one 64-bit copy is kept
    of_word = np.concatenate([np.empty((0, 2 + len(PREFIXES)), np.uint32), *tables])
    names, first = np.unique(of_word[:, 0], return_index=True)
    kind = np.concatenate([np.searchsorted(names, w) for w, _, _ in rows])
    counts = np.concatenate([c for _, c, _ in rows]).astype(np.int64)
    if not len(kind):
        return Model()
    owner, starts = np.repeat(np.arange(len(rows)), [len(c) for _, c, _ in rows]), np.r_[0, np.cumsum(counts)[:-1]]
    # word -> its features; a word's weight is their sum
    of_word = of_word[first, 1:]
    pair_word = np.nonzero(of_word < SLOTS)[0]
    slots, pair_slot = np.unique(of_word[of_word < SLOTS], return_inverse=True)
    held, at = np.zeros(len(names), np.int64), 0
    for w, _, _ in rows:
        held[np.unique(kind[at : at + len(w)])] += 1
        at += len(w)
    docs = np.bincount(pair_slot, held[pair_word], len(slots))
    shrink = SHRINK * (1 + RARE / np.maximum(docs, 1))
    weight = np.full(len(labels), 1 / len(labels))
    p = np.r_[np.zeros(len(slots)), -6.0]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        word = np.bincount(pair_word, p[pair_slot], len(names))
        each = _sigmoid(p[-1] + np.add.reduceat(word[kind], starts))
        clean = np.bincount(owner, np.log1p(-np.minimum(each, 1 - 1e-9)), len(rows))  # log P(label 0)
        # d(-log likelihood)/d logit of a sentence: its score where the label is 0, -score * P0 / P1 where it is 1
        odds = np.exp(clean) / np.maximum(-np.expm1(clean), 1e-6)
        slope = weight[owner] * each * np.where(labels[owner] == 1, -odds[owner], 1.0)
        by_word = np.bincount(kind, np.repeat(slope, counts), len(names))
        g = np.r_[np.bincount(pair_slot, by_word[pair_word], len(slots)), slope.sum()] + L2 * np.r_[p[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        p[:-1] = np.sign(p[:-1]) * np.maximum(np.abs(p[:-1]) - shrink, 0)  # most words end with no weight
    return Model({int(f): float(w) for f, w in zip(slots, p, strict=False) if w}, float(p[-1]))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most per_label toxic rows and twice as many others, and sample_bytes of text; ids go first, as a bounded broadcast."""
    usable = labels.where(split_of("doc_id", 5) != 0).where("toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.col("doc_id").cast("string")).alias("hash")).distinct()
    order = ["hash", "doc_id"]
    picked = usable.where("toxic = 1").orderBy(*order).limit(per_label).union(usable.where("toxic = 0").orderBy(*order).limit(2 * per_label))
    texts = docs.select("doc_id", text_of().alias("text"), F.xxhash64("text").alias("row"))
    first = texts.join(F.broadcast(picked), "doc_id").groupBy("toxic", "hash", "doc_id").agg(F.min(F.struct("row", F.octet_length("text").alias("n"))).alias("one"))
    # a few thousand rows: the same share of either label is kept if their texts are too long together
    share = Window.partitionBy("toxic").orderBy(*order)
    kept = first.withColumn("before", F.sum("one.n").over(share)).withColumn("most", F.when(F.col("toxic") == 1, sample_bytes / 3).otherwise(sample_bytes * 2 / 3))
    kept = kept.where("before <= most").select("doc_id", "toxic", "hash", F.col("one.row").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends the features of a word once, and there are few tasks
        for batch in batches:
            bags = [bag(t.as_py()) for t in batch.column(3)]
            named = []
            for b in bags:
                named.append(b[2][np.array([h not in seen for h in b[2][:, 0].tolist()], bool)])
                seen.update(b[2][:, 0].tolist())
            packed = [[b[0].tobytes() for b in bags], [b[1].tobytes() for b in bags], [x.tobytes() for x in named]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.binary()) for x in packed)], ["doc_id", "toxic", "hash", "words", "counts", "features"])

    found = texts.join(F.broadcast(kept), ["doc_id", "row"]).select("doc_id", "toxic", "hash", "text").repartition(SAMPLE_TASKS).mapInArrow(run, "doc_id long, toxic int, hash long, words binary, counts binary, features binary")
    rows, tables = {}, []
    for r in found.collect():
        rows[r.hash, r.doc_id, r.toxic] = np.frombuffer(r.words, np.uint32), np.frombuffer(r.counts, np.uint32), r.toxic
        tables.append(np.frombuffer(r.features, np.uint32).reshape(-1, 2 + len(PREFIXES)))
    return fit([rows[k] for k in sorted(rows)], tables)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `_score` (double) and `_offending`: place, first character, character after the last and score of each sentence that
    offends by itself."""
    docs = docs.drop(*(c for c in ("_score", "_offending") if c != text))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = StructType([StructField("place", IntegerType()), StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])
    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType()), StructField("_offending", ArrayType(span))])
    at, kind = docs.columns.index(text), pa.list_(pa.struct([("place", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Weights(model.weights)
        for batch in batches:
            scores, places = zip(*(model.score(t.as_py(), known) for t in batch.column(at)), strict=True) if batch.num_rows else ((), ())
            known.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(places, kind)], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, at_least: float = 0.5, per_label: int = PER_LABEL) -> DataFrame:
    """docs without those whose score is at_least. Only doc_id and text are read for it; all columns stay."""
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    return score(packed, train(docs, labels, per_label)).where(F.col("_score") < at_least).select("row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(split_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        F.transform("_offending", lambda s: F.substr("text", s.begin + 1, s.end - s.begin)).alias("offending"),
    )
