"""Language ID by string kernels.

The blended-spectrum presence kernel of two texts is the number of character 1- to 3-grams that both hold, over the root
of the product of how many each holds. N-grams of whatever characters are hashed to `SLOTS` places; a text's presence set is the
places that its lower-cased n-grams take. Nystroem landmarks make the kernel finite: a text's features are its kernel values
with the landmarks times the inverse root of the landmarks' own kernel matrix. Kernel ridge regression in these features, one
language against the rest, gives the scores.

Each language has `landmarks` landmarks, so their number grows with the languages. As kernel, features and scores are linear in
the presence vector but for its norm, their matrices are multiplied once, when the model is made, into one of a row per place
and a column per language; a batch of texts is then scored by one product with it. Places that no landmark holds have no row.

The model is fitted on the driver on a bounded sample of labelled rows: at most `per_lang` of each language, those with the
smallest hashed ids (rows with crc32(id as text) mod 3 = 1 are never used). Tasks send presence sets, at most 4 x SLOTS bytes
each however long the text, not texts. The model goes along with the tasks; scoring is one pass over all whole texts without
a shuffle. Only text and lang of training rows enter the model.

Defined results: `und` with score 0 for a null text or one without letters; with no training rows every text is `und`; a text
with letters that shares no n-gram with any landmark gets the language of most training rows, with score 0; ties go to the
alphabetically first language. Rows of the same id are different rows; of equal rows one is used for training. `_lang` and
`_lang_score` take the place of columns of these names; all other columns stay as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import split_of, table

PER_LANG, LANDMARKS, RIDGE = 400, 32, 1e-2
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
NONE = "und"
#: Texts that are scored at once.
BATCH = 512
#: Characters of a text that are hashed at once; n-grams across the cuts are kept.
CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_FACTOR, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - SLOT_BITS)


def presence(text: str) -> np.ndarray:
    """The places of the text's n-grams, each once, in order."""
    held = np.zeros(SLOTS, bool)
    lower = text.lower()
    for at in range(0, len(lower), CHUNK):
        code = np.frombuffer(lower[at : at + CHUNK + 2].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
        gram = code
        for n in (1, 2, 3):  # 21 bits a character: the codes of all n-grams differ
            held[(gram * _FACTOR) >> _SHIFT] = True
            if n < 3:
                gram = (gram[:-1] << np.uint64(21)) | code[n:]
    return np.flatnonzero(held).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    usual: str  # the language of most training rows
    row: np.ndarray  # place -> its row in `scores`, -1 for places that no landmark holds
    scores: np.ndarray  # (row, language): what a text that holds the place gets, times the root of its number of n-grams

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [NONE] * len(texts), [0.0] * len(texts)
        some = [k for k, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        for at in range(0, len(some), BATCH):
            part = some[at : at + BATCH]
            held = [presence(texts[k]) for k in part]
            rows = [r[r >= 0] for r in (self.row[h] for h in held)]
            known = np.array([len(r) for r in rows])
            each = np.zeros((len(part), len(self.languages)))
            full = np.flatnonzero(known)
            if len(full):
                starts = np.r_[0, np.cumsum(known[full])[:-1]]
                each[full] = np.add.reduceat(self.scores[np.concatenate([rows[k] for k in full])], starts, axis=0)
            each /= np.sqrt([[max(1, len(h))] for h in held])
            best = each.argmax(axis=1)
            for j, k in enumerate(part):
                names[k], scores[k] = (self.languages[best[j]], float(np.clip(each[j, best[j]], 0, 1))) if known[j] else (self.usual, 0.0)
        return names, scores


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The kernel of each of `sets` with each of `others`, through lists of the others that hold a place."""
    owner = np.repeat(np.arange(len(others)), [len(x) for x in others])
    place = np.concatenate(others) if others else np.empty(0, np.int32)
    order = np.argsort(place, kind="stable")
    owner, bounds = owner[order], np.searchsorted(place[order], np.arange(SLOTS + 1))
    out = np.zeros((len(sets), len(others)))
    for k, x in enumerate(sets):
        low, count = bounds[x], bounds[x + 1] - bounds[x]
        hit = owner[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
        out[k] = np.bincount(hit, minlength=len(others))
    sizes = [np.sqrt([max(1, len(x)) for x in part]) for part in (sets, others)]
    return out / sizes[0][:, None] / sizes[1][None, :]


def fit(rows: list[tuple[np.ndarray, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From (presence set, language) pairs; the first rows of each language are its landmarks."""
    if not rows:
        return Model([], NONE, np.full(SLOTS, -1, np.int32), np.zeros((0, 0), np.float32))
    labels = [y for _, y in rows]
    number = Counter(labels)
    languages, seen, turn = sorted(number), Counter(), []
    for k, y in enumerate(labels):
        seen[y] += 1
        if seen[y] <= landmarks:
            turn.append(k)
    marks = [rows[k][0] for k in turn]
    values, vectors = np.linalg.eigh(overlaps(marks, marks))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = overlaps([x for x, _ in rows], marks) @ root
    target = np.array([[float(y == c) for c in languages] for y in labels])
    # each language weighs the same, however many rows it has
    share = np.array([len(rows) / len(languages) / number[y] for y in labels])
    solved = np.linalg.solve((phi * share[:, None]).T @ phi + ridge * len(rows) / 100 * np.eye(phi.shape[1]), (phi * share[:, None]).T @ target)
    weights = root @ solved
    places = np.unique(np.concatenate(marks))
    row = np.full(SLOTS, -1, np.int32)
    row[places] = np.arange(len(places))
    scores = np.zeros((len(places), len(languages)))
    for x, w in zip(marks, weights, strict=True):
        scores[row[x]] += w / np.sqrt(max(1, len(x)))
    return Model(languages, min(languages, key=lambda c: (-number[c], c)), row, scores.astype(np.float32))


def train(docs: DataFrame, per_lang: int = PER_LANG, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on at most per_lang rows of each language. Rows are ranked by ids and hashes first; only the picked rows are hashed."""
    usable = docs.where(F.coalesce(split_of(key, 3) != 1, F.lit(False))).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    name = F.col(key).cast("string")
    usable = usable.select(F.xxhash64(name).alias("hash"), F.xxhash64(F.lit("row"), name, F.col(text)).alias("row"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    picked = usable.select("hash", "row", "lang")
    for by in (["lang", F.pmod("row", F.lit(8))], ["lang"]):  # first within shares of a language, so that none is ranked by one task alone
        w = Window.partitionBy(*by).orderBy("hash", "row")
        picked = picked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_lang).drop("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [presence(t.as_py()).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(held, pa.binary())], ["hash", "row", "lang", "held"])

    found = usable.join(F.broadcast(picked.distinct()), ["hash", "row", "lang"]).select("hash", "row", "lang", "text").mapInArrow(run, "hash long, row long, lang string, held binary")
    rows = {(r.lang, r.hash, r.row): r.held for r in found.collect()}
    return fit([(np.frombuffer(rows[k], np.int32), k[0]) for k in sorted(rows)])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `_lang` and `_lang_score`."""
    docs = docs.drop(*(c for c in ("_lang", "_lang_score") if c != text))
    shared, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField("_lang", StringType()), StructField("_lang_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    held_out = F.coalesce(split_of("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.round("_lang_score", 9).alias("score"))
