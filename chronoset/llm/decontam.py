"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is taken in blocks of bounded size, each sent to all tasks and compared with all documents:
1. One pass over the documents counts, for every word n-gram of the block's items, the documents that hold it.
2. An item's seeds are its n-grams, the rarest first; of pairs (n = 2) the most frequent are spared, as many as no copy needs.
3. A second pass joins the documents' n-grams to the seeds. Where enough hits of an item lie close enough together, the text
   around all of them is aligned with the item as one window: +2 a matching word, -1 a mismatch or gap. score is the best
   alignment over the best that is possible.

What is enough follows from the score for pairs, so that nothing is lost to the filter. An alignment of at least `threshold`
t of an item of L words spans at most (3 - 2t) L words of the text; each mismatch costs 1 and parts two pairs, other breaks cost
more for each pair. So at least (4t - 1) L / 3 - 1 pairs of neighbours stay neighbours, or have one word between them in the
text, which is looked up too. Of these, half may be among the spared ones; the other half must be hit within that span. A copy
with every third word replaced, or with long insertions, so is found as a whole. For larger n one hit is enough, and copies
without n unchanged words in a row are not found.

Nothing else leaves a task: one row per (document, item) with score >= threshold, that of its best window.

Defined results: null or empty texts match nothing; items of fewer than n words are matched by one seed, all their words (in
items of three words or fewer, at least one pair must be there); items without words match nothing; each row of either side
is treated alone, repeats included. A document shorter than the item is scored against the item's full length. Only the named
columns are read; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, text_of, words

N, THRESHOLD = 2, 0.5
#: Most bytes of benchmark text that are sent to the tasks at once; a longer benchmark takes several passes.
BLOCK_BYTES = 4_000_000
MATCH, OTHER, GAP = 2, 1, 1
#: Bits of the table that tells in one look that a key is no seed.
TABLE_BITS = 18
_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def _keys(ids: np.ndarray, n: int, skip: bool) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys, places) of the n-grams whose words are all known; with skip, also of pairs with one word between."""
    found = []
    for steps in [range(n), *([(0, 2)] if skip and n == 2 else [])]:
        count = len(ids) - steps[-1]
        if count > 0:
            key, known = np.zeros(count, np.uint64), np.ones(count, bool)
            for k in steps:
                part = ids[k : k + count]
                key, known = key * _FACTOR + part.astype(np.uint64), known & (part > 0)
            places = np.flatnonzero(known)
            found.append((key[places], places))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Items:
    """A block of benchmark items as word ids (from 1; 0 is any other word)."""

    vocabulary: _Ids
    ids: list
    words: list[np.ndarray]
    n: int

    @classmethod
    def of(cls, rows: list, n: int) -> Items:
        split = [(r[0], words(r[1])) for r in rows]
        split = [(i, w) for i, w in split if w]
        vocabulary = _Ids({w: k + 1 for k, w in enumerate(sorted({w for _, x in split for w in x}))})
        return cls(vocabulary, [i for i, _ in split], [np.array([vocabulary[w] for w in x], np.int64) for _, x in split], n)

    def by_size(self) -> dict[int, list[int]]:
        """The items by the length of their n-grams: n, or all their words."""
        found: dict[int, list[int]] = {}
        for k, x in enumerate(self.words):
            found.setdefault(min(self.n, len(x)), []).append(k)
        return found

    def read(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.vocabulary.__getitem__, found), np.int64, len(found))


@dataclass
class Seeds:
    """Sorted keys of one n-gram length with their items; by item, how many hits it takes, and within how many words."""

    size: int
    keys: np.ndarray
    item: np.ndarray
    enough: np.ndarray
    reach: np.ndarray
    table: np.ndarray

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place in the text) of seed hits, each once, in order."""
        keys, places = _keys(ids, self.size, True)
        some = self.table[_slot(keys)]
        keys, places = keys[some], places[some]
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        count = high - low
        which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.unique(self.item[which] << 32 | np.repeat(places, count))
        return both >> 32, both & 0xFFFFFFFF

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first place, place after the last) of the parts of a text that may hold a copy; a copy lies in one of them whole."""
        item, place = self.hits(ids)
        if not len(item):
            return
        last = np.arange(len(item)) + self.enough[item] - 1
        inside = last < len(item)
        last = np.minimum(last, len(item) - 1)
        good = np.flatnonzero(inside & (item[last] == item) & (place[last] - place <= self.reach[item]))
        open_ = None
        for k, lo, hi in zip(item[good].tolist(), (place[last[good]] - self.reach[item[good]]).tolist(), (place[good] + self.reach[item[good]]).tolist(), strict=True):
            lo, hi = max(0, lo), min(len(ids), hi + self.size + 1)
            if open_ and open_[0] == k and lo <= open_[2]:
                open_ = (k, open_[1], max(hi, open_[2]))
            else:
                if open_:
                    yield open_
                open_ = (k, lo, hi)
        if open_:
            yield open_


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * _SPREAD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def needed(length: int, threshold: float, n: int) -> int:
    """How many n-grams of an item any copy with this score keeps at least."""
    return max(1, math.ceil((4 * threshold - 1) * length / 3 - 1e-9) - 1) if n == 2 else 1


def ranked_seeds(items: Items, counts: dict[int, int], threshold: float) -> list[Seeds]:
    """The items' seeds, from the numbers of documents that hold each key."""
    out = []
    for size, members in sorted(items.by_size().items()):
        keys, owner = [], []
        enough, reach = np.zeros(len(items.words), np.int64), np.zeros(len(items.words), np.int64)
        for k in members:
            own, _ = _keys(items.words[k], size, False)
            kept = needed(len(items.words[k]), threshold, size)
            enough[k], reach[k] = kept - kept // 2, math.ceil((3 - 2 * threshold) * len(items.words[k]))
            rare = sorted(own.tolist(), key=lambda key: (counts.get(key, 0), key))[: len(own) - kept // 2]
            keys += set(rare)
            owner += [k] * len(set(rare))
        keys, owner = np.array(keys, np.uint64), np.array(owner, np.int64)
        order = np.argsort(keys, kind="stable")
        known = np.zeros(1 << TABLE_BITS, bool)
        known[_slot(keys)] = True
        out.append(Seeds(size, keys[order], owner[order], enough, reach, known))
    return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman: best score over 2 x the item's length, and the place in the window where it ends."""
    m = len(window)
    steps = np.arange(m + 1) * GAP
    above, best, end = np.zeros(m + 1, np.int64), 0, 0
    for word in item:
        row = np.empty(m + 1, np.int64)
        row[0] = 0
        row[1:] = np.maximum(above[:-1] + np.where(window == word, MATCH, -OTHER), above[1:] - GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps  # gaps along the window
        if (top := int(row.argmax())) and row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best / (MATCH * len(item)), end


def _bound(item: np.ndarray, window: np.ndarray) -> float:
    """No alignment scores more: every word that the two have in common matched, without a gap."""
    kinds, needed = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(kinds, window), len(kinds) - 1)
    held = np.bincount(at[kinds[at] == window], minlength=len(kinds))
    return int(np.minimum(needed, held).sum()) / len(item)


def matches(items: Items, seeds: list[Seeds], ids: np.ndarray, threshold: float, cache: dict) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, last word + 1) for each item with an alignment of at least the threshold."""
    best: dict[int, tuple[float, int, int]] = {}
    for s in seeds:
        for k, start, stop in s.windows(ids):
            window = ids[start:stop]
            most = _bound(items.words[k], window)
            if most < threshold or most <= best.get(k, (0.0,))[0]:
                continue
            if (score := cache.get(name := (k, window.tobytes()))) is None:
                if len(cache) > 20_000:
                    cache.clear()
                cache[name] = score = align(items.words[k], window)
            if score[0] >= threshold and score[0] > best.get(k, (0.0,))[0]:
                best[k] = (score[0], start + max(0, score[1] - len(items.words[k])), start + score[1])
    return [(k, *v) for k, v in best.items()]


def _blocks(bench: DataFrame, item_id: str, text: str, most: int) -> Iterator[list]:
    block, held = [], 0
    for row in bench.select(item_id, text).toLocalIterator():
        block.append((row[0], row[1]))
        held += len((row[1] or "").encode("utf-8", "replace"))
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def _count(docs: DataFrame, items: Items, text: str) -> dict[int, int]:
    """In how many documents each n-gram of the block is: counted in the tasks, summed in Spark; at most one row per n-gram."""
    known = {size: np.unique(np.concatenate([_keys(items.words[k], size, False)[0] for k in members])) for size, members in items.by_size().items()}
    shared = docs.sparkSession.sparkContext.broadcast((items, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = shared.value
        totals = {s: np.zeros(len(k), np.int64) for s, k in known.items()}
        for batch in batches:
            for t in batch.column(0):
                ids = items.read(t.as_py())
                for s, keys in known.items():
                    grams, _ = _keys(ids, s, False)
                    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    totals[s][np.unique(at[keys[at] == grams])] += 1
        for s, keys in known.items():
            some = totals[s] > 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(totals[s][some])], ["gram", "n"])

    counted = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r[0] % (1 << 64): r[1] for r in counted.collect()}


def find_leaks(docs: DataFrame, bench: DataFrame, n: int = N, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_key, row1, row2, item_key, score, first_word, last_word) of every leaked item in every document.

    row1 and row2 are two hashes of the document's text, by which rows of docs can be found again.
    """
    if n < 2:
        raise ValueError("seeds have two words or more")
    schema = "doc_key long, row1 long, row2 long, item_key long, score double, first_word int, last_word int"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
    out = None
    for rows in _blocks(bench, item_key, item_text, block_bytes):
        items = Items.of(rows, n)
        if not items.words:
            continue
        seeds = ranked_seeds(items, _count(docs, items, text), threshold)
        shared = docs.sparkSession.sparkContext.broadcast((items, seeds))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (items, seeds), cache = shared.value, {}
            for batch in batches:
                found = []
                for row in zip(*batch.columns, strict=True):
                    if hits := matches(items, seeds, items.read(row[3].as_py()), threshold, cache):
                        found += [(*(x.as_py() for x in row[:3]), items.ids[m[0]], *m[1:]) for m in hits]
                columns = list(zip(*found, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        part = docs.select(F.col(key).cast("long"), *row_of(text), F.col(text)).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def row_of(text: str = "text", names: tuple[str, str] = ("row1", "row2")) -> list[Column]:
    """Two 64-bit hashes of a text; what is found depends on nothing else."""
    return [F.xxhash64(text_of(text)).alias(names[0]), F.xxhash64(F.lit("row"), text_of(text)).alias(names[1])]


def drop_leaks(docs: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without those that hold a leaked item."""
    names = free_name("row1", docs), free_name("row2", docs)
    leaked = find_leaks(docs, bench, text=text, **options).select(F.col("row1").alias(names[0]), F.col("row2").alias(names[1])).distinct()
    return docs.select("*", *row_of(text, names)).join(leaked, list(names), "left_anti").select(*docs.columns)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_key").alias("doc_id"), F.col("item_key").alias("item_id"), F.round("score", 6).alias("score"), "first_word", "last_word")
