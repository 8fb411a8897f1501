"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. One pass over the texts gives each document the digest of its set of word n-grams (its class) and the
   hashes of its MinHash bands. Documents with equal sets are one class from here on.
2. Classes are shuffled on band hashes. A bucket's smallest member is its centre; a class joins the group of
   each of its centres once, however many bands they share. All members of a bucket share its centre, so each
   pair that any band proposes meets in a group.
3. Only classes that are in a group get their full n-gram sets. Groups are cut into blocks, and pairs of
   blocks are compared as incidence matrices. A pair of blocks gives one row per member (links, weighted by
   class sizes, and a root to hang on), never one per pair; a pair counts in its first common group only.
4. Roots are joined into components by spreading smallest labels in Spark.

Defined results: words are lower-cased and free of ASCII punctuation; a text of fewer than n words has one
n-gram, all its words; a text without words (null, empty) is linked to nothing and is a class of its own.
Each row is a document, repeated rows included. class_id is the smallest doc_id of a component (rows without
words: their own doc_id), n_links the number of other documents with a similarity of at least `threshold`.
A null doc_id is carried along; a component of null ids alone has a null class_id. Only id and text are read; other columns may have
any name. The number of links is exact: a group of different near copies is compared all with all, block by block over the tasks,
so that its work grows with the square of its size, as its number of links does; no pair leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, free_name, mixed, remove, shingles, stored, table, text_of, words

N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 5
#: Classes of a group that are compared with as many others in one task.
BLOCK = 256
#: Stands for a null id where the smallest is sought.
NO_ID = (1 << 63) - 1
#: Columns of an incidence matrix that are in memory at once.
WIDE = 8192


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> tuple[int, int]:
    """(bands, rows): the fewest bands with which a pair at the threshold shares one with probability `recall`.

    Five rows keep chance meetings rare: 3e-7 a band for texts that share a twentieth of their n-grams.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64)).astype(np.uint32)
    return seed[:count] | np.uint32(1), seed[count:]


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed 64-bit hash a band, of the `rows` smallest values under as many hash functions."""
    a, b = _factors(bands * rows)
    low, least = (grams >> np.uint64(32)).astype(np.uint32), np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, (low[at : at + 2048, None] * a + b).min(axis=0))
    return np.frombuffer(b"".join(xxhash.xxh64_digest(x.tobytes(), seed=k) for k, x in enumerate(least.reshape(bands, rows))), np.int64).tolist()


def set_digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(grams.tobytes())


def signed(docs: DataFrame, text: str, key: str, n: int, bands: int, rows: int) -> DataFrame:
    """Per document: id, row1 and row2 (two hashes of id and text), node (digest of its n-grams; null without words), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            node, found = [], []
            for t in batch.column(3):
                grams = shingles(hashes.of(words(t.as_py())), n)
                node.append(set_digest(grams) if len(grams) else None)
                found.append(band_hashes(grams, bands, rows) if len(grams) else None)
            hashes.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["id", "row1", "row2", "node", "bands"])

    rows_in = docs.select(F.col(key).cast("long").alias("id"), *row_of(key, text), F.col(text).alias("text"))
    return rows_in.mapInArrow(run, "id long, row1 long, row2 long, node binary, bands array<long>")


def row_of(key: str, text: str, names: tuple[str, str] = ("row1", "row2")) -> list[Column]:
    """Two 64-bit hashes of a row's id and text."""
    return [F.xxhash64(F.col(key), text_of(text)).alias(names[0]), F.xxhash64(F.lit("row"), text_of(text), F.col(key)).alias(names[1])]


def _with_grams(rows: DataFrame, n: int) -> DataFrame:
    """rows (node, text, ...) with `grams`, the set as sorted 64-bit values; rows whose text has another digest go."""
    schema = "node binary, size long, centres array<long>, grams binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for node, size, centres, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                grams = shingles(hashes.of(words(text)), n)
                if set_digest(grams) == node:
                    for column, value in zip(out, (node, size, centres, grams.tobytes()), strict=True):
                        column.append(value)
            hashes.trim()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], ["node", "size", "centres", "grams"])

    return rows.select("node", "size", "centres", "text").mapInArrow(run, schema)


def similar(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least the threshold, from exact intersections."""
    sizes_l, sizes_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    row_l, row_r = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
    all_l, all_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(all_l, all_r)
    keep_l, keep_r = np.isin(all_l, shared), np.isin(all_r, shared)
    row_l, col_l = row_l[keep_l], np.searchsorted(shared, all_l[keep_l])
    row_r, col_r = row_r[keep_r], np.searchsorted(shared, all_r[keep_r])
    order_l, order_r = np.argsort(col_l, kind="stable"), np.argsort(col_r, kind="stable")
    row_l, col_l, row_r, col_r = row_l[order_l], col_l[order_l], row_r[order_r], col_r[order_r]
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(shared), WIDE):
        cuts = [np.searchsorted(c, (at, at + WIDE)) for c in (col_l, col_r)]
        parts = []
        for (lo, hi), rows, cols, count in ((cuts[0], row_l, col_l, len(left)), (cuts[1], row_r, col_r, len(right))):
            parts.append(m := np.zeros((count, min(WIDE, len(shared) - at)), np.float32))
            m[rows[lo:hi], cols[lo:hi] - at] = 1
        both += parts[0] @ parts[1].T
    union = sizes_l[:, None] + sizes_r[None, :] - both
    return both >= threshold * union - 1e-9


def _met_before(centre: int, left: list, right: list) -> np.ndarray:
    """Which pairs also share a smaller centre, so that they count in that group."""
    names = sorted({c for x in [*left, *right] for c in x if c < centre})
    at = {c: k for k, c in enumerate(names)}
    parts = []
    for side in (left, right):
        parts.append(m := np.zeros((len(side), max(1, len(names))), np.float32))
        for k, x in enumerate(side):
            m[k, [at[c] for c in x if c < centre]] = 1
    return parts[0] @ parts[1].T > 0


def _compare(key: tuple, frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """All pairs of two blocks of a group: a row (node, root, links) for each member that has a link."""
    centre, low, high = key
    frame = frame.drop_duplicates("node")
    nodes, sizes = frame["node"].tolist(), frame["size"].to_numpy()
    grams, centres = [np.frombuffer(x, np.uint64) for x in frame["grams"]], [list(x) for x in frame["centres"]]
    own = [np.flatnonzero((frame["block"] == b).to_numpy()) for b in (low, high)]
    links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    if len(own[0]) and len(own[1]):
        pick = lambda values, at: [values[k] for k in at]
        hit = similar(pick(grams, own[0]), pick(grams, own[1]), threshold)
        hit &= own[0][:, None] < own[1][None, :] if low == high else True
        fresh = hit & ~_met_before(centre, pick(centres, own[0]), pick(centres, own[1])) if hit.any() else hit
        links[own[0]] += fresh @ sizes[own[1]]
        links[own[1]] += fresh.T @ sizes[own[0]]
        at_l, at_r = np.nonzero(hit)
        at_l, at_r = own[0][at_l], own[1][at_r]
        while True:  # smallest labels spread until nothing changes
            least = np.minimum(root[at_l], root[at_r])
            new = root.copy()
            np.minimum.at(new, at_l, least)
            np.minimum.at(new, at_r, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
    linked = np.flatnonzero((links > 0) | (root != np.arange(len(nodes))) | np.isin(np.arange(len(nodes)), root[root != np.arange(len(nodes))]))
    return pd.DataFrame({"node": [nodes[k] for k in linked], "root": [nodes[root[k]] for k in linked], "links": links[linked]})


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of `edges` (node, root): the smallest node of each connected component."""
    both = stored(edges.select("node", "root").union(edges.select(F.col("root"), F.col("node"))).where("node <> root").distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("root")).alias("label")), "labels")
    at = labels.stored_at
    while True:
        near = both.join(labels.select(F.col("node").alias("root"), "label"), "root").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = stored(step.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("label", "far"), "label").alias("label")), "labels")
        remove(edges.sparkSession, at)
        labels, at = step.select("node", "label"), step.stored_at
        if step.where("old <> label").isEmpty():
            return labels


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Per document: id, row1 and row2 (hashes of id and text), class_id, n_links, copies (documents with the same set), has_words, keeper1
    and keeper2 (hashes of the row that stands for the class; null without words)."""
    bands, rows = bands_for(threshold, recall)
    sigs = stored(signed(docs, text, key, n, bands, rows), "signatures")
    first = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "row1", "row2")).alias("first")
    classes = sigs.where("node is not null").groupBy("node").agg(F.count("*").alias("size"), first, F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    member = classes.select("node", F.xxhash64("node").alias("name"), F.posexplode("bands").alias("band", "hash"))
    buckets = member.groupBy("band", "hash").agg(F.min("name").alias("centre"), F.count("*").alias("n")).where("n > 1").select("band", "hash", "centre")
    in_group = member.join(buckets, ["band", "hash"]).select("node", "centre").distinct()
    groups = stored(in_group, "groups")
    sizes = groups.groupBy("centre").agg(F.count("*").alias("n")).where("n > 1")
    centres = groups.groupBy("node").agg(F.sort_array(F.collect_set("centre")).alias("centres"))
    wanted = classes.select("node", "size", "first.row1", "first.row2").join(centres, "node")
    texts = docs.select(*row_of(key, text), F.col(text).alias("text"))
    sets = _with_grams(texts.join(wanted, ["row1", "row2"]), n)
    blocks = F.ceil(F.col("n") * 1.25 / block).cast("int")
    placed = sets.select("*", F.explode("centres").alias("centre")).join(sizes, "centre").withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("centre", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "size", "centres", "grams")

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _compare(key, frame, threshold)

    found = stored(placed.groupBy("centre", "low", "high").applyInPandas(compare, "node binary, root binary, links long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found)
    joined = classes.join(links, "node", "left").join(labels, "node", "left").select("node", "size", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    firsts = joined.groupBy("label").agg(F.min("first").alias("top"))
    per_class = stored(joined.join(firsts, "label").select("node", "size", "links", F.nullif("top.id", F.lit(NO_ID)).alias("class_id"), F.col("top.row1").alias("keeper1"), F.col("top.row2").alias("keeper2")), "per-class")
    out = sigs.select("id", "row1", "row2", "node").join(per_class, "node", "left")
    return out.select(
        "id",
        "row1",
        "row2",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).alias("n_links"),
        F.coalesce(F.col("size"), F.lit(1)).alias("copies"),
        F.col("node").isNotNull().alias("has_words"),
        "keeper1",
        "keeper2",
    )


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs with one document of each class: that with the smallest id, null ids last; of equal rows one. Rows without words all stay."""
    found = jaccard_join(docs, text=text, key=key, **options)
    names, has_words = (free_name("row1", docs), free_name("row2", docs)), free_name("has_words", docs)
    own = [F.when(F.col("has_words"), F.col(f"keeper{k}")).otherwise(F.col(f"row{k}")).alias(name) for k, name in enumerate(names, 1)]
    rows = docs.select("*", *row_of(key, text, names)).join(found.select(*own, F.col("has_words").alias(has_words)).distinct(), list(names))
    once = rows.where(F.col(has_words)).dropDuplicates(list(names))
    return once.unionByName(rows.where(~F.col(has_words))).select(*docs.columns)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "copies")
