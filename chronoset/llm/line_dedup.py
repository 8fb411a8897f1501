"""Line dedup with DataFrame functions alone.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, with A-Z lower-cased. Keys are kept as two 64-bit hashes with the
number of documents that hold them, in sorted runs: tables bucketed and sorted by the hashes, so that they are joined and merged
bucket by bucket without a shuffle. Documents come in batches:
1. Each batch counts its keys, merge-anti-joins them with the keys that a run already holds often enough, and adds the others as a
   run of level 0.
2. Once a level holds two runs they are merged (by a full sort-merge join) into one of the next level.
3. When all batches are in, the runs that are left are merged, and lines whose keys they hold often enough leave their documents.

A document is an id: rows that share one count once, and those with a null id are one document. A batch holds the documents whose
hashed ids lie in one range, so that batches add up. With `keep_one`, such a line stays in one document, that with the smallest
hashed id: then a text that many have copied line by line is not lost with all its copies. The ranges come in order, so the run that
first holds a key names that document.

Defined results: null text is an empty line; empty keys are never dropped; an empty table gives an empty one; repeated rows are
each cleaned; `_kept`, `_n_lines` and `_n_dropped` take the place of columns of these names, and all other columns stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, remove, stored, table, text_of

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, BATCHES = 10, 4
#: Frequent keys, 16 bytes each, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
HASHES = ["h1", "h2"]


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(STRIPPED))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, columns: list[Column], text: str) -> DataFrame:
    """columns with `at` (the line's place) and its key's hashes h1 and h2; lines of empty keys are left out."""
    # lines are exploded before they are hashed, as functions over arrays are not compiled; the key is reckoned once, after the filter
    lines = docs.select(*columns, F.posexplode(_lines(text_of(text))).alias("at", "line")).where(F.btrim("line", F.lit(STRIPPED)) != "")
    key = line_key(F.col("line"))
    return lines.select("*", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")).drop("line")


class LineRuns:
    """Levelled sorted runs below one folder. The manifest, a few table names a level, is held by the driver; close() removes all."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS):
        self.spark, self.path, self.min_docs = spark, path or new_path(spark, "line-runs"), min_docs
        self.levels: list[list[str]] = [[]]
        self.made: list[str] = []
        # as many buckets as a shuffle has partitions: each task writes its own
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, counted: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        counted.write.format("parquet").bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", f"{self.path}/level{level}-{len(self.made)}").saveAsTable(name)
        self.made.append(name)
        self.levels[level].append(name)

    def add(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> None:
        """The batch's own run: for each key that is not yet known as frequent, the number of its documents."""
        held = hashed_lines(docs, [F.xxhash64(F.col(key)).alias("doc")], text).select("doc", *HASHES).distinct()
        counted = held.groupBy(*HASHES).agg(F.count("*").alias("n_docs"), F.min("doc").alias("first"))
        for run in self.runs():
            counted = counted.join(self._often(run).select(*HASHES).hint("merge"), HASHES, "left_anti")
        self._write(counted, 0)
        for level in range(len(self.levels)):
            if len(self.levels[level]) == 2:
                self._merge(level)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _often(self, run: str) -> DataFrame:
        return self.spark.table(run).where(F.col("n_docs") >= self.min_docs)

    def _merge(self, level: int) -> None:
        """The two runs of a level into one of the next. A join, as Spark may drop the buckets of tables that it unites."""
        a, b = (self.spark.table(name) for name in self.levels[level])
        n = F.coalesce(a.n_docs, F.lit(0)) + F.coalesce(b.n_docs, F.lit(0))
        merged = a.join(b.hint("merge"), HASHES, "full").select(*HASHES, n.alias("n_docs"), F.least(a["first"], b["first"]).alias("first"))
        self.levels[level] = []
        self._write(merged, level + 1)

    def frequent(self) -> DataFrame:
        """(h1, h2, n_docs, first) of keys that at least min_docs documents hold; n_docs may be short of what was not added any more."""
        while len(self.runs()) > 1:
            low = [k for k, level in enumerate(self.levels) if level]
            if len(self.levels[low[0]]) == 1:  # a lone run of a low level goes up to the next
                self.levels[low[1]] += self.levels[low[0]]
                self.levels[low[0]] = []
                self._merge(low[1])
            else:
                self._merge(low[0])
        return self._often(self.runs()[0]) if self.runs() else self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, first long")

    def close(self) -> None:
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.path)


def drop_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", key: str = "doc_id", keep_one: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with `_kept` (the text without the frequent lines), `_n_lines` and `_n_dropped`.

    Lines leave a document only as (two hashes of the row, place). The frequent keys are broadcast when they number at most
    broadcast_rows; otherwise both sides are shuffled, where Spark splits skewed hashes.
    """
    docs = docs.drop(*(c for c in ("_kept", "_n_lines", "_n_dropped") if c not in (text, key)))
    row = [F.xxhash64(F.col(key), text_of(text)).alias("r1"), F.xxhash64(F.lit("row"), text_of(text), F.col(key)).alias("r2")]
    keys = frequent.select(*HASHES, *["first"] * keep_one)
    if keys.limit(broadcast_rows + 1).count() <= broadcast_rows:
        keys = F.broadcast(keys)
    lines = hashed_lines(docs, [*row, *[F.xxhash64(F.col(key)).alias("doc")] * keep_one], text)
    hits = (lines.join(keys, HASHES).where("doc <> first") if keep_one else lines.join(keys, HASHES, "left_semi")).groupBy("r1", "r2").agg(F.collect_set("at").alias("drop"))
    found = docs.select(F.struct("*").alias("row"), *row).join(hits, ["r1", "r2"], "left").select("row", "drop", F.coalesce(F.col("row").getField(text), F.lit("")).alias("body"))
    found = found.withColumn("lines", _lines(F.col("body")))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop"), lambda i: F.get("lines", i)), "\n")
    return found.select("row.*", F.when(F.col("drop").isNull(), F.col("body")).otherwise(kept).alias("_kept"), F.size("lines").cast("long").alias("_n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("_n_dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, keep_one: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Add docs to the runs batch by batch, then drop each line that at least min_docs documents hold. See drop_lines for the columns."""
    runs = LineRuns(docs.sparkSession, min_docs=min_docs)
    place = F.least(F.floor((F.xxhash64(F.col(key)) / float(1 << 64) + 0.5) * batches), F.lit(batches - 1))
    for k in range(batches):
        runs.add(docs.where(place == k), text, key)
    frequent = stored(runs.frequent(), "frequent-lines")
    runs.close()
    return drop_lines(docs, frequent, text, key, keep_one)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k GROUP BY doc_id
"""
