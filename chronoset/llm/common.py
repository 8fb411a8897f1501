"""What several operators share: the shared folder, tables that cut lineage, words, hashes."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cased UTF-8 bytes to the same bytes with ASCII punctuation, white space and controls as blanks.
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: The temporary folder of a local session without spark.checkpoint.dir, as in tests.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Only a session whose executors are the driver itself may do without:
    it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="chronoset-"))
        found = _OWN[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronoset/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and survives lost executors. `stored_at` of the result is its
    path; what no one removes stays until sweep()."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession, older_than_hours: float = 48) -> list[str]:
    """Remove the intermediate tables of this library that were written so long ago that no query reads them; returns their paths.

    Results are read lazily from intermediate tables, so a query can't remove its own; run this between jobs. The digest cache of
    token counts, which is meant to stay, is left alone.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/chronoset")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath().toString() for f in (fs.listStatus(at) if fs.exists(at) else ()) if f.getModificationTime() <= (time.time() - older_than_hours * 3600) * 1000]
    old = [p for p in old if re.search(r"-[0-9a-f]{32}$", p)]
    for path in old:
        remove(spark, path)
    return old


def free_name(name: str, *frames: DataFrame) -> str:
    """`name` with as many underscores before it as it takes to be no column's, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def split_of(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % parts


def words(text: str | None) -> list[bytes]:
    """Lower-cased maximal runs without ASCII punctuation, white space and controls, as UTF-8."""
    return (text or "").lower().encode("utf-8", "replace").translate(_BLANK).split()


class WordHashes(dict):
    """64-bit hash of each word, remembered; call trim() now and then, so that it stays bounded."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))

    def trim(self, most: int = 500_000) -> None:
        if len(self) > most:
            self.clear()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of n words; of fewer words, of the whole; of none, empty."""
    if not len(word_hashes):
        return np.empty(0, np.uint64)
    n = min(n, len(word_hashes))
    h = np.full(len(word_hashes) - n + 1, n, np.uint64)
    for k in range(n):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : len(word_hashes) - n + 1 + k])
    return np.unique(h)
