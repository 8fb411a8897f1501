"""Set-difference sketches: invertible Bloom lookup tables and strata estimators, built as aggregations.

Keys are 64-bit hashes of a dot and its payload digest. Cells are (count, xor of keys, xor of check hashes). Tables have a
bounded number of cells, and one is peeled by one task; a larger difference takes more tables, which are peeled side by side.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.text import xxh64_of_long
from ..sources.shared import stored

CELLS, HASHES = 1024, 4
STRATA, STRATUM_CELLS, STRATUM_HASHES = 32, 80, 3
MAX_CELLS = 699_050
#: Cells of each of the tables to which keys are dealt.
SHARD_CELLS = 16_384


@F.pandas_udf(LongType())
def hash_dot(node: pd.Series, counter: pd.Series, digest: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, over node, little-endian counter and payload digest; a batch's rows side by side."""
    if not len(node):
        return pd.Series([], dtype="int64")
    heads = np.frombuffer(bytes.fromhex("".join(node)), np.uint8).reshape(len(node), 16)
    counts = counter.to_numpy(np.int64).astype("<u8").view(np.uint8).reshape(-1, 8)
    tails = np.frombuffer(bytes.fromhex("".join(digest)), np.uint8).reshape(len(node), -1)
    h = np.full(len(node), 0xCBF29CE484222325, np.uint64)
    for byte in np.concatenate([heads, counts, tails], axis=1).T:
        h = (h ^ byte.astype(np.uint64)) * np.uint64(0x100000001B3)
    return pd.Series(h.view(np.int64))


def _check(key: Column) -> Column:
    return F.xxhash64(key)


def _cells(key: Column, hashes: int, cells: int) -> Column:
    """The key's cells (h1 + i * h2) mod cells for i below `hashes`, from one hash h: h1 = h, h2 = (h >> 32) | 1, all unsigned.

    Both are taken modulo first, so that nothing overflows.
    """
    unsigned = lambda h: F.pmod(F.pmod(h, F.lit(cells)) + F.when(h < 0, F.lit((1 << 64) % cells)).otherwise(0), F.lit(cells))
    h = F.xxhash64(key)
    first, step = unsigned(h), F.pmod(F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long")), F.lit(cells))
    return F.array(*(((first + k * step) % cells).cast("int") for k in range(hashes)))


def iblt(keys: DataFrame, cells: int = CELLS, hashes: int = HASHES, by: list[str] | None = None) -> DataFrame:
    """keys (key) -> ([by,] cell, n, key_xor, hash_xor). Combined in each task before the shuffle."""
    if cells > MAX_CELLS:
        raise ValueError("the table is too large")
    by = by or []
    rows = keys.select(*by, "key", F.explode(_cells(F.col("key"), hashes, cells)).alias("cell"))
    return rows.groupBy(*by, "cell").agg(F.count("*").alias("n"), F.bit_xor("key").alias("key_xor"), F.bit_xor(_check(F.col("key"))).alias("hash_xor"))


def subtract(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    r = right.select(*by, "cell", F.col("n").alias("_n"), F.col("key_xor").alias("_k"), F.col("hash_xor").alias("_h"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return left.join(r, [*by, "cell"], "full").select(*by, "cell", (zero("n") - zero("_n")).alias("n"), zero("key_xor").bitwiseXOR(zero("_k")).alias("key_xor"), zero("hash_xor").bitwiseXOR(zero("_h")).alias("hash_xor"))


def _peeled(cell: np.ndarray, n: np.ndarray, key: np.ndarray, check: np.ndarray, cells: int, hashes: int) -> tuple[np.ndarray, ...]:
    """(keys, sides, and the whole table's n, key_xor, hash_xor after peeling) of one subtracted table."""
    table = [np.zeros(cells, np.int64) for _ in range(3)]
    for own, values in zip(table, (n, key, check), strict=True):
        own[cell] = values
    n, key, check = table
    keys, sides = np.empty(0, np.int64), np.empty(0, np.int64)
    while True:
        alone = np.flatnonzero(np.abs(n) == 1)
        alone = alone[xxh64_of_long(key[alone]).view(np.int64) == check[alone]]
        fresh, first = np.unique(key[alone], return_index=True)
        side = n[alone][first]
        new = ~np.isin(fresh, keys)
        fresh, side = fresh[new], side[new]
        if not len(fresh):
            return keys, sides, n, key, check
        keys, sides = np.r_[keys, fresh], np.r_[sides, side]
        h = xxh64_of_long(fresh)
        step = ((h >> np.uint64(32)) | np.uint64(1)) % np.uint64(cells)
        for k in range(hashes):
            at = ((h % np.uint64(cells) + np.uint64(k) * step) % np.uint64(cells)).astype(np.int64)
            np.subtract.at(n, at, side)
            np.bitwise_xor.at(key, at, fresh)
            np.bitwise_xor.at(check, at, h.view(np.int64))


def peel(difference: DataFrame, cells: int = CELLS, hashes: int = HASHES, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """([by,] key, side) of a subtracted table, side 1 for keys of the left alone and -1 for the right, and the cells that are left.

    A table has at most MAX_CELLS cells, so each of them is peeled whole by one task: cells of one key give it up, and it is taken out of
    its other cells, as long as there is one. No cell is left if all came out.
    """
    by = by or []
    schema = ", ".join([*(f"{c} {difference.schema[c].dataType.simpleString()}" for c in by), "cell int, n long, key_xor long, hash_xor long"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, sides, *rest = _peeled(*(frame[c].to_numpy(np.int64) for c in ("cell", "n", "key_xor", "hash_xor")), cells, hashes)
        left = np.flatnonzero((rest[0] != 0) | (rest[1] != 0) | (rest[2] != 0))
        columns = {"cell": np.r_[np.full(len(keys), -1), left], "n": np.r_[sides, rest[0][left]], "key_xor": np.r_[keys, rest[1][left]], "hash_xor": np.r_[np.zeros(len(keys), np.int64), rest[2][left]]}
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * (len(keys) + len(left)) for c in by}, **columns})

    done = stored(difference.groupBy(*by).applyInPandas(run, schema), "peeled")
    return done.where("cell < 0").select(*by, F.col("key_xor").alias("key"), F.col("n").alias("side")), done.where("cell >= 0")


def stratum(key: Column) -> Column:
    """Number of trailing zero bits, at most 31."""
    low = key.bitwiseAND(F.lit((1 << 31) - 1))
    return F.when(low == 0, 31).otherwise(F.bit_count(low.bitwiseXOR(low - 1)) - 1).cast("int")


def strata(keys: DataFrame) -> DataFrame:
    return iblt(keys.withColumn("stratum", stratum(F.col("key"))), STRATUM_CELLS, STRATUM_HASHES, ["stratum"])


def estimate(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: about how many keys are in one of the sets alone.

    All strata are peeled at once. From the sparsest down, whole strata count what came out; the first that did not come out
    whole stands for itself and all below: what was found so far, times two to the power of its number plus one.
    """
    found, rest = peel(subtract(left, right, ["stratum"]), STRATUM_CELLS, STRATUM_HASHES, by=["stratum"])
    broken = rest.agg(F.coalesce(F.max("stratum"), F.lit(-1)).alias("broken"))
    counted = found.join(F.broadcast(broken), F.col("stratum") >= F.col("broken")).groupBy("broken").agg(F.count("*").alias("n"))
    counted = broken.join(counted, "broken", "left")
    return counted.select((F.coalesce("n", F.lit(0)) * F.pow(F.lit(2), F.col("broken") + 1)).cast("long").alias("difference"))


def table_size(difference: int) -> int:
    """Cells for an expected difference."""
    return max(128, difference * 3 // 2)


def shards_for(difference: int, cells: int = SHARD_CELLS) -> int:
    """How many tables an expected difference takes, with three cells a key."""
    return max(1, -(-3 * difference // cells))


def difference(left: DataFrame, right: DataFrame, cells: int = SHARD_CELLS, hashes: int = HASHES, shards: int | None = None) -> DataFrame:
    """(key, side) of two sets of keys, whole: side 1 for keys of the left alone and -1 for those of the right.

    Keys are dealt by hash to tables of one size, as many as the strata estimate asks for, and all tables are peeled at once.
    Keys of a table that does not peel whole are compared themselves.
    """
    n = shards_for(estimate(strata(left), strata(right)).first()[0], cells) if shards is None else shards
    dealt = lambda keys: keys.select("key", F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(n)).cast("int").alias("shard"))
    left, right, by = dealt(left), dealt(right), ["shard"]
    found, rest = peel(subtract(iblt(left, cells, hashes, by), iblt(right, cells, hashes, by), by), cells, hashes, by=by)
    broken = stored(rest.select("shard").distinct(), "broken")
    if broken.isEmpty():
        return found.select("key", "side")
    left, right = left.join(broken, "shard", "left_semi").select("key"), right.join(broken, "shard", "left_semi").select("key")
    alone = lambda a, b, side: a.join(b, "key", "left_anti").select("key", F.lit(side).cast("long").alias("side"))
    return found.join(broken, "shard", "left_anti").select("key", "side").unionByName(alone(left, right, 1)).unionByName(alone(right, left, -1))


def delta_by_sketch(local: DataFrame, remote: DataFrame, cells: int = SHARD_CELLS, hashes: int = HASHES, shards: int | None = None) -> DataFrame:
    """Rows of local that remote lacks, both with dots and digests.

    Only tables and peeled keys are exchanged, and the keys of tables that don't peel whole; the rows are found by a semi-join
    on their hashed dots.
    """
    keyed = local.withColumn("_key", hash_dot("dot_node_id", "dot_counter", "payload_digest"))
    other = remote.select(hash_dot("dot_node_id", "dot_counter", "payload_digest").alias("key"))
    found = difference(keyed.select(F.col("_key").alias("key")), other, cells, hashes, shards)
    return keyed.join(found.where("side = 1").select(F.col("key").alias("_key")), "_key", "left_semi").drop("_key")
