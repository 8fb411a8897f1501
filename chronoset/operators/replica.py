"""The replicated set: rows keyed by (entity, dot). Merging is union; a dot that is there is never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY
from ..sources.layout import dot_hex
from .ordered import moving_average, rank_in_key, running_max

#: Dots of a node that share a leaf of the root's tree, and children of an inner node.
LEAF, FAN = 1024, 1024
ZERO_ROOT = "0" * 64


def dedupe(delta: DataFrame) -> DataFrame:
    """One row per key: of twins the one with the least content, so that the choice does not depend on arrival."""
    content = [c for c in sorted(delta.columns) if c not in KEY]
    w = Window.partitionBy(*KEY).orderBy(*KEY, *content)
    return delta.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def join(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state with the delta's new dots; rows that it has already stay as they are."""
    fresh = dedupe(delta).join(state.select(*KEY), list(KEY), "left_anti")
    return state.unionByName(fresh.select(*state.columns))


def join_stats(state: DataFrame, delta: DataFrame) -> DataFrame:
    """One row: rows of the delta, inserted and skipped."""
    known = state.select(*KEY, F.lit(1).alias("_known"))
    per_key = delta.groupBy(*KEY).agg(F.count("*").alias("n")).join(known, list(KEY), "left")
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("received"),
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(F.col("_known").isNull())).alias("skipped"),
    )


def difference(local: DataFrame, remote: DataFrame) -> DataFrame:
    """What the remote lacks: the exact delta."""
    return local.join(remote.select(*KEY), list(KEY), "left_anti")


def tree_root(state: DataFrame, keys: tuple[str, ...] = (), leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """One row (root, n), or one for each of `keys`: a hash tree over the distinct dots, equal for equal sets of dots.

    A leaf is SHA-256 over the sorted dots (24 bytes each) of one node whose counters share a range of `leaf`; an inner node
    is SHA-256 over its children's digests in order. So no task sees more than `fan` of them, which one hash over all
    dots would not allow. The empty set has the root of zero bytes.
    """
    dots = state.select(*keys, "dot_node_id", "dot_counter").distinct()
    level = dots.groupBy(*keys, "dot_node_id", F.expr(f"dot_counter div {leaf}").alias("at")).agg(F.sort_array(F.collect_list(dot_hex())).alias("d"), F.count("*").alias("n"))
    level = level.select(*keys, "dot_node_id", "at", F.sha2(F.unhex(F.array_join("d", "")), 256).alias("digest"), "n")
    for _ in range(-(-60 // (fan.bit_length() - 1))):  # counters are below 2^60
        level = level.groupBy(*keys, "dot_node_id", F.expr(f"at div {fan}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("d"), F.sum("n").alias("n"))
        level = level.select(*keys, "dot_node_id", "at", F.sha2(F.unhex(F.array_join("d.digest", "")), 256).alias("digest"), "n")
    # nodes are few (one per replica)
    top = level.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dot_node_id", "digest"))).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return top.select(*keys, F.when(F.size("d") == 0, ZERO_ROOT).otherwise(F.sha2(F.unhex(F.array_join("d.digest", "")), 256)).alias("root"), "n")


def flat_root(dots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root): SHA-256 over the key's sorted 24-byte dots, as other replicas reckon it. One hash over all dots of a key can't be
    split, so this is for comparing small sets; tree_root is for all others."""
    grouped = dots.select(*keys, "dot_node_id", "dot_counter").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list(dot_hex())).alias("d"))
    return grouped.select(*keys, F.sha2(F.unhex(F.array_join("d", "")), 256).alias("root"))


def _be(value: Column | str) -> Column:
    return F.lpad(F.hex(F.col(value) if isinstance(value, str) else value), 16, "0")


def entry_hex() -> Column:
    """The 120 bytes of an entry as hex: digest, origin, dot, then the times and the cell, big-endian."""
    return F.upper(F.concat("payload_digest", "origin_node_id", "dot_node_id", _be("dot_counter"), _be("system_time_ns"), _be("valid_time_start_ns"), _be("valid_time_end_ns"), _be("assertion_time_ns")))


def row_fingerprint(domain: str = "chronoset/state/v1") -> Column:
    """SHA-256 over domain, entity, a zero byte and the entry."""
    return F.sha2(F.concat(F.lit(domain).cast("binary"), F.col("entity_id").cast("binary"), F.unhex(F.lit("00")), F.unhex(entry_hex())), 256)


def state_fingerprint(state: DataFrame) -> DataFrame:
    """One row (fingerprint, n): covers ids and contents, whatever the order of rows.

    Row digests are grouped by their first bytes and combined in two levels, so that each task hashes a bounded share.
    """
    rows = state.select(row_fingerprint().alias("d"))
    for width in (6, 4, 2, 0):
        key = F.substring("d", 1, width) if width == 6 else F.substring("k", 1, width)
        rows = rows.select(key.alias("k"), "d") if width == 6 else rows.select(key.alias("k"), F.concat("k", "d").alias("d"), "n")
        n = F.count("*") if width == 6 else F.sum("n")
        rows = rows.groupBy("k").agg(F.sort_array(F.collect_list("d")).alias("d"), n.alias("n")).select("k", F.sha2(F.array_join("d", ""), 256).alias("d"), "n")
    return rows.select(F.col("d").alias("fingerprint"), "n")


def flat_fingerprint(state: DataFrame, keys: tuple[str, ...] = (), domain: str = "chronoset/state/v1") -> DataFrame:
    """(keys, fingerprint): SHA-256 over the sorted row digests, as other replicas reckon it. One hash over all rows can't be split, so this
    is for comparing small states; state_fingerprint is for all others."""
    rows = state.select(*keys, row_fingerprint(domain).alias("d")).groupBy(*keys).agg(F.sort_array(F.collect_list("d")).alias("d"))
    return rows.select(*keys, F.sha2(F.unhex(F.array_join("d", "")), 256).alias("fingerprint"))


def capture(state: DataFrame, node: str) -> DataFrame:
    """One row: rows, distinct entities, largest counter, and largest counter of the node."""
    return state.agg(F.count("*").alias("n_rows"), F.count_distinct("entity_id").alias("n_entities"), F.coalesce(F.max("dot_counter"), F.lit(0)).alias("lamport_high"), F.coalesce(F.max(F.when(F.col("dot_node_id") == node, F.col("dot_counter"))), F.lit(0)).alias("own_high"))


def assign_dots(inserts: DataFrame, node: str, lamport_high: int, order: list[str]) -> DataFrame:
    """inserts with the node's next dots in the given order."""
    return rank_in_key(inserts, [], order, "_n").withColumns({"dot_node_id": F.lit(node), "origin_node_id": F.lit(node), "dot_counter": F.col("_n") + lamport_high}).drop("_n")


def lamport_clock(log: DataFrame, order: list[str], counter: str = "dot_counter") -> DataFrame:
    """log with `lamport`, the clock after each row, and `jump`, by how much the row advanced it."""
    before = running_max(log, [], order, F.col(counter), "_before", inclusive=False)
    clock = F.coalesce("_before", F.lit(0))
    return before.withColumn("lamport", F.greatest(clock, F.col(counter))).withColumn("jump", F.greatest(F.col(counter) - clock, F.lit(0))).drop("_before")


def inbound_rate(clocked: DataFrame, order: list[str]) -> DataFrame:
    """The rows that advanced the clock, with `rate`: 0.9 of the rate before and 0.1 of the jump."""
    return moving_average(clocked.where("jump > 0"), [], order, F.col("jump"), 0.9, "rate")


def upsert(rows: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with `columns` taken from the update of the same keys, and the updates of new keys; one update a key, the largest."""
    one = updates.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_u"))
    joined = rows.join(one, keys, "full")
    return joined.select(*keys, *(F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) for c in columns), *(c for c in rows.columns if c not in [*keys, *columns]))
