"""State from an ordered log: checks, the last checkpoint, and the rebuilt state, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, MAX_COUNTER
from . import replica

MUTATION, ADVANCE, CHECKPOINT = "mutation", "clock_advance", "checkpoint"


def contiguity(log: DataFrame) -> DataFrame:
    """One row: whether seq is 0, 1, 2, ... without gap or repeat. Aggregates only, as no order is needed."""
    one = log.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("n_distinct"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    ok = (F.col("n") == 0) | ((F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n")))
    return one.select("n", "first", "last", ok.alias("contiguous"))


def lamport_high(log: DataFrame) -> DataFrame:
    """One row: the largest counter of mutations, advances and checkpoints; the clock's floor never exceeds 2^60."""
    seen = F.greatest(F.when(F.col("type") == MUTATION, F.col("dot_counter")), F.when(F.col("type") == ADVANCE, F.col("advance")), F.when(F.col("type") == CHECKPOINT, F.col("lamport_high")))
    sane = F.when(seen <= MAX_COUNTER, seen)
    return log.agg(F.coalesce(F.max(sane), F.lit(0)).alias("lamport_high"), F.count_if(seen > MAX_COUNTER).alias("n_clamped"))


def record_ok(node: str) -> Column:
    """Whether a mutation may be replayed."""
    return (F.coalesce(F.col("entity_id"), F.lit("")) != "") & (F.coalesce(F.col("dot_counter"), F.lit(0)) > 0) & F.coalesce(F.col("dot_node_id") == node, F.lit(False)) & (F.col("dot_counter") <= MAX_COUNTER)


def last_checkpoint(log: DataFrame) -> DataFrame:
    """At most one row: the last checkpoint, with cut = cut_seq or, for old records without one, seq + 1."""
    last = log.where(F.col("type") == CHECKPOINT).agg(F.max(F.struct("seq", "cut_seq", "lamport_high")).alias("c")).where("c IS NOT NULL")
    return last.select("c.seq", F.coalesce("c.cut_seq", F.col("c.seq") + 1).alias("cut"), "c.lamport_high")


def mutations(log: DataFrame, node: str) -> DataFrame:
    return log.where((F.col("type") == MUTATION) & record_ok(node))


def tail(log: DataFrame, node: str) -> DataFrame:
    """Mutations from the last checkpoint's cut on; without a checkpoint, all."""
    cut = F.broadcast(last_checkpoint(log).agg(F.coalesce(F.max("cut"), F.lit(0)).alias("_cut")))  # one row
    return mutations(log, node).join(cut, F.col("seq") >= F.col("_cut")).drop("_cut")


def phantoms(image: DataFrame, log: DataFrame, node: str) -> DataFrame:
    """The node's own rows of an image that the log does not have; with any, the image is not to be trusted."""
    return image.where(F.col("dot_node_id") == node).join(mutations(log, node).select(*KEY), list(KEY), "left_anti")


def holes(image: DataFrame, log: DataFrame, node: str) -> DataFrame:
    """Mutations below the cut that the image lacks."""
    cut = F.broadcast(last_checkpoint(log).agg(F.coalesce(F.max("cut"), F.lit(0)).alias("_cut")))  # one row
    return mutations(log, node).join(cut, F.col("seq") < F.col("_cut")).drop("_cut").join(image.select(*KEY), list(KEY), "left_anti")


def rebuild(image: DataFrame, log: DataFrame, node: str) -> DataFrame:
    """The image with the tail and the holes joined in; from the log alone if the image has phantoms."""
    columns = image.columns
    if not phantoms(image, log, node).isEmpty():
        return replica.dedupe(mutations(log, node).select(*columns))
    return replica.join(image, mutations(log, node).select(*columns))


def verify(rebuilt: DataFrame, expected_root: str) -> DataFrame:
    """One row: the rebuilt state's root, and whether it is the expected one."""
    return replica.tree_root(rebuilt).select("root", (F.col("root") == expected_root).alias("ok"))


def image_bound(checkpoint: DataFrame, root: str, cut_seq: int) -> DataFrame:
    """One row: whether an image with this root and cut is the one that the last checkpoint (merkle_root, cut_seq) names."""
    return checkpoint.agg(F.coalesce(F.bool_or((F.col("merkle_root") == root) & (F.col("cut_seq") == cut_seq)), F.lit(False)).alias("bound"))


def legacy_entries(log: DataFrame) -> DataFrame:
    """Mutations of old records, which kept digest, dot and system time alone: the other fields are 0 or the dot's node."""
    zero = F.lit(0).cast("long")
    return log.where(F.col("type") == MUTATION).select("entity_id", "dot_node_id", "dot_counter", F.col("dot_node_id").alias("origin_node_id"), "system_time_ns", *(zero.alias(c) for c in ("valid_time_start_ns", "valid_time_end_ns", "assertion_time_ns", "decision_time_ns", "h3_index")), "payload_digest")
