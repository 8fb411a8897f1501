"""Compaction, pruning under a horizon, tombstones and reaping plans."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import covering_top
from .ordered import running_max

COMPACT_AT = 64
EPOCH_LAG = 2


def dominance_prune(facts: DataFrame, horizon_ns: int, direct: bool | None = None) -> DataFrame:
    """facts without rows that a later row, known by the horizon, covers: same entity, containing interval, larger system time.

    A row goes if the latest system time among the intervals that contain its own is larger than its own; that time is found by
    running maxima (see intervals.covering_top), without pairing intervals but where these are few (or `direct` says so). A horizon of
    0 or less prunes nothing.
    """
    if horizon_ns <= 0:
        return facts
    interval = ["entity_id", "valid_time_start_ns", "valid_time_end_ns"]
    known = facts.select(*interval, F.when(F.col("system_time_ns") <= horizon_ns, F.col("system_time_ns")).alias("_known"))
    cover = covering_top(known, *interval, "_known", direct)
    return facts.join(cover, interval, "left").where(F.col("_top").isNull() | (F.col("system_time_ns") >= F.col("_top"))).drop("_top")


def effective_horizon(operator_floor_ns: int, frontier_ns: int, backoff_ns: int) -> int:
    return max(operator_floor_ns, frontier_ns - backoff_ns)


def horizon_log(proposals: DataFrame, order: list[str], horizon: str = "horizon_ns") -> DataFrame:
    """proposals with `effective`, the horizon after each, and whether the proposal was refused as a retreat."""
    out = running_max(proposals, [], order, F.col(horizon), "_before", inclusive=False)
    refused = F.coalesce(F.col(horizon) < F.col("_before"), F.lit(False))
    return out.withColumn("refused", refused).withColumn("effective", F.greatest(horizon, "_before")).drop("_before")


def compaction_candidates(files: DataFrame, at_least: int = COMPACT_AT) -> DataFrame:
    """(hash8, n) of entities with enough L0 files."""
    return files.groupBy("hash8").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def compact(facts: DataFrame, horizon_ns: int = 0, prune: bool | None = None) -> DataFrame:
    """All flushed rows of each entity as compacted rows, pruned if asked for or if a horizon is given. Rows that were not read are not in it."""
    if prune and horizon_ns <= 0:
        warnings.warn("pruning needs a horizon above 0; every row is kept", stacklevel=2)
    if prune is False:
        horizon_ns = 0
    return dominance_prune(facts, horizon_ns).withColumn("tier_rank", F.lit(0))


def compaction_manifest(files: DataFrame) -> DataFrame:
    """(l1_key, l0_key): the compacted file of each entity, named by its smallest system time, and what it replaces.

    Lists only files that were read (`readable`); each is a row, so that a manifest may be as long as it needs to.
    """
    read = files.where("readable")
    names = read.groupBy("hash8").agg(F.min("first_sys").alias("_first"))
    return read.join(names, "hash8").select(F.concat(F.lit("l1/"), "hash8", F.lit("/"), F.col("_first").cast("string"), F.lit(".arrow")).alias("l1_key"), F.col("key").alias("l0_key"))


def reap_plan(manifests: DataFrame, l1_files: DataFrame) -> DataFrame:
    """(name, action): reap what a manifest lists, if its compacted file is there and readable."""
    one = manifests.groupBy("name").agg(F.min("l1_key").alias("l1_key"), F.count("l0_key").alias("n_l0"))
    found = one.join(l1_files.select(F.col("key").alias("l1_key"), "readable"), "l1_key", "left")
    action = F.when(F.col("readable").isNull(), "skip_orphan").when(~F.col("readable"), "skip_error").otherwise("reap")
    return found.select("name", "l1_key", "n_l0", action.alias("action"))


def stable_epoch(peers: DataFrame) -> DataFrame:
    """One row: the smallest of the peers' largest epochs, 0 without peers."""
    return peers.groupBy("node_id").agg(F.max("epoch").alias("epoch")).agg(F.coalesce(F.min("epoch"), F.lit(0)).alias("stable_epoch"))


def prunable_tombstones(tombstones: DataFrame, peers: DataFrame, lag: int = EPOCH_LAG) -> DataFrame:
    """Tombstones that every peer is `lag` epochs past; none while the stable epoch is below the lag."""
    stable = F.broadcast(stable_epoch(peers))  # one row
    return tombstones.join(stable, (F.col("stable_epoch") >= lag) & (F.col("epoch") <= F.col("stable_epoch") - lag)).drop("stable_epoch")


def drop_tombstoned(facts: DataFrame, prunable: DataFrame) -> DataFrame:
    """facts without the entities of prunable tombstones: all their rows go."""
    return facts.join(prunable.select("entity_id").distinct(), "entity_id", "left_anti")


def changed_since(latest: DataFrame, flushed: DataFrame) -> DataFrame:
    """Entities whose latest dot is another than when they were last flushed."""
    key = ["entity_id", "dot_node_id", "dot_counter"]
    return latest.join(flushed.select(*key), key, "left_anti")
