"""Gates of incoming facts: integrity, rate, clock and skew, and the verdict of the first that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import moving_average, ranged

BUDGET = 1 << 20
CLOCK_CAP_US = 2000
SKEW_SECONDS, SKEW_SLACK = 60, 1000
MAX_LONG = (1 << 63) - 1
ACCEPT, MALFORMED, RATE, CLOCK, DEPTH, VERIFY, DIRECTORY = "accept", "drop_malformed", "drop_rate", "drop_clock", "drop_depth", "drop_verify", "drop_unknown_origin"


def error_kind() -> Column:
    """What is wrong with a fact, null if nothing is."""
    return (
        F.when(F.coalesce(F.length("origin_node_id"), F.lit(0)) != 32, "bad_origin")
        .when(F.coalesce(F.length("dot_node_id"), F.lit(0)) != 32, "bad_dot")
        .when(F.col("dot_node_id") != F.col("origin_node_id"), "origin_mismatch")
        .when(F.coalesce(F.col("dot_counter"), F.lit(0)) <= 0, "zero_dot")
        .when(F.col("payload").isNotNull() & (F.sha2(F.col("payload"), 256) != F.col("payload_digest")), "digest_mismatch")
    )


def clock_ok(physical_us: Column, local_us: Column, cap_us: int = CLOCK_CAP_US) -> Column:
    """Not further in the future than the cap; the past is always fine."""
    return physical_us - local_us <= cap_us


def rate_ok(counter: Column, budget: int = BUDGET) -> Column:
    """Whether a peer's frame is within its budget.

    An accepted frame lowers the budget by as much as it raises the last counter, so their sum stays what it was at first: a
    frame passes if and only if its counter is below the first budget. No state is needed, whatever the order.
    """
    return counter < budget


def rate_gate(frames: DataFrame, keys: list[str], order: list[str], counter: str = "dot_counter", budget: int = BUDGET) -> DataFrame:
    """frames with `verdict` (keep or drop), `last` (the key's largest accepted counter before), `delta` (what the frame is
    beyond it) and `remaining`, the budget after it.
    """
    ok = rate_ok(F.col(counter), budget)
    rows = ranged(frames, keys, order)
    tops = rows.groupBy(*keys, "_range").agg(F.max(F.when(ok, F.col(counter))).alias("_top"))
    tops = tops.withColumn("_before", F.max("_top").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.max(F.when(ok, F.col(counter))).over(inner)).join(tops, [*keys, "_range"])
    last = F.coalesce(F.greatest("_inner", "_before"), F.lit(0))
    rows = rows.withColumn("last", last).withColumn("delta", F.greatest(F.col(counter) - F.col("last"), F.lit(0))).drop("_inner", "_before")
    verdict = F.when((F.col("delta") == 0) | ok, "keep").otherwise("drop")
    remaining = F.lit(budget) - F.when(ok, F.greatest(F.col("last"), F.col(counter))).otherwise(F.col("last"))
    return rows.withColumn("verdict", verdict).withColumn("remaining", remaining).drop("_range")


def moving_rate(gated: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The frames that have a delta, dropped ones too, with `rate`: 0.1 of the key's rate before and 0.9 of the delta."""
    return moving_average(gated.where("delta > 0"), keys, order, F.col("delta"), 0.1, "rate")


def skew_bound(lamport: Column, rate: Column, seconds: float = SKEW_SECONDS, slack: int = SKEW_SLACK) -> Column:
    """The largest counter that is believed: clock + ceil(rate * seconds) + slack, held at the largest long."""
    room = F.lit(MAX_LONG) - slack - F.greatest(lamport, F.lit(0))
    envelope = F.when(rate * seconds > 0, F.least(F.ceil(F.least(rate * seconds, F.lit(9e18))), room)).otherwise(0)
    return F.when(room <= 0, F.lit(MAX_LONG)).otherwise(lamport + F.least(envelope, room) + slack)


def verdict(parsed: Column, rate: Column, clock: Column, depth: Column, verified: Column) -> Column:
    """The first gate that fails names the verdict; nulls fail."""
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(fails(parsed), MALFORMED).when(fails(rate), RATE).when(fails(clock), CLOCK).when(fails(depth), DEPTH).when(fails(verified), VERIFY).otherwise(ACCEPT)


def batch_verdicts(frames: DataFrame, batch: list[str]) -> DataFrame:
    """A batch is applied as a whole or not at all: its size, first error kind by name, and whether it is applied."""
    return frames.groupBy(*batch).agg(F.count("*").alias("n"), F.min(error_kind()).alias("error_kind"), F.bool_and(error_kind().isNull()).alias("applied"))


def batch_gate(frames: DataFrame, batch: list[str], directory: DataFrame, signed: Column, budget: int = BUDGET) -> DataFrame:
    """(batch, verdict, n): a batch passes all gates or none of it is applied. In order: every frame parses; every origin's counters are
    within its budget; every origin is in the directory (origin_node_id); every signature holds. The first gate that fails names the
    verdict."""
    known = directory.select("origin_node_id", F.lit(True).alias("_known")).distinct()
    rows = frames.join(known, "origin_node_id", "left")
    all_ = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    found = rows.groupBy(*batch).agg(all_(error_kind().isNull()).alias("_parsed"), all_(rate_ok(F.col("dot_counter"), budget)).alias("_rate"), all_(F.col("_known")).alias("_known"), all_(signed).alias("_signed"), F.count("*").alias("n"))
    fails = lambda c: ~F.col(c)
    named = F.when(fails("_parsed"), MALFORMED).when(fails("_rate"), RATE).when(fails("_known"), DIRECTORY).when(fails("_signed"), VERIFY).otherwise(ACCEPT)
    return found.select(*batch, named.alias("verdict"), "n")


def inspect_dots(frames: DataFrame, batch: list[str]) -> DataFrame:
    """The dots that a batch would add, without applying it: each origin and counter once."""
    return frames.select(*batch, "origin_node_id", "dot_counter").distinct()


def insert_status(results: DataFrame) -> DataFrame:
    """results with the status that a caller sees: 400 for a bad request, 503 where the log was not written, else 200."""
    return results.withColumn("status", F.when(F.coalesce(F.col("key"), F.lit("")) == "", 400).when(~F.coalesce(F.col("logged"), F.lit(False)), 503).otherwise(200))
