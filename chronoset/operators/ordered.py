"""Ranks and running values over long orders without bringing a key's rows to one task.

Rows are dealt by ranges of (keys, order), stored, and numbered within each range; what earlier ranges of the same key add is
one small row per (range, key).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def ranged(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """df with `_range`, stored, so that the ranges stay as they are."""
    dealt = df.repartitionByRange(*(F.col(c) if isinstance(c, str) else c for c in [*keys, *order]))
    return stored(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def rank_in_key(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """df with the row's number, from 1, in its key's order. `order` must make rows of a key distinct for a defined result."""
    rows = ranged(df, keys, order)
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = rows.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    return inner.join(counts, [*keys, "_range"]).withColumn(name, F.col("_inner") + F.col("_before")).drop("_inner", "_before", "_range")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """df with the largest value of the key's rows up to this one (or before it)."""
    rows = ranged(df.withColumn("_value", value), keys, order)
    tops = rows.groupBy(*keys, "_range").agg(F.max("_value").alias("_top"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_earlier", F.max("_top").over(before)).drop("_top")
    frame = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = rows.withColumn("_inner", F.max("_value").over(frame))
    return inner.join(tops, [*keys, "_range"]).withColumn(name, F.greatest("_inner", "_earlier")).drop("_inner", "_earlier", "_range", "_value")


def next_in_key(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, *more: str) -> DataFrame:
    """df with the value of the key's next row as `name` (and of further columns as `_next` and their names); null for its last row.

    Within a range by a window; the last row of a range takes the first of the key's next range, one small row per range.
    """
    rows, wanted = ranged(df, keys, order), {name: value} | {f"_next{c}": c for c in more}
    inner = Window.partitionBy(*keys, "_range").orderBy(*order)
    firsts = rows.groupBy(*keys, "_range").agg(F.min_by(F.struct(*dict.fromkeys(wanted.values())), F.struct(*order)).alias("_first"))
    firsts = firsts.withColumn("_first", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range")))
    out = rows.select("*", F.lead(F.lit(True)).over(inner).alias("_inside"), *(F.lead(v).over(inner).alias(f"_lead_{k}") for k, v in wanted.items())).join(firsts, [*keys, "_range"])
    out = out.withColumns({k: F.when(F.col("_inside"), F.col(f"_lead_{k}")).otherwise(F.col("_first").getField(v)) for k, v in wanted.items()})
    return out.drop("_first", "_inside", "_range", *(f"_lead_{k}" for k in wanted))


def moving_average(df: DataFrame, keys: list[str], order: list[str], value: Column, keep: float, name: str) -> DataFrame:
    """df with the value of r = keep * r + (1 - keep) * value after each row of its key's order, from r = 0.

    A key's rows are numbered and cut into blocks so long that what comes from before the previous block weighs less than
    1e-50; within a block the recurrence is a running sum of value / keep^place, times keep^place.
    """
    block = max(2, int(50 / -math.log10(keep)))
    rows = rank_in_key(df.withColumn("_value", value.cast("double") * (1 - keep)), keys, order, "_n")
    rows = rows.withColumn("_block", F.expr(f"(_n - 1) div {block}")).withColumn("_place", F.expr(f"(_n - 1) % {block}"))
    lift, sink = F.pow(F.lit(1 / keep), F.col("_place")), F.pow(F.lit(keep), F.col("_place"))
    w = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", F.sum(F.col("_value") * lift).over(w) * sink)
    ends = rows.where(F.col("_place") == block - 1).select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_own").alias("_carried"))
    carried = F.coalesce("_carried", F.lit(0.0)) * sink * keep
    return rows.join(ends, [*keys, "_block"], "left").withColumn(name, F.col("_own") + carried).drop("_n", "_block", "_place", "_own", "_carried", "_value")
