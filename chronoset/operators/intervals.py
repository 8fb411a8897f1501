"""Intervals and points without products of rows: everything that is paired meets under an equality.

Points of a key are ranked. Node (level, n) of a key stands for the ranks [n * 2^level, (n + 1) * 2^level). A point lies in
one node of each level; an interval of ranks is the union of at most two nodes a level. A point and an interval that holds it share
exactly one of these, so that joins and running maxima by (key, level, node) see each hit once and nothing else. A row so becomes
some log2(points of its key) rows; keys with many rows are dealt over tasks by their nodes. Where all keys have few rows, which
is counted first, a plain join does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .ordered import rank_in_key, running_max

NODE = ["_level", "_node"]
#: Pairs of one key, and pairs a row, up to which a plain join under the key's equality takes less than nodes do.
PAIRS_OF_KEY, PAIRS_OF_ROW = 4_000_000, 100


def pairs_are_few(left: DataFrame, right: DataFrame, key: str) -> bool:
    """Whether joining all rows of equal keys makes few pairs: for no key more than one task can well look at, and not many a row."""
    a, b = left.groupBy(key).agg(F.count("*").alias("_a")), right.groupBy(key).agg(F.count("*").alias("_b"))
    n = F.coalesce(F.col("_a"), F.lit(0)).cast("double") * F.coalesce(F.col("_b"), F.lit(0))
    rows = F.coalesce(F.sum(F.coalesce(F.col("_a"), F.lit(0)) + F.coalesce(F.col("_b"), F.lit(0))), F.lit(0))
    most, total, count = a.join(b, key, "full").agg(F.coalesce(F.max(n), F.lit(0.0)), F.coalesce(F.sum(n), F.lit(0.0)), rows).first()
    return most <= PAIRS_OF_KEY and total <= PAIRS_OF_ROW * count


def _levels(size: Column) -> Column:
    """0 up to the level at which one node holds `size` ranks."""
    return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double")) + 1e-9).cast("int"))


def nodes_of_point(rank: Column, size: Column) -> Column:
    """The nodes that hold a rank (from 0), as an array."""
    return F.transform(_levels(size), lambda k: F.struct(k.alias("level"), F.floor(rank / F.pow(F.lit(2.0), k)).cast("long").alias("node")))


def nodes_of_interval(lo: Column, hi: Column) -> Column:
    """The nodes whose union is the ranks [lo, hi), as an array; empty if there are none."""

    def at(k: Column) -> Column:
        width = F.pow(F.lit(2.0), k)
        low, high = F.ceil(lo / width).cast("long"), F.floor(hi / width).cast("long")
        node = lambda n: F.struct(k.alias("level"), n.alias("node"))
        left = F.when((low < high) & (low % 2 == 1), F.array(node(low)))
        right = F.when((low < high) & (high % 2 == 1), F.array(node(high - 1)))
        none = F.filter(F.array(node(F.lit(0).cast("long"))), lambda _: F.lit(False))
        return F.concat(F.coalesce(left, none), F.coalesce(right, none))

    return F.flatten(F.transform(_levels(hi), at))


def _by_node(df: DataFrame, nodes: Column) -> DataFrame:
    return df.select("*", F.explode(nodes).alias("_at")).withColumns({"_level": F.col("_at.level"), "_node": F.col("_at.node")}).drop("_at")


def ranked_points(points: DataFrame, key: str, at: str) -> DataFrame:
    """(key, at, _rank, _size): the different points of each key with their ranks from 0, and how many the key has."""
    ranks = rank_in_key(points.select(key, at).distinct(), [key], [at], "_rank").withColumn("_rank", F.col("_rank") - 1)
    return ranks.join(ranks.groupBy(key).agg(F.count("*").alias("_size")), key)


def ranks_below(ranks: DataFrame, places: DataFrame, key: str, at: str) -> DataFrame:
    """(key, at, _below): for each different place of a key, how many of the key's ranked points lie before it; keys without points go."""
    both = ranks.select(key, F.col(at).alias("at"), F.lit(1).alias("kind"), F.col("_rank"))
    both = both.unionByName(places.select(key, F.col(at).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("_rank")).distinct())
    out = running_max(both, [key], ["at", "kind"], F.col("_rank") + 1, "_below")
    return out.where("kind = 0").select(key, F.col("at").alias(at), F.coalesce("_below", F.lit(0).cast("long")).alias("_below"))


def on_nodes(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """points and intervals (start <= at < end) with a row for each of their nodes, of equal keys and NODE where one holds the other.

    Intervals that hold no point have no row.
    """
    ranks = ranked_points(points, key, at)
    below = ranks_below(ranks, intervals.select(key, F.col(start).alias(at)).union(intervals.select(key, F.col(end).alias(at))), key, at)
    spans = intervals.join(below.select(key, F.col(at).alias(start), F.col("_below").alias("_lo")), [key, start]).join(below.select(key, F.col(at).alias(end), F.col("_below").alias("_hi")), [key, end])
    spans = _by_node(spans.where("_lo < _hi"), nodes_of_interval(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    dots = _by_node(points.join(ranks, [key, at]), nodes_of_point(F.col("_rank"), F.col("_size"))).drop("_rank", "_size")
    return dots, spans


def covering_top(intervals: DataFrame, key: str, start: str, end: str, value: str, direct: bool | None = None) -> DataFrame:
    """(key, start, end, _top): for each different interval of a key, the largest value among the key's intervals that contain it, itself
    included.

    In the order by (start, falling end) and in that by (falling end, start), an interval comes after all that contain it, and
    only these come before it in both. The first order gives ranks, and their prefixes nodes; within a node, the second
    gives a running maximum.
    """
    one = stored(intervals.groupBy(key, start, end).agg(F.max(value).alias("_value")), "intervals")
    if pairs_are_few(one, one, key) if direct is None else direct:
        outer = one.where("_value IS NOT NULL").select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"), F.col("_value").alias("_outer"))
        covers = (F.col(key) == F.col("_key")) & (F.col("_start") <= F.col(start)) & (F.col("_end") >= F.col(end))
        return one.join(outer, covers).groupBy(key, start, end).agg(F.max("_outer").alias("_top"))
    one = one.withColumn("_back", -F.col(end))
    ranks = rank_in_key(one, [key], [start, "_back"], "_rank")
    ranks = ranks.join(ranks.groupBy(key).agg(F.max("_rank").alias("_size")), key)
    columns = [key, start, end, "_back", *NODE]
    given = _by_node(ranks, nodes_of_point(F.col("_rank") - 1, F.col("_size"))).select(*columns, F.lit(0).alias("_kind"), "_value")
    asked = _by_node(ranks, nodes_of_interval(F.lit(0).cast("long"), F.col("_rank"))).select(*columns, F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_value"))
    tops = running_max(given.unionByName(asked), [key, *NODE], ["_back", start, "_kind"], F.col("_value"), "_best")
    return tops.where("_kind = 1").groupBy(key, start, end).agg(F.max("_best").alias("_top"))
