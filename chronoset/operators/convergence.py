"""Peers, fan-out and convergence: which peers get a delta, and when replicas agreed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import rank_in_key

HISTOGRAM = (1e-7, 2.5e-7, 5e-7, 1e-6, 2.5e-6, 5e-6, 1e-5, 5e-5, 1e-4)


def region_fanout(peers: DataFrame, own_region: int, most_foreign: int, seed: int = 0) -> DataFrame:
    """All peers of the own region (0 counts as own), and one of each foreign region, at most most_foreign of these."""
    local = peers.where((F.col("region") == own_region) | (F.col("region") == 0))
    order = F.xxhash64(F.lit(seed), F.col("peer_id"))
    foreign = peers.where((F.col("region") != own_region) & (F.col("region") != 0))
    one = foreign.withColumn("_r", F.row_number().over(Window.partitionBy("region").orderBy(order, "peer_id"))).where("_r = 1").drop("_r")
    return local.unionByName(one.orderBy("region", "peer_id").limit(most_foreign))


def all_equal(roots: DataFrame) -> DataFrame:
    """One row: nodes, distinct roots, and whether there is a node and all roots are one that is not zero."""
    one = roots.agg(F.count("*").alias("n_nodes"), F.count_distinct("root").alias("n_roots"), F.min("root").alias("root"))
    return one.select("n_nodes", "n_roots", ((F.col("n_roots") == 1) & (F.col("root") != "0" * 64)).alias("converged"))


def converged_share(times: DataFrame, keys: list[str], shares: tuple[float, ...] = (0.5, 0.9, 1.0)) -> DataFrame:
    """Per key and share, the time by which that share of nodes had converged: the value of that rank, no interpolation.

    Ranks come from ranges of the order, so that a key's rows are not sorted by one task.
    """
    ranked = rank_in_key(times, keys, ["converged_ms", "node_id"], "_r")
    ranked = ranked.join(ranked.groupBy(*keys).agg(F.max("_r").alias("_n")), keys)
    at = [F.max(F.when(F.col("_r") == F.ceil(F.col("_n") * s), F.col("converged_ms"))).alias(f"t{round(s * 100)}") for s in shares]
    return ranked.groupBy(*keys).agg(*at)


def stamps(sweeps: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """sweeps with `converged`: the root is that of the sweep before, and was not so already then."""
    w = Window.partitionBy(*keys).orderBy(*order)
    stable = F.coalesce(F.col("root") == F.lag("root", 1).over(w), F.lit(False))
    before = F.coalesce(F.lag("root", 1).over(w) == F.lag("root", 2).over(w), F.lit(False))
    return sweeps.withColumn("converged", stable & ~before)


def quiet_runs(polls: DataFrame, keys: list[str], order: list[str], at_least: int) -> DataFrame:
    """Runs of at least `at_least` polls in which neither root nor commit count changed: gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.coalesce((F.col("root") == F.lag("root").over(w)) & (F.col("commits") == F.lag("commits").over(w)), F.lit(False))
    runs = polls.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")).where(F.col("n") >= at_least)


def ship_class(has_payload: Column, is_own: Column, relayed: Column) -> Column:
    """What became of a row of a delta."""
    return F.when(is_own & has_payload, "shipped").when(is_own, "payload_miss").when(relayed.isNull(), "pending").when(relayed, "shipped").otherwise("relay_miss")


def histogram(values: DataFrame, value: str, bounds: tuple[float, ...] = HISTOGRAM) -> DataFrame:
    """One row: cumulative counts up to each bound, the total and the sum."""
    return values.agg(*(F.count_if(F.col(value) <= b).alias(f"le_{k}") for k, b in enumerate(bounds)), F.count(value).alias("total"), F.sum(value).alias("sum"))


def per_second(counts: DataFrame, keys: list[str], order: str, value: str = "n") -> DataFrame:
    """counts with `pps`: the growth of a counter since the key's row before, over the seconds between; null at first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return counts.withColumn("pps", (F.col(value) - F.lag(value).over(w)) / (F.col(order) - F.lag(order).over(w)))


def false_pass(keys: Column, failed: Column, root: Column) -> Column:
    """Why equal roots prove nothing, null if they do: every insert failed, or the root is that of nothing."""
    return F.when((keys > 0) & (failed >= keys), "all inserts failed").when(root.isNull() | (root == "0" * 64), "zero root")
