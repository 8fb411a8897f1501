"""Structured Streaming forms of the ingest: a join sink, rates and clocks as aggregates, and convergence stamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from ..operators import admission, convergence, replica
from ..schema import KEY, MAX_COUNTER
from ..sources import layout
from ..sources.shared import exists


def join_sink(path: str, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the batch's new dots to the state table at path, which is kept in buckets of the entity.

    A duplicate may come at any time later, so no watermark bounds the comparison: it is an anti-join with the table, of which only
    the buckets that the batch touches are read. That makes a repeated batch add nothing, which foreachBatch needs after a failure.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, fresh = batch.sparkSession, replica.dedupe(batch).withColumn("bucket", layout.bucket_of(buckets=buckets))
        if exists(spark, path):
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
            known = spark.read.schema(fresh.schema).parquet(path).where(F.col("bucket").isin(touched)).select("bucket", *KEY)
            fresh = fresh.join(known, ["bucket", *KEY], "left_anti")
        fresh.write.mode("append").partitionBy("bucket").parquet(path)

    return sink


def admitted(frames: DataFrame) -> DataFrame:
    """frames, a stream or not, that pass the integrity checks and the rate budget."""
    return frames.where(admission.error_kind().isNull() & admission.rate_ok(frames["dot_counter"]))


def peer_rates(frames: DataFrame, key: str, counter: str, budget: int = admission.BUDGET) -> DataFrame:
    """A stream of (key, counter) -> per key: frames kept and dropped so far, and the largest counter that was kept.

    What a frame's counter is compared with is always below the budget, as only such frames are kept. So a frame is dropped if and
    only if its counter is not below the budget, in whatever order frames come, and three aggregates are all the state there is.
    """
    ok = admission.rate_ok(F.col(counter), budget)
    return frames.groupBy(key).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"), F.coalesce(F.max(F.when(ok, F.col(counter))), F.lit(0)).alias("last"))


def clocks(frames: DataFrame, key: str = "dot_node_id", counter: str = "dot_counter") -> DataFrame:
    """A stream's Lamport clock per node: the largest sane counter so far."""
    return frames.where(F.col(counter) <= MAX_COUNTER).groupBy(key).agg(F.max(counter).alias("lamport"))


def stamp_sink(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: sweeps (keys, order, root) go to path/stamped with `converged`, as convergence.stamps gives them.

    The state is the last two sweeps of each key, a table per batch, so that a batch that is repeated finds the state before it. Sweeps
    of a key come in order from batch to batch; within one, in any order.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, batch.withColumn("_new", F.lit(True))
        if batch_id:
            now = now.unionByName(spark.read.parquet(f"{path}/state/{batch_id - 1}").withColumn("_new", F.lit(False)))
        stamped = convergence.stamps(now, keys, [order])
        stamped.where("_new").drop("_new").write.mode("overwrite").parquet(f"{path}/stamped/batch={batch_id}")
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
        now.withColumn("_last", last).where("_last <= 2").drop("_last", "_new").write.mode("overwrite").parquet(f"{path}/state/{batch_id}")

    return sink


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run the stream over what is there now, then stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def files(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files at path, a folder or one file; as a pattern, as a plain path must be a folder."""
    reader: DataStreamReader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")
