"""Facts, states and logs from event tables, and stamping of inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DAY_NS, OPEN_END

L1, L0, LIVE = 0, 1, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def facts_from_events(events: DataFrame, grain_us: int = 1) -> DataFrame:
    """One fact per event: its user is the entity, its time the system time cut to grain_us, its props the payload.

    tier_rank says where a row is stored: compacted, flushed or live; on ties the smaller wins.
    """
    us, n = micros("ts"), F.col("event_id")
    system = (us - F.pmod(us, F.lit(grain_us))) * 1000
    start = (us - F.pmod(us, F.lit(DAY_NS // 1000))) * 1000 - (n % 7) * DAY_NS
    return events.select(
        n.alias("seq"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity_id"),
        system.alias("system_time_ns"),
        start.alias("valid_time_start_ns"),
        F.when(n % 3 == 0, F.lit(OPEN_END)).otherwise(start + (n % 11 + 1) * DAY_NS).alias("valid_time_end_ns"),
        system.alias("assertion_time_ns"),
        F.lit(0).cast("long").alias("h3_index"),
        F.sha2("props", 256).alias("payload_digest"),
        F.col("props").alias("payload"),
        F.lpad((n % 4).cast("string"), 32, "0").alias("dot_node_id"),
        (n + 1).alias("dot_counter"),
        F.when(n % 5 == 0, LIVE).when(n % 5 < 3, L0).otherwise(L1).alias("tier_rank"),
    )


def stamp_inserts(requests: DataFrame, now_ns: Column) -> DataFrame:
    """key, val, valid_from_ns, valid_for_ns -> facts: what an insert is stamped with. An end past the open end is open.

    The clamp compares before it adds, as adding may overflow.
    """
    start = F.coalesce(F.col("valid_from_ns"), now_ns)
    span = F.col("valid_for_ns")
    end = F.when(span.isNull() | (span <= 0), F.lit(OPEN_END)).when(start >= OPEN_END, F.lit(OPEN_END)).when(span > F.lit(OPEN_END) - F.greatest(start, F.lit(0)), F.lit(OPEN_END)).otherwise(F.try_add(start, span))
    return requests.select(
        "*", now_ns.alias("system_time_ns"), start.alias("valid_time_start_ns"), end.alias("valid_time_end_ns"), now_ns.alias("assertion_time_ns"), F.sha2(F.coalesce("val", F.lit("")), 256).alias("payload_digest")
    )


def facts_from_edge(events: DataFrame, arrival_ns: Column) -> DataFrame:
    """Edge events (latitude, longitude, assertion_time, entity_id, payload) as facts: known from their arrival on, valid from
    their assertion on. Events without an entity or with places off the globe are left out; the cell stays 0."""
    sane = (F.coalesce("entity_id", F.lit("")) != "") & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    return events.where(sane).select(
        "entity_id", arrival_ns.alias("system_time_ns"), F.col("assertion_time").alias("valid_time_start_ns"), F.lit(OPEN_END).alias("valid_time_end_ns"), F.col("assertion_time").alias("assertion_time_ns"), F.lit(0).cast("long").alias("h3_index"), F.sha2(F.coalesce("payload", F.lit("")), 256).alias("payload_digest"), "payload"
    )
