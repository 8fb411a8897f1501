"""A store of facts under one path, with the calls that a client makes."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .functions.text import mask_pii
from .operators import admission, maintenance, replica, temporal
from .schema import KEY, STATE, enforce_schema
from .sources import layout
from .sources.facts import LIVE, stamp_inserts
from .sources.shared import stored


class NotFound(LookupError):
    """No fact answers the question."""


SCHEMA = StructType([*STATE.fields, StructField("payload", StringType()), StructField("tier_rank", IntegerType())])


#: Beginnings of the names of tables that inserts and merges add, and of those that compactions write.
ADDED, COMPACTED = "table=added-", "table=compacted-"


class Engine:
    """Facts in tables below one path; reads are DataFrames over all live ones. One writer at a time per node id.

    Every insert or merge adds a table of its own, in buckets of the entity. A compaction writes one table, and then a manifest that names
    it and all tables that it takes the place of; tables that come meanwhile are not named and so stay.
    """

    def __init__(self, spark: SparkSession, path: str, node: str = "0" * 32):
        self.spark, self.path, self.node, self.frontier_ns = spark, path.rstrip("/"), node, 0

    def _tables(self) -> tuple[list[str], list[str]]:
        """(live tables, tables that compactions have replaced)."""
        manifests, gone = layout.folders(self.spark, f"{self.path}/manifests"), []
        tables = layout.folders(self.spark, f"{self.path}/facts")
        if manifests:
            last = self.spark.read.parquet(f"{self.path}/manifests/{manifests[-1]}").first()
            # a compacted table counts from its manifest on, and then only the last one
            gone = list(last.replaced)
            tables = [last.table, *(t for t in tables if not t.startswith(COMPACTED))]
        else:
            tables = [t for t in tables if not t.startswith(COMPACTED)]
        return [t for t in tables if t not in gone], gone

    def facts(self, entity: str | None = None) -> DataFrame:
        """All facts, or those of one entity, of which only its bucket is read."""
        tables = [f"{self.path}/facts/{t}" for t in self._tables()[0]]
        if not tables:
            return self.spark.createDataFrame([], SCHEMA)
        return layout.read_facts(self.spark, *tables, base=f"{self.path}/facts", entity=entity).select(*SCHEMA.fieldNames())

    def _append(self, rows: DataFrame) -> None:
        self._write(ADDED, enforce_schema(rows.select(*SCHEMA.fieldNames()), SCHEMA))

    def _write(self, kind: str, rows: DataFrame) -> str:
        name = f"{kind}{time.time_ns():020d}-{uuid.uuid4().hex}"
        layout.write_facts(rows, f"{self.path}/facts/{name}")
        return name

    def insert_batch(self, requests: DataFrame, now_ns: int | None = None) -> DataFrame:
        """requests (key, val[, valid_from_ns, valid_for_ns]) are stamped with one time and this node's next dots; long runs of digits in
        values are masked before anything is stored.

        Returns (key, status, dot_counter); requests without a key have status 400 and are not stored.
        """
        now = F.lit(time.time_ns() if now_ns is None else now_ns).cast("long")
        for name in ("valid_from_ns", "valid_for_ns"):
            if name not in requests.columns:
                requests = requests.withColumn(name, F.lit(None).cast("long"))
        requests = stored(requests.withColumn("val", mask_pii("val")).withColumn("logged", F.lit(True)), "requests")
        judged = admission.insert_status(requests)
        rows = stamp_inserts(judged.where("status = 200"), now)
        high = self.facts().where(F.col("dot_node_id") == self.node).agg(F.coalesce(F.max("dot_counter"), F.lit(0))).first()[0]
        rows = stored(replica.assign_dots(rows, self.node, high, ["key", "val", "valid_from_ns", "valid_for_ns"]), "inserts")
        self._append(rows.withColumns({"entity_id": F.col("key"), "decision_time_ns": F.lit(0).cast("long"), "h3_index": F.lit(0).cast("long"), "payload": F.col("val"), "tier_rank": F.lit(LIVE)}))
        return rows.select("key", "status", "dot_counter").unionByName(judged.where("status <> 200").select("key", "status", F.lit(None).cast("long").alias("dot_counter")))

    def merge(self, delta: DataFrame) -> DataFrame:
        """Join another replica's rows in; returns how many were new."""
        own = self.facts()
        delta = stored(delta.select(*(c for c in own.columns if c in delta.columns), *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns if c not in delta.columns)), "delta")
        stats = stored(replica.join_stats(own, delta), "stats")
        self._append(replica.dedupe(delta).join(own.select(*KEY), list(KEY), "left_anti"))
        return stats

    def get(self, key: str) -> dict:
        """The key's latest dot with its payload, which only the originator has."""
        found = temporal.latest_dot(temporal.of_entity(self.facts(key), key)).withColumn("dot", layout.dot_hex()).first()
        if found is None:
            raise NotFound(key)
        return found.asDict()

    def as_of(self, valid_ns: int, tx_ns: int, entity: str | None = None) -> DataFrame:
        self.frontier_ns = max(self.frontier_ns, tx_ns)
        return temporal.as_of(self.facts(entity), valid_ns, tx_ns, entity)

    def range(self, lo: int, hi: int, tx_ns: int, entity: str, most: int = 4096, coalesce: bool = False) -> tuple[DataFrame, bool]:
        rows, truncated = temporal.range_capped(self.facts(entity), lo, hi, tx_ns, entity, most)
        return (temporal.coalesce_range(rows) if coalesce else rows).orderBy("valid_time_start_ns", "dot_node_id", "dot_counter"), truncated

    def merkle_root(self) -> str:
        return replica.tree_root(self.facts()).first().root

    def status(self) -> dict:
        return replica.capture(self.facts(), self.node).first().asDict() | {"frontier_ns": self.frontier_ns}

    def metrics(self, prefix: str = "chronoset_") -> str:
        """The status as metrics text, which layout.parse_metrics reads."""
        return "".join(f"{prefix}{name} {value}\n" for name, value in self.status().items())

    def compact(self, horizon_ns: int = 0) -> str:
        """Write all facts, pruned under the horizon, as one table that reads see in place of those it was made of; returns its name."""
        live, gone = self._tables()
        name = self._write(COMPACTED, maintenance.compact(self.facts(), horizon_ns).select(*SCHEMA.fieldNames()))
        manifest = self.spark.createDataFrame([(name, [*gone, *live])], "table string, replaced array<string>")
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{time.time_ns():020d}")
        return name
