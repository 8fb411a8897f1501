"""Files of facts: layout by hash bucket, keys, manifests, snapshots and metrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_SORT = ("entity_id", "system_time_ns", "valid_time_start_ns", "assertion_time_ns")


def entity_hash8(entity: str = "entity_id") -> Column:
    """The first 8 bytes of SHA-256 of the id, as hex."""
    return F.substring(F.sha2(F.col(entity), 256), 1, 16)


def bucket_of(entity: Column | str = "entity_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")


def write_facts(facts: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "append") -> None:
    """Partitioned by a bucket of the entity and sorted within files, so that entity and time filters prune.

    Rebalancing by bucket lets Spark split a bucket that a hot entity fills over several files.
    """
    facts.withColumn("bucket", bucket_of(buckets=buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *_SORT).write.mode(mode).partitionBy("bucket").parquet(path)


def read_facts(spark: SparkSession, *paths: str, base: str | None = None, entity: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The facts of a path, or of several below a base; of one entity, only its bucket is listed and only its row groups are read."""
    facts = (spark.read.option("basePath", base) if base else spark.read).parquet(*paths)
    if entity is not None:
        bucket = spark.range(1).select(bucket_of(F.lit(entity), buckets)).first()[0]
        facts = facts.where((F.col("bucket") == bucket) & (F.col("entity_id") == entity))
    return facts.drop("bucket")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables (folders with a success mark) below a path, in order; none if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in (fs.listStatus(at) if fs.exists(at) else ()) if f.isDirectory()]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(p.getName() for p in found if fs.exists(done(p, "_SUCCESS")))


def sharded_key(node: str = "dot_node_id", tx: str = "system_time_ns", suffix: Column | str = "payload_digest") -> Column:
    """Four hex digits of SHA-256 over node and big-endian time, a slash, and the suffix."""
    packed = F.concat(F.unhex(F.col(node)), F.unhex(F.lpad(F.hex(F.col(tx)), 16, "0")))
    return F.concat(F.substring(F.sha2(packed, 256), 1, 4), F.lit("/"), suffix if isinstance(suffix, Column) else F.col(suffix))


def dot_hex(node: str = "dot_node_id", counter: str = "dot_counter") -> Column:
    return F.concat(F.col(node), F.lower(F.lpad(F.hex(F.col(counter)), 16, "0")))


def first_sys(key: Column) -> Column:
    """The smallest system time that a file's key names; null if it names none."""
    digits = F.regexp_extract(key, r"/(-?[0-9]+)\.arrow$", 1)
    return F.when(digits != "", digits).try_cast("long")


def visible_files(keys: DataFrame, tx_ns: int) -> DataFrame:
    """Files that may hold rows visible at tx: those that begin later are skipped, unreadable names are not."""
    return keys.where(F.coalesce(first_sys(F.col("key")) <= tx_ns, F.lit(True)))


def parse_manifests(manifests: DataFrame) -> DataFrame:
    """(name, content) -> (name, l1_key, l0_key): the first line that is not blank, then each line that names an L0 file."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.filter(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: x.startswith("l0/"))
    return manifests.select("name", lines.alias("lines")).where(F.size("lines") > 0).select("name", F.get("lines", 0).alias("l1_key"), F.explode_outer(listed).alias("l0_key"))


def surviving_l0(keys: DataFrame, superseded: DataFrame) -> DataFrame:
    """L0 keys that no manifest lists."""
    return keys.join(superseded.select(F.col("l0_key").alias("key")).distinct(), "key", "left_anti")


def newest_files(keys: DataFrame, most: int = 1000) -> DataFrame:
    """The newest files by number, not by string; `capped` says whether others were left out. A top-k report."""
    top = keys.orderBy(first_sys(F.col("key")).desc_nulls_last(), F.col("key").desc()).limit(most + 1)
    n = top.count()
    return top.orderBy(first_sys(F.col("key")).desc_nulls_last(), F.col("key").desc()).limit(most).withColumn("capped", F.lit(n > most))


def list_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(key, length) of the files below path by name; temporary and empty ones are left out, contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("key"), "length").orderBy("key")
    return found if most is None else found.limit(most)


def scan_plan(l1: DataFrame, l0: DataFrame, superseded: DataFrame, most: int = 1000) -> DataFrame:
    """Keys that a read opens: all compacted files and the newest flushed ones that none replaces; if there are none, all flushed ones."""
    chosen = l1.select("key").union(newest_files(surviving_l0(l0, superseded), most).select("key"))
    return l0.select("key") if chosen.isEmpty() else chosen


def parse_metrics(lines: DataFrame, prefix: str = "") -> DataFrame:
    """Prometheus text (value) -> (name, labels, sample): lines `name{labels} sample` whose name begins with the prefix; labels are a map,
    with the escapes of their values undone."""
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{(?:[^\"}]|\"(?:[^\"\\\\]|\\\\.)*\")*\})?\s+(\S+)".replace('\\"', '"').replace("\\\\", "\\")
    pair = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
    text = F.regexp_extract("value", pattern, 2)
    plain = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\x00"), F.lit("\\"))
    labels = F.map_from_arrays(F.regexp_extract_all(text, F.lit(pair), 1), F.transform(F.regexp_extract_all(text, F.lit(pair), 2), plain))
    out = lines.select(F.regexp_extract("value", pattern, 1).alias("name"), labels.alias("labels"), F.regexp_extract("value", pattern, 3).try_cast("double").alias("sample"))
    return out.where((F.col("name") != "") & F.col("name").startswith(prefix) & F.col("sample").isNotNull())


def with_labels(samples: DataFrame, **labels: str) -> DataFrame:
    """The samples that have all these labels, whatever others they have."""
    for name, value in labels.items():
        samples = samples.where(F.col("labels").getItem(name) == value)
    return samples


def single_sample(samples: DataFrame) -> DataFrame:
    """Metrics with exactly one sample, and its value."""
    return samples.groupBy("name").agg(F.count("*").alias("n"), F.min("sample").alias("sample")).where("n = 1").select("name", "sample")


def write_snapshot(state: DataFrame, path: str, root: str, lamport_high: int, cut_seq: int) -> None:
    """The state and one row of metadata, written last, so that a snapshot without it is no snapshot."""
    state.write.mode("overwrite").parquet(f"{path}/state")
    state.sparkSession.createDataFrame([(root, lamport_high, cut_seq)], "root string, lamport_high long, cut_seq long").write.mode("overwrite").parquet(f"{path}/meta")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/state"), spark.read.parquet(f"{path}/meta").first().asDict()
