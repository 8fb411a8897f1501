"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of a local session without spark.checkpoint.dir, as in tests.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Only a session whose executors are the driver itself may do without:
    it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="chronoset-"))
        found = _OWN[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronoset/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: later uses do not compute it anew, and it survives lost executors. What was written stays until sweep()."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def sweep(spark: SparkSession, older_than_hours: float = 48) -> list[str]:
    """Remove the intermediate tables that were written so long ago that no query reads them; returns their paths.

    Results are read lazily from intermediate tables, so a query can't remove its own; run this between jobs.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/chronoset")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in (fs.listStatus(at) if fs.exists(at) else ()) if f.getModificationTime() <= (time.time() - older_than_hours * 3600) * 1000 and re.search(r"-[0-9a-f]{32}$", f.getPath().getName())]
    for path in old:
        fs.delete(path, True)
    return [path.toString() for path in old]
