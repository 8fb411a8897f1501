"""Schemas and fixed values of the bitemporal data model. Times are nanoseconds since 1970 in BIGINT: Spark's
timestamps hold microseconds, and cutting would merge distinct facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: The end of an interval that is open.
OPEN_END = 9_000_000_000_000_000_000
DAY_NS = 86_400_000_000_000
#: Largest counter of a dot that is taken for sane.
MAX_COUNTER = 1 << 60

_LONG, _TEXT = LongType(), StringType()
TIMES = ("system_time_ns", "valid_time_start_ns", "valid_time_end_ns", "assertion_time_ns")
FACTS = StructType([StructField("entity_id", _TEXT), *(StructField(t, _LONG) for t in TIMES), StructField("h3_index", _LONG), StructField("payload_digest", _TEXT), StructField("payload", _TEXT)])
DOT = ("dot_node_id", "dot_counter")
KEY = ("entity_id", *DOT)
STATE = StructType([StructField("entity_id", _TEXT), StructField("dot_node_id", _TEXT), StructField("dot_counter", _LONG), StructField("origin_node_id", _TEXT), *(StructField(t, _LONG) for t in TIMES), StructField("decision_time_ns", _LONG), StructField("h3_index", _LONG), StructField("payload_digest", _TEXT)])


class SchemaError(ValueError):
    """A table that does not have the fields it must have."""


def enforce_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """df, if it has as many fields as the schema and each the same type in order; names are not compared."""
    if len(df.schema.fields) != len(schema.fields):
        raise SchemaError(f"{len(df.schema.fields)} fields, {len(schema.fields)} expected")
    for found, wanted in zip(df.schema.fields, schema.fields, strict=True):
        if found.dataType != wanted.dataType:
            raise SchemaError(f"{found.name} is {found.dataType.simpleString()}, {wanted.dataType.simpleString()} expected")
    return df.toDF(*schema.fieldNames())
