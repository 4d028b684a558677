"""A cache of looked-up values as an append-only table of (ns, key, updated_at, value).

Writers append; readers take the last entry of a key.  Entries are partitioned by namespace, so a reader of one
doesn't list the others.  `compact` rewrites a cache without replaced and expired entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.linking import alive, newest

SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("updated_at", T.LongType()), T.StructField("value", T.StringType()), T.StructField("ns", T.StringType())])


def append(entries: DataFrame, folder: str) -> None:
    entries.select(*SCHEMA.names).write.mode("append").partitionBy("ns").parquet(folder)


def read(spark: SparkSession, folder: str, ns: str, now: int | None = None, days: int = 90) -> DataFrame:
    """(key, updated_at, value): the last entry of each key that hasn't expired."""
    rows = newest(spark.read.schema(SCHEMA).parquet(folder).filter(F.col("ns") == ns).drop("ns"), ["key"])
    return rows if now is None else alive(rows, F.lit(now), days)


def compact(spark: SparkSession, folder: str, to: str, now: int, days: int) -> None:
    """Writes the living entries of a cache to another folder."""
    alive(newest(spark.read.schema(SCHEMA).parquet(folder), ["ns", "key"]), F.lit(now), days).select(*SCHEMA.names).write.mode("overwrite").partitionBy("ns").parquet(to)


def unpack(value: Column, schema: T.StructType | str) -> Column:
    """A cached JSON value; also one that was stored in an envelope {updated_at, value}.  Missing fields are null."""
    inner = F.get_json_object(value, "$.value")
    return F.from_json(F.coalesce(inner, value), schema, {"mode": "PERMISSIVE"})
