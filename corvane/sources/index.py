"""Listings kept as tables: a scan writes its rows, and a later run reads them while the folder hasn't changed."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def persist(rows: DataFrame, folder: str, root: str, now: int) -> None:
    """Writes the raw rows of a scan of root, replacing those of an earlier one.  now: seconds."""
    rows.withColumns({"root": F.lit(root), "updated_at": F.lit(now).cast("bigint")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("root").parquet(folder)


def load(spark: SparkSession, folder: str, root: str, root_mtime: int | None) -> DataFrame | None:
    """The rows of the last scan of root, or None without any or if root changed since.

    Only root's own time is compared, so changes in folders below it aren't seen.  A root without a time counts as unchanged.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(folder).filter(F.col("root") == root)
    at = rows.agg(F.max("updated_at")).first()[0]
    if at is None or root_mtime is not None and root_mtime > at:
        return None
    return rows.drop("root", "updated_at")


def load_or_scan(spark: SparkSession, folder: str, target: str, scan: Callable[[str], DataFrame], now: int) -> tuple[DataFrame, str]:
    """(rows, `cached` or `live`): the kept rows if they are fresh, else a new scan, which is kept.

    A single file is looked for in a scan of its folder, which isn't kept.  A target that doesn't exist is an error.
    """
    if not os.path.exists(target):
        raise FileNotFoundError(target)
    if (rows := load(spark, folder, target, int(os.path.getmtime(target)))) is not None:
        return rows, "cached"
    if os.path.isdir(target):
        rows = scan(target)
        persist(rows, folder, target, now)
        return rows, "live"
    return scan(os.path.dirname(target) or ".").filter(F.col("path") == target), "live"
