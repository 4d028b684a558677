"""Scans as a stream: files that arrive in a landing folder are taken up once.

These are Spark's own means applied to the batch operators; late and repeated deliveries are dropped under a watermark, so
the state stays as large as the deliveries of that time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corvane.functions import identify, paths


def arrivals(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def distinct_items(stream: DataFrame, key: str = "id", at: str = "scanned_at", late: str = "30 days") -> DataFrame:
    """Each item once; a delivery later than `late` behind the newest is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def identified(stream: DataFrame) -> DataFrame:
    """Items with what their names say; the batch expression, unchanged."""
    return stream.withColumn("named", identify.identify(paths.stem(F.col("path"))))


def counts_by_window(stream: DataFrame, at: str = "scanned_at", width: str = "1 day", late: str = "7 days") -> DataFrame:
    """How many items of each kind arrive in each window of time."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), "media_type").agg(F.count("*").alias("items"), F.sum("file_size").alias("bytes")).select(F.col("w.start").alias("start"), "media_type", "items", "bytes")


def run(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream to a folder until all that has arrived is taken up."""
    return stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
