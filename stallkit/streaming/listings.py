"""Listings as a stream: repeated crawls dropped within a watermark, and rows upserted batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallkit.sources.store import write_upserted


def read_files(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    """Files of a folder as they arrive, ``files`` a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def first_seen(stream: DataFrame, keys: Sequence[str] = ("id", "platform"), time: str = "found_at", late: str = "1 day") -> DataFrame:
    """Rows whose key did not come within the last ``late`` before. State of older keys is dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def daily_prices(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """``date, product_seo_id, sample_count, min_price, max_price`` of product listings per day, given out once a day is over."""
    timed = stream.withColumn("found_at", F.col("found_at").cast("timestamp")).withWatermark("found_at", late)
    days = timed.filter(F.col("price") > 0).groupBy(F.window("found_at", "1 day").alias("w"), "product_seo_id").agg(F.count("*").alias("sample_count"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    return days.select(F.col("w.start").alias("date"), "product_seo_id", "sample_count", "min_price", "max_price")


def upsert_to(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Writes each batch of a stream into the table at ``path``, the later write of a key in place of the earlier."""

    def write(batch: DataFrame, _: int) -> None:
        write_upserted(batch.sparkSession, path, batch, keys, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
