"""Incremental variants: folding chunks as they arrive, and finished units of work skipped on resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, time: str, delay: str) -> DataFrame:
    """Parquet files as they come, with a watermark; a time without zone counts in the session's zone."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def distinct_entities(spark: SparkSession, folder: str, schema: StructType, entity: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """Entities seen so far, from files as they arrive; state older than the watermark is dropped."""
    return arriving(spark, folder, schema, time, delay).dropDuplicatesWithinWatermark(entity)


def windowed_counts(spark: SparkSession, folder: str, schema: StructType, time: str, keys: list[str], width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts per time window and key, with late rows up to ``delay``."""
    events = arriving(spark, folder, schema, time, delay)
    return events.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, once; a second run goes on where this one ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def unfinished(tasks: DataFrame, done: DataFrame, keys: list[str], retry_failed: bool = False) -> DataFrame:
    """Units without a checkpoint; failed ones count as done unless they are to be tried again."""
    kept = done.where("ok") if retry_failed else done
    return tasks.join(kept.select(*keys).distinct(), keys, "left_anti")
