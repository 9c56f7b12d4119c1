"""A Spark session with the settings the library expects; an existing session is used as it is."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "heddle", cores: int | str | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_path(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package by the driver's path, where it isn't installed for them."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names.  Only a session in one process may go without: it gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not where and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not where:
            where = tempfile.mkdtemp(prefix="heddle-checkpoint-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        context.setCheckpointDir(where)
    return context.getCheckpointDir()


def hold(df: DataFrame) -> DataFrame:
    """The rows written once, for plans that read them several times: they survive lost executors, and no memory is kept."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """With a broadcast hint if it has at most so many rows, which is checked; else as it is, for Spark to join by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
