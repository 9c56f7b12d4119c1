"""Answers of a slow lookup, remembered over runs, asked no faster than a stated rate.

The cache is a table of (name, result): a null result means that the lookup knows nothing of the name, and is not asked again.
Names that it lacks are dealt to ``slots`` partitions, each of which keeps a bucket that fills at its share of the rate, so
that all together never exceed it and need not talk to each other.  Answers are written once and become the cache's next version when
all are there.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import hold

_SHAPE = "name string, result string"


class Bucket:
    """Tokens that come at a rate; at most ``burst`` are kept."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = 0.0, clock()

    def take(self) -> None:
        """Waits for a token; a new bucket is empty, so that a task which starts again cannot exceed the rate."""
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.at, self.tokens = self.clock(), 1.0
        self.tokens -= 1


class Resolver:
    """A lookup function behind a cache in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, lookup: Callable[[str], str | None], rate: float, slots: int = 4):
        if rate <= 0:
            raise ValueError("the rate must be above 0")
        self.spark, self.lookup, self.rate, self.slots = spark, lookup, rate, slots
        self.folder = (folder if ":" in folder.split("/")[0] else f"file://{folder}").rstrip("/")

    def cache(self) -> DataFrame:
        system, root = fs.FileSystem.from_uri(self.folder)
        if system.get_file_info(f"{root}/CURRENT").type == fs.FileType.NotFound:
            return self.spark.createDataFrame([], _SHAPE)
        with system.open_input_stream(f"{root}/CURRENT") as file:
            return self.spark.read.schema(_SHAPE).parquet(f"{self.folder}/{file.read().decode()}")

    def learn(self, names: DataFrame) -> int:
        """Asks for the names (one string column) that the cache lacks; null and blank names are never asked."""
        known = self.cache()
        own = names.select(F.trim(F.col(names.columns[0])).alias("name")).where("name is not null and name <> ''").distinct()
        missing = own.join(known.select("name"), "name", "left_anti").repartition(self.slots, "name")
        lookup, share = self.lookup, self.rate / self.slots

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket = Bucket(share)
            for batch in batches:
                found = []
                for name in batch.column(0).to_pylist():
                    bucket.take()
                    found.append(lookup(name) or None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["name", "result"])

        answers = hold(missing.mapInArrow(ask, _SHAPE))
        count = answers.count()
        if count:
            version = uuid.uuid4().hex
            known.unionByName(answers).write.parquet(f"{self.folder}/{version}")
            system, root = fs.FileSystem.from_uri(self.folder)
            with system.open_output_stream(f"{root}/CURRENT.new") as out:
                out.write(version.encode())
            system.move(f"{root}/CURRENT.new", f"{root}/CURRENT")
        return count

    def resolve(self, df: DataFrame, ident: str, candidates: str, result: str) -> DataFrame:
        """Of each row's ordered list of names, the answer to the first that has one.

        Rung by rung: names are asked only for rows that no earlier name has answered.
        """
        rungs = df.agg(F.max(F.size(candidates))).first()[0] or 0
        for k in range(rungs):
            self.learn(self._open(df, ident, candidates, k).select("name"))
        return self._answered(df, ident, candidates, result)

    def _answered(self, df: DataFrame, ident: str, candidates: str, result: str) -> DataFrame:
        tried = df.select(ident, F.posexplode(candidates).alias("__at", "__raw")).select(ident, "__at", F.trim("__raw").alias("name"))
        first = tried.join(self.cache().where("result is not null"), "name").groupBy(ident).agg(F.min_by("result", "__at").alias(result))
        return df.join(first, ident, "left")

    def _open(self, df: DataFrame, ident: str, candidates: str, k: int) -> DataFrame:
        rows = self._answered(df, ident, candidates, "__result").where("__result is null")
        return rows.select(F.get(candidates, F.lit(k)).alias("name"))
