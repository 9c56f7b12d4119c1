"""A sink of one JSON document per key, with a sorted index, that becomes visible in one commit.

Tasks write their documents and a sorted list of their keys below ``_pending``; nothing there is read by anybody.  The commit
merges the lists into the index, line by line, and then gives the folder its name; an abort removes it.  An attempt of a task
that is not part of the commit (killed, or beaten by a speculative one) leaves nothing.

::

    path/CURRENT                      the name of the version that counts, replaced in one step
    path/versions/<job>/index.jsonl   {"key": ..., "file": ...}, sorted by key
    path/versions/<job>/part-.../<key>.json

``path`` must be a folder that driver and executors share.
"""

from __future__ import annotations

import heapq
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from pathlib import Path

import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from heddle.functions.text import nan_to_null
from heddle.session import ship_path

NAME = "keyed_documents"


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: the folder of its attempt, and how many documents."""

    folder: str
    count: int


def file_name(key: str) -> str:
    """Of a key: itself where it is a plain name, else a hash and its plain letters, so that no two keys meet."""
    plain = "".join(c if c.isalnum() and c.isascii() or c in "-_." else "_" for c in key)
    # names that begin with a dot or a line are hidden from Spark's readers
    own = plain == key and 0 < len(key) <= 100 and key[0] not in "._"
    return f"{key}.json" if own else f"{xxhash.xxh3_128_hexdigest(key.encode())}~{plain[:80]}.json"


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = Path(path.removeprefix("file:")), uuid.uuid4().hex

    @property
    def pending(self) -> Path:
        return self.path / "_pending" / self.job

    def write(self, iterator: Iterator[Row]) -> Part:
        task = TaskContext.get()
        folder = self.pending / f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        folder.mkdir(parents=True)
        keys = []
        for row in iterator:
            if row["key"] is None:
                raise ValueError("a document without a key")
            (folder / file_name(row["key"])).write_text(row["value"], encoding="utf-8")
            keys.append(row["key"])
        keys.sort()
        with (folder / "_keys.jsonl").open("w", encoding="utf-8") as out:
            for k in keys:
                print(json.dumps(k), file=out)
        return Part(folder.name, len(keys))

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        self.pending.mkdir(parents=True, exist_ok=True)
        kept = {m.folder for m in parts}
        for folder in self.pending.iterdir():
            if folder.name not in kept:
                shutil.rmtree(folder)
        with ExitStack() as files, (self.pending / "index.jsonl").open("w", encoding="utf-8") as index:
            lists = [self._keys(m.folder, files) for m in parts]
            before = None
            for key, folder in heapq.merge(*lists):
                if key == before:
                    raise ValueError(f"two documents have the key {key!r}")
                before = key
                print(json.dumps({"key": key, "file": f"{folder}/{file_name(key)}"}, ensure_ascii=False), file=index)
        for m in parts:
            (self.pending / m.folder / "_keys.jsonl").unlink()
        (self.path / "versions").mkdir(exist_ok=True)
        os.rename(self.pending, self.path / "versions" / self.job)
        told = self.path / f"_CURRENT.{self.job}"
        told.write_text(self.job)
        os.replace(told, self.path / "CURRENT")  # from here on the new version counts
        for old in (self.path / "versions").iterdir():
            if old.name != self.job:
                shutil.rmtree(old, ignore_errors=True)

    def _keys(self, folder: str, files: ExitStack) -> Iterator[tuple[str, str]]:
        for line in files.enter_context((self.pending / folder / "_keys.jsonl").open(encoding="utf-8")):
            yield json.loads(line), folder

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class Documents(DataSource):
    """Writes (key string, value string) rows."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "key string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if [f.name for f in schema] != ["key", "value"]:
            raise ValueError("documents are written from the columns key and value")
        return Writer(self.options["path"])


def finite(x: Column, kind: DataType) -> Column:
    """NaN and infinities at any depth as nulls."""
    if isinstance(kind, DoubleType | FloatType):
        return nan_to_null(x)
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*(finite(x[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda v: finite(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, v: finite(v, kind.valueType))
    return x


def write(df: DataFrame, path: str, key: str, document: str) -> None:
    """One compact JSON document per key; NaN becomes null, as JSON has none.  A new write replaces the whole version."""
    spark = ship_path(df.sparkSession)
    spark.dataSource.register(Documents)
    text = F.to_json(finite(F.col(document), df.schema[document].dataType), {"ignoreNullFields": "false"})
    df.select(F.col(key).cast("string").alias("key"), text.alias("value")).write.format(NAME).mode("append").option("path", path).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the version that counts."""
    root = Path(path.removeprefix("file:"))
    version = f"file://{root / 'versions' / (root / 'CURRENT').read_text()}"
    index = spark.read.schema("key string, file string").json(f"{version}/index.jsonl")
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(version)
    named = texts.select("value", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1).alias("file"))
    return index.join(named, "file").select("key", "value")
