"""Copies what is new or changed from one folder to another; a second run writes nothing.

Spark lists the source with lengths and digests; an anti join with the target's manifest leaves what must be copied; tasks copy
it, each file under another name first.  The new manifest is written last, so a run that breaks off is completed by the next:
what it has copied is copied again, to the same bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.session import hold

_SHAPE = "file string, length long, digest string"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, digest) of all files below a folder, hidden ones aside; file is the path within it."""
    root = _uri(folder)
    # Spark's paths have one slash after the scheme where a URI has three
    within = root.split(":", 1)[1].lstrip("/") + "/"
    inside = F.substring(F.col("path"), F.locate(within, F.col("path")) + len(within), F.lit(1 << 30))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(inside.alias("file"), "length", "content")
    # Spark's readers give no row for an empty file
    system, top = fs.FileSystem.from_uri(root)
    hollow = [i.path.removeprefix(f"{top}/") for i in system.get_file_info(fs.FileSelector(top, recursive=True)) if i.type == fs.FileType.File and i.size == 0]
    whole = found.unionByName(spark.createDataFrame([(name, 0, b"") for name in hollow], "file string, length long, content binary"))
    return whole.select("file", "length", F.sha2("content", 256).alias("digest"), "content").where(~F.col("file").rlike(r"(^|/)[_.]"))


def _uri(folder: str) -> str:
    return (folder if ":" in folder.split("/")[0] else f"file://{folder}").rstrip("/")


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """What earlier runs have brought to the target."""
    system, root = fs.FileSystem.from_uri(_uri(target))
    told = f"{root}/_manifest/CURRENT"
    if system.get_file_info(told).type == fs.FileType.NotFound:
        return spark.createDataFrame([], _SHAPE)
    with system.open_input_stream(told) as file:
        return spark.read.schema(_SHAPE).parquet(f"{_uri(target)}/_manifest/{file.read().decode()}")


def sync(spark: SparkSession, source: str, target: str, parts: int = 8) -> int:
    """Copies and returns how many files it has copied.  Files that the source no longer has stay in the target."""
    known = manifest(spark, target)
    now = listing(spark, source)
    changed = now.join(known, ["file", "length", "digest"], "left_anti").repartition(parts, "file")
    uri = _uri(target)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for k, file in enumerate(batch.column(0).to_pylist()):
                place = f"{root}/{file}"
                system.create_dir(place.rpartition("/")[0], recursive=True)
                part = f"{place}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(batch.column(3)[k].as_buffer())
                system.move(part, place)
            yield batch.select([0, 1, 2])

    copied = hold(changed.mapInArrow(copy, _SHAPE))
    count = copied.count()
    if count:
        version = uuid.uuid4().hex
        kept = known.join(copied.select("file"), "file", "left_anti")
        kept.unionByName(copied).coalesce(1).write.parquet(f"{uri}/_manifest/{version}")
        system, root = fs.FileSystem.from_uri(uri)
        with system.open_output_stream(f"{root}/_manifest/CURRENT.new") as out:
            out.write(version.encode())
        system.move(f"{root}/_manifest/CURRENT.new", f"{root}/_manifest/CURRENT")
    return count
