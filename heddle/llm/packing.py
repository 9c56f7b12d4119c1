"""Packing by powers of two: each document is cut into pieces of binary lengths, and equal lengths share a bucket.

A document of L tokens becomes L // capacity pieces of the capacity (a power of two), then one piece for each bit
of the remainder, longest first.  A piece is a sequence of its own, so no sequence crosses documents, and as every
length is a power of two no padding is needed at all.

Sequences are numbered inside their bucket: the number holds the input partition, the bucket and the running index
there, so it is unique without a shuffle, also for repeated rows, and a retried task gives the same numbers.

Defined results: a null or empty text is only its end id, one piece of length 1; a text of any length is packed whole; repeated rows are packed each; only
the id and text columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import settle

SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def binary_lengths(total: int, capacity: int = 1024) -> list[int]:
    """Powers of two, none above the capacity and none growing, that add up to total."""
    whole, rest = divmod(total, capacity)
    return [capacity] * whole + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]


@lru_cache(maxsize=2)
def encoder(spec_path: str, ranks_path: str):
    """The ids of the JSON vocabulary, by the faster library over the same vocabulary's ranks; tests hold them equal.

    The added tokens of the JSON file are matched inside texts, as its own library does by default.  A text that the faster
    library's pattern matcher gives up on (its backtracking stack ends at some 200,000 blanks in a row) is encoded by the
    JSON file's own library.
    """
    import tiktoken

    with open(spec_path, encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    from heddle.llm.token_counts import PATTERN

    tool = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        try:
            return tool.encode(text, allowed_special="all")
        except ValueError:
            return own_library(spec_path).encode(text, add_special_tokens=False).ids

    return encode


@lru_cache(maxsize=2)
def own_library(spec_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(spec_path)


def pack(docs: DataFrame, spec_path: str, ranks_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece; ``with_ids`` adds the ids themselves, as array<int>, for writing the packed corpus."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(spec_path, ranks_path), TaskContext.get()
        part, used = task.partitionId() if task else 0, defaultdict(int)
        for batch in batches:
            rows, ids_out = [], []
            owner = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*(encode(text) if text else ()), end_id], "<u4")
                start = 0
                for length in binary_lengths(len(ids), capacity):
                    bucket = length.bit_length() - 1
                    piece = ids[start : start + length]
                    rows.append((start, length, zlib.crc32(piece.tobytes()), len(ids), part << 40 | bucket << 35 | used[bucket], 0, bucket))
                    used[bucket] += 1
                    owner.append(k)
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
                    start += length
                if len(rows) >= 20_000:
                    yield emit(batch, owner, rows, ids_out)
                    rows, ids_out, owner = [], [], []
            if rows:
                yield emit(batch, owner, rows, ids_out)

    def emit(batch, owner, rows, ids_out):
        kinds = [pa.int64()] * 6 + [pa.int32()]
        columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True))]
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
        if with_ids:
            columns.append(pa.array(ids_out, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    settle(docs.sparkSession)
    two = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(run, f"`{id_col}` {two.schema[0].dataType.simpleString()}, {SCHEMA}" + ", ids array<int>" * with_ids)
