"""What several operators share: ASCII word hashes, rolling n-gram hashes, connected components, checkpoints.

A word's hash is the sum of one pseudo-random 64-bit number for each of its (place, byte) pairs; words of over 64 bytes have
their xxh3.  A range of words has two polynomials over the halves of its words' hashes, modulo the prime 2**31 - 1 (powers of
two as modulus make structured texts collide), together 62 bits.  Equal content always gives equal hashes on every executor;
two different ranges collide with a probability of about 2**-62.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_P = 2**31 - 1
_BASES = (0x5BD1E995, 0x2C1B3C6D)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POW: dict[int, np.ndarray] = {}


class WordHashes(dict):
    """bytes -> 64-bit hash, remembering the words seen; emptied when it grows past ``limit``."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers of base modulo the prime."""
    have = _POW.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), _P)) % np.uint64(_P)])
    _POW[base] = have
    return have


#: A 64-bit number for each place in a word and byte value, from a rule.
_PLACES = 64
_LETTERS = mix(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each ASCII-white-space word."""
    data = np.frombuffer(raw, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    letters, first = data[~space[1:-1]], np.cumsum(size) - size
    key = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    np.minimum(key, _PLACES - 1, out=key)
    key <<= 8
    key += letters
    hashes = mix(np.add.reduceat(_LETTERS[key], first) + size.astype(np.uint64) * _M1)
    for k in np.flatnonzero(size > _PLACES).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(raw[start[k] : start[k] + size[k]])
    return start, hashes


def hash_texts(texts: list[bytes | None], lower: bool = False, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words start (one more offset than texts).

    Works on pieces of about ``piece`` bytes, cut at white space, so memory doesn't grow with a text's length.
    """
    raw = b"\n".join(t or b"" for t in texts)
    raw = raw.lower() if lower else raw
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + piece)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        s, h = _hash_piece(raw[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.append(np.searchsorted(start, begins), len(start)).astype(np.int64)


class Rolling:
    """Polynomial hashes of any range of a sequence of word hashes, in constant time per range."""

    def __init__(self, hashes: np.ndarray):
        self.n, self.sums = len(hashes), []
        for half, base in zip((hashes & np.uint64(_P), hashes >> np.uint64(33)), _BASES, strict=True):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(half * _powers(base, self.n)[: self.n] % np.uint64(_P), dtype=np.uint64, out=sums[1:])
            self.sums.append(sums)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words in [start, end); the length is part of the hash."""
        a, b = ((sums[end] - sums[start]) % np.uint64(_P) * _powers(pow(base, -1, _P), self.n + 1)[start] % np.uint64(_P) for sums, base in zip(self.sums, _BASES, strict=True))
        return mix((a << np.uint64(32) | b) + (end - start).astype(np.uint64) * _M1)

    def grams(self, n: int) -> np.ndarray:
        """Of every n consecutive words; empty if there are fewer."""
        starts = np.arange(max(0, self.n + 1 - n), dtype=np.int64)
        return self.ranges(starts, starts + n)


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Of each text, ASCII lower-cased: its sorted distinct n-word shingles, as ``shingles`` has them."""
    hashes, offsets = hash_texts(texts, lower=True)
    grams = Rolling(hashes).grams(n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else shingles(hashes[a:b], n))
    return out


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return hashes
    return np.unique(Rolling(hashes).grams(min(n, len(hashes))))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names.  Only a session in one process may go without: it gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not where and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="heddle-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage is cut and the rows survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: for what is larger or read in several ways."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, id) of every id that isn't the smallest of its component in these edges."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[below]], ids[below]


def _contracted(edges: DataFrame, parts: int, held: int) -> DataFrame:
    """``edges(u, v)`` in ``parts`` partitions, each ``held`` edges of a partition replaced by the stars of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, count = [], [], 0

        def stars() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(np.concatenate(u), np.concatenate(v))], names=["u", "v"])

        for batch in batches:
            u.append(batch.column(0).to_numpy(zero_copy_only=False))
            v.append(batch.column(1).to_numpy(zero_copy_only=False))
            count += len(batch)
            if count >= held:
                yield stars()
                u, v, count = [], [], 0
        if count:
            yield stars()

    return edges.coalesce(parts).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, salts: int = 8, held: int = 200_000) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as ``(id, component)``; component is the smallest id.

    Each round contracts the edges where they lie: a task replaces at most ``held`` of them at a time by stars, so there
    are as many tasks as the edges ask for, and a graph of one such share is done.  Then two star contractions alternate
    over the whole graph: every node's larger neighbours are linked to its smallest neighbour, then its smaller ones are.
    Each is one aggregation; a node that touches a third of the edges only ever has its minimum aggregated, before the
    shuffle as well, and its neighbours are never gathered; they meet the minimum in ``salts`` parts.  The edges turn into
    stars around the smallest ids in at most about log(n) rounds.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    while True:
        parts = max(1, -(-e.count() // held))
        e = cut(_contracted(e, parts, held))
        if parts == 1:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # large star: each neighbour above u hangs on the minimum around u
        above = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        big = above.join(low, ["u", "salt"]).select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: u itself and its smaller neighbours hang on the smallest of them
        least = big.groupBy("v").agg(F.min("u").alias("m"))
        small = big.join(least, "v")
        new = cut(small.select(F.col("m").alias("u"), F.col("u").alias("v")).union(small.select(F.col("m").alias("u"), "v")).where("u <> v").distinct())
        done = _stamp(e.distinct()) == _stamp(new)
        e = new
        if done:
            break
    heads = e.select("u").distinct()
    return e.select(F.col("v").alias("id"), F.col("u").alias("component")).union(heads.select("u", "u"))


def _stamp(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)), F.bit_xor(F.xxhash64("v", "u"))).first())


def map_columns(df: DataFrame, make, schema: str, kinds: list, names: list[str]) -> DataFrame:
    """mapInArrow by a function that turns a batch's columns, as lists, into output columns (or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):  # keeps what a step holds small
                columns = make(*(c.to_pylist() for c in batch.slice(at, 1000).columns))
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str, limit: int = 500_000, lists: str | None = None) -> DataFrame:
    """Joins docs with a table of ids; it is broadcast if it has at most ``limit`` rows, else both sides are shuffled.

    ``lists`` names an array column of ids; then its elements are what is counted, and of an inner join's documents only those
    that may have a list are shuffled.
    """
    total = ids.agg(F.sum(F.size(lists) + 4)).first()[0] or 0 if lists else ids.count()
    if lists and how == "inner" and total > limit:
        docs = docs.where(likely(ids, id_col)(id_col))
    return docs.join(F.broadcast(ids) if total <= limit else ids, id_col, how)


def slot_bits(hashes: DataFrame, most: int = 26) -> tuple[Broadcast, int]:
    """The low bits of a column of hashes (longs), as a set of bits that is broadcast, and the mask that gives a hash's slot.

    There are 32 or more slots for each row, but at most 2**``most`` (for 26, 8 MB are broadcast, and twice that is collected);
    beyond 2**``most`` / 32 rows more of the other hashes are in it as well, but none of these is ever lost.
    """
    mask = (1 << min(most, max(10, (32 * hashes.count()).bit_length()))) - 1
    taken = hashes.toDF("hash").select(F.col("hash").bitwiseAND(F.lit(mask)).alias("slot")).select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 AS int))").alias("bit"))
    taken = taken.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros((mask + 1) >> 6, np.int64)
    bits[taken.column("word").to_numpy()] = taken.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bits), mask


def in_slots(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63)) & 1 == 1


def likely(ids: DataFrame, id_col: str, most: int = 26) -> Callable[[str | Column], Column]:
    """A test of longs: true for all of ``ids``, false for nearly all others, so that these need not move to meet a table of ids
    (``slot_bits``)."""
    hashed = lambda c: F.xxhash64(F.col(c).cast("long") if isinstance(c, str) else c.cast("long"))
    held, mask = slot_bits(ids.select(hashed(id_col)), most)

    @F.pandas_udf("boolean")
    def test(slots: pd.Series) -> pd.Series:
        return pd.Series(in_slots(held.value, slots.to_numpy()))

    return lambda c: test(hashed(c).bitwiseAND(F.lit(mask)))


def having(df: DataFrame, keys: DataFrame, on: str, limit: int = 500_000, most: int = 26) -> DataFrame:
    """The rows of df whose ``on`` (a long) is in ``keys``, a stored table of distinct ones; it is broadcast if it has at most
    ``limit`` rows, else both sides are shuffled, of df only rows that may be in it (``likely``)."""
    if keys.count() <= limit:
        return df.join(F.broadcast(keys), on, "left_semi")
    return df.where(likely(keys, on, most)(on)).join(keys, on, "left_semi")


def meet(df: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner", small: int = 500_000) -> DataFrame:
    """Joins ``df`` with a table of one row per key, where ``weight`` says how many rows of df have the key.

    A small table is broadcast.  Of a large one, the keys that have more than a ``small``-th of all rows are: there are
    fewer than ``small`` of them, however large the table is; the others meet in a shuffle, in which no key is hot.
    """
    count, total = table.agg(F.count("*"), F.sum(weight)).first()
    if count <= small:
        return df.join(F.broadcast(table.drop(weight)), on, how)
    hot = F.col(weight) > max(1000, total // small)
    often = F.broadcast(table.where(hot).drop(weight))
    rest = df.join(often.select(on), on, "left_anti").join(table.where(~hot).drop(weight), on, how)
    return df.join(often, on).unionByName(rest)


def settle(spark: SparkSession, batch_rows: int = 500) -> SparkSession:
    """What the operators ask of a session: small Arrow batches, as one text may be very long, and workers that give memory
    back; Python workers find this package by the driver's path where it isn't installed.  Set before the first batch runs."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > batch_rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    environment = spark.sparkContext.environment
    environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    environment.setdefault("MALLOC_ARENA_MAX", "2")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")
