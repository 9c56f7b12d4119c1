"""Benchmark decontamination by greedy string tiling.

Words are the lower-cased runs of word characters.  A document is a candidate for an item if the two share a seed:
``min_tile`` consecutive words.  Between a candidate and the item, running Karp-Rabin hashes find the longest match
of words that are in no tile yet; it becomes a tile; that repeats until no match of ``min_tile`` words is left.  Tiles
do not overlap, in neither text, and their order is free, so a passage whose sentences were reordered is covered as
well as a copy.  A document leaks an item if the tiles cover at least ``coverage`` of the item's words.

Items go to the executors in blocks of at most ``block_words`` words, so what is broadcast has a bound whatever
the benchmark's size; each block is one narrow pass over the documents, without a shuffle.

Defined results: null texts are empty and match nothing; an item of fewer than ``min_tile`` words is matched as a whole;
items without words match nothing; repeated document rows are reported each, repeated items once per item id and text;
empty tables give an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import Rolling, WordHashes, settle

_WORD = re.compile(r"\w+")
_BASE, _MASK = 0x100000001B3, (1 << 61) - 1
SCHEMA = "coverage double, n_tiles int, longest int"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rolling(seq: list[int], size: int, free: bytearray) -> Iterator[tuple[int, int]]:
    """(start, hash) of every window of ``size`` words that are all free; the hash runs along."""
    top, value, run = pow(_BASE, size - 1, _MASK), 0, 0
    for i, word in enumerate(seq):
        if not free[i]:
            value = run = 0
            continue
        if run >= size:
            value = (value - seq[i - size] * top) % _MASK
        value = (value * _BASE + word) % _MASK
        run += 1
        if run >= size:
            yield i - size + 1, value


def tiles(item: list[int], doc: list[int], min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item start, doc start, length), the longest first, then the first in item and document.

    Search lengths are halved from round to round.  A round finds all matches of at least its length that cannot be longer
    on the left, and takes them longest first; of one that a tile has cut, the free stretches go back among the others.
    """
    free_i, free_d, out = bytearray(b"\x01" * len(item)), bytearray(b"\x01" * len(doc)), []
    size, left = max(min_tile, min(len(item), len(doc))), len(item)
    while left >= min_tile and size >= min_tile:
        table: dict[int, dict[int | None, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, h in _rolling(item, size, free_i):
            table[h][item[i - 1] if i and free_i[i - 1] else None].append(i)
        heap = []
        for d, h in _rolling(doc, size, free_d) if table else ():
            if h not in table:
                continue
            before = doc[d - 1] if d and free_d[d - 1] else None
            for word, starts in table[h].items():
                if word is not None and word == before:
                    continue  # the match starts further left
                for i in starts:
                    if item[i : i + size] == doc[d : d + size]:
                        n = size
                        while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n]:
                            n += 1
                        heap.append((-n, i, d))
        heapq.heapify(heap)
        while heap and left >= size:
            n, i, d = heapq.heappop(heap)
            n = -n
            if all(free_i[i : i + n]) and all(free_d[d : d + n]):
                free_i[i : i + n] = free_d[d : d + n] = bytes(n)
                left -= n
                out.append((i, d, n))
                continue
            start = 0
            for k in range(n + 1):
                if k == n or not (free_i[i + k] and free_d[d + k]):
                    if k - start >= size:
                        heapq.heappush(heap, (start - k, i + start, d + start))
                    start = k + 1
        if size == min_tile:
            break
        size = max(min_tile, size // 2)
    return out


class Index:
    """Seeds of a block of items: which items have which run of ``min_tile`` words, as sorted arrays."""

    def __init__(self, items: list[tuple[object, str]], min_tile: int):
        self.hashes, self.min_tile = WordHashes(), min_tile
        self.items = [(key, self.of(text)) for key, text in items]
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_length = defaultdict(list)
        for k, (_, seq) in enumerate(self.items):
            if n := min(min_tile, len(seq)):
                seeds = np.unique(Rolling(seq).grams(n))
                by_length[n].append((seeds, np.full(len(seeds), k, np.int32)))
        for n, found in by_length.items():
            keys, owners = np.concatenate([s for s, _ in found]), np.concatenate([o for _, o in found])
            order = np.lexsort((owners, keys))
            bits = np.zeros(1 << 20, bool)  # a first sieve: nearly all windows of a document end here
            bits[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.lengths[n] = keys[order], owners[order], bits

    def of(self, text: str) -> np.ndarray:
        return self.hashes.of([w.encode() for w in words(text)])

    def matches(self, text: str) -> Iterator[tuple[object, float, int, int]]:
        """(item, coverage, tiles, longest tile) of each item that shares a seed."""
        seq = self.of(text)
        if not len(seq):
            return
        rolling, places = Rolling(seq), defaultdict(set)
        for n, (keys, owners, bits) in self.lengths.items():
            grams = rolling.grams(n)
            spots = np.flatnonzero(bits[(grams >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, grams[spots], "left"), np.searchsorted(keys, grams[spots], "right")
            for at, a, b in zip(*(x[lo < hi].tolist() for x in (spots, lo, hi)), strict=True):
                for k in owners[a:b].tolist():
                    places[k].add((at, n))
        for k, spots in sorted(places.items()):
            key, item = self.items[k]
            # only words inside seeds can be in tiles; the rest of the document is left out, with a break in its place
            near, last = [], 0
            for at, n in sorted(spots):
                if at > last and near:
                    near.append(-1 - len(near))
                near += seq[max(at, last) : at + n].tolist()
                last = max(last, at + n)
            found = tiles(item.tolist(), near, min(self.min_tile, len(item)))
            if found:
                yield key, sum(n for _, _, n in found) / len(item), len(found), max(n for _, _, n in found)


class Block:
    """Some items on their way to the executors; each Python worker indexes them once."""

    def __init__(self, items: list[tuple[object, str]], min_tile: int):
        self.items, self.min_tile = items, min_tile
        self._index: Index | None = None

    def __getstate__(self) -> dict:
        return {"items": self.items, "min_tile": self.min_tile, "_index": None}

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = Index(self.items, self.min_tile)
        return self._index


def _blocks(items: DataFrame, block_words: int) -> list[list[tuple[object, str]]]:
    """Items in blocks of bounded size, one block at a time on the driver."""
    size = F.size(F.split("text", r"\s+"))
    total = items.agg(F.sum(size)).first()[0] or 0
    n = 1 + total // block_words
    for k in range(n):
        yield [(r["key"], r["text"]) for r in items.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == k).orderBy("key", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, min_tile: int = 5, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, coverage, n_tiles, longest) of every document and item that it leaks."""
    settle(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("key"), F.col(item_text_col).cast("string").alias("text")).where("trim(text) <> ''").distinct()
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = two.schema[0].dataType.simpleString(), items.schema[0].dataType.simpleString()
    found = None
    for block in _blocks(items, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(Block(block, min_tile))
        part = two.mapInArrow(_searcher(sent, coverage), f"id {kinds[0]}, item {kinds[1]}, {SCHEMA}")
        found = part if found is None else found.unionAll(part)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "coverage", "n_tiles", "longest")


def _searcher(sent, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = sent.value.index
            rows, owner = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for key, share, n, longest in index.matches(text) if text else ():
                    if share >= coverage:
                        owner.append(k)
                        rows.append((key, share, n, longest))
            if rows:
                item, share, n, longest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(item), pa.array(share, pa.float64()), pa.array(n, pa.int32()), pa.array(longest, pa.int32())], names=["id", "item", "coverage", "n_tiles", "longest"])

    return run


def clean(docs: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that leak nothing, all columns as they were; a null id is kept."""
    return docs.join(leaks.select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)
