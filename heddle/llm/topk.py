"""Exact top-k search by integer inner product, with M-trees and best-first search.

Inner products are no metric, so vectors get one more component: with M the largest squared norm of a shard,
``x' = (x, sqrt(M - |x|^2))`` and ``q' = (q, 0)``, and then ``|q' - x'|^2 = |q|^2 + M - 2 q.x``: near in the metric means a
high score.  Trees live in that space; scores are integers, computed exactly.

1. The top level of the tree is shared: ``pivots`` rows (those whose hash is lowest, a documented sample; every row is indexed)
   are broadcast, and each candidate belongs to the cell of its nearest pivot.  A cell has a covering radius and a
   least distance; small cells near each other share a shard of
   ``shard_rows`` rows, a larger cell is dealt into several.
2. A query's ``k`` best pivots bound its k-th score.  It is sent only to the shards of cells that may hold something better:
   by the triangle inequality, nothing in a cell is nearer than the distance to the pivot less the radius.
3. Each shard has an M-tree, loaded in pages: routing pages hold pivots with covering radii and distances to the parent's
   pivot, leaf pages hold vectors and their distances to the parent's pivot.  A block of queries goes through the pages best
   first, by the least distance that a page can hold for one of them.  Entries whose parent distance alone shows that they
   are too far cost no distance computation; the others are one matrix product for a page.  Each shard gives its best k
   of each query, and the best k of those are the answer.

Ties go to the smaller id: only what is farther than the k-th best, beyond rounding, is cut off.

Defined results: vectors that are null or hold nulls or non-finite components take no part; a shorter vector counts as
padded with zeros; components are floor(scale * x), sums are exact, and components so large that a score may not fit a long
raise an error;
candidates with the query's id are its own row; repeated candidate rows are candidates each, and a repeated query id is
asked once, with its smallest vector; an empty table gives an empty result; only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import settle


class Page:
    """Entries of one tree page; ``kids`` is None in a leaf."""

    __slots__ = ("kids", "parent", "points", "radius", "rows")

    def __init__(self, points, rows, radius, parent, kids):
        self.points, self.rows, self.radius, self.parent, self.kids = points, rows, radius, parent, kids


class MTree:
    """Over integer vectors and their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = 512):
        self.ids, self.vectors = ids, vectors
        norms = (vectors.astype(np.float64) ** 2).sum(1)
        self.most = float(norms.max(initial=0))
        self.points = np.hstack([vectors.astype(np.float64), np.sqrt(np.maximum(0, self.most - norms))[:, None]])
        self.computed = 0
        # doubles hold integers exactly below 2**53, and their products are faster
        self.largest = int(np.abs(vectors).max(initial=0))
        self.page = page
        self.root, _ = self._load(np.arange(len(ids)), None) if len(ids) else (None, 0)

    def _far(self, points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((points - pivot) ** 2).sum(1))

    def _load(self, rows: np.ndarray, pivot: np.ndarray | None) -> tuple[Page, float]:
        """The page tree over these rows and its covering radius around ``pivot``."""
        away = self._far(self.points[rows], pivot) if pivot is not None else np.zeros(len(rows))
        if len(rows) <= self.page:
            return Page(self.points[rows], rows, np.zeros(len(rows)), away, None), float(away.max(initial=0))
        fan = min(self.page, max(2, -(-len(rows) // self.page)), 16)
        # pivots far from each other, starting with the first row
        chosen = [0]
        near = self._far(self.points[rows], self.points[rows[0]])
        which = np.zeros(len(rows), int)
        while len(chosen) < fan and near.max() > 0:
            chosen.append(int(near.argmax()))
            d = self._far(self.points[rows], self.points[rows[chosen[-1]]])
            which[d < near] = len(chosen) - 1
            near = np.minimum(near, d)
        if len(chosen) == 1:  # all are equal: pages of equal points
            parts = [rows[i : i + self.page] for i in range(0, len(rows), self.page)]
            kids = [Page(self.points[p], p, np.zeros(len(p)), np.zeros(len(p)), None) for p in parts]
            spots, radii = np.repeat(self.points[rows[:1]], len(parts), 0), np.zeros(len(parts))
        else:
            loaded = [self._load(rows[which == k], self.points[rows[c]]) for k, c in enumerate(chosen)]
            kids, radii = [p for p, _ in loaded], np.array([r for _, r in loaded])
            spots = self.points[rows[chosen]]
        parent = self._far(spots, pivot) if pivot is not None else np.zeros(len(spots))
        return Page(spots, None, radii, parent, kids), float(away.max(initial=0))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, least_score: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(query's place, id, score) of each query's best rows, at most k; ``least_score`` says what scores are of no use."""
        if self.root is None or not len(own):
            return []
        points = np.hstack([queries.astype(np.float64), np.zeros((len(own), 1))])
        base = (points**2).sum(1) + self.most
        slack = 1e-6 * np.sqrt(base + 1) + 1e-6
        small = self.largest * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < 1 << 53
        floor = np.full(len(own), np.iinfo(np.int64).min) if least_score is None else least_score.copy()
        reach = lambda: np.sqrt(np.maximum(0.0, base - 2.0 * floor)) + slack
        limit = np.where(floor == np.iinfo(np.int64).min, np.inf, reach())
        best: list[list[tuple[int, int]]] = [[] for _ in own]  # (-score, id), sorted
        whole = np.arange(len(own))
        queue: list[tuple] = [(0.0, 0, self.root, whole, np.zeros(len(own)), None)]
        count = 0
        while queue:
            _, _, page, who, bound, to_parent = heapq.heappop(queue)
            keep = bound <= limit[who]
            who, to_parent = who[keep], None if to_parent is None else to_parent[keep]
            if not len(who):
                continue
            near = np.ones((len(who), len(page.points)), bool)
            if to_parent is not None:
                near = np.abs(page.parent[None, :] - to_parent[:, None]) - page.radius[None, :] <= limit[who][:, None]
            spots = np.flatnonzero(near.any(0))
            self.computed += int(near.sum())
            if page.kids is None:
                rows = page.rows[spots]
                scores = (points[who, :-1] @ page.points[spots, :-1].T).astype(np.int64) if small else queries[who] @ self.vectors[rows].T
                good = near[:, spots] & (scores >= floor[who][:, None]) & (self.ids[rows][None, :] != own[who][:, None])
                for at in np.flatnonzero(good.any(1)).tolist():
                    q, some = int(who[at]), np.flatnonzero(good[at])
                    best[q] = sorted([*best[q], *zip((-scores[at, some]).tolist(), self.ids[rows[some]].tolist(), strict=True)])[:k]
                    if len(best[q]) == k:
                        floor[q] = max(floor[q], -best[q][-1][0])  # equal scores may still win by their id
                changed = floor > np.iinfo(np.int64).min
                limit = np.where(changed, reach(), limit)
                continue
            # every point has the squared length ``most``
            far = np.sqrt(np.maximum(0.0, base[who][:, None] - 2 * (points[who] @ page.points[spots].T)))
            for column, kid in enumerate(spots.tolist()):
                lower = np.maximum(0.0, far[:, column] - page.radius[kid])
                asks = near[:, kid] & (lower <= limit[who])
                if asks.any():
                    count += 1
                    heapq.heappush(queue, (float(lower[asks].min()), count, page.kids[kid], who[asks], lower[asks], far[asks, column]))
        return [(q, i, -s) for q, found in enumerate(best) for s, i in found]


def _stack(vectors: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, number)


class Cells:
    """The shared top level: pivots with ids, in the metric space, and what their cells hold."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float):
        self.ids, self.vectors, self.most = ids, vectors.astype(np.float64), most
        self.high = np.sqrt(np.maximum(0.0, most - (self.vectors**2).sum(1)))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and its distance to the pivot there."""
        high = np.sqrt(np.maximum(0.0, self.most - (rows**2).sum(1)))
        inner = rows @ self.vectors.T + high[:, None] * self.high[None, :]
        cell = inner.argmax(1)
        return cell, np.sqrt(np.maximum(0.0, 2 * (self.most - inner[np.arange(len(rows)), cell])))

    def close(self, stats: dict[int, tuple[int, float]], shard_rows: int) -> None:
        """Rows and covering radius of each cell.  Small cells near each other share a shard, large ones have several."""
        size = np.array([stats[c][0] if c in stats else 0 for c in range(len(self.ids))], np.int64)
        self.radius = np.array([stats[c][1] if c in stats else -np.inf for c in range(len(self.ids))])
        self.parts, self.first = np.where(size > 0, np.maximum(1, -(-size // shard_rows)), 0), np.zeros(len(size), np.int64)
        shard = used = 0
        for c in self._neighbours(min(len(size), int(1 + size.sum() // shard_rows))).tolist():
            if used and used + size[c] > shard_rows:
                shard, used = shard + 1, 0
            self.first[c] = shard
            used += int(size[c])
            if self.parts[c] > 1:
                shard, used = shard + int(self.parts[c]), 0

    def _neighbours(self, groups: int) -> np.ndarray:
        """All cells, those around one of some pivots far from each other together, the nearest first."""
        points = np.hstack([self.vectors, self.high[:, None]])
        near, which = ((points - points[0]) ** 2).sum(1), np.zeros(len(points), np.int64)
        for k in range(1, groups):
            d = ((points - points[near.argmax()]) ** 2).sum(1)
            which[d < near] = k
            near = np.minimum(near, d)
        return np.lexsort((near, which))

    def route(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Shards that each query must see, and a score that its k-th best is not below."""
        none = np.iinfo(np.int64).min
        scores = queries @ self.vectors.T
        base = (queries**2).sum(1) + self.most
        usable = np.where(self.ids[None, :] == own[:, None], -np.inf, scores)
        floor = np.full(len(own), none)
        if len(self.ids) > k:
            kth = np.partition(usable, -k, axis=1)[:, -k]
            floor = np.where(np.isfinite(kth), kth, none).astype(np.int64)
        slack = 1e-6 * np.sqrt(base + 1) + 1e-6
        limit = np.where(floor == none, np.inf, np.sqrt(np.maximum(0.0, base - 2.0 * floor)) + slack)
        lower = np.sqrt(np.maximum(0.0, base[:, None] - 2 * scores)) - self.radius[None, :]
        shards = []
        for asked in (lower <= limit[:, None]) & (self.parts > 0)[None, :]:
            cells = np.flatnonzero(asked)
            shards.append(np.unique(np.concatenate([np.arange(self.first[c], self.first[c] + self.parts[c]) for c in cells])) if len(cells) else np.zeros(0, np.int64))
        return shards, floor


def _prepared(vectors: DataFrame, is_query: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    return vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), is_query.alias("q")).where("id is not null")


def routes(whole: DataFrame, k: int, shard_rows: int, max_pivots: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Candidates (shard, id, v) and queries (shard, id, v, floor) of a table (id, v, q); a query is in each shard that it must see."""
    spark = whole.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = F.array_max(F.transform("v", lambda x: F.greatest(x, F.bitwise_not(x))))  # has no overflow at the least long
    rows, most, width, largest = whole.agg(F.count("*"), F.max(square), F.max(F.size("v")), F.max(size)).first()
    width = width or 0
    if (int(largest or 0) + 1) ** 2 * max(1, width) >= 1 << 63:
        raise ValueError(f"components up to {largest} in {width} dimensions: scores may not fit a long")
    # at most max_pivots pivots, and at most 2 million of their components
    wanted = int(max(16, min(max_pivots, 4 * (rows or 0) ** 0.5, 2_000_000 // max(1, width))))
    chosen = whole.orderBy(F.xxhash64("id", "v"), "id").limit(wanted).select("id", "v").collect()
    cells = Cells(np.array([r["id"] for r in chosen], np.int64), _stack([r["v"] for r in chosen], width), float(most or 0))
    sent = spark.sparkContext.broadcast(cells)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = sent.value.nearest(_stack(batch.column(0).to_pylist(), width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=["cell", "far"])

    if chosen:
        found = whole.select("v").mapInArrow(assign, "cell int, far double").groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
        cells.close({r["cell"]: (r["n"], r["far"]) for r in found}, shard_rows)
    known = spark.sparkContext.broadcast(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tool = known.value
            cell, _ = tool.nearest(_stack(batch.column(1).to_pylist(), width).astype(np.float64))
            shard = tool.first[cell] + np.array(batch.column(2).to_pylist(), np.int64) % tool.parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column(0), batch.column(1)], names=["shard", "id", "v"])

    dealt = whole.select("id", "v", F.xxhash64("id", "v").alias("h")).mapInArrow(deal, "shard long, id long, v array<long>")
    asked = whole.where("q").groupBy("id").agg(F.min("v").alias("v"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(batch.column(0).to_pylist(), np.int64)
            shards, floor = known.value.route(own, _stack(batch.column(1).to_pylist(), width).astype(np.float64), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shards, pa.list_(pa.int64())), pa.array(floor, pa.int64())], names=["id", "v", "shards", "floor"])

    routed = asked.mapInArrow(ask, "id long, v array<long>, shards array<long>, floor long").select(F.explode("shards").alias("shard"), "id", "v", "floor")
    return dealt, routed


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard_rows: int = 8192, page: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query row its k best of all other rows."""
    settle(vectors.sparkSession)
    mine, each = routes(_prepared(vectors, is_query, scale, id_col, vector_col), k, shard_rows)
    both = mine.select("shard", F.lit(0).alias("asks"), "id", "v", F.lit(0).cast("long").alias("floor")).union(each.select("shard", F.lit(1).alias("asks"), "id", "v", "floor"))
    dealt = both.repartition("shard").sortWithinPartitions("shard", "asks", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        ids: list[int] = []
        rows: list[list[int]] = []
        asked: list[tuple] = []

        def answer() -> list[tuple[int, int, int]]:
            """Of the queries that have gathered for this shard."""
            nonlocal tree, ids, rows, asked
            if not asked:
                return []
            if tree is None:
                tree = MTree(np.array(ids, np.int64), _stack(rows, max(map(len, rows), default=0)), page)
                ids, rows = [], []
            width = tree.vectors.shape[1]
            own = np.array([i for i, _, _ in asked], np.int64)
            found = tree.search(own, _stack([v[:width] for _, v, _ in asked], width), k, np.array([f for _, _, f in asked], np.int64))
            asked = []
            return [(int(own[q]), i, s) for q, i, s in found]

        for batch in batches:
            out: list[tuple] = []
            for own, asks, i, v, floor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != shard:
                    out += answer()
                    shard, tree, ids, rows = own, None, [], []
                if asks:
                    asked.append((i, v, floor))
                else:
                    ids.append(i)
                    rows.append(v)
            out += answer()
            yield _found(out)

    def _found(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "id", "score"])

    found = dealt.mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
