"""Hard negatives by one-dimensional distance keys: vectors stored sorted by (pivot, distance), searched by growing annuli.

Scores are integer inner products.  With one more component, ``x' = (x, sqrt(M - |x|^2))`` and ``q' = (q, 0)``, where M is the
largest squared norm of the table, ``|q' - x'|^2 = |q|^2 + M - 2 q.x``: near in that space means a high score, and a range of
scores is a ring of distances.

1. ``pivots`` rows (those whose hash is lowest, a documented sample; every row is indexed) are broadcast.  A row's key is its
   nearest pivot and the distance to it.  Counts per (pivot, step of the distance), a table of bounded size, cut the keys into
   shards of some ``shard_rows`` rows; the rows of a shard are stored in key order, in pages that hold one pivot's interval
   of distances each.
2. A probe is a query vector with a range of scores and a number of rows wanted.  By the triangle inequality a page of the
   pivot p with distances [a, b] holds nothing nearer than ``max(a - |q'p|, |q'p| - b)`` and nothing farther than
   ``|q'p| + b``.  The first wave asks the shard with the least bound; what it finds bounds the probe's last wanted score, and
   the second wave asks the shards whose bounds still allow something better.
3. Inside a shard a query takes the key intervals around it in growing steps, and ends as soon as the least distance of all
   that is left shows that nothing better can come.

An anchor's positives are the best rows of its own label.  For each of them one probe looks for rows of other labels with
scores between two shares of the positive's score.

Defined results: rows with a null id or label, or with a vector that is null or holds nulls or non-finite components, take
no part; a shorter vector counts as padded with zeros; ties go to the smaller id; rows with the anchor's id are its own and
are neither positives nor negatives; repeated candidate rows are candidates each, a repeated anchor id is asked once, with its
smallest (label, vector); without positives, or with none of a positive score, an anchor has no rows but for scores of 0, where
both bounds are 0; an empty table gives an empty result; only the id, label and vector columns are read.  Scores must fit a
long: components so large that they may not raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import settle, stored
from heddle.llm.topk import usable

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Keys:
    """The pivots in the augmented space, and the directory of key intervals."""

    def __init__(self, vectors: np.ndarray, most: float, steps: int = 128):
        self.vectors, self.most, self.steps = vectors.astype(np.float64), most, steps
        self.high = np.sqrt(np.maximum(0.0, most - (self.vectors**2).sum(1)))
        self.step = 2 * np.sqrt(most) / steps + 1e-9  # no two points are farther from each other than 2 sqrt(most)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row and the distance to it."""
        high = np.sqrt(np.maximum(0.0, self.most - (rows**2).sum(1)))
        inner = rows @ self.vectors.T + high[:, None] * self.high[None, :]
        pivot = inner.argmax(1)
        return pivot, np.sqrt(np.maximum(0.0, 2 * (self.most - inner[np.arange(len(rows)), pivot])))

    def interval(self, distance: np.ndarray) -> np.ndarray:
        return np.minimum((distance / self.step).astype(np.int64), self.steps - 1)

    def close(self, counts: dict[tuple[int, int], tuple[int, float, float]], shard_rows: int) -> None:
        """Shards of neighbouring key intervals; an interval of more rows than a shard is dealt into several."""
        self.first: dict[tuple[int, int], tuple[int, int]] = {}
        shard, used = 0, 0
        spots = []
        for (pivot, step), (n, least, most) in sorted(counts.items()):
            parts = -(-n // shard_rows)
            if used and used + n > shard_rows:
                shard, used = shard + 1, 0
            self.first[pivot, step] = (shard, parts)
            spots += [(shard + k, pivot, least, most) for k in range(parts)]
            shard, used = (shard + parts, 0) if parts > 1 else (shard, used + n)
        self.spots = np.array([(s, p) for s, p, _, _ in spots], np.int64).reshape(-1, 2)
        self.edges = np.array([(a, b) for _, _, a, b in spots], np.float64).reshape(-1, 2)
        # the spots are in the order of their shards
        self.shards, self.starts = np.unique(self.spots[:, 0], return_index=True)

    def shard(self, pivot: np.ndarray, distance: np.ndarray, salt: np.ndarray) -> np.ndarray:
        found = [self.first[key] for key in zip(pivot.tolist(), self.interval(distance).tolist(), strict=True)]
        first, parts = np.array(found, np.int64).reshape(-1, 2).T
        return first + salt % parts

    def away(self, queries: np.ndarray) -> np.ndarray:
        """Distances of augmented queries to the pivots; every stored point has the squared length ``most``."""
        return np.sqrt(np.maximum(0.0, (queries**2).sum(1)[:, None] + self.most - 2 * (queries @ self.vectors.T)))

    def route(self, queries: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each query: the shards that may hold a distance in [near, far], and the one of them with the least bound."""
        away = self.away(queries)[:, self.spots[:, 1]]
        least, most = _bounds(away, self.edges[:, 0], self.edges[:, 1])
        able = (least <= far[:, None]) & (most >= near[:, None])
        able_shard = np.logical_or.reduceat(able, self.starts, axis=1)
        closest = np.minimum.reduceat(np.where(able, least, np.inf), self.starts, axis=1)
        return [self.shards[row] for row in able_shard], self.shards[closest.argmin(1)]


def _bounds(away: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance of what lies between two distances from a pivot that is ``away``."""
    return np.maximum(0.0, np.maximum(least - away, away - most)), away + most


def _slack(base: np.ndarray) -> np.ndarray:
    return 1e-6 * np.sqrt(base + 1) + 1e-6


def _distance(base: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, base - 2.0 * score))


class Probes:
    """Queries of one table block, each with some ranges of scores; rows of ``low``, ``high``, ``floor`` are probes."""

    def __init__(self, ids: list[int], labels: list[int], vectors: np.ndarray, low: list[list[int]], high: list[list[int]], floor: list[list[int]], most: float):
        self.ids, self.labels, self.vectors = np.array(ids, np.int64), np.array(labels, np.int64), vectors
        self.points = vectors.astype(np.float64)
        self.base = (self.points**2).sum(1) + most
        self.owner = np.repeat(np.arange(len(ids)), [len(x) for x in low])
        self.place = np.concatenate([np.arange(len(x)) for x in low]) if ids else np.zeros(0, np.int64)
        self.high, self.floor = (np.array([v for x in some for v in x], np.int64) for some in (high, floor))
        self.floor = np.maximum(self.floor, np.array([v for x in low for v in x], np.int64))
        self.starts = np.flatnonzero(np.append(True, self.owner[1:] != self.owner[:-1])) if len(self.owner) else np.zeros(0, np.int64)

    def ring(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each query: least and largest distance that is of use to one of its probes."""
        base = self.base[self.owner]
        open_end = self.floor == _LOW
        far = np.where(open_end, np.inf, _distance(base, np.where(open_end, 0, self.floor)) + _slack(base))
        near = np.where(self.high == _HIGH, 0.0, _distance(base, np.where(self.high == _HIGH, 0, self.high)) - _slack(base))
        return np.minimum.reduceat(near, self.starts), np.maximum.reduceat(far, self.starts)


def scan(pages: list[tuple], probes: Probes, keys: Keys, same: bool, k: int, first: int = 4) -> tuple[list[tuple[int, int, int]], int]:
    """(probe, id, score) of each probe's best k rows in these pages of (pivot, least, most, ids, labels, rows); and the number of scores computed."""
    found: list[list[tuple[int, int]]] = [[] for _ in probes.owner]
    computed = 0
    if not pages or not len(probes.ids):
        return [], 0
    pivot = np.array([p[0] for p in pages])
    least, most = _bounds(keys.away(probes.points)[:, pivot], np.array([p[1] for p in pages]), np.array([p[2] for p in pages]))
    order = np.argsort(least, axis=1, kind="stable")
    largest = max(int(np.abs(p[5]).max(initial=0)) for p in pages)
    exact = largest * int(np.abs(probes.vectors).max(initial=0)) * max(1, probes.vectors.shape[1]) < 1 << 53  # doubles hold such sums
    asking, at, width = np.arange(len(probes.ids)), 0, first
    while at < len(pages) and len(asking):
        near, far = probes.ring()
        some = order[asking, at : at + width]
        use = (np.take_along_axis(least[asking], some, 1) <= far[asking][:, None]) & (np.take_along_axis(most[asking], some, 1) >= near[asking][:, None])
        who, page = asking[np.nonzero(use)[0]], some[use]
        for p in np.unique(page).tolist():
            queries = who[page == p]
            ids, labels, rows = pages[p][3:]
            scores = (probes.points[queries] @ rows.T.astype(np.float64)).astype(np.int64) if exact else probes.vectors[queries] @ rows.T
            computed += scores.size
            fits = (labels[None, :] == probes.labels[queries][:, None]) == same
            fits &= ids[None, :] != probes.ids[queries][:, None]
            spot = np.full(len(probes.ids), -1)
            spot[queries] = np.arange(len(queries))
            mine = np.flatnonzero(spot[probes.owner] >= 0)
            line = spot[probes.owner[mine]]
            good = fits[line] & (scores[line] >= probes.floor[mine][:, None]) & (scores[line] <= probes.high[mine][:, None])
            for hit in np.flatnonzero(good.any(1)).tolist():
                j, columns = int(mine[hit]), np.flatnonzero(good[hit])
                found[j] = sorted([*found[j], *zip((-scores[line[hit], columns]).tolist(), ids[columns].tolist(), strict=True)])[:k]
                if len(found[j]) == k:
                    probes.floor[j] = -found[j][-1][0]  # equal scores may still win by their id
        at, width = at + width, width * 2
        if at < len(pages):  # the distance that is left certifies a query's rows
            asking = asking[least[asking, order[asking, at]] <= probes.ring()[1][asking]]
    return [(j, i, -s) for j, rows in enumerate(found) for s, i in rows], computed


def _stack(vectors: list[list[int]], width: int) -> np.ndarray:
    if vectors and all(len(v) == width for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of an Arrow column as rows, without a Python object for each number where they are equally long."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(column) and column.null_count == 0 and (sizes == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return _stack(column.to_pylist(), width)


class Index:
    """The stored pages of a table, and how to ask them."""

    def __init__(self, pages: DataFrame, keys: Keys, width: int):
        self.pages, self.keys, self.width = pages, keys, width
        self.sent = pages.sparkSession.sparkContext.broadcast(keys)

    def search(self, probes: DataFrame, same: bool, k: int) -> DataFrame:
        """(id, probe, row_id, score, rank) for probes (id, label, v, low, high); low and high are arrays, a probe for each entry."""
        asked = stored(probes.withColumn("floor", F.col("low")))
        first = stored(self._wave(self._routed(asked, True), same, k))
        best = Window.partitionBy("id", "probe").orderBy(F.desc("score"), "row_id")
        last = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("probe", "score"))).alias("last"))
        known = asked.join(last, "id", "left").withColumn("floor", F.transform("low", lambda x, i: F.coalesce(F.try_element_at("last", i.cast("int")), x))).drop("last")
        second = self._wave(self._routed(known, False), same, k)
        return first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _routed(self, probes: DataFrame, nearest: bool) -> DataFrame:
        """A row per query and shard that it must ask: the nearest one, or all others."""
        sent, width = self.sent, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, labels, low, high, floor = (batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5))
                asked = Probes(ids, labels, _matrix(batch.column(2), width), low, high, floor, sent.value.most)
                # a first wave looks where the ring begins, whatever the floor
                shards, home = sent.value.route(asked.points, *asked.ring())
                picked = [[int(h)] if len(s) else [] for s, h in zip(shards, home, strict=True)] if nearest else [s[s != h].tolist() for s, h in zip(shards, self_home(asked, low, high), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(picked, pa.list_(pa.int64()))], names=["id", "label", "v", "low", "high", "floor", "shards"])

        def self_home(asked: Probes, low: list, high: list) -> np.ndarray:
            """The first wave's shard, by the floors that it had."""
            before = Probes(asked.ids.tolist(), asked.labels.tolist(), asked.vectors, low, high, low, sent.value.most)
            return sent.value.route(before.points, *before.ring())[1]

        lists = "low array<long>, high array<long>, floor array<long>"
        use = probes.where(F.size("low") > 0).select("id", "label", "v", "low", "high", "floor")
        return use.mapInArrow(run, f"id long, label long, v array<long>, {lists}, shards array<long>").select(F.explode("shards").alias("shard"), "id", "label", "v", "low", "high", "floor")

    def _wave(self, routed: DataFrame, same: bool, k: int) -> DataFrame:
        sent, width = self.sent, self.width
        empty = lambda kind: F.lit(None).cast(kind)
        stock = self.pages.select("shard", F.lit(0).alias("asks"), F.monotonically_increasing_id().alias("id"), "pivot", "least", "most", "ids", "labels", "rows", empty("long").alias("label"), *(empty("array<long>").alias(c) for c in ("v", "low", "high", "floor")))
        asks = routed.select("shard", F.lit(1).alias("asks"), "id", empty("int").alias("pivot"), empty("double").alias("least"), empty("double").alias("most"), *(empty("binary").alias(c) for c in ("ids", "labels", "rows")), "label", "v", "low", "high", "floor")
        # only shards that a query asks for move
        wanted = routed.select("shard").distinct()
        both = stock.join(wanted, "shard", "left_semi").unionByName(asks).repartition("shard").sortWithinPartitions("shard", "asks", "pivot", "least", "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, pages, queries = None, [], []

            def answer() -> list[tuple[int, int, int, int]]:
                nonlocal queries
                if not queries:
                    return []
                ids, labels, v, low, high, floor = map(list, zip(*queries, strict=True))
                asked = Probes(ids, labels, _stack(v, width), low, high, floor, sent.value.most)
                rows, _ = scan(pages, asked, sent.value, same, k)
                queries = []
                return [(ids[asked.owner[j]], int(asked.place[j]), i, s) for j, i, s in rows]

            for batch in batches:
                out: list[tuple] = []
                for own, asks, i, pivot, least, most, row_ids, labels, rows, label, v, low, high, floor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if own != shard:
                        out += answer()
                        shard, pages = own, []
                    if asks:
                        queries.append((i, label, v, low, high, floor))
                    else:
                        pages.append((pivot, least, most, np.frombuffer(row_ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(rows, np.int64).reshape(-1, width)))
                out += answer()
                columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["id", "probe", "row_id", "score"])

        return both.mapInArrow(run, "id long, probe int, row_id long, score long")


def build(rows: DataFrame, shard_rows: int = 8192, max_pivots: int = 512) -> Index | None:
    """The index of (id, label, v); None for an empty table."""
    spark = rows.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, most, width, largest = rows.agg(F.count("*"), F.max(square), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.greatest(x, F.bitwise_not(x)))))).first()
    if not count:
        return None
    width = max(1, width)
    if (int(largest or 0) + 1) ** 2 * width * 100 >= 1 << 63:
        raise ValueError(f"components up to {largest} in {width} dimensions: scores may not fit a long")
    # at most max_pivots pivots, and at most 2 million of their components
    wanted = int(max(4, min(max_pivots, 2 * count**0.5, 2_000_000 // width)))
    chosen = rows.orderBy(F.xxhash64("id", "v"), "id").limit(wanted).select("v").collect()
    keys = Keys(_stack([r["v"] for r in chosen], width), float(most or 0))
    sent = spark.sparkContext.broadcast(keys)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, distance = sent.value.of(_matrix(batch.column(2), width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32()), pa.array(distance, pa.float64()), pa.array(sent.value.interval(distance), pa.int32())], names=["id", "label", "v", "pivot", "distance", "step"])

    keyed = stored(rows.select("id", "label", "v").mapInArrow(key, "id long, label long, v array<long>, pivot int, distance double, step int"))
    # at most max_pivots x steps rows
    counts = keyed.groupBy("pivot", "step").agg(F.count("*").alias("n"), F.min("distance").alias("a"), F.max("distance").alias("b")).collect()
    held = max(1, min(shard_rows, (64 << 20) // (8 * width)))
    keys.close({(r["pivot"], r["step"]): (r["n"], r["a"], r["b"]) for r in counts}, held)
    known = spark.sparkContext.broadcast(keys)
    in_page = max(1, min(256, (1 << 16) // (8 * width)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, distance, salt = (np.array(batch.column(k).to_pylist(), t) for k, t in ((3, np.int64), (4, np.float64), (6, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(known.value.shard(pivot, distance, salt), pa.int64()), *(batch.column(k) for k in range(5))], names=["shard", "id", "label", "v", "pivot", "distance"])

    dealt = keyed.select("id", "label", "v", "pivot", "distance", "step", F.xxhash64("id", "v").alias("salt")).mapInArrow(deal, "shard long, id long, label long, v array<long>, pivot int, distance double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def page() -> pa.RecordBatch:
            shard, ids, labels, v, pivot, distance = map(list, zip(*held, strict=True))
            values = [shard[0], pivot[0], distance[0], distance[-1], *(np.array(x, np.int64).tobytes() for x in (ids, labels)), _stack(v, width).tobytes()]
            held.clear()
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds, strict=True)], names=["shard", "pivot", "least", "most", "ids", "labels", "rows"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == in_page or held[0][0] != row[0] or held[0][4] != row[4]):
                    yield page()
                held.append(row)
        if held:
            yield page()

    by_key = dealt.repartition("shard").sortWithinPartitions("shard", "pivot", "distance", "id")
    pages = stored(by_key.mapInArrow(pack, "shard long, pivot int, least double, most double, ids binary, labels binary, rows binary"))
    return Index(pages, keys, width)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, shard_rows: int = 8192, max_pivots: int = 512,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of an anchor's best ``positives``
    rows of its label, the best ``negatives`` rows of other labels with low % to high % of the positive's score."""
    spark = settle(vectors.sparkSession)
    named = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), is_anchor.alias("asked"))
    rows = stored(named.where("id is not null and label is not null"))
    index = build(rows, shard_rows, max_pivots)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return spark.createDataFrame([], shape)
    anchors = rows.where("asked").groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")
    one = lambda value: F.array(F.lit(value).cast("long"))
    best = stored(index.search(anchors.withColumn("low", one(_LOW)).withColumn("high", one(_HIGH)), True, positives).select("id", F.col("rank").alias("place"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # least and largest score between the shares; whole numbers rounded inwards
    s = F.col("positive_score")
    ranges = best.withColumn("low", F.expr(f"({low} * positive_score + pmod(-{low} * positive_score, 100)) div 100")).withColumn("high", F.expr(f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100"))
    lists = ranges.where(F.col("low") <= F.col("high")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("p"))
    asked = anchors.join(lists, "id").select("id", "label", "v", F.col("p.low").alias("low"), F.col("p.high").alias("high"), F.col("p.place").alias("places"))
    places = asked.select("id", F.posexplode("places").alias("probe", "place"))
    found = index.search(asked.drop("places"), False, negatives).join(places, ["id", "probe"]).join(best, ["id", "place"])
    return found.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), s.alias("positive_score"), F.col("score").alias("negative_score"))
