"""Boosted trees over binned columns, with second-order gains; distributed over rows, or in one panel inside nested CV.

Both grow trees level by level from histograms: the sums of gradients and second derivatives per (node, column, bin).  Over
many rows each task adds up its own histograms, one aggregation adds up the tasks', and the driver takes the best split of each
node; its size is nodes x columns x bins, however many rows there are.  Rows and columns of a tree are chosen by hash, so a
task that runs again gives the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """What a boosted model is made with."""

    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    subsample: float = 1.0
    colsample: float = 1.0
    min_child_weight: float = 1.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    seed: int = 0


@dataclass
class Tree:
    """Complete binary levels: node k has the children 2k + 1 and 2k + 2; a leaf has column -1."""

    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def node(self, binned: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after so many levels."""
        at = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(depth):
            c = self.column[at]
            at = np.where(c < 0, at, 2 * at + 1 + (binned[rows, np.maximum(c, 0)] > self.bin[at]))
        return at


def mark(seed: int, *ids: object) -> float:
    """A number in [0, 1) from a hash."""
    return xxhash.xxh64_intdigest(repr(ids).encode(), seed) / 2**64


def chosen_columns(p: int, s: Settings, tree: int) -> np.ndarray:
    """The columns of a tree, by hash, at least one."""
    order = np.argsort([mark(s.seed, tree, "column", k) for k in range(p)], kind="stable")
    return np.sort(order[: max(1, round(s.colsample * p))])


def gains(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    """Gain of cutting after each bin, of histograms (node, column, bin); impossible cuts are -inf.

    score(G, H) = G^2 / (H + lambda); the gain is half of what the two sides have more than the node, less gamma.
    """
    gl, hl = np.cumsum(g, -1), np.cumsum(h, -1)
    gt, ht = gl[..., -1:], hl[..., -1:]
    gr, hr = gt - gl, ht - hl
    score = lambda a, b: a * a / (b + s.reg_lambda + 1e-12)
    gain = 0.5 * (score(gl, hl) + score(gr, hr) - score(gt, ht)) - s.gamma
    able = (hl >= max(s.min_child_weight, 1e-9)) & (hr >= max(s.min_child_weight, 1e-9))
    able[..., -1] = False
    return np.where(able, gain, -np.inf)


def split_level(tree: Tree, level: int, g: np.ndarray, h: np.ndarray, columns: np.ndarray, s: Settings) -> None:
    """Puts the best split of each node of a level into the tree; ties go to the first column and bin."""
    first = 2**level - 1
    gain = gains(g, h, s)
    for k in range(len(gain)):
        if first and tree.column[(first + k - 1) // 2] < 0:
            continue  # its parent is a leaf
        best = int(np.argmax(np.round(gain[k], 9)))
        c, b = divmod(best, gain.shape[-1])
        if gain[k, c, b] > 1e-9:
            tree.column[first + k], tree.bin[first + k] = columns[c], b
            gl, hl, gt, ht = g[k, c, : b + 1].sum(), h[k, c, : b + 1].sum(), g[k, c].sum(), h[k, c].sum()
            for side, (a, w) in enumerate(((gl, hl), (gt - gl, ht - hl))):
                tree.value[2 * (first + k) + 1 + side] = -s.rate * a / (w + s.reg_lambda + 1e-12)


def empty_tree(depth: int) -> Tree:
    size = 2 ** (depth + 1) - 1
    return Tree(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size))


def histograms(binned: np.ndarray, node: np.ndarray, g: np.ndarray, nodes: int, bins: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and counts (the second derivative of squared error is 1) per (node, column, bin); nodes below 0 are out."""
    on = node >= 0
    spot = (node[on, None] * len(columns) + np.arange(len(columns))) * bins + binned[on][:, columns]
    size = nodes * len(columns) * bins
    shape = (nodes, len(columns), bins)
    return np.bincount(spot.ravel(), np.repeat(g[on], len(columns)), size).reshape(shape), np.bincount(spot.ravel(), minlength=size).astype(float).reshape(shape)


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts of each column at quantiles; a value is in the bin of how many cuts lie below it."""
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins, method="lower")) for c in x.T]


def binned_by(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1) if len(edges) else np.zeros((len(x), 0), np.int64)


class Forest:
    """Trees over binned columns."""

    def __init__(self, edges: list[np.ndarray], base: float, depth: int):
        self.edges, self.base, self.depth, self.trees = edges, base, depth, []

    def raw(self, binned: np.ndarray) -> np.ndarray:
        out = np.full(len(binned), self.base)
        for tree in self.trees:
            out += tree.value[tree.node(binned, self.depth)]
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.raw(binned_by(np.asarray(x, float), self.edges))


def fit_panel(x: np.ndarray, y: np.ndarray, s: Settings, bins: int = 64) -> Forest:
    """A forest of one panel's rows."""
    edges = edges_of(x, bins)
    binned = binned_by(x, edges)
    width = max((len(e) for e in edges), default=0) + 1
    forest, now = Forest(edges, float(y.mean()), s.depth), np.full(len(y), y.mean())
    for t in range(s.rounds):
        rows = np.flatnonzero([s.subsample >= 1 or mark(s.seed, t, "row", k) < s.subsample for k in range(len(y))])
        columns, tree = chosen_columns(x.shape[1], s, t), empty_tree(s.depth)
        g = now[rows] - y[rows]
        for level in range(s.depth):
            at, first = tree.node(binned[rows], level), 2**level - 1
            live = np.where(at >= first, at - first, -1)  # rows of leaves above stay where they are
            if (live < 0).all():
                break
            split_level(tree, level, *histograms(binned[rows], live, g, 2**level, width, columns), columns, s)
        now += tree.value[tree.node(binned, s.depth)]
        forest.trees.append(tree)
        if tree.column[0] < 0 and s.subsample >= 1 and s.colsample >= 1:
            break  # nothing left to gain
    return forest


#: The ranges of the random search, (kind, low, high); whole numbers stop before high.
RANGES = {
    "rounds": ("whole", 100, 400), "depth": ("whole", 2, 4), "rate": ("real", 0.01, 0.16), "subsample": ("real", 0.6, 1.0), "colsample": ("real", 0.5, 1.0),
    "min_child_weight": ("whole", 3, 10), "reg_lambda": ("real", 1.0, 6.0), "gamma": ("real", 0.0, 0.5),
}


def draw_settings(n: int, seed: int, **fixed: object) -> list[dict]:
    """The settings of a seeded random search; ``fixed`` ones are not drawn."""
    rng = np.random.default_rng(seed)
    draw = lambda kind, low, high: int(rng.integers(low, high)) if kind == "whole" else float(rng.uniform(low, high))
    return [{name: draw(*how) for name, how in RANGES.items()} | fixed for _ in range(n)]


def boosted_model(x: np.ndarray, y: np.ndarray, **settings) -> Callable[[np.ndarray], np.ndarray]:
    """M18 as one of ``models.MODELS``."""
    return fit_panel(x, y, Settings(**settings))


def fit(df: DataFrame, vector: str, y: str, ident: str, s: Settings, bins: int = 64) -> Forest:
    """M18 over all rows of a table (ident, vector, y): a job per level of each tree, none that gathers rows.

    Cuts are approximate quantiles of each column (relative rank error 1 / (100 bins)).
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(y).isNotNull()).select(F.col(ident).cast("string").alias("id"), F.col(vector).alias("x"), F.col(y).cast("double").alias("y"))
    n, base, width = rows.agg(F.count("*"), F.avg("y"), F.max(F.size("x"))).first()
    if not n:
        return Forest([], 0.0, s.depth)
    at = [k / bins for k in range(1, bins)]
    found = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.percentile_approx("v", at, 100 * bins).alias("cuts")).collect()
    cuts = {r["k"]: np.unique(np.array(r["cuts"], float)) for r in found}
    forest = Forest([cuts[k] for k in range(width)], float(base), s.depth)
    size = max(map(len, forest.edges)) + 1

    def level_sums(tree: Tree, level: int, t: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = rows.sparkSession.sparkContext.broadcast((forest, tree))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, now = sent.value
            total_g, total_h = np.zeros((2**level, len(columns), size)), np.zeros((2**level, len(columns), size))
            for batch in batches:
                ids = batch.column(0).to_pylist()
                keep = np.flatnonzero([s.subsample >= 1 or mark(s.seed, t, "row", i) < s.subsample for i in ids])
                if not len(keep):
                    continue
                binned = binned_by(np.array(batch.column(1).to_pylist(), float)[keep], model.edges)
                g = model.raw(binned) - np.array(batch.column(2).to_pylist(), float)[keep]
                at, first = now.node(binned, level), 2**level - 1
                a, b = histograms(binned, np.where(at >= first, at - first, -1), g, 2**level, size, columns)
                total_g, total_h = total_g + a, total_h + b
            for node in range(2**level):
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([total_g[node].ravel()], pa.list_(pa.float64())), pa.array([total_h[node].ravel()], pa.list_(pa.float64()))], names=["node", "g", "h"])

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[key[0], np.sum(np.stack(pdf["g"].to_list()), 0), np.sum(np.stack(pdf["h"].to_list()), 0)]], columns=["node", "g", "h"])

        shape = "node int, g array<double>, h array<double>"
        sums = rows.mapInArrow(run, shape).groupBy("node").applyInPandas(add, shape).collect()
        g, h = np.zeros((2**level, len(columns), size)), np.zeros((2**level, len(columns), size))
        for r in sums:
            g[r["node"]], h[r["node"]] = (np.array(r[c]).reshape(len(columns), size) for c in ("g", "h"))
        return g, h

    for t in range(s.rounds):
        columns, tree = chosen_columns(width, s, t), empty_tree(s.depth)
        for level in range(s.depth):
            g, h = level_sums(tree, level, t, columns)
            if not h.any():
                break
            split_level(tree, level, g, h, columns, s)
        forest.trees.append(tree)
    return forest


def predict(df: DataFrame, vector: str, forest: Forest, name: str = "y_pred") -> DataFrame:
    """Adds the forest's prediction; null for a null vector."""
    sent = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        some = x.notna()
        out = pd.Series(np.full(len(x), np.nan), index=x.index)
        if some.any():
            out[some] = sent.value(np.stack(x[some].to_list()).astype(float))
        return out

    return df.withColumn(name, F.when(F.col(vector).isNotNull(), apply(vector)))
