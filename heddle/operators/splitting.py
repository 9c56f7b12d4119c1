"""Enrichment p-values below what plain permutations reach, by multilevel splitting over sets of one size.

A chain is a set of k features, uniform among those that score at least the current level.  At each level the median of the chains
is the next one: about half of them are above it, these replace the others, and single exchanges of a member that stay above
the level make them independent again.  The probability of a level is the product of the shares; what a score needs is that
product times its own share at its last level.  The shares' binomial variances add up to the error of ln p.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators import panels as P


def scores(places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Enrichment score of each row of sorted places in a ranked list with these weights, as ``panels.enrichment`` defines it."""
    k, n = places.shape[1], len(weights)
    w = weights[places]
    total = w.sum(1, keepdims=True)
    own = np.divide(w, total, out=np.full(w.shape, 1.0 / k), where=total > 0)
    share = np.cumsum(own, 1)
    miss = (places - np.arange(k)) / (n - k) if n > k else np.zeros(places.shape)
    top, low = (share - miss).max(1), (share - own - miss).min(1)
    return np.where(np.round(top, 9) >= -np.round(low, 9), top, low)


def _draw(rng: np.random.Generator, chains: int, n: int, k: int) -> np.ndarray:
    """Uniform k-subsets of range(n), sorted."""
    if k * 4 > n:
        return np.sort(np.argpartition(rng.random((chains, n)), k - 1, axis=1)[:, :k], 1)
    out = np.sort(rng.integers(0, n, (chains, k)), 1)
    while (bad := (np.diff(out, axis=1) == 0).any(1)).any():  # draws with repeats are drawn again, whole
        if bad.mean() > 0.9:
            out[bad] = [np.sort(rng.choice(n, k, replace=False)) for _ in range(int(bad.sum()))]
        else:
            out[bad] = np.sort(rng.integers(0, n, (int(bad.sum()), k)), 1)
    return out


def _mix(rng: np.random.Generator, places: np.ndarray, weights: np.ndarray, level: float, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exchanges of one member until the chains have, on average, taken one for each member."""
    chains, k = places.shape
    n, rows, taken = len(weights), np.arange(chains), 0
    for step in range(20 * k + 200):
        new = places.copy()
        new[rows, rng.integers(0, k, chains)] = rng.integers(0, n, chains)
        new.sort(1)
        fresh = (np.diff(new, axis=1) > 0).all(1)
        found = scores(new, weights)
        good = fresh & (found >= level)
        places, now = np.where(good[:, None], new, places), np.where(good, found, now)
        taken += int(good.sum())
        if step >= 20 and taken >= chains * max(k, 10):
            break
    return places, now


def tail(weights: np.ndarray, k: int, targets: np.ndarray, chains: int = 201, seed: int = 0, start: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """P(score >= target | score >= 0) of uniform k-subsets, and the deviation of its logarithm, for positive targets."""
    rng = np.random.default_rng(seed)
    n = len(weights)
    out, error = np.full(len(targets), np.nan), np.full(len(targets), np.nan)
    if k >= n:
        return np.ones(len(targets)), np.zeros(len(targets))
    plain = np.concatenate([scores(_draw(rng, chains, n, k), weights) for _ in range(start)])
    up = max((plain >= 0).mean(), 1.0 / len(plain))
    variance = (1 - up) / (up * len(plain))
    # the first level needs no chains
    log_p, waiting = 0.0, np.argsort(targets, kind="stable").tolist()
    drawn = _draw(rng, chains, n, k)
    now = scores(drawn, weights)
    while waiting:
        level = float(np.median(now))
        if (now >= level).all():  # ties at the bottom: the next score there is
            above = now[now > level]
            level = float(above.min()) if len(above) else np.inf
        while waiting and targets[waiting[0]] <= level:
            t = waiting.pop(0)
            share = max((now >= targets[t] - 1e-9).mean(), 0.5 / chains)
            out[t] = min(1.0, np.exp(log_p) * share / up)
            error[t] = np.sqrt(variance + (1 - share) / (share * chains))
        if not waiting or not np.isfinite(level):
            break
        keep = np.flatnonzero(now >= level)
        share = len(keep) / chains
        log_p += np.log(share)
        variance += (1 - share) / (share * chains)
        again = keep[np.arange(chains) % len(keep)]
        drawn, now = _mix(rng, drawn[again], weights, level, now[again])
    for t in waiting:  # above all that the chains can reach: rounding of the best score
        share = max((now >= targets[t] - 1e-6).mean(), 0.5 / chains)
        out[t], error[t] = np.exp(log_p) * share / up, np.sqrt(variance + (1 - share) / (share * chains))
    return out, error


def multilevel(stats: DataFrame, sets: DataFrame, panel: list[str], feature: str, stat: str, name: str, chains: int = 201, seed: int = 0, exponent: float = 1.0, least: int = 5, most: int = 500) -> DataFrame:
    """M16 with eps = 0, M27: enrichment (panel, name, size, es, leading_edge) with ``p``, ``log_error`` and ``padj``.

    p is the share of sets of the same size, among those with a score of the same sign, that score at least as far from 0;
    ``log_error`` is the deviation of ln p.  One group per (panel, size) runs the chains of both signs for all its sets; it holds the
    panel's ranked weights and ``chains`` sets of places.  Chains are seeded by panel and size, so a task that runs again gives the same.
    """
    ranked = stats.where(F.col(stat).isNotNull())
    real = P.enrichment(ranked, sets, panel, feature, stat, name, exponent, least, most)
    order = F.array_sort(F.collect_list(F.struct((-F.col(stat)).alias("s"), F.col(feature).alias("f"))))
    lists = ranked.groupBy(*panel).agg(F.transform(order, lambda r: F.pow(F.abs(r["s"]), exponent).cast("double")).alias("weights"))
    asked = real.groupBy(*panel, "size").agg(F.collect_list(F.struct(F.col(name).alias("name"), F.col("es").cast("double").alias("es"))).alias("asked"))
    kinds = ", ".join(f"`{c}` {real.schema[c].dataType.simpleString()}" for c in [*panel, "size"])
    shape = f"{kinds}, `{name}` {real.schema[name].dataType.simpleString()}, p double, log_error double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        weights = np.asarray(pdf["weights"].iloc[0], float)
        asked = sorted(((float(r["es"]), r["name"]) for r in pdf["asked"].iloc[0]), key=lambda r: (r[0], str(r[1])))
        for sign in (1, -1):
            own = [(sign * es, which) for es, which in asked if (es >= 0) == (sign > 0)]
            if own:
                mark = zlib.crc32(repr((seed, sign, *key)).encode())
                p, error = tail(weights[::sign], int(key[-1]), np.array([es for es, _ in own]), chains, mark)
                rows += [[*key, which, float(a), float(b)] for (_, which), a, b in zip(own, p, error, strict=True)]
        return pd.DataFrame(rows, columns=[*panel, "size", name, "p", "log_error"])

    found = asked.join(lists, panel).groupBy(*panel, "size").applyInPandas(run, shape)
    return P.adjusted(real.join(found.drop("size"), [*panel, name]), "p", panel, name)
