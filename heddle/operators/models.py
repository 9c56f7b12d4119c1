"""Model arms: PCA through the smaller of the two product matrices, elastic net, signature model, nested cross-validation, boosted trees.

Dense algebra runs in grouped pandas functions, one group per (panel, repeat, fold), so the tasks of a sweep spread over
the cluster; a panel has hundreds of rows, which bounds a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators import boosting, components


def pca_scores(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and explained share of the standardized varying columns, from the n x n Gram matrix (columns >> rows)."""
    sd = x.std(0)
    z = (x[:, sd > 0] - x[:, sd > 0].mean(0)) / sd[sd > 0]
    k = min(k, len(x) - 1, z.shape[1])
    values, vectors = np.linalg.eigh(z @ z.T)
    order = np.argsort(values)[::-1][:k]
    kept = np.clip(values[order], 0, None)
    return vectors[:, order] * np.sqrt(kept), kept / max(values.sum(), 1e-300)


def pca(df: DataFrame, panel: list[str], cell: str, vector: str, k: int = 20) -> DataFrame:
    """(panel, cell, component, score, explained); the sign makes the largest score positive.

    With few columns, panels of any size are solved from their columns' products (``components``, which reads df three times); with many,
    small panels are a group each, and larger ones go by ``pca_any``.
    """
    most, widest = shape_of(df, panel, vector)
    if widest <= components.FEW_COLUMNS:
        return components.tall(df, panel, cell, vector, k)
    if most > 2_000:
        return pca_any(df, panel, cell, vector, k)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cell)
        scores, share = pca_scores(np.array(pdf[vector].tolist(), float), k)
        scores = scores * np.sign(scores[np.abs(scores).argmax(0), range(scores.shape[1])])
        n, m = scores.shape
        return pd.DataFrame({**{p: [v] * (n * m) for p, v in zip(panel, key, strict=True)}, cell: np.repeat(pdf[cell].to_numpy(), m), "component": np.tile(np.arange(m), n), "score": scores.ravel(), "explained": np.tile(share, n)})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*panel, cell])
    return df.groupBy(*panel).applyInPandas(run, f"{kinds}, component int, score double, explained double")


def shape_of(df: DataFrame, panel: list[str], vector: str) -> tuple[int, int]:
    """Rows of the largest panel and columns of the widest one."""
    sizes = df.groupBy(*panel).agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("p"))
    return tuple(v or 0 for v in sizes.agg(F.max("n"), F.max("p")).first())


def pca_any(df: DataFrame, panel: list[str], cell: str, vector: str, k: int = 20, size: int = 512) -> DataFrame:
    """M13 for panels of any shape: from products of columns where panels have more cells than columns, else from ``pca_blocks``."""
    most, widest = shape_of(df, panel, vector)
    if widest <= min(most, components.MOST_COLUMNS):
        return components.tall(df, panel, cell, vector, k)
    return pca_blocks(feature_blocks(df, panel, cell, vector, size), panel, cell, k)


def feature_blocks(df: DataFrame, panel: list[str], cell: str, vector: str, size: int = 512) -> DataFrame:
    """(panel, cell, block, values): the vectors cut into blocks of features."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(vector) - 1), F.lit(size))
    return df.select(*panel, cell, vector, F.posexplode(starts).alias("block", "__at")).select(*panel, cell, "block", F.slice(vector, F.col("__at") + 1, size).alias("values"))


def long_blocks(df: DataFrame, panel: list[str], cell: str, feature: str, value: str, blocks: int = 128) -> DataFrame:
    """The same from (panel, cell, feature, value) rows: features are dealt to blocks by hash and stand in their order there.

    Every cell of a panel must have every feature; a feature that some cell lacks fails where the block is stacked.
    """
    dealt = df.withColumn("block", F.pmod(F.xxhash64(feature), F.lit(blocks)).cast("int"))
    return dealt.groupBy(*panel, cell, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct(feature, value))), lambda s: s[value].cast("double")).alias("values"))


def pca_blocks(blocks: DataFrame, panel: list[str], cell: str, k: int = 20, salts: int = 8, rows: int = 256) -> DataFrame:
    """M13 for panels whose cells x features matrix fits no task: (panel, cell, component, score, explained), as ``pca``.

    Each block of features is standardized on its own, and gives its part of the cells x cells products of all features; parts
    are added up in ``salts`` groups and then over these, in strips of ``rows`` rows, so that a task holds one block or one strip of
    products of a few parts.  The eigenproblem of a panel has the size of its cells; only there all products meet.
    """
    kinds = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in panel)
    own = blocks.schema[cell].dataType.simpleString()
    strip = f"{kinds + ', ' if panel else ''}salt int, strip int, features long, products binary, cells array<{own}>"

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cell, kind="stable")
        x = np.stack(pdf["values"].to_list()).astype(float)
        x -= x.mean(0)
        sd = np.sqrt((x**2).mean(0))
        live = sd > 1e-12 * np.maximum(1.0, np.abs(x).max(0, initial=0))
        z = x[:, live] / sd[live]
        return pd.DataFrame([[*key[: len(panel)], key[-1] % salts, at // rows, int(live.sum()), (z[at : at + rows] @ z.T).tobytes(), pdf[cell].to_list()] for at in range(0, len(z), rows)], columns=[*panel, "salt", "strip", "features", "products", "cells"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["products"].iloc[0]) // 8)
        for part in pdf["products"]:
            total += np.frombuffer(part)
        salt = key[-2] if len(key) == len(panel) + 2 else 0
        return pd.DataFrame([[*key[: len(panel)], salt, key[-1], int(pdf["features"].sum()), total.tobytes(), pdf["cells"].iloc[0]]], columns=[*panel, "salt", "strip", "features", "products", "cells"])

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("strip")
        cells = list(pdf["cells"].iloc[0])
        n, m = len(cells), int(pdf["features"].iloc[0])
        gram = np.concatenate([np.frombuffer(p).reshape(-1, n) for p in pdf["products"]])
        most = min(k, n - 1, m)
        values, vectors = np.linalg.eigh(gram)
        kept = np.argsort(values)[::-1][:most]
        scores = vectors[:, kept] * np.sqrt(np.clip(values[kept], 0, None))
        scores *= np.sign(scores[np.abs(scores).argmax(0), range(most)]) if most else 1
        share = np.clip(values[kept], 0, None) / max(values.sum(), 1e-300)
        return pd.DataFrame({**{p: [v] * (n * most) for p, v in zip(panel, key, strict=True)}, cell: np.repeat(np.array(cells, object), most), "component": np.tile(np.arange(most), n), "score": scores.ravel(), "explained": np.tile(share, n)})

    parts = blocks.groupBy(*panel, "block").applyInPandas(products, strip)
    parts = parts.groupBy(*panel, "salt", "strip").applyInPandas(add, strip)
    whole = parts.groupBy(*panel, "strip").applyInPandas(add, strip)
    return whole.groupBy(*panel).applyInPandas(solve, f"{kinds + ', ' if panel else ''}`{cell}` {own}, component int, score double, explained double")


def proximal(times: Callable[[np.ndarray], np.ndarray], c: np.ndarray, top: float, alpha: np.ndarray, l1: np.ndarray, steps: int = 2000, start: np.ndarray | None = None) -> np.ndarray:
    """Min w'Cw / 2 - c'w + alpha l1 |w|_1 + alpha (1 - l1) / 2 |w|^2 for all grid points at once, a column each.

    Accelerated proximal gradients with restarts; ``times`` multiplies with C and ``top`` bounds its eigenvalues.  A c with
    columns has a target for each grid point.
    """
    ridge, lasso = alpha * (1 - l1), alpha * l1
    rate = 1 / (top + ridge + 1e-12)
    c = c[:, None] if c.ndim == 1 else c
    w = v = np.zeros((len(c), len(alpha))) if start is None else start
    t = 1.0
    for _ in range(steps):
        g = v - rate * (times(v) - c + ridge * v)
        new = np.sign(g) * np.maximum(np.abs(g) - rate * lasso, 0)
        if ((v - new) * (new - w)).sum() > 0:
            t, v = 1.0, w  # overshot: start the acceleration anew
            g = v - rate * (times(v) - c + ridge * v)
            new = np.sign(g) * np.maximum(np.abs(g) - rate * lasso, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t_new * (new - w)
        done = np.abs(new - w).max(initial=0) < 1e-7 * (1 + np.abs(new).max(initial=0))
        w, t = new, t_new
        if done:
            break
    return w


def fit_moments(m: np.ndarray, alpha: np.ndarray, l1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and weights of elastic nets on standardized columns, from the products of (1, x, y)."""
    n, mx, my = m[0, 0], m[0, 1:-1] / m[0, 0], m[0, -1] / m[0, 0]
    cov = m[1:-1, 1:-1] / n - np.outer(mx, mx)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-9 * (1 + np.abs(mx)), sd, np.inf)  # a constant column has no weight
    z = cov / np.outer(sd, sd)
    w = proximal(lambda v: z @ v, (m[1:-1, -1] / n - mx * my) / sd, float(np.linalg.eigvalsh(z)[-1]) if len(z) else 0.0, alpha, l1) / sd[:, None]
    return my - mx @ w, w


def squared_error(m: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of squared errors of each model on the rows that have these products."""
    v = np.vstack([b[None, :], w, -np.ones((1, len(b)))])
    return np.maximum(((m @ v) * v).sum(0), 0)


def elastic_path(x: np.ndarray, y: np.ndarray, alpha: np.ndarray, l1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from rows; with more columns than rows the products of the columns are never formed."""
    if x.shape[1] <= len(y):
        z = np.column_stack([np.ones(len(y)), x, y])
        return fit_moments(z.T @ z, alpha, l1)
    mean, sd, n = x.mean(0), x.std(0), len(y)
    sd = np.where(sd > 1e-9 * (1 + np.abs(mean)), sd, np.inf)
    z = (x - mean) / sd
    w = proximal(lambda v: z.T @ (z @ v) / n, z.T @ (y - y.mean()) / n, float(np.linalg.eigvalsh(z @ z.T)[-1]) / n, alpha, l1) / sd[:, None]
    return y.mean() - mean @ w, w


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1: float) -> Callable[[np.ndarray], np.ndarray]:
    """Minimises |y - Xw|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) / 2 |w|^2 on standardized columns."""
    b, w = elastic_path(x, y, np.array([alpha]), np.array([l1]))
    return lambda v: b[0] + v @ w[:, 0]


def ranks(x: np.ndarray) -> np.ndarray:
    return pd.DataFrame(x).rank(method="average").to_numpy()


def signature_model(x: np.ndarray, y: np.ndarray, top: int) -> Callable[[np.ndarray], np.ndarray]:
    """Features of highest |Spearman| with -y, standardized and weighted by it, then a line through the score."""
    rx, ry = ranks(x) - (len(y) + 1) / 2, ranks(-y[:, None]) - (len(y) + 1) / 2
    scale = np.sqrt((rx**2).sum(0) * (ry**2).sum())
    rho = np.divide((rx * ry).sum(0), scale, out=np.zeros(x.shape[1]), where=scale > 0)
    best = np.lexsort((np.arange(len(rho)), -np.abs(rho)))[:top]
    mean, sd = x[:, best].mean(0), x[:, best].std(0)
    sd = np.where(sd > 0, sd, 1)
    score = lambda v: (v[:, best] - mean) / sd @ rho[best]
    s = score(x)
    slope = ((s - s.mean()) * (y - y.mean())).sum() / max(((s - s.mean()) ** 2).sum(), 1e-300) if s.std() > 0 else 0.0
    return lambda v: (score(v) - s.mean()) * slope + y.mean()


def signature_path(x: np.ndarray, y: np.ndarray, tops: list[int], at: np.ndarray, rx: np.ndarray | None = None) -> np.ndarray:
    """Predictions for the rows ``at`` of the signature models with these numbers of features, a column each: one ranking serves all.

    ``rx`` are the centred ranks of x, which do not depend on y.
    """
    rx = ranks(x) - (len(y) + 1) / 2 if rx is None else rx
    ry = ranks(-y[:, None])[:, 0] - (len(y) + 1) / 2
    scale = np.sqrt((rx**2).sum(0) * (ry**2).sum())
    rho = np.divide(ry @ rx, scale, out=np.zeros(x.shape[1]), where=scale > 0)
    best = np.lexsort((np.arange(len(rho)), -np.abs(rho)))[: max(tops)]
    mean, sd = x[:, best].mean(0), x[:, best].std(0)
    sd = np.where(sd > 0, sd, 1)
    z, v, weight = (x[:, best] - mean) / sd, (at[:, best] - mean) / sd, rho[best]
    found = {}
    for m in {min(t, len(best)) for t in tops}:
        s = z[:, :m] @ weight[:m]
        slope = ((s - s.mean()) * (y - y.mean())).sum() / max(((s - s.mean()) ** 2).sum(), 1e-300) if s.std() > 0 else 0.0
        found[m] = (v[:, :m] @ weight[:m] - s.mean()) * slope + y.mean()
    return np.column_stack([found[min(t, len(best))] for t in tops])


def signature_out_of_fold(x: np.ndarray, ys: np.ndarray, groups: np.ndarray, outer: int, inner: int, seed: int) -> np.ndarray:
    """M05 for the signature model: out-of-fold predictions of several targets, the columns of ``ys``.

    Folds are the same for all, so features are ranked once for each of them.
    """
    tops = [g["top"] for g in MODELS["signature"][1]]
    fold, out = deal(groups, outer, seed), np.zeros(ys.shape)
    centred = lambda part: ranks(part) - (len(part) + 1) / 2
    for f in np.unique(fold):
        tr, te = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        part, loss = deal(groups[tr], inner, seed), np.zeros((ys.shape[1], len(tops)))
        for i in np.unique(part):
            fit, own = tr[part != i], tr[part == i]
            rx = centred(x[fit])
            for k in range(ys.shape[1]):
                loss[k] += ((signature_path(x[fit], ys[fit, k], tops, x[own], rx) - ys[own, k, None]) ** 2).sum(0)
        rx = centred(x[tr])
        for k in range(ys.shape[1]):
            out[te, k] = signature_path(x[tr], ys[tr, k], [tops[int(np.argmin(loss[k]))]], x[te], rx)[:, 0]
    return out


def mean_model(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """M07."""
    return lambda v: np.full(len(v), y.mean())


#: What the inner folds choose from: grids, and for boosted trees a seeded random search.
MODELS: dict[str, tuple[Callable, list[dict]]] = {
    "mean": (mean_model, [{}]),
    "enet": (elastic_net, [{"alpha": float(a), "l1": l1} for a in np.logspace(-2, 1, 7) for l1 in (0.2, 0.5, 0.9)]),
    "signature": (signature_model, [{"top": k} for k in (25, 50, 100, 200, 500)]),
    "boosted": (boosting.boosted_model, boosting.draw_settings(10, 42)),
    "boosted_small": (boosting.boosted_model, boosting.draw_settings(3, 42, rounds=15)),
}


def make(name: str) -> tuple[Callable, list[dict]]:
    """A known model, or an error with the names there are."""
    if name not in MODELS:
        raise KeyError(f"unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name]


def deal(groups: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Fold of each row: unique groups shuffled by seed, in near-equal parts; no group is in two folds."""
    unique = np.unique(groups)
    if len(unique) < 2:
        raise ValueError("fewer than two groups cannot be split")
    shuffled = np.random.default_rng(seed).permutation(unique)
    fold = {g: f for f, part in enumerate(np.array_split(shuffled, min(k, len(unique)))) for g in part}
    return np.array([fold[g] for g in groups])


def tune(name: str, x: np.ndarray, y: np.ndarray, groups: np.ndarray, inner: int, seed: int) -> dict:
    """The grid point of least mean squared error over inner folds."""
    model, grid = make(name)
    if len(grid) == 1:
        return grid[0]
    fold = deal(groups, inner, seed)
    if name == "enet":  # the whole grid at once
        alpha, l1 = np.array([g["alpha"] for g in grid]), np.array([g["l1"] for g in grid])
        paths = ((elastic_path(x[fold != f], y[fold != f], alpha, l1), fold == f) for f in np.unique(fold))
        return grid[int(np.argmin(sum(((b[None, :] + x[own] @ w - y[own, None]) ** 2).sum(0) for (b, w), own in paths)))]
    if name == "signature":
        paths = ((signature_path(x[fold != f], y[fold != f], [g["top"] for g in grid], x[fold == f]), y[fold == f]) for f in np.unique(fold))
        return grid[int(np.argmin(sum(((p - t[:, None]) ** 2).sum(0) for p, t in paths)))]
    loss = [sum(((model(x[fold != f], y[fold != f], **g)(x[fold == f]) - y[fold == f]) ** 2).sum() for f in np.unique(fold)) for g in grid]
    return grid[int(np.argmin(loss))]


def out_of_fold(name: str, x: np.ndarray, t: np.ndarray, g: np.ndarray, outer: int, inner: int, seed: int, flat_seed: int, flat: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each row's fold and its prediction from the other folds."""
    fold, out = deal(g, outer, seed), np.zeros(len(t))
    all_in = tune(name, x, t, g, inner, flat_seed) if flat else None
    for f in np.unique(fold):
        tr, te = fold != f, fold == f
        params = all_in or tune(name, x[tr], t[tr], g[tr], inner, seed)
        out[te] = make(name)[0](x[tr], t[tr], **params)(x[te])
    return fold, out


def nested_cv(df: DataFrame, panel: list[str], group: str, y: str, vector: str, name: str, outer: int = 5, inner: int = 4, repeats: int = 1, seed: int = 0, flat: bool = False, ident: str | None = None) -> DataFrame:
    """Out-of-fold predictions of each (panel, repeat); tuning inside the training folds.

    ``flat`` tunes once on all rows, the optimistic way (M26).  A panel that is too small gives one row with ``ok`` false and
    the error, and the sweep goes on (E06).
    """
    make(name)
    ident = ident or group
    tasks = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in panel)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        *own, repeat = key
        base = dict(zip(panel, own, strict=True)) | {"repeat": repeat}
        try:
            pdf = pdf.sort_values([group, ident], kind="stable")
            x, t, g = np.array(pdf[vector].tolist(), float), pdf[y].to_numpy(float), pdf[group].to_numpy()
            fold, out = out_of_fold(name, x, t, g, outer, inner, seed + repeat, seed, flat)
            return pd.DataFrame({k: [v] * len(t) for k, v in base.items()} | {"id": pdf[ident].astype(str).to_numpy(), "y": t, "y_pred": out, "fold": fold, "ok": True, "error": None})
        except (ValueError, np.linalg.LinAlgError) as e:
            return pd.DataFrame([base | {"id": None, "y": None, "y_pred": None, "fold": None, "ok": False, "error": str(e)}])

    return tasks.groupBy(*panel, "repeat").applyInPandas(run, f"{kinds}, repeat int, id string, y double, y_pred double, fold int, ok boolean, error string")


def optimism(df: DataFrame, panel: list[str], group: str, y: str, vector: str, name: str, outer: int = 5, inner: int = 4, repeats: int = 1, seed: int = 0, ident: str | None = None) -> DataFrame:
    """What tuning on all rows feigns: (panel, flat, nested, optimism) of Spearman, RMSE and R2, mean over repeats.

    ``flat`` chose its parameters with the held-out rows in sight, ``nested`` did not; optimism is by how much flat looks better.
    """
    from heddle.operators.evaluate import regression_metrics

    def measured(flat: bool) -> DataFrame:
        done = nested_cv(df, panel, group, y, vector, name, outer, inner, repeats, seed, flat, ident).where("ok").withColumn("y_pred", F.round("y_pred", 9))
        met = regression_metrics(done, [*panel, "repeat"])
        kind = "flat" if flat else "nested"
        return met.groupBy(*panel).agg(*(F.avg(m).alias(f"{kind}_{m}") for m in ("spearman", "rmse", "r2")))

    both = measured(True).join(measured(False), panel)
    return both.select("*", (F.col("flat_spearman") - F.col("nested_spearman")).alias("optimism_spearman"), (F.col("nested_rmse") - F.col("flat_rmse")).alias("optimism_rmse"), (F.col("flat_r2") - F.col("nested_r2")).alias("optimism_r2"))


def spark_elastic_net(alpha: float, l1: float, sd_y: float) -> tuple[float, float]:
    """Spark's (regParam, elasticNetParam) for the penalty above; Spark scales the label by its deviation first."""
    reg = alpha * l1 + alpha * (1 - l1) * sd_y
    return reg, alpha * l1 / reg if reg else 0.0


def boosted_trees(df: DataFrame, features: list[str], y: str, seed: int = 0, rounds: int = 10, depth: int = 3):
    """A boosted tree regression by pyspark.ml."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTRegressor(labelCol=y, maxIter=rounds, maxDepth=depth, seed=seed)]).fit(df)


def regression_tree(x: np.ndarray, y: np.ndarray, depth: int) -> Callable[[np.ndarray], np.ndarray]:
    """The greedy tree of least squared error over all columns; the first column and threshold win ties."""
    n, mean = len(y), y.mean()
    if depth == 0 or n < 2:
        return lambda v: np.full(len(v), mean)
    order = np.argsort(x, axis=0, kind="stable")
    xs, left, k = np.take_along_axis(x, order, 0), np.cumsum((y - mean)[order], axis=0)[:-1], np.arange(1, n)[:, None]
    # the deviations' sum is 0, so both sides have the same sum but for its sign
    gain = np.where(xs[1:] > xs[:-1], left**2 / k + left**2 / (n - k), 0.0)
    j, row = divmod(int(gain.T.argmax()), n - 1)
    if gain[row, j] <= 1e-12:
        return lambda v: np.full(len(v), mean)
    at = xs[row, j]
    low = x[:, j] <= at
    below, above = regression_tree(x[low], y[low], depth - 1), regression_tree(x[~low], y[~low], depth - 1)
    return lambda v: np.where(v[:, j] <= at, below(v), above(v))


def boosted_panels(df: DataFrame, panel: list[str], cell: str, y: str, vector: str, rounds: int = 10, depth: int = 3, rate: float = 0.1) -> DataFrame:
    """M18 per panel: (panel, cell, y, y_pred) of trees over all components, the first in full and the others by ``rate``."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cell)
        x, t = np.array(pdf[vector].tolist(), float), pdf[y].to_numpy(float)
        out = np.zeros(len(t))
        for k in range(rounds):
            out += (rate if k else 1.0) * regression_tree(x, t - out, depth)(x)
        return pd.DataFrame({**{p: [v] * len(t) for p, v in zip(panel, key, strict=True)}, cell: pdf[cell].to_numpy(), "y": t, "y_pred": out})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*panel, cell])
    return df.groupBy(*panel).applyInPandas(run, f"{kinds}, y double, y_pred double")


def pooled(df: DataFrame, cell: str, drug: str, disease: str | None = None, cohort: str = "both", least_lines: int = 5) -> DataFrame:
    """The rows of a modelling set after all filters; errors if nothing is left to model."""
    from heddle.operators.panels import cohort_filter, supported

    if cohort.lower() not in ("both", "a", "b"):
        raise ValueError(f"unknown cohort {cohort!r}")
    rows = cohort_filter(df, cohort)
    rows = rows.where(F.col("disease") == disease) if disease else rows
    rows = supported(rows, drug, cell, least_lines)
    if rows.select(cell).distinct().limit(2).count() < 2:
        raise ValueError("fewer than two cells, or no drug with enough of them")
    return rows
