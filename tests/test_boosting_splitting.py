"""Histogram boosting against an exact search, multilevel splitting against enumeration, block PCA against the dense one."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import boosting as B
from heddle.operators import models as M
from heddle.operators import panels as P
from heddle.operators import splitting as S


def exact_tree(binned, g, columns, s, depth, path=0, out=None, value=0.0):
    """The same trees by trying every cut of every column on the rows themselves: {node: (column, bin)} and leaf values."""
    out = {} if out is None else out
    best = None
    score = lambda v: v.sum() ** 2 / (len(v) + s.reg_lambda + 1e-12)
    if depth:
        for c in columns:
            for b in range(int(binned[:, c].max(initial=0))):
                left, right = g[binned[:, c] <= b], g[binned[:, c] > b]
                if min(len(left), len(right)) < max(s.min_child_weight, 1e-9):
                    continue
                gain = round(0.5 * (score(left) + score(right) - score(g)) - s.gamma, 9)
                if gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, c, b)
    if best is None:
        out[path] = ("leaf", value)
        return out
    _, c, b = best
    out[path] = (int(c), b)
    for side, on in enumerate((binned[:, c] <= b, binned[:, c] > b)):
        exact_tree(binned[on], g[on], columns, s, depth - 1, 2 * path + 1 + side, out, -s.rate * g[on].sum() / (on.sum() + s.reg_lambda + 1e-12))
    return out


def data(n=200, p=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 2] = rng.integers(0, 3, n)
    return x, np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 2] * (x[:, 1] > 0) + rng.normal(size=n) * 0.1


SETTINGS = B.Settings(rounds=4, depth=3, rate=0.3, subsample=0.8, colsample=0.7, min_child_weight=4, reg_lambda=2.0, gamma=0.05, seed=3)


def test_splits_equal_an_exact_search():
    x, y = data()
    forest = B.fit_panel(x, y, SETTINGS, bins=16)
    binned, now = B.binned_by(x, forest.edges), np.full(len(y), y.mean())
    for t, tree in enumerate(forest.trees):
        rows = [k for k in range(len(y)) if B.mark(3, t, "row", k) < 0.8]
        columns = B.chosen_columns(5, SETTINGS, t)
        assert len(columns) == 4 and 0.6 * len(y) < len(rows) < len(y)
        want = exact_tree(binned[rows], (now - y)[rows], columns, SETTINGS, 3)
        for node, what in want.items():
            if what[0] == "leaf":
                assert tree.column[node] == -1 and abs(tree.value[node] - what[1]) < 1e-12
            else:
                assert (tree.column[node], tree.bin[node]) == what
        now += tree.value[tree.node(binned, 3)]
    assert np.allclose(forest(x), now) and ((y - now) ** 2).mean() < 0.5 * y.var()


def test_distributed_forest_equals_the_panel(spark):
    x, y = data(400)
    df = spark.createDataFrame([(str(k), v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "id string, x array<double>, y double").repartition(3)
    s = B.Settings(rounds=3, depth=3, rate=0.3, min_child_weight=4, reg_lambda=2.0, colsample=0.7, seed=3)
    spread = B.fit(df, "x", "y", "id", s, bins=16)
    binned, now = B.binned_by(x, spread.edges), np.full(len(y), y.mean())
    for t, tree in enumerate(spread.trees):
        for node, what in exact_tree(binned, now - y, B.chosen_columns(5, s, t), s, 3).items():
            assert (tree.column[node] == -1 and abs(tree.value[node] - what[1]) < 1e-9) if what[0] == "leaf" else (tree.column[node], tree.bin[node]) == what
        now += tree.value[tree.node(binned, 3)]
    got = {r["id"]: r["y_pred"] for r in B.predict(df, "x", spread).collect()}
    assert all(abs(got[str(k)] - v) < 1e-9 for k, v in enumerate(now))
    part = B.fit(df, "x", "y", "id", SETTINGS, bins=16)
    assert ((part(x) - y) ** 2).mean() < 0.6 * y.var() and B.fit(df.limit(0), "x", "y", "id", s).trees == []
    assert B.predict(df.select("id", F.lit(None).cast("array<double>").alias("x")), "x", spread).where("y_pred is not null").count() == 0


def test_boosted_arm_of_nested_cv(spark):
    x, y = data(90)
    df = spark.createDataFrame([("p", f"c{k}", v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "panel string, cell string, x array<double>, y double")
    found = M.nested_cv(df, ["panel"], "cell", "y", "x", "boosted_small", 3, 2).collect()
    assert len(found) == 90 and all(r["ok"] for r in found)
    err = np.mean([(r["y"] - r["y_pred"]) ** 2 for r in found])
    assert err < 0.8 * y.var()
    assert len(M.MODELS["boosted"][1]) == 10 and all(100 <= g["rounds"] < 400 and 2 <= g["depth"] < 4 and 3 <= g["min_child_weight"] < 10 for g in M.MODELS["boosted"][1])
    assert B.draw_settings(3, 1) == B.draw_settings(3, 1) != B.draw_settings(3, 2)


# ---- multilevel p-values


def test_scores_equal_the_running_sum():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(6, 30))
        k = int(rng.integers(1, n))
        w = rng.random(n) * (rng.random(n) < 0.8)
        places = np.sort(rng.choice(n, k, replace=False))
        hit = np.isin(np.arange(n), places)
        step = np.where(hit, (w / w[hit].sum()) if w[hit].sum() > 0 else 1 / k, -1 / (n - k))
        run = np.cumsum(step)
        top, low = run.max(), min(run.min(), 0)
        want = top if round(top, 9) >= -round(low, 9) else low
        assert abs(S.scores(places[None], w)[0] - want) < 1e-9


@pytest.mark.parametrize(("n", "k"), [(12, 3), (14, 5)])
def test_tail_equals_enumeration(n, k):
    w = np.linspace(2, 0.1, n) ** 2
    every = S.scores(np.array(list(itertools.combinations(range(n), k))), w)
    targets = np.quantile(every[every >= 0], [0.2, 0.6, 0.9, 0.99, 1.0])
    p, error = S.tail(w, k, targets, chains=401, seed=5)
    for t, got, e in zip(targets, p, error, strict=True):
        want = (every >= t - 1e-9).sum() / (every >= 0).sum()
        assert abs(math.log(got / want)) < 4 * e + 0.05, (t, got, want, e)


@pytest.mark.parametrize(("n", "k"), [(60, 8), (100, 10)])
def test_planted_sets_reach_tiny_p(n, k):
    """Only the first k places score 1, so p is one over the number of sets, among those with a positive score."""
    w = np.linspace(3, 0.2, n)
    rng = np.random.default_rng(1)
    up = (S.scores(S._draw(rng, 20_000, n, k), w) >= 0).mean()
    p, error = S.tail(w, k, np.array([1.0]), chains=401, seed=2)
    want = 1 / (math.comb(n, k) * up)
    assert want < 1e-9 and abs(math.log(p[0] / want)) < 4 * error[0] + 0.1, (p[0], want, error[0])


def test_multilevel_rows(spark):
    rng = np.random.default_rng(3)
    stats = [("a", k, float(120 - k) / 40 - 1.4 + 0.001 * rng.random()) for k in range(120)] + [("b", k, float(rng.normal())) for k in range(40)] + [("b", 99, None)]
    df = spark.createDataFrame(stats, "panel string, gene int, stat double")
    sets = spark.createDataFrame([("top", k) for k in range(10)] + [("end", k) for k in range(110, 120)] + [("mixed", k) for k in range(3, 40, 4)] + [("tiny", 1)], "gs string, gene int")
    args = (df, sets, ["panel"], "gene", "stat", "gs")
    found = {(r["panel"], r["gs"]): r for r in S.multilevel(*args, chains=101).collect()}
    es = {(r["panel"], r["gs"]): r["es"] for r in P.enrichment(df.where("stat is not null"), sets, ["panel"], "gene", "stat", "gs").collect()}
    assert found.keys() == es.keys() and all(abs(found[k]["es"] - v) < 1e-12 for k, v in es.items())
    assert found["a", "top"]["p"] < 1e-11 and found["a", "end"]["p"] < 1e-11 and all(0 < r["p"] <= r["padj"] <= 1 and r["log_error"] >= 0 for r in found.values())
    assert {k: r["p"] for k, r in found.items()} == {(r["panel"], r["gs"]): r["p"] for r in S.multilevel(*args, chains=101).collect()}
    # where plain permutations reach, both agree
    plain = {(r["panel"], r["gs"]): r["p"] for r in P.enrichment_significance(df, sets, ["panel"], "gene", "stat", "gs", perms=400).collect()}
    for k, p in plain.items():
        if p > 0.05:
            assert abs(math.log(found[k]["p"] / p)) < 4 * (found[k]["log_error"] + math.sqrt(1 / (200 * p)))


# ---- components from blocks


@pytest.mark.parametrize("size", [7, 64])
def test_block_components_equal_the_dense_ones(spark, size):
    rng = np.random.default_rng(6)
    rows = [(p, f"c{k:02d}", (rng.normal(size=50) * np.arange(1, 51) + (k % 3) * 40).tolist()) for p, n in (("a", 30), ("b", 9)) for k in range(n)]
    for r in rows:
        r[2][4] = 3.0
    df = spark.createDataFrame(rows, "panel string, cell string, x array<double>")
    dense = {(r["panel"], r["cell"], r["component"]): r for r in M.pca(df, ["panel"], "cell", "x", 5).collect()}
    for blocks in (M.feature_blocks(df, ["panel"], "cell", "x", size), M.long_blocks(df.select("panel", "cell", F.posexplode("x").alias("f", "v")), ["panel"], "cell", "f", "v", 9)):
        found = M.pca_blocks(blocks, ["panel"], "cell", 5, salts=3, rows=8).collect()
        assert len(found) == len(dense)
        for r in found:
            want = dense[r["panel"], r["cell"], r["component"]]
            assert abs(abs(r["score"]) - abs(want["score"])) < 1e-6 and abs(r["explained"] - want["explained"]) < 1e-9
    # the spaces are the same
    for p in ("a", "b"):
        a, b = (np.array([[s[p, c, k] for k in range(5)] for c in sorted({r[1] for r in rows if r[0] == p})]) for s in ({k: v["score"] for k, v in dense.items()}, {(r["panel"], r["cell"], r["component"]): r["score"] for r in found}))
        qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
        assert np.arccos(np.clip(np.linalg.svd(qa.T @ qb)[1], -1, 1)).max() < 1e-6


def test_wide_unit_stays_in_bounds(spark):
    """57,820 features: each task gets one block, and the result is the dense one's."""
    n, p = 40, 57_820
    vectors = spark.range(n).select(F.col("id").alias("cell"), F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: F.sin(k.cast("double") * (F.col("id") % 7 + 1) * 0.37 + F.col("id"))).alias("x"))
    found = M.pca_blocks(M.feature_blocks(vectors, [], "cell", "x", 2048), [], "cell", 3).collect()
    x = np.sin(np.arange(p)[None] * (np.arange(n) % 7 + 1)[:, None] * 0.37 + np.arange(n)[:, None])
    scores, share = M.pca_scores(x, 3)
    got = np.zeros((n, 3))
    for r in found:
        got[r["cell"], r["component"]] = r["score"]
        assert abs(r["explained"] - share[r["component"]]) < 1e-9
    qa, qb = np.linalg.qr(scores)[0], np.linalg.qr(got)[0]
    assert np.linalg.norm(qa @ qa.T - qb @ qb.T, 2) < 1e-6
