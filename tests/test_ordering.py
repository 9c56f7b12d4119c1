"""Ranks, quantiles and tau of large groups, cut into small ranges, against windows, numpy and pair counts."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions.stats import average_rank
from heddle.operators import evaluate as E
from heddle.operators import ordering as O


def rows(seed=0, n=4000):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        key = [None, "a", "b", "c"][int(rng.choice(4, p=[0.05, 0.7, 0.2, 0.05]))]
        kind = rng.random()
        v = None if kind < 0.03 else float("nan") if kind < 0.05 else float("inf") if kind < 0.06 else 1.5 if kind < 0.4 else float(rng.normal()) if kind < 0.8 else float(rng.integers(-3, 4))
        out.append((k, key, v))
    return out


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-9))


@pytest.mark.parametrize("cut", [25, 300, 10**6])
def test_ranks_equal_the_window(spark, cut):
    df = spark.createDataFrame(rows(), "id long, key string, v double")
    for keys in (["key"], []):
        got = {r["id"]: r["r"] for r in O.average_ranks(df, keys, "v", "r", cut).collect()}
        want = {r["id"]: r["r"] for r in df.withColumn("r", average_rank("v", *keys)).collect()}
        assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in got)
    assert O.average_ranks(df.limit(0), ["key"], "v", "r", cut).count() == 0
    assert {r["r"] for r in O.average_ranks(df.withColumn("v", F.lit(None).cast("double")), ["key"], "v", "r", cut).collect()} == {None}


def test_ranges_are_even_at_one_key(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(x),) for x in np.exp(3 * rng.normal(size=60_000))], "v double")
    sizes = sorted(r["__n"] for r in O.Ranges(df, [], "v", 2000).offsets.collect())
    assert len(sizes) >= 25 and sum(sizes) == 60_000 and sizes[-1] < 3 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("cut", [40, 10**6])
def test_quantiles_equal_percentile(spark, cut):
    df = spark.createDataFrame([r for r in rows(2) if r[2] is None or math.isfinite(r[2])], "id long, key string, v double")
    probs = [0.0, 0.05, 0.5, 0.731, 0.95, 1.0]
    got = {(r["key"], r["prob"]): r["quantile"] for r in O.exact_quantiles(df, ["key"], "v", probs, cut).collect()}
    for r in df.groupBy("key").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect():
        assert all(abs(got[r["key"], p] - q) < 1e-9 for p, q in zip(probs, r["q"], strict=True))
    every = np.array([r[2] for r in rows(2) if r[2] is not None and math.isfinite(r[2])])
    assert all(abs(r["quantile"] - np.quantile(every, r["prob"])) < 1e-9 for r in O.exact_quantiles(df, [], "v", probs, cut).collect())


def pair_tau(y, p):
    s = [(np.sign(a - b), np.sign(c - d)) for i, (a, c) in enumerate(zip(y, p, strict=True)) for b, d in list(zip(y, p, strict=True))[:i]]
    down = math.sqrt(sum(abs(a) for a, _ in s) * sum(abs(b) for _, b in s))
    return sum(a * b for a, b in s) / down if down else None


def test_inversions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 30, 5)
        line = np.repeat(np.arange(5), sizes)
        y, p = rng.integers(0, 8, len(line)).astype(float), rng.integers(0, 6, len(line)).astype(float)
        got = O.wrong_pairs(line, y, p, 5)
        for k in range(5):
            a, b = y[line == k], p[line == k]
            assert got[k] == sum((a[i] - a[j]) * (b[i] - b[j]) < 0 for i in range(len(a)) for j in range(i))
            assert O.tied_pairs(line, 5, y)[k] == sum(a[i] == a[j] for i in range(len(a)) for j in range(i))
        order = np.lexsort((y, p))
        c = rng.integers(1, 5, len(y)).astype(float)
        assert O._weighted_inversions(y[order], c[order]) == sum(c[order][i] * c[order][j] for j in range(len(y)) for i in range(j) if y[order][i] > y[order][j])


@pytest.mark.parametrize("cut", [7, 60, 10**6])
def test_tau_over_ranges_equals_pairs(spark, cut):
    rng = np.random.default_rng(3)
    data = [(k, float(rng.integers(0, 90)), float(rng.integers(0, 60)) if k != "flat" else 1.0) for k in ["x"] * 300 + ["y"] * 40 + ["flat"] * 5 + ["one"]]
    data += [("x", 5.0, 5.0)] * 100 + [("x", None, 1.0)]
    df = spark.createDataFrame(data, "key string, y double, p double")
    for r in O.kendall_spread(df, ["key"], "y", "p", cut).collect():
        own = [(a, b) for k, a, b in data if k == r["key"] and a is not None]
        want = pair_tau(*map(list, zip(*own, strict=True)))
        assert r["n"] == len(own) and (r["kendall_tau"] is None if want is None else abs(r["kendall_tau"] - want) < 1e-12)
    whole = O.kendall_spread(df, [], "y", "p", cut).collect()
    own = [(a, b) for _, a, b in data if a is not None]
    assert len(whole) == 1 and abs(whole[0]["kendall_tau"] - pair_tau(*map(list, zip(*own, strict=True)))) < 1e-12


def test_line_ranking_of_odd_lines(spark):
    data = [("a", f"i{k}", float(k % 4), float(k % 3)) for k in range(11)] + [("flat", f"i{k}", 1.0, float(k)) for k in range(4)] + [("short", "i", 1.0, 2.0)] + [("a", "none", None, 1.0)]
    df = spark.createDataFrame(data, "cell string, item string, y double, y_pred double")
    got = {r["cell"]: r for r in E.per_line_ranking(df, ["cell"], "item").collect()}
    assert set(got) == {"a", "flat"} and got["flat"]["kendall_tau"] is None and got["flat"]["ndcg"] is None and got["a"]["n_items"] == 11
    own = [r for r in data if r[0] == "a" and r[2] is not None]
    assert abs(got["a"]["kendall_tau"] - pair_tau([r[2] for r in own], [r[3] for r in own])) < 1e-12


def test_spread_metrics_equal_the_window(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k % 2, float(rng.normal()), float(rng.integers(0, 9))) for k in range(500)], "repeat int, y double, y_pred double")
    a, b = (sorted(map(tuple, E.regression_metrics(df, ["repeat"], spread=s).collect())) for s in (False, True))
    assert np.allclose(np.array(a), np.array(b))


def test_features_with_gaps_equal_the_window(spark):
    from heddle.functions.stats import safe_corr
    from heddle.operators.panels import spearman_features

    rng = np.random.default_rng(9)
    odd = [None, float("nan"), float("inf"), 1.0, 1.0, 2.0]
    expression = [(c, g, odd[int(rng.integers(0, 6))] if rng.random() < 0.4 else float(rng.normal())) for c in range(40) for g in range(5) if rng.random() < 0.9] + [(c, 9, 3.0) for c in range(40)]
    response = [(p, c, None if rng.random() < 0.1 else float(rng.integers(0, 7))) for p in "ab" for c in range(40) if rng.random() < 0.8]
    e, r = spark.createDataFrame(expression, "cell int, gene int, value double"), spark.createDataFrame(response, "panel string, cell int, y double")
    got = {(x["panel"], x["gene"]): (x["n"], x["rho"]) for x in spearman_features(e, r, ["panel"], "cell", "gene", "value", "y").collect()}
    met = r.join(e, "cell").withColumn("a", average_rank("value", "panel", "gene")).withColumn("s", -F.col("y")).withColumn("b", average_rank("s", "panel", "gene"))
    want = {(x["panel"], x["gene"]): (x["n"], x["rho"]) for x in met.groupBy("panel", "gene").agg(F.count("*").alias("n"), safe_corr("a", "b").alias("rho")).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == n and (got[k][1] is None if v is None else abs(got[k][1] - v) < 1e-9) for k, (n, v) in want.items())
    assert got["a", 9][1] is None
