"""The signature model's whole grid from one ranking, and its scan with all replicates of a panel in one group."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import evaluate as E
from heddle.operators import models as M
from heddle.operators import permute as Q
from heddle.operators import workloads as L


def test_a_path_equals_single_models():
    rng = np.random.default_rng(2)
    x, y, at = rng.normal(size=(40, 30)).round(1), rng.normal(size=40), rng.normal(size=(9, 30))
    x[:, 3] = 1.0
    tops = [1, 5, 25, 50, 100]
    assert np.allclose(M.signature_path(x, y, tops, at), np.column_stack([M.signature_model(x, y, t)(at) for t in tops]), atol=1e-12)


def test_scan_equals_replicates_as_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(d, c, float(rng.normal()), rng.normal(size=4).tolist()) for d, n in (("a", 30), ("b", 21), ("tiny", 1)) for c in range(n)]
    design = spark.createDataFrame(rows, "drug string, cell long, y double, vector array<double>")
    out = L.signature_scan(design, ["drug"], "cell", "y", "vector", n_perm=4, outer=3, inner=2)
    got = {r["drug"]: r for r in out.collect()}
    real = design.withColumn("perm", F.lit(0))
    null = Q.permuted(design.withColumnRenamed("y", "v"), "v", "cell", ["drug"], 4, 1).select("drug", "cell", F.col("shuffled").alias("y"), "vector", "perm")
    done = M.nested_cv(real.unionByName(null), ["drug", "perm"], "cell", "y", "vector", "signature", 3, 2, 1, 0).where("ok")
    rho = E.regression_metrics(done, ["drug", "perm"]).select("drug", "perm", F.coalesce("spearman", F.lit(0.0)).alias("value"))
    want = {r["drug"]: r for r in Q.significance(rho.where("perm = 0"), rho.where("perm > 0"), ["drug"]).collect()}
    assert set(got) == set(want) == {"a", "b"}
    for d, r in want.items():
        assert tuple(got[d])[1:] == pytest.approx(tuple(r)[1:], abs=1e-9)


def test_scan_moves_each_vector_once(spark, monkeypatch):
    design = spark.createDataFrame([("a", c, float(c % 5), [float(c), float(c % 3)]) for c in range(30)], "drug string, cell long, y double, vector array<double>")
    held = []
    monkeypatch.setattr(L, "hold", lambda d: held.append(d) or d)
    L.signature_scan(design, ["drug"], "cell", "y", "vector", n_perm=3)
    plan = held[0]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
