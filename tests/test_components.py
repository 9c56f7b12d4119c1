"""Components of panels with more cells than columns, from moments; z-scores from one row per group."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import components as C
from heddle.operators import harmonize as H
from heddle.operators import models as M


def test_a_panel_of_20000_cells(spark):
    """The products of its cells would be 3.2 GB."""
    df = spark.range(20_000, numPartitions=6).select(F.col("id").alias("cell"), F.lit("p").alias("panel"), F.array(F.sin("id"), F.cos(F.col("id") * 0.7) + F.sin("id"), F.lit(0.1)).alias("x"))
    found = M.pca(df, ["panel"], "cell", "x", 5).toPandas()
    k = np.arange(20_000)
    x = np.column_stack([np.sin(k), np.cos(k * 0.7) + np.sin(k)])
    u, s, _ = np.linalg.svd((x - x.mean(0)) / x.std(0), full_matrices=False)
    for c in range(2):
        one = found[found.component == c].sort_values("cell")
        assert np.allclose(np.abs(one.score), np.abs(u[:, c] * s[c])) and np.allclose(one.explained, s[c] ** 2 / (s**2).sum())
        assert one.score.iloc[one.score.abs().argmax()] > 0
    assert len(found) == 40_000  # the constant column gives none


@pytest.mark.parametrize("held_bytes", [400, 32 << 20])
def test_panels_equal_the_dense_ones(spark, held_bytes):
    rng = np.random.default_rng(3)
    rows = [(p, c, (rng.normal(size=6) * 10.0 ** np.arange(6) + 1e6).tolist()) for p, n in (("a", 50), (None, 4), ("b", 2), ("one", 1)) for c in range(n)]
    df = spark.createDataFrame(rows, "panel string, cell long, x array<double>").repartition(5)
    found = C.tall(df, ["panel"], "cell", "x", 4, held_bytes).toPandas()
    for p, n in (("a", 50), (None, 4), ("b", 2), ("one", 1)):
        own = found[found.panel.isna() if p is None else found.panel == p]
        assert len(own) == n * min(4, n - 1)
        scores, share = M.pca_scores(np.array([r[2] for r in rows if r[0] == p]), 4) if n > 1 else (np.zeros((1, 0)), [])
        for c in range(scores.shape[1]):
            one = own[own.component == c].sort_values("cell")
            want = scores[:, c] * np.sign(scores[np.abs(scores[:, c]).argmax(), c])
            assert np.allclose(one.score, want, atol=1e-6) and np.allclose(one.explained, share[c])


def test_strips_of_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 600))
    df = spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(x)], "cell long, x array<double>").repartition(3)
    found = M.pca_any(df, [], "cell", "x", 3).toPandas()
    scores, _ = M.pca_scores(x, 3)
    for c in range(3):
        one = found[found.component == c].sort_values("cell").score.to_numpy()
        assert np.allclose(np.abs(one), np.abs(scores[:, c]), atol=1e-6)
    plan = M.pca_any(df, [], "cell", "x", 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan  # no group of all cells


def test_scores_need_no_sort_of_their_groups(spark):
    rows = [("A", None if d == 2 else f"d{d}", c, float(c * (d + 1) % 7)) for d in range(3) for c in range(9)] + [("A", "few", 1, 1.0), ("A", "flat", 1, 1.0)] + [("A", "flat", c, 1.0) for c in range(2, 9)]
    out = H.add_metric(spark.createDataFrame(rows, "cohort string, drug string, cell int, auc double")).drop("sens_rank")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.toPandas()
    assert len(got) == len(rows) and got[got.drug.isin(["few", "flat"])].sens_z.isna().all()
    for d in range(3):
        own = got[got.drug.isna() if d == 2 else got.drug == f"d{d}"]
        assert np.allclose(own.sens_z, (own.auc - own.auc.mean()) / own.auc.std())
