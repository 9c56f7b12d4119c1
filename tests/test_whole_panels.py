"""The model queries run over every (disease, drug) panel and all components."""

from __future__ import annotations

import numpy as np
import pytest

from heddle.operators import models as M
from heddle.plans import registry
from heddle.plans.fixture import panel_means
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def panels(spark):
    return {tuple(r) for r in panel_means(spark, SMALL).where("y is not null").select("disease", "drug").distinct().collect()}


@pytest.mark.parametrize("name", ["m13_pca", "m18_boosted_trees", "m19_signature_model"])
def test_every_panel(spark, panels, name):
    assert len({drug for _, drug in panels}) > 1
    assert {tuple(r) for r in registry.queries()[name](spark, SMALL).select("disease", "drug").distinct().collect()} == panels


def test_boosted_panels_use_all_components(spark):
    x = np.random.default_rng(0).normal(size=(2, 40, 64))
    rows = [("d", f"b{p}", c, float(x[p, c, 63 - p] > 0), x[p, c].tolist()) for p in range(2) for c in range(40)]
    df = spark.createDataFrame(rows, "disease string, drug string, cell long, y double, vector array<double>")
    got = M.boosted_panels(df, ["disease", "drug"], "cell", "y", "vector").collect()
    assert len(got) == len(rows) and all(abs(r.y - r.y_pred) < 1e-9 for r in got)
    one = df.where("cell = 0")
    assert [r.y_pred for r in M.boosted_panels(one, ["disease", "drug"], "cell", "y", "vector").collect()] == pytest.approx([r.y for r in one.collect()])


def test_regression_tree_finds_the_best_cut():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = rng.integers(0, 4, (9, 3)).astype(float), rng.normal(size=9)
        loss = [sum(((y[s] - y[s].mean()) ** 2).sum() for s in (x[:, j] <= v, x[:, j] > v) if s.any()) for j in range(3) for v in np.unique(x[:, j])]
        assert ((y - M.regression_tree(x, y, 1)(x)) ** 2).sum() == pytest.approx(min(loss))
