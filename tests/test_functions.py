"""Scalar and statistic functions on small literal frames, and properties of operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.functions import stats as T
from heddle.functions import text as X
from heddle.operators import evaluate as E
from heddle.operators import harmonize as H
from heddle.operators import models as M
from heddle.operators import panels as P
from heddle.operators import permute as Q
from heddle.operators import vectors as V


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (X.norm_id, "NCI-H2 (b)", "NCIH2B"), (X.norm_id, None, None), (X.norm_name, "Foo-1 β", "foo1"), (X.slug, "--a b/c--", "a_b_c"), (X.block, "ABC-DEF-N", "ABC"), (X.block, "-x", None), (X.block, "", None),
        (X.clean_name, "  Drug (salt)  x ", "Drug x"), (X.first_token, "ENSG1.3", "ENSG1"), (X.clean_target, "A; A,B,C", "A, B"), (X.clean_target, " ; ", None), (X.norm_label, " coad/read=x", "COAD_READ"), (X.prettify, "A_B", "a b"),
        (X.to_float, "1e3", 1000.0), (X.to_float, "Inf", None), (X.to_float, "NaN", None), (X.to_float, "x", None), (X.to_int, "2.5", 2), (X.split_genes, "A/ B//", ["A", "B"]), (X.file_safe, "a/b", "a-b"),
        (X.pretty_disease, "BRCA", "Breast"), (X.pretty_disease, "SITE_SOFT_TISSUE", "Soft Tissue"), (X.pretty_disease, None, "unknown"), (X.pretty_disease, "XYZ", "XYZ"), (X.actionable, "BRD-K123", False), (X.actionable, "NSC 74859", False),
        (X.actionable, "12345", False), (X.actionable, "Digoxin", False), (X.actionable, " ", False), (X.actionable, None, False), (X.actionable, "erlotinib", True), (X.site_label, "SITE_A/B", "SITE_A-B".removeprefix("SITE_")), (X.pretty_set_name, "REACTOME_CELL_CYCLE", "Cell Cycle"),
        (X.blank_to_null, "  ", None), (lambda c: X.short_label(c, 5), "abcdefgh", "Abcde..."),
    ],
)
def test_text(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_candidates(spark):
    row = spark.createDataFrame([("Foo (x)", "foo, Bar ,BAR,")], "n string, s string").select(X.candidates(F.col("n"), F.col("s")).alias("c")).first()
    assert row["c"] == ["Foo (x)", "Foo", "Bar"]


def test_digest_score_range(spark):
    v = one(spark, "anything", X.digest_score)
    assert 0.55 <= v <= 0.95


def test_erf_and_binomial(spark):
    for x in (-2.5, -0.3, 0.0, 0.7, 3.0):
        assert abs(one(spark, x, T.erf, "double") - math.erf(x)) < 2e-7
    row = spark.createDataFrame([(3, 10)], "k int, n int").select(T.binomial_tail(F.col("k"), F.col("n"), F.lit(0.2)).alias("p")).first()
    assert abs(row["p"] - sum(math.comb(10, i) * 0.2**i * 0.8 ** (10 - i) for i in range(3, 11))) < 1e-12


def test_average_rank_and_quartiles(spark):
    rng = np.random.default_rng(0)
    for n in (4, 6, 7, 10, 33):
        v = rng.integers(0, 6, n)
        df = spark.createDataFrame(pd.DataFrame({"i": range(n), "g": 0, "v": v}))
        got = df.select("i", T.average_rank("v", "g").alias("r"), T.quartile_of_rank("v", "i", "g").alias("q")).toPandas().sort_values("i")
        assert np.allclose(got["r"], pd.Series(v).rank())
        assert got["q"].tolist() == pd.qcut(pd.Series(v).rank(method="first"), 4, labels=False).tolist()


def test_safe_corr_on_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    assert df.agg(T.safe_corr("x", "y").alias("c")).first()["c"] is None


def test_metric_properties(spark):
    rng = np.random.default_rng(0)
    rows = [("A", f"d{k}", i, float(v)) for k in range(3) for i, v in enumerate(rng.normal(size=4 + 3 * k))]
    got = H.add_metric(spark.createDataFrame(rows, "cohort string, drug string, cell int, auc double")).toPandas()
    assert got[got.drug == "d0"].sens_z.isna().all()  # fewer than five
    big = got[got.drug != "d0"].groupby("drug").sens_z
    assert np.allclose(big.mean(), 0) and np.allclose(big.std(), 1)


def test_folds(spark):
    df = spark.createDataFrame([(f"c{i}", i % 3) for i in range(53)], "cell string, d int")
    got = E.folds(df.union(df), "cell", 5, 3, 7).toPandas()
    sizes = got.groupby(["repeat", "fold"]).size()
    assert sizes.max() - sizes.min() <= 1 and (got.groupby(["repeat", "cell"]).fold.nunique() == 1).all()
    with pytest.raises(ValueError):
        E.check_groups(df.where("cell = 'c1'"), "cell")


def test_leave_fold_out_equals_refits(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"i": range(60), "drug": rng.integers(0, 4, 60), "disease": rng.integers(0, 2, 60), "fold": rng.integers(0, 3, 60), "y": rng.normal(size=60), "r": 0})
    got = E.residual(spark.createDataFrame(pdf), "y", "drug", "fold", ["r"], "disease").toPandas().set_index("i")
    for _, row in pdf.iterrows():
        train = pdf[pdf.fold != row.fold]
        for part in (train[(train.drug == row.drug) & (train.disease == row.disease)], train[train.drug == row.drug], train):
            if len(part):
                break
        assert abs(got.loc[row.i, "residual"] - (row.y - part.y.mean())) < 1e-9


def test_permuted_keeps_groups(spark):
    pdf = pd.DataFrame({"i": range(40), "g": [i % 4 for i in range(40)], "v": [float(i) for i in range(40)]})
    got = Q.permuted(spark.createDataFrame(pdf), "v", "i", ["g"], 6).toPandas()
    for _, part in got.groupby(["perm", "g"]):
        assert sorted(part.v) == sorted(part.shuffled)
    assert (got.v != got.shuffled).any()
    null = spark.createDataFrame([(1, float(k)) for k in range(9)], "g int, value double")
    row = Q.significance(spark.createDataFrame([(1, 20.0)], "g int, value double"), null, ["g"]).first()
    assert row["perm_p"] == pytest.approx(0.1) and row["n_perm"] == 9


def test_even_chunks(spark):
    df = spark.createDataFrame([("a", i) for i in range(23)] + [("b", 1)], "g string, i int")
    got = P.even_chunks(df, "g", "i", 5).toPandas()
    assert got[got.g == "a"].groupby("chunk").size().tolist() == [len(x) for x in np.array_split(np.arange(23), 5)]


def test_enrichment_leading_edge(spark):
    stats = spark.createDataFrame([("p", f"g{i}", 10.0 - i) for i in range(20)], "panel string, gene string, stat double")
    sets = spark.createDataFrame([("up", f"g{i}") for i in range(5)] + [("down", f"g{i}") for i in range(15, 20)] + [("tiny", "g1")], "name string, gene string")
    got = {r["name"]: r for r in P.enrichment(stats, sets, ["panel"], "gene", "stat", "name").collect()}
    assert set(got) == {"up", "down"} and got["up"].es == pytest.approx(1) and got["down"].es == pytest.approx(-1)
    assert got["up"].leading_edge == "g0/g1/g2/g3/g4" and got["down"].leading_edge == "g15/g16/g17/g18/g19"


def test_self_similarity_moments(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = V.self_similarity(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k int, v array<double>"), "k", "v").toPandas().set_index("k")
    s = v @ v.T
    for i in range(30):
        others = np.delete(s[i], i)
        assert got.loc[i, "r"] == pytest.approx(others.mean()) and got.loc[i, "sd"] == pytest.approx(others.std())


def test_search_errors_and_scope(spark):
    atlas = spark.createDataFrame([(i, "L1" if i < 3 else "L2", [float(i == k) for k in range(10)]) for i in range(10)], "drug_uid int, disease string, vector array<double>")
    s = V.SignatureSearch(atlas)
    assert s.status() == "real"
    q = spark.createDataFrame([("a", "L1", [1.0] * 10), ("b", "nowhere", [1.0] * 10), ("c", None, [1.0] * 10)], "query string, wanted string, qvector array<double>")
    got = s.search(q, 5).toPandas()
    assert got.groupby("query").size().to_dict() == {"a": 3, "b": 5, "c": 5} and set(got[got.broadened]["query"]) == {"b"}
    assert V.SignatureSearch(atlas.limit(3)).status() == "small"
    for k in (0, 201):
        with pytest.raises(ValueError):
            s.search(q, k)


def test_average_linkage():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    order, merges, flat = V.average_linkage(x @ x.T)
    assert len(merges) == 3 and flat[0] == flat[1] != flat[2] == flat[3] and sorted(order) == [0, 1, 2, 3]
    assert V.average_linkage(np.ones((3, 3)))[2] == [1, 1, 1] and V.average_linkage(np.ones((0, 0))) == ([], [], [])


def test_models():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    y = 2 * x[:, 0] + x[:, 1] + 0.1 * rng.normal(size=80)
    assert np.corrcoef(M.elastic_net(x, y, 0.01, 0.5)(x), y)[0, 1] > 0.99
    assert np.allclose(M.elastic_net(x, y, 100.0, 0.9)(x), y.mean())
    assert np.corrcoef(M.signature_model(x, -y, 2)(x), -y)[0, 1] > 0.9
    scores, share = M.pca_scores(x, 3)
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z - z.mean(0), full_matrices=False)
    assert np.allclose(np.abs(scores), np.abs(u[:, :3] * s[:3])) and share.sum() < 1
    with pytest.raises(KeyError):
        M.make("nothing")
    with pytest.raises(ValueError):
        M.deal(np.array([1, 1]), 3, 0)
    reg, l1 = M.spark_elastic_net(0.5, 0.4, 2.0)
    assert reg == pytest.approx(0.2 + 0.6) and l1 == pytest.approx(0.25)


def test_nested_cv_goes_on_after_a_small_panel(spark):
    rng = np.random.default_rng(4)
    rows = [("big", i, float(i % 5), rng.normal(size=3).tolist()) for i in range(30)] + [("small", 1, 1.0, [0.0, 1.0, 2.0])]
    got = M.nested_cv(spark.createDataFrame(rows, "panel string, cell int, y double, v array<double>"), ["panel"], "cell", "y", "v", "mean").toPandas()
    assert got[got.panel == "big"].ok.all() and len(got[got.panel == "big"]) == 30
    assert not got[got.panel == "small"].ok.any() and "two groups" in got[got.panel == "small"].error.iloc[0]


def test_spark_elastic_net_agrees(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, 1.0, 0.0] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    reg, l1 = M.spark_elastic_net(0.3, 0.5, y.std(ddof=1))
    fit = LinearRegression(labelCol="y", regParam=reg, elasticNetParam=l1).fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df))
    own = M.elastic_net(x, y, 0.3, 0.5)
    assert np.allclose(x @ fit.coefficients.toArray() + fit.intercept, own(x), atol=0.05)


def test_pooled_errors(spark):
    df = spark.createDataFrame([("A", "c1", "d1", "L", 1.0)], "cohort string, cell string, drug string, disease string, y double")
    with pytest.raises(ValueError, match="unknown cohort"):
        M.pooled(df, "cell", "drug", cohort="x")
    with pytest.raises(ValueError, match="fewer than two cells"):
        M.pooled(df, "cell", "drug", least_lines=1)


def test_registry_refuses_a_second_name():
    from heddle.plans import registry

    name = next(iter(registry.queries()))
    with pytest.raises(ValueError):
        registry.register(name)(lambda s, d: None)


def test_unknown_arm(spark):
    from heddle.operators.workloads import mean_arm

    with pytest.raises(KeyError):
        mean_arm(spark.range(1), "nothing", [])
