"""Queries of the evaluation and permutation stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import evaluate as E
from heddle.operators import models as M
from heddle.operators import permute as Q
from heddle.operators import pooled as PO
from heddle.plans.fixture import AVG_RANK, METRIC, PANEL_MEANS, metric, panel_means, table, with_sql
from heddle.plans.registry import register
from heddle.session import hold

R6 = lambda c: F.round(c, 6)

_FOLDS = "folds AS (SELECT repeat, cell, ntile(5) OVER (PARTITION BY repeat ORDER BY md5('0|' || repeat || '|' || cell), cell) - 1 AS fold FROM (SELECT DISTINCT cell FROM metric WHERE sens_z IS NOT NULL), range(2) t(repeat))"
_ROWS = METRIC + ", " + _FOLDS + ", d AS (SELECT repeat, fold, cohort, cell, drug, disease, sens_z y FROM metric JOIN folds USING (cell) WHERE sens_z IS NOT NULL)"


def _rows(spark, sf_dir, repeats: int = 2):
    m = metric(spark, sf_dir).where("sens_z is not null").select("cohort", "cell", "drug", "disease", F.col("sens_z").alias("y"))
    return m.join(E.folds(m, "cell", 5, repeats, 0), "cell")


@register("w12_m04_folds", with_sql("SELECT repeat::int AS repeat, cell, fold::int AS fold FROM folds", METRIC, _FOLDS))
def folds(spark, sf_dir):
    return E.folds(metric(spark, sf_dir).where("sens_z is not null"), "cell", 5, 2, 0).select("repeat", "cell", "fold")


def _lfo(keys: str) -> str:
    g = f"(PARTITION BY repeat{keys})"
    f = f"(PARTITION BY repeat{keys}, fold)"
    return f"(sum(y) OVER {g} - sum(y) OVER {f}) / nullif(count(y) OVER {g} - count(y) OVER {f}, 0)"


@register("m07_m08_drug_mean", with_sql(f"SELECT repeat::int AS repeat, cohort, cell, drug, round(coalesce({_lfo(', drug')}, {_lfo('')}), 6) y_pred FROM d", _ROWS))
def drug_mean(spark, sf_dir):
    return E.drug_mean(_rows(spark, sf_dir), "y", "drug", "fold", ["repeat"]).select("repeat", "cohort", "cell", "drug", R6("y_pred").alias("y_pred"))


@register("m09_residual_drug", with_sql(f"SELECT repeat::int AS repeat, cohort, cell, drug, round(y - coalesce({_lfo(', drug')}, {_lfo('')}), 6) residual FROM d", _ROWS))
def residual_drug(spark, sf_dir):
    return E.residual(_rows(spark, sf_dir), "y", "drug", "fold", ["repeat"]).select("repeat", "cohort", "cell", "drug", R6("residual").alias("residual"))


@register("m10_j15_residual_disease_drug", with_sql(f"SELECT repeat::int AS repeat, cohort, cell, drug, round(y - coalesce({_lfo(', disease, drug')}, {_lfo(', drug')}, {_lfo('')}), 6) residual FROM d", _ROWS))
def residual_disease(spark, sf_dir):
    return E.residual(_rows(spark, sf_dir), "y", "drug", "fold", ["repeat"], "disease").select("repeat", "cohort", "cell", "drug", R6("residual").alias("residual"))


_ORACLE = f"res AS (SELECT *, y - coalesce({_lfo(', drug')}, {_lfo('')}) AS r FROM d), orc AS (SELECT *, coalesce((sum(r) OVER (PARTITION BY repeat, disease) - sum(r) OVER (PARTITION BY repeat, disease, fold)) / nullif(count(r) OVER (PARTITION BY repeat, disease) - count(r) OVER (PARTITION BY repeat, disease, fold), 0), 0) y_pred FROM res)"


@register("m11_tissue_oracle", with_sql("SELECT repeat::int AS repeat, cohort, cell, drug, round(r, 6) residual, round(y_pred, 6) y_pred FROM orc", _ROWS, _ORACLE))
def oracle(spark, sf_dir):
    return E.tissue_oracle(_rows(spark, sf_dir), "y", "cell", "drug", "disease", "fold", ["repeat"]).select("repeat", "cohort", "cell", "drug", R6("residual").alias("residual"), R6("y_pred").alias("y_pred"))


_PRED = f"pred AS (SELECT repeat, disease, cohort, cell, drug, y, round(coalesce({_lfo(', drug')}, {_lfo('')}), 9) y_pred FROM d)"
_METRICS = f"""met AS (SELECT repeat, disease, count(*) n, corr(ry, rp) spearman, corr(y, y_pred) pearson, sqrt(avg(pow(y - y_pred, 2))) rmse, 1 - sum(pow(y - y_pred, 2)) / nullif(var_pop(y) * count(*), 0) r2
 FROM (SELECT *, {AVG_RANK.format(p='repeat, disease', v='y')} ry, {AVG_RANK.format(p='repeat, disease', v='y_pred')} rp FROM pred) GROUP BY ALL)"""


def _pred(spark, sf_dir, repeats: int = 2):
    return E.drug_mean(_rows(spark, sf_dir, repeats), "y", "drug", "fold", ["repeat"]).withColumn("y_pred", F.round("y_pred", 9))


@register("m03_regression_metrics", with_sql("SELECT repeat::int AS repeat, disease, n, round(spearman, 6) spearman, round(pearson, 6) pearson, round(rmse, 6) rmse, round(r2, 6) r2 FROM met", _ROWS, _PRED, _METRICS))
def metrics(spark, sf_dir):
    out = E.regression_metrics(_pred(spark, sf_dir), ["repeat", "disease"], spread=True)
    return out.select("repeat", "disease", "n", *(R6(c).alias(c) for c in ("spearman", "pearson", "rmse", "r2")))


@register(
    "a15_summary_interval",
    with_sql("SELECT disease, round(avg(rmse), 6) mean, round(coalesce(stddev_samp(rmse), 0), 6) sd, round(avg(rmse) - 1.96 * coalesce(stddev_samp(rmse), 0) / sqrt(count(rmse)), 6) lo, round(avg(rmse) + 1.96 * coalesce(stddev_samp(rmse), 0) / sqrt(count(rmse)), 6) hi, round(min(rmse), 6) AS min, round(max(rmse), 6) AS max, count(rmse) n FROM met GROUP BY 1", _ROWS, _PRED, _METRICS),
)
def summary(spark, sf_dir):
    out = E.summarize(E.regression_metrics(_pred(spark, sf_dir), ["repeat", "disease"]), ["disease"], "rmse")
    return out.select("disease", *(R6(c).alias(c) for c in ("mean", "sd", "lo", "hi", "min", "max")), "n")


_LINES = "lines AS (SELECT cell, drug || cohort AS item, y, y_pred FROM pred WHERE repeat = 0)"
_RANKING = f"""a AS (SELECT *, count(*) OVER (PARTITION BY cell) n FROM lines), b AS (SELECT *, least(3, n) kk, row_number() OVER (PARTITION BY cell ORDER BY y, item) ty, row_number() OVER (PARTITION BY cell ORDER BY y_pred, item) tp, max(y) OVER (PARTITION BY cell) - y AS gain,
 {AVG_RANK.format(p='cell', v='y')} ry, {AVG_RANK.format(p='cell', v='y_pred')} rp FROM a WHERE n >= 3),
c AS (SELECT *, avg(gain) OVER (PARTITION BY cell, y_pred) * CASE WHEN tp <= kk THEN 1 / log2(tp + 1) ELSE 0 END AS dcg, CASE WHEN ty <= kk THEN gain / log2(ty + 1) ELSE 0 END AS ideal FROM b),
e AS (SELECT cell, max(n) n_items, sum((ty <= kk AND tp <= kk)::int) / max(kk) hit, corr(ry, rp) rho, sum(dcg) / nullif(sum(ideal), 0) ndcg, stddev_pop(y) * stddev_pop(y_pred) spread FROM c GROUP BY cell),
k AS (SELECT p.cell, sum(sign(p.y - q.y) * sign(p.y_pred - q.y_pred)) / nullif(sqrt(sum(abs(sign(p.y - q.y))) * sum(abs(sign(p.y_pred - q.y_pred)))), 0) tau FROM b p JOIN b q ON p.cell = q.cell AND p.item < q.item GROUP BY p.cell)"""


@register(
    "m12_w14_per_line_ranking",
    with_sql("SELECT e.cell, n_items, round(hit, 6) topk_hit_rate, CASE WHEN spread > 0 THEN round(tau, 6) END kendall_tau, CASE WHEN spread > 0 THEN round(rho, 6) END spearman, CASE WHEN spread > 0 THEN round(ndcg, 6) END ndcg FROM e LEFT JOIN k ON e.cell = k.cell", _ROWS, _PRED, _LINES, _RANKING),
)
def ranking(spark, sf_dir):
    lines = _pred(spark, sf_dir).where("repeat = 0").select("cell", F.concat("drug", "cohort").alias("item"), "y", "y_pred")
    out = E.per_line_ranking(lines, ["cell"], "item")
    return out.select("cell", "n_items", *(R6(c).alias(c) for c in ("topk_hit_rate", "kendall_tau", "spearman", "ndcg")))


_ARMS = f"""arms AS (SELECT disease, 'drugmean' model, sqrt(avg(pow(y - y_pred, 2))) rmse FROM pred GROUP BY disease UNION ALL SELECT disease, 'mean', sqrt(avg(pow(y - g, 2))) FROM (SELECT disease, y, {_lfo('')} g FROM d) GROUP BY disease)"""


@register("m32_j18_compare_arms", with_sql("SELECT disease, round(max(CASE WHEN model = 'mean' THEN rmse END), 6) AS mean, round(max(CASE WHEN model = 'drugmean' THEN rmse END), 6) drugmean, max(CASE WHEN model = 'drugmean' THEN rmse END) < max(CASE WHEN model = 'mean' THEN rmse END) AS better FROM arms GROUP BY 1", _ROWS, _PRED, _ARMS))
def arms(spark, sf_dir):
    error = F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2)))
    a = _pred(spark, sf_dir).withColumn("p", F.col("y_pred")).groupBy("disease").agg(error.alias("rmse")).withColumn("model", F.lit("drugmean"))
    b = E.leave_fold_out(_rows(spark, sf_dir), "y", "fold", [], "p", ["repeat"]).groupBy("disease").agg(error.alias("rmse")).withColumn("model", F.lit("mean"))
    out = E.compare_arms(a.unionByName(b), ["disease"], "model", "rmse", ["mean", "drugmean"])
    return out.select("disease", R6("mean").alias("mean"), R6("drugmean").alias("drugmean"), (F.col("drugmean") < F.col("mean")).alias("better"))


_PERM = "perm AS (SELECT a.perm, a.c_nationkey, a.c_custkey, a.c_acctbal, b.c_acctbal shuffled FROM (SELECT *, row_number() OVER (PARTITION BY perm, c_nationkey ORDER BY c_custkey) rn FROM customer, range(1, 6) t(perm)) a JOIN (SELECT *, row_number() OVER (PARTITION BY perm, c_nationkey ORDER BY md5('1|' || perm || '|' || c_custkey), c_custkey) rn FROM customer, range(1, 6) t(perm)) b ON a.perm = b.perm AND a.c_nationkey = b.c_nationkey AND a.rn = b.rn)"


def _perm(spark, sf_dir):
    return Q.permuted(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", "c_custkey", ["c_nationkey"], 5)


@register("m20_permuted", with_sql("SELECT perm::int AS perm, c_custkey, shuffled FROM perm", _PERM))
def permuted(spark, sf_dir):
    return _perm(spark, sf_dir).select("perm", "c_custkey", "shuffled")


@register("m20_permuted_map", "WITH c AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT a.perm::int AS perm, a.c_custkey, b.c_custkey AS source FROM (SELECT *, row_number() OVER (PARTITION BY perm, c_mktsegment ORDER BY c_custkey) rn FROM c, range(1, 4) t(perm)) a JOIN (SELECT *, row_number() OVER (PARTITION BY perm, c_mktsegment ORDER BY md5('2|' || perm || '|' || c_custkey), c_custkey) rn FROM c, range(1, 4) t(perm)) b ON a.perm = b.perm AND a.c_mktsegment = b.c_mktsegment AND a.rn = b.rn")
def permuted_map(spark, sf_dir):
    return Q.permuted_map(table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"], 3).select("perm", "c_custkey", "source")


@register(
    "m21_significance",
    with_sql(
        """SELECT s.c_nationkey, round(r, 6) AS real, count(v) n_perm, round(avg(v), 6) perm_mean, round(stddev_pop(v), 6) perm_sd, round((1 + count(*) FILTER (WHERE v >= r)) / (1 + count(v)), 6) perm_p, round((r - avg(v)) / (stddev_pop(v) + 1e-9), 6) perm_z
        FROM (SELECT c_nationkey, round(avg(c_acctbal * (c_custkey % 13)), 6) r FROM customer GROUP BY 1) s JOIN (SELECT perm, c_nationkey, round(avg(shuffled * (c_custkey % 13)), 6) v FROM perm GROUP BY ALL) n ON s.c_nationkey = n.c_nationkey GROUP BY s.c_nationkey, r""",
        _PERM,
    ),
)
def significance(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    stat = lambda v: R6(F.avg(F.col(v) * (F.col("c_custkey") % 13))).alias("value")
    out = Q.significance(c.groupBy("c_nationkey").agg(stat("c_acctbal")), _perm(spark, sf_dir).groupBy("perm", "c_nationkey").agg(stat("shuffled")), ["c_nationkey"])
    return out.select("c_nationkey", R6("real").alias("real"), "n_perm", *(R6(c).alias(c) for c in ("perm_mean", "perm_sd", "perm_p", "perm_z")))


_PANELS = "panels AS (SELECT disease, drug, count(y) n_lines, md5(disease || drug) < '4' AS hit FROM panel GROUP BY ALL)"


def _panels(spark, sf_dir):
    return panel_means(spark, sf_dir).groupBy("disease", "drug").agg(F.count("y").alias("n_lines")).withColumn("hit", F.md5(F.concat("disease", "drug")) < "4")


_REC = "SELECT {k}k, count(*) FILTER (WHERE n >= k) n_drugs FROM (SELECT {k}drug, count(*) n FROM {t} GROUP BY ALL), range(2, 6) r(k) GROUP BY ALL"


@register("a25_r08_recurrence", with_sql("SELECT k::int AS k, n_drugs FROM (" + _REC.format(k="", t="(SELECT * FROM panels WHERE hit)") + ")", PANEL_MEANS, _PANELS))
def recurrence(spark, sf_dir):
    return Q.recurrence(_panels(spark, sf_dir).where("hit"), "drug", [])


def _null(pool: str, bins: str = "") -> str:
    p = "disease" + (", bin" if bins else "")
    key = " || '|' || ".join(["'0'", "perm", "disease", *(["bin"] if bins else []), "drug"])
    src = "panels" if not bins else "(SELECT *, greatest(0, ceil(round((row_number() OVER (PARTITION BY disease ORDER BY n_lines, drug) - 1) * 4.0::double / (count(*) OVER (PARTITION BY disease) - 1), 9)) - 1)::int AS bin FROM panels)"
    drawn = f"(SELECT perm, drug FROM (SELECT *, row_number() OVER (PARTITION BY perm, {p} ORDER BY md5({key}), drug) rn FROM (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY {p}) h FROM {src}), range(1, 21) t(perm)) WHERE rn <= h)"
    return f"""obs AS ({_REC.format(k='', t='(SELECT * FROM panels WHERE hit)')}), nul AS ({_REC.format(k='perm, ', t=drawn)})
SELECT obs.k::int AS k, obs.n_drugs AS observed, round(avg(nul.n_drugs), 6) null_mean, round(quantile_cont(nul.n_drugs, 0.95), 6) null_p95, CASE WHEN stddev_samp(nul.n_drugs) > 0 THEN round((obs.n_drugs - avg(nul.n_drugs)) / nullif(stddev_samp(nul.n_drugs), 0), 6) END z, round((1 + count(*) FILTER (WHERE nul.n_drugs >= obs.n_drugs)) / (1 + count(*)), 6) perm_p
FROM obs JOIN nul ON obs.k = nul.k GROUP BY obs.k, obs.n_drugs"""


def _report(panels, pool):
    drawn = Q.redrawn(panels, "hit", "drug", pool, 20)
    out = Q.null_report(Q.recurrence(panels.where("hit"), "drug", []), Q.recurrence(drawn, "drug", ["perm"]))
    return out.select("k", "observed", *(R6(c).alias(c) for c in ("null_mean", "null_p95", "z", "perm_p")))


@register("m22_recurrence_null", "WITH " + PANEL_MEANS + ", " + _PANELS + ", " + _null("disease"))
def recurrence_null(spark, sf_dir):
    return _report(_panels(spark, sf_dir), ["disease"])


@register("m23_recurrence_null_matched", "WITH " + PANEL_MEANS + ", " + _PANELS + ", " + _null("disease", "bin"))
def recurrence_null_matched(spark, sf_dir):
    from heddle.functions.stats import quartile_of_rank

    return _report(_panels(spark, sf_dir).withColumn("bin", quartile_of_rank("n_lines", "drug", "disease")), ["disease", "bin"])


@register(
    "m24_ndcg_null",
    with_sql(
        f"""SELECT cell, round(avg(ndcg), 6) null_mean, round(quantile_cont(ndcg, 0.05), 6) p05, round(quantile_cont(ndcg, 0.95), 6) p95 FROM (SELECT perm, cell, sum(CASE WHEN tp <= 3 THEN gain / log2(tp + 1) ELSE 0 END) / nullif(sum(CASE WHEN ty <= 3 THEN gain / log2(ty + 1) ELSE 0 END), 0) ndcg
        FROM (SELECT perm, cell, max(y) OVER (PARTITION BY cell, perm) - y AS gain, row_number() OVER (PARTITION BY cell, perm ORDER BY y, item) ty, row_number() OVER (PARTITION BY cell, perm ORDER BY md5('3|' || perm || '|' || cell || '|' || item), item) tp
        FROM (SELECT cell, drug || cohort AS item, sens_z y, count(*) OVER (PARTITION BY cell) n FROM metric WHERE sens_z IS NOT NULL), range(1, 11) t(perm) WHERE n >= 30) GROUP BY ALL) GROUP BY 1""",
        METRIC,
    ),
)
def ndcg_null(spark, sf_dir):
    from pyspark.sql import Window

    from heddle.functions.stats import md5_order

    lines = metric(spark, sf_dir).where("sens_z is not null").select("cell", F.concat("drug", "cohort").alias("item"), F.col("sens_z").alias("y")).withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where("n >= 30")
    w = Window.partitionBy("cell", "perm")
    each = Q.replicates(lines, 10).withColumn("gain", F.max("y").over(w) - F.col("y")).withColumn("ty", F.row_number().over(w.orderBy("y", "item"))).withColumn("tp", F.row_number().over(w.orderBy(md5_order(3, "perm", "cell", "item"), "item")))
    part = lambda c: F.sum(F.when(F.col(c) <= 3, F.col("gain") / F.log2(F.col(c) + F.lit(1.0))).otherwise(0.0))
    null = each.groupBy("perm", "cell").agg(F.try_divide(part("tp"), F.nullif(part("ty"), F.lit(0.0))).alias("ndcg"))
    return null.groupBy("cell").agg(R6(F.avg("ndcg")).alias("null_mean"), R6(F.percentile("ndcg", F.lit(0.05))).alias("p05"), R6(F.percentile("ndcg", F.lit(0.95))).alias("p95"))


_CLASSES = "classes AS (SELECT * FROM (VALUES ('one', ['Brand#11', 'Brand#12', 'Brand#99'], ['BUILDING', 'MACHINERY']), ('two', ['Brand#21', 'Brand#31'], ['HOUSEHOLD', 'FURNITURE', 'NOWHERE'])) v(drug_class, drugs, tissues)), cross_ AS (SELECT drug_class, drug, unnest(tissues) disease FROM (SELECT drug_class, unnest(drugs) drug, tissues FROM classes)), ref AS (SELECT drug_class, p.* FROM panels p JOIN cross_ USING (drug, disease))"


def _ref(spark, sf_dir):
    classes = spark.sql("SELECT * FROM VALUES ('one', array('Brand#11', 'Brand#12', 'Brand#99'), array('BUILDING', 'MACHINERY')), ('two', array('Brand#21', 'Brand#31'), array('HOUSEHOLD', 'FURNITURE', 'NOWHERE')) AS t(drug_class, drugs, tissues)")
    return Q.panel_hits(_panels(spark, sf_dir), classes, "drug", "disease", "n_lines")


@register("j12_a26_class_panels", with_sql("SELECT drug_class, count(*) FILTER (WHERE hit) hits, count(*) n, coalesce(string_agg(CASE WHEN NOT hit THEN drug || '/' || disease END, '; ' ORDER BY drug || '/' || disease), '') misses FROM ref GROUP BY 1", PANEL_MEANS, _PANELS, _CLASSES))
def class_panels(spark, sf_dir):
    miss = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("hit"), F.concat("drug", F.lit("/"), "disease")))), "; ")
    return _ref(spark, sf_dir).groupBy("drug_class").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"), miss.alias("misses"))


@register(
    "m25_binomial_enrichment",
    with_sql(
        "SELECT k, n, round(base, 6) base, round(k / n / base, 6) fold, CASE WHEN k <= 0 THEN 1.0 ELSE round((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(base) + (n - i) * ln(1 - base))) FROM range(0, 60) r(i) WHERE i >= k AND i <= n), 6) END p_value FROM (SELECT (SELECT count(*) FROM ref WHERE hit) k, (SELECT count(*) FROM ref) n, (SELECT avg(hit::int) FROM panels) base)",
        PANEL_MEANS, _PANELS, _CLASSES,
    ),
)
def binomial(spark, sf_dir):
    out = Q.enrichment_test(_ref(spark, sf_dir), _panels(spark, sf_dir))
    return out.select("k", "n", *(R6(c).alias(c) for c in ("base", "fold", "p_value")))


def _vectors(spark, sf_dir, name: str = "vector"):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.transform("embedding", lambda x: x.cast("double")).alias(name))


def _design(spark, sf_dir):
    """(disease, drug, cell, y, vector) of all panels; the rows are stored without vectors, so what reads them again only joins."""
    rows = hold(panel_means(spark, sf_dir).where("y is not null").select("disease", "drug", "cell", "y"))
    return rows.join(_vectors(spark, sf_dir), "cell")


@register("m05_m06_m17_nested_enet")
def nested_enet(spark, sf_dir):
    return M.nested_cv(_design(spark, sf_dir), ["disease", "drug"], "cell", "y", "vector", "enet", outer=3, inner=2)


@register("m19_signature_model")
def signature_model(spark, sf_dir):
    return M.nested_cv(_design(spark, sf_dir), ["disease", "drug"], "cell", "y", "vector", "signature", outer=5, inner=4)


@register("m26_flat_tuning")
def flat_tuning(spark, sf_dir):
    return M.nested_cv(_design(spark, sf_dir), ["disease", "drug"], "cell", "y", "vector", "signature", outer=5, inner=4, flat=True)


@register("m26_optimism_audit")
def optimism_audit(spark, sf_dir):
    """Flat against nested tuning of the signature model, per (disease, drug) panel."""
    return M.optimism(_design(spark, sf_dir), ["disease", "drug"], "cell", "y", "vector", "signature", outer=5, inner=4)


@register("m13_pca")
def pca(spark, sf_dir):
    return M.pca(_design(spark, sf_dir), ["disease", "drug"], "cell", "vector", 5)


@register("m18_boosted_trees")
def boosted(spark, sf_dir):
    return M.boosted_panels(_design(spark, sf_dir), ["disease", "drug"], "cell", "y", "vector")


@register("m14_pooled_rows", with_sql("SELECT cohort, cell, drug FROM metric WHERE disease = 'BUILDING' AND drug IN (SELECT drug FROM metric WHERE disease = 'BUILDING' GROUP BY 1 HAVING count(DISTINCT cell) >= 5)", METRIC))
def pooled(spark, sf_dir):
    return M.pooled(metric(spark, sf_dir), "cell", "drug", "BUILDING").select("cohort", "cell", "drug")


def _pooled_design(spark, sf_dir):
    rows = hold(panel_means(spark, sf_dir).where("y is not null").select("disease", "drug", "cell", "y"))
    return PO.design(rows, _vectors(spark, sf_dir), ["disease"], "cell", "drug", "vector", 10)


@register(
    "m14_pooled_design",
    with_sql(
        """SELECT disease, drug, cell, dense_rank() OVER (PARTITION BY disease ORDER BY drug) AS hot, n_drugs, n_lines, 10 AS n_pcs, 10 + n_drugs AS width FROM (SELECT DISTINCT disease, drug, cell FROM metric WHERE sens_z IS NOT NULL AND cell IN (SELECT vec_id FROM embeddings))
        JOIN (SELECT disease, count(DISTINCT drug) n_drugs, count(DISTINCT cell) n_lines FROM metric WHERE sens_z IS NOT NULL AND cell IN (SELECT vec_id FROM embeddings) GROUP BY 1) USING (disease)""",
        METRIC,
    ),
)
def pooled_design(spark, sf_dir):
    hot = F.array_position(F.slice("x", F.col("n_pcs") + 1, F.col("n_drugs").cast("int")), F.lit(1.0))
    return _pooled_design(spark, sf_dir).select("disease", "drug", "cell", hot.alias("hot"), "n_drugs", "n_lines", "n_pcs", F.size("x").alias("width"))


@register("m05_m09_m10_residual_enet")
def residual_enet(spark, sf_dir):
    """Out-of-fold rows of the elastic net on the target that has the means of (disease, drug) taken off."""
    rows = _pooled_design(spark, sf_dir).select("disease", "drug", "cell", "y", F.col("pcs").alias("x"))
    return PO.elastic_net_cv(rows, ["disease"], "cell", "y", "x", "disease_drug", "drug", "disease", outer=3, inner=2)


@register("m30_enet_arms")
def enet_arms(spark, sf_dir):
    """The three elastic net arms on components, and one on the raw vectors."""
    from heddle.operators import workloads as L

    rows = hold(_pooled_design(spark, sf_dir).select("disease", "drug", "cell", "y", F.col("pcs").alias("x")))
    return L.ablation(rows, ("enet_expr", "enet_resid", "enet_resid_disease"), repeats=2, folds=3)


def _pathway(vectors):
    """(cell, x): the products of two of a cell's 64 components, 2,016 features."""
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: F.transform(F.slice("v", i + 1, 64 - i), lambda x: x * F.element_at("v", i))))
    return vectors.select("cell", pairs.alias("x"))


def _wide_inputs(spark, sf_dir):
    """Rows (disease, drug, cell, y), components (disease, cell, x), 2,016 pathway features, and two layers.

    A pathway is the product of two of a cell's 64 components; layers are what users did: kinds of events, and their mean values.
    """
    pooled_rows = hold(_pooled_design(spark, sf_dir).select("disease", "drug", "cell", "y", "pcs"))
    pcs = hold(pooled_rows.groupBy("disease", "cell").agg(F.first("pcs").alias("x")))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"))
    kinds = ("click", "error", "purchase", "signup", "view")
    does = events.agg(F.array(*(F.max((F.col("event_type") == k).cast("double")) for k in kinds)).alias("does"))
    values = events.agg(F.array(*(F.avg(F.when(F.col("event_type") == k, F.col("value"))) for k in kinds)).alias("value"))
    return pooled_rows.drop("pcs"), pcs, _pathway(_vectors(spark, sf_dir, "v")), {"does": (does, True), "value": (values, False)}


_LAYERS = """rw AS (SELECT disease, cell, count(*) n FROM (SELECT DISTINCT disease, drug, cell FROM metric WHERE sens_z IS NOT NULL AND cell IN (SELECT vec_id FROM embeddings)) GROUP BY ALL),
kinds(k, t) AS (VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')),
ly AS (SELECT user_id AS cell, k, max((event_type = t)::int)::double AS does, avg(CASE WHEN event_type = t THEN value END) AS v FROM events, kinds GROUP BY ALL),
mn AS (SELECT disease, k, sum(n * v) / sum(CASE WHEN v IS NOT NULL THEN n END) AS m FROM rw JOIN ly USING (cell) GROUP BY ALL)"""


@register(
    "m28_layer_vectors",
    with_sql("SELECT rw.disease, rw.cell, kinds.k::int AS k, round(coalesce(does, 0), 6) AS does, round(coalesce(v, m, 0), 6) AS value, CASE WHEN ly.cell IS NULL THEN 1.0 ELSE 0.0 END AS missing FROM rw CROSS JOIN kinds LEFT JOIN ly ON ly.cell = rw.cell AND ly.k = kinds.k LEFT JOIN mn ON mn.disease = rw.disease AND mn.k = kinds.k", METRIC, _LAYERS),
)
def layer_vectors(spark, sf_dir):
    """A binary and a continuous layer per disease and cell, gaps filled by rows, one line per feature."""
    rows, _, _, layers = _wide_inputs(spark, sf_dir)
    out = None
    for name, (layer, binary) in layers.items():
        v = PO.layer_vectors(rows, layer, ["disease"], "cell", name, binary)
        flag = F.element_at(name, -1).alias("missing")
        one = v.select("disease", "cell", flag, F.posexplode(F.slice(name, 1, F.size(name) - 1)).alias("k", name))
        out = one if out is None else out.join(one.drop("missing"), ["disease", "cell", "k"])
    return out.select("disease", "cell", "k", R6("does").alias("does"), R6("value").alias("value"), "missing")


@register("m30_wide_arms")
def wide_arms(spark, sf_dir):
    """All arms with pathways and layers, per disease: 2,016 pathway features against some hundred cells."""
    from heddle.operators import workloads as L

    rows, pcs, pathway, layers = _wide_inputs(spark, sf_dir)
    return L.wide_ablation(rows, L.wide_designs(rows, ["disease"], "cell", pcs, pathway, layers), ["disease"], 1, 3, 2)


@register("m20_m21_arm_nulls")
def arm_nulls(spark, sf_dir):
    """The arms on components with 100 replicates each: shuffled responses, and for the tissue-free arm vectors dealt anew within diseases.

    One unit holds all diseases, as the beyond-tissue null needs.
    """
    from heddle.operators import workloads as L

    rows, pcs, _, _ = _wide_inputs(spark, sf_dir)
    vectors = hold(pcs.select("cell", "x"))
    every = rows.withColumn("unit", F.lit("all"))
    return L.wide_ablation(every, {"enet_resid": vectors, "enet_resid_disease": vectors}, ["unit"], 1, 3, 2, n_perm=100, with_null=("enet_resid", "enet_resid_disease"))


@register("m18_boosted_cv")
def boosted_cv(spark, sf_dir):
    """Boosted trees in nested cross-validation, settings by random search, on every (disease, drug) panel."""
    return M.nested_cv(_design(spark, sf_dir), ["disease", "drug"], "cell", "y", "vector", "boosted_small", outer=3, inner=2)


@register("m18_boosted_forest")
def boosted_forest(spark, sf_dir):
    """One forest over all panels' rows, from histograms that tasks add up; (disease, drug, cell, y, y_pred)."""
    from heddle.operators import boosting as B

    rows = hold(_design(spark, sf_dir).withColumn("row", F.concat_ws("|", "disease", "drug", "cell")))
    forest = B.fit(rows, "vector", "y", "row", B.Settings(rounds=8, depth=3, rate=0.1, subsample=0.8, colsample=0.7, min_child_weight=5))
    return B.predict(rows, "vector", forest).select("disease", "drug", "cell", "y", "y_pred")


@register("m13_pca_blocks")
def pca_blocks(spark, sf_dir):
    """Components of all cells as one unit over 2,016 pathway features: in blocks, or from strips of the features' products."""
    return M.pca_any(_pathway(_vectors(spark, sf_dir, "v").repartition(32)), [], "cell", "x", 10, 256)


_TAU = """c AS (SELECT c_nationkey g, c_acctbal y, c_custkey % 37 p FROM customer),
t AS (SELECT a.g, sum(sign(a.y - b.y) * sign(a.p - b.p)) net, sum(abs(sign(a.y - b.y))) ny, sum(abs(sign(a.p - b.p))) np FROM c a JOIN c b USING (g) GROUP BY 1)"""


@register("m12_kendall_spread", with_sql("SELECT g AS c_nationkey, (SELECT count(*) FROM c WHERE c.g = t.g) n, round(net / nullif(sqrt(ny * np), 0), 9) kendall_tau FROM t", _TAU))
def kendall_spread(spark, sf_dir):
    from heddle.operators import ordering as O

    out = O.kendall_spread(table(spark, sf_dir, "customer").withColumn("p", F.col("c_custkey") % 37), ["c_nationkey"], "c_acctbal", "p")
    return out.select("c_nationkey", "n", F.round("kendall_tau", 9).alias("kendall_tau"))


@register("a18_exact_quantiles", " UNION ALL ".join(f"SELECT {p}::double AS prob, round(quantile_cont(l_extendedprice, {p}), 6) quantile FROM lineitem" for p in (0.05, 0.5, 0.95)))
def exact_quantiles(spark, sf_dir):
    """Of one group of all rows."""
    from heddle.operators import ordering as O

    out = O.exact_quantiles(table(spark, sf_dir, "lineitem"), [], "l_extendedprice", [0.05, 0.5, 0.95], 10_000)
    return out.select("prob", F.round("quantile", 6).alias("quantile"))


@register("w02_ranks_of_one_group", "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity * 100 + l_partkey % 100) + (count(*) OVER (PARTITION BY l_quantity * 100 + l_partkey % 100) - 1) / 2.0 AS r FROM lineitem")
def ranks_of_one_group(spark, sf_dir):
    """Average ranks of all rows as one group, with ties, cut into ranges."""
    from heddle.operators import ordering as O

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 100 + F.col("l_partkey") % 100).alias("v"))
    return O.average_ranks(rows, [], "v", "r", 1000).select("l_orderkey", "l_linenumber", "r")


_RESULTS = "res AS (SELECT CASE WHEN length(disease) % 2 = 0 THEN 'both' ELSE 'a' END cohort, disease, model, repeat, rmse spearman, rmse - 0.2 * length(disease) / 9 spearman_lo, rmse + 0.1 spearman_hi FROM (SELECT disease, 'drugmean' model, 0 repeat, round(sqrt(avg(pow(y - y_pred, 2))), 6) rmse FROM pred GROUP BY disease UNION ALL SELECT disease, 'mean', 0, round(sqrt(avg(pow(y - g, 2))), 6) FROM (SELECT disease, y, {g} g FROM d) GROUP BY disease))".format(g=_lfo(""))


def _results(spark, sf_dir):
    """Result rows of two arms; their errors stand in for scores."""
    error = F.round(F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2))), 6)
    a = _pred(spark, sf_dir).withColumn("p", F.col("y_pred")).groupBy("disease").agg(error.alias("spearman")).withColumn("model", F.lit("drugmean"))
    b = E.leave_fold_out(_rows(spark, sf_dir), "y", "fold", [], "p", ["repeat"]).groupBy("disease").agg(error.alias("spearman")).withColumn("model", F.lit("mean"))
    size = F.length("disease")
    return a.unionByName(b).withColumns({"cohort": F.when(size % 2 == 0, "both").otherwise("a"), "spearman_lo": F.col("spearman") - 0.2 * size / 9, "spearman_hi": F.col("spearman") + 0.1})


@register("m32_arm_deltas", with_sql("SELECT cohort, disease, round(max(spearman) FILTER (WHERE model = 'drugmean'), 5) drugmean, round(max(spearman) FILTER (WHERE model = 'mean'), 5) AS mean, round(max(spearman) FILTER (WHERE model = 'mean') - max(spearman) FILTER (WHERE model = 'drugmean'), 5) delta_mean FROM res GROUP BY ALL", _ROWS, _PRED, _RESULTS))
def arm_deltas(spark, sf_dir):
    out = E.arm_deltas(_results(spark, sf_dir), ["cohort", "disease"], ["drugmean", "mean"])
    return out.select("cohort", "disease", *(F.round(c, 5).alias(c) for c in ("drugmean", "mean", "delta_mean")))


@register("m32_cohort_summary", with_sql("SELECT cohort, model, count(DISTINCT disease) n_diseases, round(avg(spearman), 5) mean_spearman, round(avg(spearman_hi - spearman_lo), 5) mean_ci_width, count(*) FILTER (WHERE spearman_lo > 0) n_above_zero FROM res GROUP BY ALL", _ROWS, _PRED, _RESULTS))
def cohort_summary(spark, sf_dir):
    return E.cohort_summary(_results(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("mean_spearman", "mean_ci_width")})
