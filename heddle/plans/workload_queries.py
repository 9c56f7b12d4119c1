"""Queries of the sweeps and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import workloads as L
from heddle.plans.evaluate_queries import _ROWS, _design, _lfo
from heddle.plans.fixture import AVG_RANK, METRIC, RAW, RESPONSE, metric, raw, response, table, with_sql
from heddle.plans.registry import register
from heddle.plans.search_queries import _GSEA, _gsea

R6 = lambda c: F.round(c, 6)


@register("m31_disease_sizes", with_sql("SELECT disease, count(DISTINCT cell) n_lines, count(DISTINCT drug) n_drugs, count(*) n_rows FROM response GROUP BY 1 HAVING count(DISTINCT cell) >= 30", RESPONSE))
def disease_sizes(spark, sf_dir):
    return L.disease_sizes(response(spark, sf_dir), least=30)


_TASK = "SELECT disease, count(DISTINCT cell) n_lines, count(DISTINCT drug) n_drugs, count(*) n_rows, '{c}' AS cohort FROM response {w} GROUP BY 1 HAVING count(DISTINCT cell) >= 25 AND count(DISTINCT drug) >= 10"


@register("m31_tasks", with_sql(" UNION ALL ".join([_TASK.format(c="A", w="WHERE cohort = 'A'"), _TASK.format(c="B", w="WHERE cohort = 'B'"), _TASK.format(c="both", w="")]), RESPONSE))
def tasks(spark, sf_dir):
    return L.tasks(response(spark, sf_dir), ["A", "B", "both"])


@register(
    "m31_t02_pairs",
    with_sql("SELECT disease, drug, n_lines, round(sd, 6) sd_y FROM (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY n_lines DESC, drug) rn FROM (SELECT disease, drug, count(DISTINCT cell) n_lines, stddev_samp(sens_z) sd FROM metric WHERE regexp_matches(drug, '(?i)brand#[123]') GROUP BY ALL) WHERE n_lines >= 20 AND sd >= 0.3) WHERE rn <= 4 ORDER BY n_lines DESC, disease, drug LIMIT 12", METRIC),
)
def pairs(spark, sf_dir):
    return L.pairs(metric(spark, sf_dir), "sens_z", per_disease=4, cap=12, like=["brand#[123]"]).select("disease", "drug", "n_lines", R6("sd_y").alias("sd_y"))


_PREDS = {
    "mean": (f"{_lfo('')}", "y"),
    "drugmean": (f"coalesce({_lfo(', drug')}, {_lfo('')})", "y"),
    "disease_drugmean": (f"coalesce({_lfo(', disease, drug')}, {_lfo(', drug')}, {_lfo('')})", "y"),
}
_ARM_ROWS = "preds AS (" + " UNION ALL ".join(f"SELECT '{a}' model, repeat, disease, round({y}, 9) y, round({p}, 9) y_pred FROM d" for a, (p, y) in _PREDS.items()) + f"""
 UNION ALL SELECT 'tissue_oracle', repeat, disease, round(r, 9), round(coalesce((sum(r) OVER (PARTITION BY repeat, disease) - sum(r) OVER (PARTITION BY repeat, disease, fold)) / nullif(count(r) OVER (PARTITION BY repeat, disease) - count(r) OVER (PARTITION BY repeat, disease, fold), 0), 0), 9)
 FROM (SELECT *, y - coalesce({_lfo(', drug')}, {_lfo('')}) AS r FROM d)),
met AS (SELECT model, repeat, disease, count(*) n, corr(ry, rp) s, sqrt(avg(pow(y - y_pred, 2))) rmse, 1 - sum(pow(y - y_pred, 2)) / nullif(var_pop(y) * count(*), 0) r2 FROM (SELECT *, {AVG_RANK.format(p='model, repeat, disease', v='y')} ry, {AVG_RANK.format(p='model, repeat, disease', v='y_pred')} rp FROM preds) GROUP BY ALL),
mm AS (SELECT *, CASE WHEN isnan(s) THEN NULL ELSE s END sp FROM met)"""


@register(
    "m30_l14_ablation",
    with_sql("SELECT model, disease, round(avg(sp), 5) spearman, round(avg(sp) - 1.96 * coalesce(stddev_samp(sp), 0) / sqrt(count(sp)), 5) spearman_lo, round(avg(sp) + 1.96 * coalesce(stddev_samp(sp), 0) / sqrt(count(sp)), 5) spearman_hi, round(avg(rmse), 6) rmse, round(avg(r2), 6) r2, max(n) n_rows FROM mm GROUP BY ALL", _ROWS, _ARM_ROWS),
)
def ablation(spark, sf_dir):
    rows = metric(spark, sf_dir).where("sens_z is not null").select("cohort", "cell", "drug", "disease", F.col("sens_z").alias("y"))
    out = L.ablation(rows)
    return out.select("model", "disease", *(F.round(c, 5).alias(c) for c in ("spearman", "spearman_lo", "spearman_hi")), R6("rmse").alias("rmse"), R6("r2").alias("r2"), "n_rows")


@register("m20_m21_signature_scan")
def signature_scan(spark, sf_dir):
    return L.signature_scan(_design(spark, sf_dir), ["disease", "drug"], "cell", "y", "vector", n_perm=10)


_ATLAS = """emb AS (SELECT 'SET_' || (vec_id + 1) AS pathway, g, embedding[g]::double x FROM embeddings, range(1, 65) r(g)),
k AS (SELECT *, row_number() OVER (PARTITION BY result ORDER BY abs(nes) DESC, pathway) rk FROM gsea WHERE padj <= 0.25 AND nes >= 1),
c AS (SELECT result, g, sum(abs(nes) * x) / nullif(sum(abs(nes)), 0) m FROM k JOIN emb USING (pathway) WHERE rk <= 50 GROUP BY ALL), l AS (SELECT result, sqrt(sum(m * m)) l FROM c GROUP BY 1),
n AS (SELECT result, string_agg(pathway, '/' ORDER BY rk) top_pathways FROM k WHERE rk <= 10 GROUP BY 1)"""


@register("v05_build_atlas", with_sql("SELECT c.result, c.g::int AS g, round(m / l, 6) x, top_pathways FROM c JOIN l ON c.result = l.result JOIN n ON n.result = c.result", _GSEA, _ATLAS))
def build_atlas(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("SET_"), F.col("vec_id") + 1).alias("pathway"), "embedding")
    out = L.build_atlas(_gsea(spark, sf_dir), emb, "result", "pathway", "embedding")
    return out.select("result", F.array_join("top_pathways", "/").alias("top_pathways"), F.posexplode("vector").alias("g", "x")).select("result", (F.col("g") + 1).alias("g"), R6("x").alias("x"), "top_pathways")


@register("w04_group_mean_residual", with_sql("SELECT cohort, cell, drug, round(a - avg(a) OVER (PARTITION BY disease, drug)) / 1e6 residual FROM (SELECT *, round(auc * 1e6) a FROM response)", RESPONSE))
def w04(spark, sf_dir):
    # whole millionths have exact sums, in whatever order they are added
    whole = response(spark, sf_dir).withColumn("auc", F.round(F.col("auc") * 1e6))
    return L.group_mean_residual(whole, ["disease", "drug"], "auc").select("cohort", "cell", "drug", (F.round("residual") / 1e6).alias("residual"))


@register("p03_log1p", "SELECT c_custkey, round(ln(1 + abs(c_acctbal)), 6) v FROM customer")
def p03(spark, sf_dir):
    from heddle.operators.layers import log1p_matrix

    return log1p_matrix(table(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("v")), "v").withColumn("v", R6("v"))


@register("p05_j05_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)")
def p05(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@register("p06_prefixes", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#33')")
def p06(spark, sf_dir):
    return L.prefixed(table(spark, sf_dir, "part"), "p_brand", ["Brand#1", "Brand#33"]).select("p_partkey")


@register("p27_mixed_lineage", "SELECT c_custkey, starts_with(d, 'SITE_') OR upper(d) = 'UNABLE TO CLASSIFY' AS mixed FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'SITE_X' WHEN c_custkey % 3 = 1 THEN 'Unable to Classify' ELSE c_mktsegment END d FROM customer)")
def p27(spark, sf_dir):
    k = F.col("c_custkey")
    d = F.when(k % 3 == 0, "SITE_X").when(k % 3 == 1, "Unable to Classify").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(k, (d.startswith("SITE_") | (F.upper(d) == "UNABLE TO CLASSIFY")).alias("mixed"))


@register("a10_mean_exp", with_sql("SELECT cell, drug, round(avg(exp(ln(qty))), 6) ic50 FROM raw WHERE cohort = 'A' GROUP BY ALL", RAW))
def a10(spark, sf_dir):
    return raw(spark, sf_dir).where("cohort = 'A'").groupBy("cell", "drug").agg(R6(F.avg(F.exp(F.ln("qty")))).alias("ic50"))


@register("a27_a28_member_lists", "SELECT c_mktsegment, string_agg(DISTINCT n_name, ';' ORDER BY n_name) nations, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def a27(spark, sf_dir):
    met = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ";").alias("nations"), F.count("*").alias("n"))


@register(
    "r03_r04_r09_report",
    with_sql("SELECT cohort, round(avg(hi - lo), 6) ci_width, round(quantile_cont(m, 0.5), 6) median, round(avg((m > 0)::int), 6) positive, round(avg(m), 6) mean FROM (SELECT cohort, disease, avg(sens_z) m, avg(sens_z) - 1.96 * stddev_samp(sens_z) / sqrt(count(sens_z)) lo, avg(sens_z) + 1.96 * stddev_samp(sens_z) / sqrt(count(sens_z)) hi FROM metric GROUP BY ALL) GROUP BY 1", METRIC),
)
def report(spark, sf_dir):
    half = 1.96 * F.stddev_samp("sens_z") / F.sqrt(F.count("sens_z"))
    m = metric(spark, sf_dir).groupBy("cohort", "disease").agg(F.avg("sens_z").alias("m"), (F.avg("sens_z") - half).alias("lo"), (F.avg("sens_z") + half).alias("hi"))
    return m.groupBy("cohort").agg(R6(F.avg(F.col("hi") - F.col("lo"))).alias("ci_width"), R6(F.percentile("m", F.lit(0.5))).alias("median"), R6(F.avg((F.col("m") > 0).cast("int"))).alias("positive"), R6(F.avg("m")).alias("mean"))


@register("r01_r07_r10_ordered_labels", with_sql("SELECT replace(disease, '/', '-') AS label, n, (row_number() OVER (ORDER BY n DESC, disease))::int AS ord FROM (SELECT disease, count(DISTINCT cell) n FROM response GROUP BY 1) ORDER BY n DESC, disease LIMIT 20", RESPONSE))
def ordered_labels(spark, sf_dir):
    from pyspark.sql import Window

    from heddle.functions.text import site_label

    top = response(spark, sf_dir).groupBy("disease").agg(F.countDistinct("cell").alias("n")).orderBy(F.desc("n"), "disease").limit(20)
    return top.select(site_label(F.col("disease")).alias("label"), "n", F.row_number().over(Window.orderBy(F.desc("n"), "disease")).alias("ord"))


@register("l12_drug_tables", with_sql("SELECT cohort, native, nname, n FROM (SELECT cohort, drug_name AS native, regexp_replace(lower(drug_name), '[^a-z0-9]', '', 'g') nname, count(*) n FROM raw GROUP BY ALL)", RAW))
def drug_tables(spark, sf_dir):
    from heddle.functions.text import norm_name

    return raw(spark, sf_dir).groupBy("cohort", F.col("drug_name").alias("native")).agg(F.count("*").alias("n")).withColumn("nname", norm_name(F.col("native")))


@register(
    "r05_pooled_null",
    "SELECT c_nationkey, round(quantile_cont(m + greatest(s, 0.001) * sqrt(-2 * ln(u1)) * cos(2 * pi() * u2), 0.95), 5) p95 FROM (SELECT c_nationkey, m, s, (('0x' || substr(h, 1, 8))::bigint + 0.5::double) / 4294967296.0::double u1, (('0x' || substr(h, 9, 8))::bigint + 0.5::double) / 4294967296.0::double u2 FROM (SELECT *, md5('0|' || c_nationkey || '|' || k) h FROM (SELECT c_nationkey, round(avg(c_acctbal), 6) m, round(stddev_pop(c_acctbal), 6) s FROM customer GROUP BY 1), range(1, 101) r(k))) GROUP BY 1",
)
def pooled_null(spark, sf_dir):
    base = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(R6(F.avg("c_acctbal")).alias("m"), R6(F.stddev_pop("c_acctbal")).alias("s"))
    draws = L.pooled_null(base, ["c_nationkey"], "m", "s")
    return draws.groupBy("c_nationkey").agg(F.round(F.percentile("draw", F.lit(0.95)), 5).alias("p95"))


@register(
    "l15_panel_design",
    with_sql(
        """SELECT disease, drug, cell, round(y, 6) y, len(v) n_features, round(list_sum(v), 5) total FROM (SELECT disease, drug, cell, avg(sens_z) y FROM metric GROUP BY ALL) p JOIN (SELECT vec_id, list_transform(range(1, 65), lambda i: embedding[i]::double) v FROM embeddings) ON vec_id = cell WHERE y IS NOT NULL""",
        METRIC,
    ),
)
def panel_design(spark, sf_dir):
    from heddle.plans.fixture import expression

    out = L.panel_design(metric(spark, sf_dir), expression(spark, sf_dir), ["disease", "drug"], "cell", "sens_z", "gene", "value")
    return out.select("disease", "drug", "cell", R6("y").alias("y"), F.size("vector").cast("long").alias("n_features"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@register(
    "l19_expression_store",
    "WITH f AS (SELECT p_brand AS gene, * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) rn FROM part) WHERE rn = 1) SELECT gene, 'c1' AS cell, round(ln(1 + p_size), 6) AS value FROM f UNION ALL SELECT gene, 'c2', round(ln(1 + p_retailprice), 6) FROM f",
)
def expression_store(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("."), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("gene"), F.col("p_size").alias("s1"), F.col("p_retailprice").alias("s2"), F.col("p_partkey").alias("s3"))
    samples = spark.sql("SELECT * FROM VALUES ('s1', 'c1', 1), ('s2', 'c2', 2), ('s3', 'c2', 3), ('s4', null, 4) AS t(sample, cell, o)")
    out = L.expression_store(wide, samples, "gene", "sample", "cell", "o")
    return out.select("gene", "cell", R6("value").alias("value"))


@register("v04_s15_embed_names", "SELECT p_brand, (p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 5 = 0)) AS known FROM (SELECT DISTINCT trim(p_brand) p_brand, trim(p_name) n FROM part WHERE trim(p_name) <> '')")
def embed_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = L.gene_sets(p, "p_brand", "p_name")
    cache = p.where("p_partkey % 5 = 0").select("p_brand", F.array(F.lit(1.0)).alias("vector"))
    return L.embed_names(names, cache, "p_brand", "vector").select("p_brand", F.col("vector").isNotNull().alias("known"))


@register(
    "v04_embed_missing",
    "WITH n AS (SELECT p_name, min(p_partkey) k FROM part GROUP BY 1) SELECT p_name, k % 2 = 0 AS cached, CASE WHEN k % 2 = 0 THEN [1.0, 0, 0, 0, 0, 0, 0, 0] ELSE list_transform(range(8), lambda b: len(list_filter(string_split(p_name, ''), lambda c: ascii(c) % 8 = b))::double) END::varchar AS vector FROM n",
)
def embed_missing(spark, sf_dir):
    """Half of the names are in the cache; the encoder gives the others."""
    n = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    unit = F.array(*(F.lit(1.0 if b == 0 else 0.0) for b in range(8)))
    out, _ = L.embed(n.select("p_name"), n.where("k % 2 = 0").select("p_name", unit.alias("v")), "p_name", "v", L.letter_encoder)
    shown = F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x.cast("string")), ", "), F.lit("]"))
    return out.join(n, "p_name").select("p_name", (F.col("k") % 2 == 0).alias("cached"), shown.alias("vector"))
