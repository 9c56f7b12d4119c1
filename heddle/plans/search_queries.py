"""Queries of the search service, the documents, the sources and the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.functions.stats import binomial_tail, dot, normal_percentile
from heddle.operators import documents as D
from heddle.operators import vectors as V
from heddle.plans.fixture import AVG_RANK, METRIC, expression, metric, table, with_sql
from heddle.plans.registry import register
from heddle.sources import tables as S

R6 = lambda c: F.round(c, 6)

#: A stand-in for enrichment results: one result per label, a row per component.
_GSEA = "gsea AS (SELECT label::varchar AS result, 'SET_' || g AS pathway, round(avg(embedding[g]::double) * 40, 6) nes, round(abs(sin(g * 1.7 + label)) * 0.5, 6) padj FROM embeddings, range(1, 65) r(g) GROUP BY label, g)"


def _gsea(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("g", "x")).withColumn("g", F.col("g") + 1)
    return e.groupBy("label", "g").agg(R6(F.avg(F.col("x").cast("double")) * 40).alias("nes")).select(F.col("label").cast("string").alias("result"), F.concat(F.lit("SET_"), "g").alias("pathway"), "nes", R6(F.abs(F.sin(F.col("g") * 1.7 + F.col("label"))) * 0.5).alias("padj"))


_KEPT = "kept AS (SELECT *, row_number() OVER (PARTITION BY result, direction ORDER BY abs(nes) DESC, pathway) rk FROM (SELECT *, CASE WHEN nes > 0 THEN 'activated' ELSE 'suppressed' END direction FROM gsea WHERE padj <= 0.25 AND abs(nes) >= 1))"


def _kept(spark, sf_dir, top=5):
    return V.filter_result(_gsea(spark, sf_dir), "result", "pathway", top_k=top)


@register("p10_w07_filter_result", with_sql("SELECT result, direction, pathway, nes, rk::int AS rank FROM kept WHERE rk <= 5", _GSEA, _KEPT))
def filter_result(spark, sf_dir):
    return _kept(spark, sf_dir).select("result", "direction", "pathway", "nes", "rank")


@register("p11_relax_if_empty", with_sql("SELECT result, pathway FROM (SELECT *, count(*) FILTER (WHERE padj <= 0.02 AND abs(nes) >= 4) OVER (PARTITION BY result) some_ FROM gsea) WHERE CASE WHEN some_ > 0 THEN padj <= 0.02 AND abs(nes) >= 4 ELSE padj <= 1 END", _GSEA))
def relax(spark, sf_dir):
    return V.relax_if_empty(_gsea(spark, sf_dir), "result", 0.02, 4.0).select("result", "pathway")


@register(
    "e08_direction_warnings",
    with_sql("SELECT r.result, d AS direction, coalesce(n, 0) n, CASE WHEN coalesce(n, 0) = 0 THEN 'no pathways' ELSE 'few pathways' END AS warning FROM (SELECT DISTINCT result FROM gsea) r CROSS JOIN (VALUES ('activated'), ('suppressed')) v(d) LEFT JOIN (SELECT result, direction, count(*) n FROM kept WHERE abs(nes) >= 3 GROUP BY ALL) k ON k.result = r.result AND k.direction = d WHERE coalesce(n, 0) < 3", _GSEA, _KEPT),
)
def warnings(spark, sf_dir):
    g = _gsea(spark, sf_dir)
    return V.direction_warnings(V.filter_result(g, "result", "pathway", abs_nes_min=3.0), g, "result").select("result", "direction", F.col("n").cast("long").alias("n"), "warning")


_CENTROID = """cen AS (SELECT label, g, sum(abs(w) * x) / nullif(sum(abs(w)), 0) m FROM (SELECT label, vec_id % 7 - 3 AS w, g, embedding[g]::double x FROM embeddings, range(1, 65) r(g)) GROUP BY ALL), nrm AS (SELECT label, sqrt(sum(m * m)) l FROM cen GROUP BY 1)"""


@register("a19_v03_centroid", with_sql("SELECT cen.label, g::int AS g, round(m / l, 6) x FROM cen JOIN nrm ON cen.label = nrm.label", _CENTROID))
def centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("w", F.col("vec_id") % 7 - 3)
    return V.centroid(e, ["label"], "embedding", "w").select("label", F.posexplode("vector").alias("g", "x")).select("label", (F.col("g") + 1).alias("g"), R6("x").alias("x"))


_ATLAS = "atlas AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) v FROM embeddings)"
_SELF = "selfs AS (SELECT a.vec_id, avg(list_dot_product(a.v, b.v)) r, stddev_pop(list_dot_product(a.v, b.v)) sd FROM atlas a JOIN atlas b ON a.vec_id <> b.vec_id GROUP BY 1)"


def _atlas(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


@register("v06_j10_self_similarity", with_sql("SELECT vec_id, round(r, 6) r, round(sd, 6) sd FROM selfs", _ATLAS, _SELF))
def self_similarity(spark, sf_dir):
    out = V.self_similarity(_atlas(spark, sf_dir), "vec_id", "vector")
    return out.select("vec_id", R6("r").alias("r"), R6("sd").alias("sd"))


_SCORED = "scored AS (SELECT q.vec_id query, CASE WHEN q.vec_id % 4 = 0 THEN q.label WHEN q.vec_id % 3 = 0 THEN 999 END wanted, a.vec_id, a.label, list_dot_product(a.v, q.v) c, (list_dot_product(a.v, q.v) - r) / (sd + 5e-7) z FROM atlas a JOIN selfs ON a.vec_id = selfs.vec_id, atlas q WHERE q.vec_id % 50 = 0)"


def _queries(spark, sf_dir):
    k = F.col("vec_id")
    return _atlas(spark, sf_dir).where("vec_id % 50 = 0").select(k.alias("query"), F.when(k % 4 == 0, F.col("label")).when(k % 3 == 0, 999).alias("wanted"), F.col("vector").alias("qvector"))


@register("j11_v07_csls", with_sql("SELECT query, vec_id, round(c, 6) cosine, round(z, 5) csls_z FROM scored", _ATLAS, _SELF, _SCORED))
def csls(spark, sf_dir):
    a = _atlas(spark, sf_dir)
    scored = V.against(V.self_similarity(a, "vec_id", "vector", "vector"), _queries(spark, sf_dir).drop("wanted"), "vec_id", "vector", "qvector", True)
    out = V.csls(scored)
    return out.select("query", "vec_id", R6("cosine").alias("cosine"), F.round("csls_z", 5).alias("csls_z"))


_ERF = "(sign(x) * (1 - (1 / (1 + 0.3275911 * abs(x))) * (0.254829592 + (1 / (1 + 0.3275911 * abs(x))) * (-0.284496736 + (1 / (1 + 0.3275911 * abs(x))) * (1.421413741 + (1 / (1 + 0.3275911 * abs(x))) * (-1.453152027 + (1 / (1 + 0.3275911 * abs(x))) * 1.061405429)))) * exp(-x * x)))"


@register(
    "v08_v13_search",
    with_sql(
        f"""SELECT query, vec_id, broadened, round(z, 5) csls_z, round(ez, 5) evidence_z, round(50 * (1 + {_ERF}), 4) percentile, rk::int AS rank FROM (SELECT *, ez / sqrt(2) AS x FROM (SELECT *, (z - avg(z) OVER (PARTITION BY query)) / (stddev_pop(z) OVER (PARTITION BY query) + 1e-9) ez, row_number() OVER (PARTITION BY query ORDER BY z DESC, vec_id) rk
        FROM (SELECT *, count(*) FILTER (WHERE label = wanted) OVER (PARTITION BY query) = 0 AND wanted IS NOT NULL AS broadened, count(*) FILTER (WHERE label = wanted) OVER (PARTITION BY query) some_ FROM scored) WHERE some_ = 0 OR label = wanted)) WHERE rk <= 20""",
        _ATLAS, _SELF, _SCORED,
    ),
)
def search(spark, sf_dir):
    out = V.SignatureSearch(_atlas(spark, sf_dir), "vec_id", "label", "vector").search(_queries(spark, sf_dir), 20)
    return out.select("query", "vec_id", "broadened", F.round("csls_z", 5).alias("csls_z"), F.round("evidence_z", 5).alias("evidence_z"), F.round("percentile", 4).alias("percentile"), "rank")


@register("t07_v09_matched", with_sql("SELECT label, vec_id, round(best, 6) best, rk::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY best DESC, vec_id) rk FROM (SELECT a.label, a.vec_id, max(greatest(-1.0, least(1.0, list_dot_product(a.v, q.v)))) best FROM atlas a, atlas q WHERE q.vec_id % 50 = 0 GROUP BY ALL)) WHERE rk <= 3", _ATLAS))
def matched(spark, sf_dir):
    a = _atlas(spark, sf_dir)
    return V.matched(a, _queries(spark, sf_dir), "label", "vec_id", "vector", "qvector").select("label", "vec_id", R6("best").alias("best"), "rank")


@register(
    "v10_best_match",
    with_sql("SELECT r.a, r.b, round((r.m + c.m) / 2, 6) similarity FROM (SELECT a, b, avg(m) m FROM (SELECT a, b, i, max(s) m FROM sims GROUP BY ALL) GROUP BY ALL) r JOIN (SELECT a, b, avg(m) m FROM (SELECT a, b, j, max(s) m FROM sims GROUP BY ALL) GROUP BY ALL) c ON r.a = c.a AND r.b = c.b", _ATLAS, "sims AS (SELECT x.label a, y.label b, x.vec_id i, y.vec_id j, greatest(-1.0, least(1.0, list_dot_product(x.v, y.v))) s FROM atlas x JOIN atlas y ON y.label = x.label + 1)"),
)
def best_match(spark, sf_dir):
    a = _atlas(spark, sf_dir)
    pairs = a.select(F.col("label").alias("a"), (F.col("label") + 1).alias("b"))  # each label with the next one
    return V.best_match(a, a, "label", "vec_id", "vector", pairs).select("a", "b", R6("similarity").alias("similarity"))


@register(
    "v10_best_match_all",
    with_sql("SELECT r.a, r.b, round((r.m + c.m) / 2, 6) similarity FROM (SELECT a, b, avg(m) m FROM (SELECT a, b, i, max(s) m FROM sims GROUP BY ALL) GROUP BY ALL) r JOIN (SELECT a, b, avg(m) m FROM (SELECT a, b, j, max(s) m FROM sims GROUP BY ALL) GROUP BY ALL) c ON r.a = c.a AND r.b = c.b", _ATLAS, "sims AS (SELECT x.label a, y.label b, x.vec_id i, y.vec_id j, greatest(-1.0, least(1.0, list_dot_product(x.v, y.v))) s FROM atlas x JOIN atlas y ON x.label < y.label)"),
)
def best_match_all(spark, sf_dir):
    """Every pair of labels, from blocks."""
    return V.best_match_all(_atlas(spark, sf_dir), "label", "vec_id", "vector", 64).select("a", "b", R6("similarity").alias("similarity"))


@register(
    "j13_v12_nes_correlation",
    with_sql(f"SELECT a, b, count(*) shared, CASE WHEN count(*) >= 2 AND NOT isnan(corr(rx, ry)) THEN round(corr(rx, ry), 6) END rho FROM (SELECT a, b, {AVG_RANK.format(p='a, b', v='x')} rx, {AVG_RANK.format(p='a, b', v='y')} ry FROM (SELECT p.result a, q.result b, p.nes x, q.nes y FROM k p JOIN k q ON p.pathway = q.pathway AND p.result < q.result)) GROUP BY ALL", _GSEA, _KEPT, "k AS (SELECT * FROM kept WHERE rk <= 20)"),
)
def nes_correlation(spark, sf_dir):
    return V.nes_correlation(_kept(spark, sf_dir, 20), "result", "pathway").withColumn("rho", R6("rho"))


@register("j17_a24_consensus", with_sql("SELECT pathway, round(avg(nes), 6) nes FROM gsea GROUP BY 1 ORDER BY abs(round(avg(nes), 6)) DESC, pathway LIMIT 15", _GSEA))
def consensus(spark, sf_dir):
    return _gsea(spark, sf_dir).groupBy("pathway").agg(R6(F.avg("nes")).alias("nes")).orderBy(F.desc(F.abs("nes")), "pathway").limit(15)


@register("u07_shared_themes", with_sql("SELECT len(list_intersect(a, b)) shared, len(list_filter(a, lambda x: NOT list_contains(b, x))) only_a, len(list_filter(b, lambda x: NOT list_contains(a, x))) only_b FROM (SELECT coalesce((SELECT list(pathway) FROM kept WHERE result = '0' AND rk <= 20), []) a, coalesce((SELECT list(pathway) FROM kept WHERE result = '1' AND rk <= 20), []) b)", _GSEA, _KEPT))
def themes(spark, sf_dir):
    sets = _kept(spark, sf_dir, 20).agg(*(F.collect_set(F.when(F.col("result") == r, F.col("pathway"))).alias(n) for r, n in (("0", "a"), ("1", "b"))))
    parts = V.shared_themes(F.col("a"), F.col("b"))
    return sets.select(*(F.size(p).cast("long").alias(n) for p, n in zip(parts, ("shared", "only_a", "only_b"), strict=True)))


@register("t09_v11_clusters")
def clusters(spark, sf_dir):
    """Average linkage of the label centroids: one row per label; the matrix has a row per label only."""
    import numpy as np

    rows = V.centroid(table(spark, sf_dir, "embeddings").withColumn("w", F.lit(1)), ["label"], "embedding", "w").orderBy("label").collect()
    m = np.array([r["vector"] for r in rows])
    order, _, flat = V.average_linkage(m @ m.T)
    return spark.createDataFrame([(r["label"], order.index(i), flat[i]) for i, r in enumerate(rows)], "label int, leaf int, cluster int")


_BROAD = "broad AS (SELECT disease, drug, s, n, rk FROM (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY s, drug) rk FROM (SELECT disease, drug, avg(sens_z) s, count(*) n FROM metric GROUP BY ALL) WHERE n >= 5 AND s IS NOT NULL) WHERE rk <= 15)"


@register(
    "v16_cell_documents",
    with_sql(
        """SELECT c_custkey AS cell, c_name AS name, c_mktsegment disease, count(drug) n_drugs, (SELECT count(*) FROM customer d WHERE d.c_mktsegment = c.c_mktsegment) n_disease_lines, string_agg(drug, ',' ORDER BY rk) drugs, round(sum(ls), 3) line_sum
        FROM customer c LEFT JOIN (SELECT b.*, c2 cell2, round(m.z, 3) ls FROM broad b JOIN (SELECT c_custkey c2, c_mktsegment g FROM customer) ON g = b.disease LEFT JOIN (SELECT cell, drug, avg(sens_z) z FROM metric GROUP BY ALL) m ON m.cell = c2 AND m.drug = b.drug) x ON x.cell2 = c_custkey GROUP BY c_custkey, c_name, c_mktsegment""",
        METRIC, _BROAD,
    ),
)
def cell_documents(spark, sf_dir):
    m = metric(spark, sf_dir)
    broad = D.broad_spectrum(m, "disease", "drug", "sens_z")
    line = m.groupBy("cell", "drug").agg(F.avg("sens_z").alias("line_sens")).withColumn("ic50", F.lit(None).cast("double"))
    mech = D.mechanism(broad.select("disease", "drug", F.lit(0.5).alias("perm_p"), F.lit(0.0).alias("perm_z"), F.lit(0.0).alias("rho")), "disease", "drug")
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("disease"))
    docs = D.documents(cells, broad, mech, "cell", "name", "disease", "drug", line).select("document.*")
    arm = F.col("broad_spectrum")
    total = F.aggregate(arm, F.lit(0.0), lambda s, x: s + F.coalesce(x["line_sens"], F.lit(0.0)))
    some = F.exists(arm, lambda x: x["line_sens"].isNotNull())
    return docs.select("cell", "name", "disease", F.col("n_drugs").cast("long").alias("n_drugs"), "n_disease_lines", F.array_join(F.transform(arm, lambda x: x["drug"]), ",").alias("drugs"), F.round(F.when(some, total), 3).alias("line_sum"))


@register("p20_w15_mechanism", with_sql("SELECT disease, drug, perm_p, perm_z, rk::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY perm_z DESC NULLS LAST, rho DESC NULLS LAST, drug) rk FROM sig WHERE perm_p <= 0.4) WHERE rk <= 4", METRIC, "sig AS (SELECT disease, drug, round(abs(avg(sens_z)) * 10, 6) perm_p, CASE WHEN drug <> 'Brand#11' THEN (count(*) % 7)::double END perm_z, round(avg(sens_z), 6) rho FROM metric GROUP BY disease, drug)"))
def mechanism(spark, sf_dir):
    s = metric(spark, sf_dir).groupBy("disease", "drug").agg(R6(F.abs(F.avg("sens_z")) * 10).alias("perm_p"), F.when(F.col("drug") != "Brand#11", (F.count("*") % 7).cast("double")).alias("perm_z"), R6(F.avg("sens_z")).alias("rho"))
    return D.mechanism(s, "disease", "drug", 0.4, 4).select("disease", "drug", "perm_p", "perm_z", "rank")


@register("p19_without_probes", "SELECT DISTINCT p_brand, p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 40 = 3)")
def without_probes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    status = p.select("p_name", F.when(F.col("p_partkey") % 40 == 3, "probe").otherwise("clinical").alias("status"))
    return D.without_probes(p.select("p_brand", "p_name").distinct(), status, "p_name")


@register(
    "f09_pretty_disease",
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Breast' WHEN 1 THEN 'Soft Tissue' WHEN 2 THEN 'Unclassified' WHEN 3 THEN 'unknown' ELSE c_mktsegment END AS label FROM customer",
)
def pretty_disease(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.when(k % 5 == 0, "BRCA").when(k % 5 == 1, "SITE_SOFT_TISSUE").when(k % 5 == 2, "Unable to classify").when(k % 5 == 4, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(k, X.pretty_disease(code).alias("label"))


@register("f16_normal_percentile", f"SELECT event_id, round(50 * (1 + {_ERF}), 5) pct FROM (SELECT event_id, (value - 50) / 25 / sqrt(2) AS x FROM events)")
def percentile(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(normal_percentile((F.col("value") - 50) / 25), 5).alias("pct"))


@register("f19_digest_score", "SELECT p_partkey, round(0.55 + 0.4 * (('0x' || substr(sha256(p_name), 1, 8))::bigint % 10000) / 9999.0::double, 6) score FROM part")
def digest_score(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R6(X.digest_score(F.col("p_name"))).alias("score"))


@register("f20_dot_norm", "SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double)), 6) n2 FROM embeddings")
def dot_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", R6(dot(F.col("embedding"), F.col("embedding"))).alias("n2"))


@register("f21_s13_gsea_rows", "SELECT p_partkey::varchar || ':' || p_name AS description, p_retailprice AS nes, CASE WHEN p_partkey % 3 = 0 THEN p_partkey / 1000.0::double WHEN p_partkey % 3 = 1 THEN 0.25 END padj FROM part WHERE p_partkey % 4 <> 0")
def gsea_rows(spark, sf_dir):
    k = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        F.concat(k.cast("string"), F.lit(":"), "p_name").alias("Description"), F.when(k % 4 != 0, F.col("p_retailprice").cast("string")).otherwise("Inf").alias("NES"),
        F.when(k % 3 == 0, (k / F.lit(1000.0)).cast("string")).otherwise("").alias("p.adjust"), F.when(k % 3 == 1, "0.25").otherwise(" ").alias("FDR"),
    )
    return S.gsea_rows(raw)


@register("v01_apply_mapping", "SELECT 'q' result, p_brand || '_' || p_partkey AS pathway, p_retailprice nes, 0.1::double padj, p_size::bigint AS size, 2::bigint n_genes, CASE WHEN (SELECT count(DISTINCT p_brand) FROM part WHERE p_size > 5) = 1 THEN 'x' END collection FROM part WHERE p_size > 5")
def mapping(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("_"), "p_partkey").alias("term"), F.col("p_retailprice").alias("score"), F.when(F.col("p_size") > 5, "0.1").otherwise("na").alias("q"), F.col("p_size").alias("n"), F.lit("A/ B/").alias("genes"))
    out = S.apply_mapping(p, {"pathway": "term", "nes": "score", "padj": "q", "size": "n", "leading_edge": "genes"}, "q")
    return out.select("result", "pathway", "nes", "padj", "size", F.size("leading_edge").cast("long").alias("n_genes"), "collection")


@register("r06_density_histogram", "SELECT bin::int AS bin, count(*) / ((SELECT count(*) FROM events) * 2.0::double) density FROM (SELECT least(49, floor(value / 2)) bin FROM events WHERE value >= 0 AND value <= 100) GROUP BY 1")
def histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = e.agg(F.count("*").alias("n"))
    bins = e.where("value >= 0 and value <= 100").groupBy(F.least(F.lit(49), F.floor(F.col("value") / 2)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    return bins.join(F.broadcast(n), how="cross").select("bin", (F.col("c") / (F.col("n") * 2.0)).alias("density"))


@register("r13_minmax_top", with_sql("SELECT result, pathway, round((nes - min(nes) OVER w) / (max(nes) OVER w - min(nes) OVER w + 1e-9), 5) x FROM (SELECT *, row_number() OVER (PARTITION BY result ORDER BY nes DESC, pathway) rk FROM gsea WHERE padj < 0.2 AND nes > 0) WHERE rk <= 11 WINDOW w AS (PARTITION BY result)", _GSEA))
def minmax(spark, sf_dir):
    from pyspark.sql import Window

    from heddle.operators.panels import head_per_group

    top = head_per_group(_gsea(spark, sf_dir).where("padj < 0.2 and nes > 0"), ["result"], [F.desc("nes"), F.asc("pathway")], 11)
    w = Window.partitionBy("result")
    return top.select("result", "pathway", F.round((F.col("nes") - F.min("nes").over(w)) / (F.max("nes").over(w) - F.min("nes").over(w) + 1e-9), 5).alias("x"))


@register("r12_r14_labels", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'p < .05' ELSE 'n.s.' END sig, CASE WHEN length(t) > 18 THEN substr(t, 1, 18) || '...' ELSE t END AS label FROM (SELECT *, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') t FROM part)")
def labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 10, "p < .05").otherwise("n.s.").alias("sig"), X.short_label(F.col("p_name"), 18).alias("label"))


@register("j08_u06_streamlike_distinct", "SELECT DISTINCT user_id, event_type FROM events WHERE value IS NOT NULL")
def distinct_entities(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_type").distinct()


@register("f22_nan_to_null", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END v FROM events")
def nan_to_null(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.nan_to_null(F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("v"))


@register("m25_binomial_tail", "SELECT k, n, CASE WHEN k <= 0 THEN 1.0 ELSE round((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.3) + (n - i) * ln(0.7))) FROM range(0, 40) r(i) WHERE i >= k AND i <= n), 6) END p FROM (SELECT DISTINCT p_size % 10 AS k, 10 + p_size % 30 AS n FROM part)")
def tail(spark, sf_dir):
    d = table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("k"), (10 + F.col("p_size") % 30).alias("n")).distinct()
    return d.select("k", "n", R6(binomial_tail(F.col("k"), F.col("n"), F.lit(0.3))).alias("p"))
