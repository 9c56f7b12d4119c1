"""Queries of the layer, panel and enrichment stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions.stats import quartile_of_rank
from heddle.operators import layers as L
from heddle.operators import omics as O
from heddle.operators import panels as P
from heddle.plans.fixture import AVG_RANK, EXPRESSION, METRIC, PANEL_MEANS, RESPONSE, expression, metric, panel_means, response, table, with_sql
from heddle.plans.registry import register

R6 = lambda c: F.round(c, 6)
TYPES = ["click", "view", "purchase", "signup", "logout"]


def _types(spark, sf_dir):
    return sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())  # five names


@register(
    "a06_a07_presence_long",
    "WITH p AS (SELECT c_custkey cell FROM customer), f AS (SELECT DISTINCT event_type FROM events WHERE value > 50 AND event_type IS NOT NULL) SELECT cell, event_type, CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.value > 50 AND e.user_id = cell AND e.event_type = f.event_type) THEN 1 ELSE 0 END AS value FROM p, f",
)
def presence_long(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 50").select(F.col("user_id").alias("cell"), "event_type")
    return L.presence_long(e, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell")), "cell", "event_type")


@register(
    "a06_presence_wide",
    "SELECT c.c_custkey AS cell, coalesce(max((l_returnflag = 'A')::int), 0) ret_A, coalesce(max((l_returnflag = 'N')::int), 0) ret_N, coalesce(max((l_returnflag = 'R')::int), 0) ret_R FROM customer c LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def presence_wide(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("cell"), F.col("l_returnflag").alias("f"))
    return L.wide_presence_complete(rows, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell")), "cell", "f", "ret_", ["A", "N", "R"])


@register(
    "p07_p08_driver_events",
    "SELECT event_id, user_id FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'FALSE' END passed, CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE (event_id % 6)::varchar END cnt, 'd' || (event_id % 10) drv FROM events) WHERE upper(passed) = 'TRUE' AND (drv IN ('d2', 'd4') OR coalesce(try_cast(cnt AS double), 0) >= 3)",
)
def driver_events(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").withColumns({"passed": F.when(k % 2 == 0, "true").otherwise("FALSE"), "cnt": F.when(k % 5 == 0, "n/a").otherwise((k % 6).cast("string")), "drv": F.concat(F.lit("d"), k % 10)})
    return L.driver_events(e, "passed", "drv", ["d2", "d4"], "cnt").select("event_id", "user_id")


@register(
    "p09_any_flag",
    "SELECT l_orderkey, count(*) n FROM lineitem WHERE coalesce(l_quantity > 45, false) OR coalesce(CASE WHEN l_discount > 0.05 THEN l_tax > 0.07 END, false) GROUP BY 1",
)
def any_flag(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_quantity") > 45, "b": F.when(F.col("l_discount") > 0.05, F.col("l_tax") > 0.07)})
    return rows.where(L.any_flag("a", "b")).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register(
    "l01_unpivot_numeric",
    "SELECT c_custkey, 'bal' AS feature, c_acctbal::double AS value FROM customer UNION ALL SELECT c_custkey, 'seg', NULL FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::double FROM customer",
)
def unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"))
    return L.unpivot_numeric(wide, "c_custkey", ["bal", "seg", "nation"])


@register("a08_locus_mean", with_sql("SELECT gene % 8 AS gene, cell, round(avg(value), 6) AS value FROM expression GROUP BY 1, 2", EXPRESSION))
def locus_mean(spark, sf_dir):
    e = expression(spark, sf_dir).withColumn("gene", F.col("gene") % 8)
    return L.locus_mean(e, "gene", "cell", "value").withColumn("value", R6("value"))


@register(
    "s22_features_as_rows",
    "SELECT o_orderpriority AS feature, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS \"F\", max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS \"O\", max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
)
def features_as_rows(spark, sf_dir):
    long = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("feature"), F.col("o_orderstatus").alias("cell")).agg(F.max("o_orderkey").alias("value"))
    return L.features_as_rows(long, "feature", "cell", "value", ["F", "O", "P"])


@register(
    "a20_r11_coverage",
    """WITH l AS (SELECT DISTINCT user_id cell, 'events' layer FROM events UNION SELECT DISTINCT vec_id, 'vectors' FROM embeddings), m AS (SELECT c_mktsegment, c_custkey, layer FROM customer LEFT JOIN l ON c_custkey = cell)
    SELECT c_mktsegment, n_cells, events, vectors, round(events / n_cells, 6) events_fraction, round(vectors / n_cells, 6) vectors_fraction FROM (SELECT c_mktsegment, count(DISTINCT c_custkey) n_cells, count(DISTINCT c_custkey) FILTER (WHERE layer = 'events') events, count(DISTINCT c_custkey) FILTER (WHERE layer = 'vectors') vectors FROM m GROUP BY 1)""",
)
def coverage(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), "c_mktsegment")
    layers = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.lit("events").alias("layer")).union(table(spark, sf_dir, "embeddings").select("vec_id", F.lit("vectors")))
    out = L.coverage(cells, layers, "c_mktsegment", "cell", "layer", ["events", "vectors"])
    return out.withColumns({c: R6(c) for c in ("events_fraction", "vectors_fraction")})


@register(
    "m28_attach_layer",
    """WITH v AS (SELECT user_id cell, event_type f, avg(value) v FROM events GROUP BY ALL), g AS (SELECT c_custkey, f FROM customer, (SELECT DISTINCT f FROM v))
    SELECT c_custkey, g.f AS feature, round(coalesce(v.v, avg(v.v) OVER (PARTITION BY g.f)), 6) AS value, (c_custkey NOT IN (SELECT cell FROM v))::int AS missing FROM g LEFT JOIN v ON c_custkey = cell AND g.f = v.f""",
)
def attach(spark, sf_dir):
    layer = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("value"))
    out = L.attach(table(spark, sf_dir, "customer").select("c_custkey"), layer, "c_custkey", "feature", "value", binary=False)
    return out.select("c_custkey", "feature", R6("value").alias("value"), "missing")


@register(
    "m29_impute_mean",
    "SELECT p_partkey, round(coalesce(v, avg(v) OVER (PARTITION BY p_brand)), 6) AS v FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END v FROM part)",
)
def impute(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("v"))
    return L.impute_mean(p, "p_brand", "v").select("p_partkey", R6("v").alias("v"))


@register(
    "w10_collapse_symbols",
    with_sql("SELECT symbol, gene, round(m, 6) mean_value FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY m DESC, gene) rn FROM (SELECT gene % 20 symbol, gene, avg(value) m FROM expression GROUP BY ALL)) WHERE rn = 1", EXPRESSION),
)
def symbols(spark, sf_dir):
    e = expression(spark, sf_dir).withColumn("symbol", F.col("gene") % 20)
    return L.collapse_symbols(e, "symbol", "gene", "value").withColumn("mean_value", R6("mean_value"))


@register("p21_t06_variance", with_sql("SELECT gene, round(var_samp(value), 6) variance FROM expression GROUP BY 1 ORDER BY var_samp(value) DESC, gene LIMIT 25", EXPRESSION))
def variance(spark, sf_dir):
    e = expression(spark, sf_dir)
    return L.top_variance(e.join(L.varying(e, "gene", "value").select("gene"), "gene", "left_semi"), "gene", "value", 25).withColumn("variance", R6("variance"))


@register("l08_doubled_genome", "SELECT p_partkey, coalesce(try_cast(x AS double) >= 1, false) wgd FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '2' WHEN 2 THEN 'NA' END x FROM part)")
def doubled(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k, L.doubled_genome(F.when(k % 4 == 0, "0").when(k % 4 == 1, "2").when(k % 4 == 2, "NA")).alias("wgd"))


@register("p13_supported", with_sql("SELECT cohort, cell, drug FROM response WHERE drug IN (SELECT drug FROM response GROUP BY 1 HAVING count(DISTINCT cell) >= 990)", RESPONSE))
def supported(spark, sf_dir):
    return P.supported(response(spark, sf_dir), "drug", "cell", 990).select("cohort", "cell", "drug")


@register("p14_supported_in_group", with_sql("SELECT cohort, cell, drug FROM response r WHERE (disease, drug) IN (SELECT (disease, drug) FROM response GROUP BY disease, drug HAVING count(DISTINCT cell) >= 200)", RESPONSE))
def supported_in_group(spark, sf_dir):
    return P.supported_in_group(response(spark, sf_dir), ["disease", "drug"], "cell", 200).select("cohort", "cell", "drug")


@register("p15_panels_by_rows", with_sql("SELECT disease, drug, count(DISTINCT cell) n_lines, round(stddev_samp(sens_z), 6) sd_y FROM metric GROUP BY ALL HAVING count(DISTINCT cell) >= 20 AND stddev_samp(sens_z) >= 0.3", METRIC))
def panels_rows(spark, sf_dir):
    return P.panels_by_rows(metric(spark, sf_dir), "sens_z").withColumn("sd_y", R6("sd_y"))


@register("p16_a23_panels_by_means", with_sql("SELECT disease, drug, count(y) n, round(stddev_samp(y), 6) sd FROM (SELECT disease, drug, cell, avg(sens_z) y FROM metric GROUP BY ALL) GROUP BY ALL HAVING count(y) >= 20 AND stddev_samp(y) >= 0.75", METRIC))
def panels_means(spark, sf_dir):
    return P.panels_by_means(metric(spark, sf_dir), "sens_z", least_sd=0.75).withColumn("sd", R6("sd"))


@register("p17_p23_named_cohort", with_sql("SELECT cell, drug FROM response WHERE cohort = 'A' AND regexp_matches(drug, '(?i)brand#1|BRAND#23')", RESPONSE))
def named(spark, sf_dir):
    return P.named_like(P.cohort_filter(response(spark, sf_dir), "a"), "drug", ["brand#1", "BRAND#23"]).select("cell", "drug")


@register(
    "w06_t03_head_per_group",
    with_sql("SELECT disease, cell, drug, rk::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY auc DESC, cell, drug, cohort) rk FROM response) WHERE rk <= 7", RESPONSE),
)
def head(spark, sf_dir):
    return P.head_per_group(response(spark, sf_dir), ["disease"], [F.desc("auc"), F.asc("cell"), F.asc("drug"), F.asc("cohort")], 7).select("disease", "cell", "drug", "rank")


@register(
    "w11_l13_shards",
    "WITH n AS (SELECT *, count(*) OVER (PARTITION BY p_brand) n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 rn FROM part), c AS (SELECT *, ceil(n / 25.0)::bigint c FROM n), s AS (SELECT *, n // c AS s, n % c AS e FROM c), k AS (SELECT *, CASE WHEN rn < e * (s + 1) THEN rn // (s + 1) ELSE e + (rn - e * (s + 1)) // s END chunk FROM s) SELECT p_brand, chunk::int AS chunk, '[' || string_agg(p_partkey::varchar, ',' ORDER BY p_partkey) || ']' AS items, count(*) n_items FROM k GROUP BY ALL",
)
def shards(spark, sf_dir):
    return P.shards(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 25)


_SPEARMAN = f"""rk AS (SELECT disease, drug, gene, {AVG_RANK.format(p='disease, drug, gene', v='value')} rx, {AVG_RANK.format(p='disease, drug, gene', v='s')} ry FROM (SELECT disease, drug, gene, value, -y AS s FROM panel JOIN expression USING (cell) WHERE y IS NOT NULL)),
rho AS (SELECT disease, drug, gene, count(*) n, corr(rx, ry) rho FROM rk GROUP BY ALL)"""


def _rho(spark, sf_dir):
    p = panel_means(spark, sf_dir).where("y is not null")
    return P.spearman_features(expression(spark, sf_dir), p, ["disease", "drug"], "cell", "gene", "value", "y")


@register("m02_spearman_features", with_sql("SELECT disease, drug, gene, n, CASE WHEN isnan(rho) THEN NULL ELSE round(rho, 6) END rho FROM rho", PANEL_MEANS, EXPRESSION, _SPEARMAN))
def spearman_features(spark, sf_dir):
    return _rho(spark, sf_dir).withColumn("rho", R6("rho"))


@register(
    "d12_ranked_list",
    with_sql("SELECT disease, drug, gene, round(round(rho, 9), 6) rho, (row_number() OVER (PARTITION BY disease, drug ORDER BY round(rho, 9) DESC, gene))::int AS rank FROM rho WHERE NOT isnan(rho)", PANEL_MEANS, EXPRESSION, _SPEARMAN),
)
def ranked_list(spark, sf_dir):
    out = P.ranked_list(_rho(spark, sf_dir).withColumn("rho", F.round("rho", 9)), ["disease", "drug"], "gene")
    return out.select("disease", "drug", "gene", R6("rho").alias("rho"), "rank")


_RUN = """st AS (SELECT disease, drug, gene, round(rho, 9) rho, row_number() OVER (PARTITION BY disease, drug ORDER BY round(rho, 9) DESC, gene) r, count(*) OVER (PARTITION BY disease, drug) n FROM rho WHERE NOT isnan(rho)),
pairs AS (SELECT s.*, g AS gs, (gene % 8 = g)::int AS hit FROM st s, range(8) t(g)),
sums AS (SELECT *, sum(CASE WHEN hit = 1 THEN abs(rho) END) OVER w AS nr, sum(hit) OVER w AS size FROM pairs WINDOW w AS (PARTITION BY disease, drug, gs)),
run AS (SELECT *, sum(CASE WHEN hit = 1 THEN abs(rho) / nr ELSE -1.0 / (n - size) END) OVER (PARTITION BY disease, drug, gs ORDER BY r) AS s FROM sums)"""


@register(
    "m16_enrichment_score",
    with_sql("SELECT disease, drug, gs, max(size)::bigint AS size, round(CASE WHEN round(max(s), 9) >= -round(least(min(s), 0), 9) THEN max(s) ELSE min(s) END, 6) es FROM run GROUP BY ALL", PANEL_MEANS, EXPRESSION, _SPEARMAN, _RUN),
)
def enrichment_score(spark, sf_dir):
    sets = spark.range(64).select((F.col("id") % 8).alias("gs"), F.col("id").cast("int").alias("gene"))
    stats = _rho(spark, sf_dir).withColumn("rho", F.round("rho", 9)).where("rho is not null")
    return P.enrichment(stats, sets, ["disease", "drug"], "gene", "rho", "gs").select("disease", "drug", "gs", "size", R6("es").alias("es"))


_NULL = """en AS (SELECT disease, drug, gs, max(size)::bigint size, CASE WHEN round(max(s), 9) >= -round(least(min(s), 0), 9) THEN max(s) ELSE min(s) END es FROM run GROUP BY ALL),
pm AS (SELECT st.*, perm, row_number() OVER (PARTITION BY disease, drug, perm ORDER BY md5('0|' || perm || '|' || gene), gene) f FROM st, range(1, 21) t(perm)),
pr AS (SELECT *, row_number() OVER (PARTITION BY disease, drug, perm ORDER BY rho DESC, f) r2 FROM pm),
ph AS (SELECT *, (f <= z)::int hit FROM pr, (SELECT DISTINCT size z FROM en)),
ps AS (SELECT *, sum(CASE WHEN hit = 1 THEN abs(rho) END) OVER w nr, sum(hit) OVER w size FROM ph WINDOW w AS (PARTITION BY disease, drug, perm, z)),
pu AS (SELECT *, sum(CASE WHEN hit = 1 THEN abs(rho) / nr ELSE -1.0 / (n - size) END) OVER (PARTITION BY disease, drug, perm, z ORDER BY r2) s FROM ps),
e0 AS (SELECT disease, drug, perm, z, CASE WHEN round(max(s), 9) >= -round(least(min(s), 0), 9) THEN max(s) ELSE min(s) END e FROM pu GROUP BY ALL),
sg AS (SELECT en.disease, en.drug, gs, size, es, es / avg(abs(e)) nes, (1 + count(*) FILTER (WHERE round(abs(e), 9) >= round(abs(es), 9))) / (1 + count(e)) p FROM en LEFT JOIN e0 ON en.disease = e0.disease AND en.drug = e0.drug AND size = z AND (es >= 0) = (e >= 0) GROUP BY en.disease, en.drug, gs, size, es),
ad AS (SELECT *, p * count(*) OVER (PARTITION BY disease, drug) / row_number() OVER (PARTITION BY disease, drug ORDER BY p, gs) raw FROM sg)"""


@register(
    "m16_m27_enrichment_significance",
    with_sql("SELECT disease, drug, gs, size, round(es, 6) es, round(nes, 5) nes, round(p, 6) p, round(least(1, min(raw) OVER (PARTITION BY disease, drug ORDER BY p DESC, gs DESC ROWS UNBOUNDED PRECEDING)), 6) padj FROM ad", PANEL_MEANS, EXPRESSION, _SPEARMAN, _RUN, _NULL),
)
def enrichment_significance(spark, sf_dir):
    sets = spark.range(64).select((F.col("id") % 8).alias("gs"), F.col("id").cast("int").alias("gene"))
    stats = _rho(spark, sf_dir).withColumn("rho", F.round("rho", 9)).where("rho is not null")
    out = P.enrichment_significance(stats, sets, ["disease", "drug"], "gene", "rho", "gs", perms=20)
    return out.select("disease", "drug", "gs", "size", R6("es").alias("es"), F.round("nes", 5).alias("nes"), R6("p").alias("p"), R6("padj").alias("padj"))


@register("m16_multilevel")
def multilevel(spark, sf_dir):
    """Enrichment p-values by multilevel splitting, for every (disease, drug) panel."""
    from heddle.operators import splitting as S

    sets = spark.range(64).select((F.col("id") % 8).alias("gs"), F.col("id").cast("int").alias("gene"))
    stats = _rho(spark, sf_dir).withColumn("rho", F.round("rho", 9)).where("rho is not null")
    return S.multilevel(stats, sets, ["disease", "drug"], "gene", "rho", "gs", chains=101)


_FUSIONS = "SELECT cell, 'fus_' || f AS feature, coalesce(max(v), 0)::int AS value FROM (SELECT DISTINCT o_custkey cell FROM orders) CROSS JOIN (SELECT DISTINCT f FROM ev) LEFT JOIN ev USING (cell, f) GROUP BY ALL"
_FUSION_EVENTS = "ev AS (SELECT DISTINCT o_custkey cell, o_orderpriority f, 1 v FROM orders WHERE upper(CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'no' END) = 'TRUE' AND (o_orderstatus = 'P' OR coalesce(try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE (o_orderkey % 7)::varchar END AS double), 0) >= 3))"


def _fusions(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cell"), F.col("o_orderpriority").alias("name"), F.lit("none").alias("left"), F.col("o_orderstatus").alias("right"),
        F.when(k % 2 == 0, "true").otherwise("no").alias("passed"), F.when(k % 5 == 0, "n/a").otherwise((k % 7).cast("string")).alias("count"),
    )
    return O.fusions(rows, "cell", "name", "left", "right", "passed", "count", ["P"])


@register("l05_fusions", with_sql(_FUSIONS, _FUSION_EVENTS))
def fusions(spark, sf_dir):
    return _fusions(spark, sf_dir)


def _mutations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("o_custkey").alias("cell"), F.col("p_brand").alias("gene"), (F.col("l_quantity") > 45).alias("a"), F.when(F.col("l_discount") > 0.05, F.col("l_tax") > 0.07).alias("b"))
    return O.mutations(rows, "cell", "gene", ["a", "b"], ["Brand#11", "Brand#13", "Brand#22"])


_MUTATION_EVENTS = """mr AS (SELECT o_custkey cell, p_brand gene, coalesce(l_quantity > 45, false) OR coalesce(CASE WHEN l_discount > 0.05 THEN l_tax > 0.07 END, false) f FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
mu AS (SELECT c.cell, g.gene, coalesce(max(m.f::int), 0) AS value FROM (SELECT DISTINCT cell FROM mr) c CROSS JOIN (SELECT DISTINCT gene FROM mr WHERE f AND gene IN ('Brand#11', 'Brand#13', 'Brand#22')) g LEFT JOIN mr m ON m.cell = c.cell AND m.gene = g.gene AND m.f GROUP BY ALL)"""


@register("l06_mutations", with_sql("SELECT cell, 'mut_' || gene AS feature, value::int AS value FROM mu", _MUTATION_EVENTS))
def mutations(spark, sf_dir):
    return _mutations(spark, sf_dir)


def _methylation(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("_"), F.col("p_partkey").cast("string")).alias("locus_id"), F.when(F.col("p_partkey") % 5 == 0, "NA").otherwise(F.col("p_size").cast("string")).alias("S1"), F.col("p_retailprice").cast("string").alias("S2"), F.col("p_size").cast("string").alias("S3"))
    cells = spark.sql("SELECT * FROM VALUES ('S1', 1L), ('S2', 2L), ('S3', 2L), ('S4', 3L) AS t(sample, cell)")
    return O.methylation(wide, "locus_id", ["S1", "S2", "S3"], cells, ["Brand#11", "Brand#1", "Brand#23"])


@register("l07_methylation", "SELECT cell, 'meth_' || p_brand AS feature, round(v, 6) AS value FROM (SELECT 1 AS cell, p_brand, avg(CASE WHEN p_partkey % 5 <> 0 THEN p_size END) v FROM part GROUP BY ALL UNION ALL SELECT 2, p_brand, avg(p_retailprice) FROM part GROUP BY ALL) WHERE p_brand IN ('Brand#11', 'Brand#1', 'Brand#23')")
def methylation(spark, sf_dir):
    return _methylation(spark, sf_dir).withColumn("value", R6("value"))


@register("l02_l03_l04_resolved_layers", "SELECT cell, 'rppa_' || f AS feature, CASE WHEN f = 'bal' THEN v END AS value FROM (SELECT c_custkey // 2 AS cell, arg_min(c_acctbal, c_custkey) v FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1), (VALUES ('bal'), ('seg')) t(f)")
def resolved_layers(spark, sf_dir):
    """Two samples resolve to one cell: the first counts."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    wide = c.select(k.alias("sample"), F.col("c_acctbal").cast("string").alias("bal"), F.col("c_mktsegment").alias("seg"))
    ladder = c.select(k.alias("sample"), F.when(k % 7 != 0, F.floor(k / 2)).alias("cell"))
    return O.numeric_layer(wide, "sample", ["bal", "seg"], ladder, "rppa_")


@register("l09_annotation", "SELECT p_partkey, p_brand FROM part")
def annotation(spark, sf_dir):
    return O.annotation(table(spark, sf_dir, "part").select("p_partkey", "p_brand"))


@register(
    "l10_layer_summary",
    with_sql(
        f"""SELECT layer, n_features, n_cells_total, n_cells_in_universe, kind FROM (SELECT 'mutations' layer, count(DISTINCT gene) n_features, count(DISTINCT cell) n_cells_total, count(DISTINCT cell) FILTER (WHERE cell IN (SELECT cell FROM u)) n_cells_in_universe, 'binary' kind FROM mu
        UNION ALL SELECT 'fusions', count(DISTINCT feature), count(DISTINCT cell), count(DISTINCT cell) FILTER (WHERE cell IN (SELECT cell FROM u)), 'binary' FROM fu UNION ALL SELECT 'chromatin', count(DISTINCT gene), count(DISTINCT cell), count(DISTINCT cell) FILTER (WHERE cell IN (SELECT cell FROM u)), 'continuous' FROM expression)""",
        _MUTATION_EVENTS, _FUSION_EVENTS, f"fu AS ({_FUSIONS})", EXPRESSION, "u AS (SELECT c_custkey cell FROM customer WHERE c_mktsegment <> 'BUILDING')",
    ),
)
def layer_summary(spark, sf_dir):
    universe = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("cell"))
    layers = {"mutations": _mutations(spark, sf_dir), "fusions": _fusions(spark, sf_dir), "chromatin": expression(spark, sf_dir).withColumnRenamed("gene", "feature")}
    return O.summary(layers, universe)


_COVERED = "SELECT {d} disease, count(*) n_cells, count(*) FILTER (WHERE cell IN (SELECT cell FROM mu)) mutations, count(*) FILTER (WHERE cell IN (SELECT cell FROM fu)) fusions, count(*) FILTER (WHERE cell IN (SELECT cell FROM expression)) chromatin FROM cs GROUP BY 1"


@register("l10_a20_layer_driver", with_sql(_COVERED.format(d="disease"), _MUTATION_EVENTS, _FUSION_EVENTS, f"fu AS ({_FUSIONS})", EXPRESSION, "cs AS (SELECT c_custkey cell, c_mktsegment disease FROM customer)"))
def layer_driver(spark, sf_dir):
    """Layers written with their slices by disease; the coverage that the driver reports."""
    import uuid

    from heddle.session import shared_folder

    samples = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("disease"))
    layers = {"mutations": _mutations(spark, sf_dir), "fusions": _fusions(spark, sf_dir), "chromatin": expression(spark, sf_dir).withColumnRenamed("gene", "feature")}
    coverage, _ = O.build(layers, samples, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return coverage.select("disease", "n_cells", "mutations", "fusions", "chromatin")


@register(
    "m15_single_sample_enrichment",
    with_sql(
        """SELECT cell, gs, round(sum(ph - pm), 6) score FROM (SELECT cell, gs, sum(CASE WHEN hit = 1 THEN w / nr ELSE 0 END) OVER o AS ph, sum((1 - hit) / (n - size)::double) OVER o AS pm FROM
        (SELECT *, sum(CASE WHEN hit = 1 THEN w END) OVER (PARTITION BY cell, gs) nr, sum(hit) OVER (PARTITION BY cell, gs) size FROM (SELECT cell, gs, (gene % 8 = gs)::int hit, r, n, pow(n - r + 1, 0.25) w FROM
        (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) r, count(*) OVER (PARTITION BY cell) n FROM expression), range(8) t(gs))) WINDOW o AS (PARTITION BY cell, gs ORDER BY r)) GROUP BY ALL""",
        EXPRESSION,
    ),
)
def single_sample(spark, sf_dir):
    sets = spark.range(64).select((F.col("id") % 8).alias("gs"), F.col("id").cast("int").alias("gene"))
    return P.single_sample_enrichment(expression(spark, sf_dir), sets, "cell", "gene", "value", "gs").select("cell", "gs", R6("score").alias("score"))


@register(
    "m27_benjamini_hochberg",
    "SELECT event_id, round(least(1, min(raw) OVER (PARTITION BY event_type ORDER BY p DESC, event_id DESC ROWS UNBOUNDED PRECEDING)), 6) padj FROM (SELECT event_id, event_type, p, p * count(p) OVER (PARTITION BY event_type) / row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) raw FROM (SELECT event_id, event_type, (event_id * 7919 % 1009) / 1009.0::double AS p FROM events))",
)
def bh(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") * 7919 % 1009 / F.lit(1009.0)).alias("p"))
    return P.adjusted(e, "p", ["event_type"], "event_id").select("event_id", R6("padj").alias("padj"))


@register(
    "w08_quartile_of_rank",
    "SELECT c_custkey, greatest(0, ceil(round((rn - 1) * 4.0::double / (n - 1), 9)) - 1)::int AS bin FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -3), c_custkey) rn, count(*) OVER (PARTITION BY c_nationkey) n FROM customer)",
)
def quartile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("v", F.round("c_acctbal", -3))
    return c.select("c_custkey", quartile_of_rank("v", "c_custkey", "c_nationkey").alias("bin"))


@register(
    "a21_disease_summary",
    with_sql("SELECT disease, count(DISTINCT cell) n_cells, count(DISTINCT CASE WHEN cohort = 'A' THEN cell END) n_a, count(DISTINCT CASE WHEN cohort = 'B' THEN cell END) n_b, count(DISTINCT drug) n_drugs, count(*) n_rows FROM response GROUP BY 1", RESPONSE),
)
def disease_summary(spark, sf_dir):
    in_ = lambda c: F.countDistinct(F.when(F.col("cohort") == c, F.col("cell")))
    return response(spark, sf_dir).groupBy("disease").agg(F.countDistinct("cell").alias("n_cells"), in_("A").alias("n_a"), in_("B").alias("n_b"), F.countDistinct("drug").alias("n_drugs"), F.count("*").alias("n_rows"))
