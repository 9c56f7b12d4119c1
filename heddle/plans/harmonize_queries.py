"""Queries of the harmonisation and merge stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import text as X
from heddle.functions.stats import average_rank, keep_first
from heddle.operators import harmonize as H
from heddle.plans.fixture import AVG_RANK, METRIC, RAW, RESPONSE, metric, raw, response, table, with_sql
from heddle.plans.registry import register

R6 = lambda c: F.round(c, 6)


@register(
    "flagship_broad_ranking",
    with_sql(
        """SELECT disease, drug, round(s, 6) disease_sens, n n_lines, rk::bigint AS rank FROM (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY s, drug) rk FROM
        (SELECT disease, drug, avg(sens_z) s, count(*) n FROM metric WHERE cell IN (SELECT cell FROM response WHERE cohort = 'A' INTERSECT SELECT cell FROM response WHERE cohort = 'B')
         AND drug IN (SELECT drug FROM response WHERE cohort = 'A' INTERSECT SELECT drug FROM response WHERE cohort = 'B') GROUP BY ALL) WHERE n >= 5 AND s IS NOT NULL) WHERE rk <= 15""",
        METRIC,
    ),
)
def flagship(spark, sf_dir):
    from heddle.operators.documents import broad_spectrum

    shared = H.shared_subset(metric(spark, sf_dir), "A", "B")
    top = broad_spectrum(shared, "disease", "drug", "sens_z")
    return top.select("disease", "drug", R6("disease_sens").alias("disease_sens"), "n_lines", F.col("rank").cast("long").alias("rank"))


@register("w01_w02_sens_metric", with_sql("SELECT cohort, cell, drug, round(auc, 6) auc, round(sens_z, 6) sens_z, round(sens_rank, 6) sens_rank FROM metric", METRIC))
def sens_metric(spark, sf_dir):
    return metric(spark, sf_dir).select("cohort", "cell", "drug", R6("auc").alias("auc"), R6("sens_z").alias("sens_z"), R6("sens_rank").alias("sens_rank"))


@register(
    "a01_a02_collapse",
    with_sql(
        """SELECT cohort, cell, drug, round(avg(auc), 6) auc, round(avg(ln_qty), 6) ln_qty, min_by(drug_name, ord) drug_name, min_by(target, ord) FILTER (WHERE target IS NOT NULL) target
        FROM (SELECT cohort, cell, drug, auc, ord, drug_name, CASE WHEN cohort = 'A' THEN ln(qty) END ln_qty, CASE WHEN cohort = 'A' OR qty > 25 THEN target END target FROM raw) GROUP BY ALL""",
        RAW,
    ),
)
def collapse(spark, sf_dir):
    rows = raw(spark, sf_dir).withColumn("ln_qty", F.when(F.col("cohort") == "A", F.ln("qty"))).withColumn("target", F.when((F.col("cohort") == "A") | (F.col("qty") > 25), F.col("target")))
    out = H.collapse(rows, ["cohort", "cell", "drug"], ["auc", "ln_qty"], ["drug_name", "target"], "ord")
    return out.withColumns({"auc": R6("auc"), "ln_qty": R6("ln_qty")})


@register(
    "p04_lost_keys",
    "SELECT count(*) FILTER (WHERE user_id IS NULL OR NOT has_label) lost, count(*) FILTER (WHERE user_id IS NULL) null_user, count(*) FILTER (WHERE NOT has_label) null_label FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END user_id, event_id % 5 <> 0 has_label FROM events WHERE value IS NOT NULL)",
)
def lost(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("value", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("label"))
    return H.lost_keys(e, "value", ["user", "label"])


@register(
    "p01_p02_u01_conform_union",
    "SELECT 'A' cohort, c_custkey::varchar AS cell, c_name AS name, c_acctbal::double AS measure, NULL::varchar AS broad_id FROM customer UNION ALL SELECT 'B', s_suppkey::varchar, s_name, NULL::double, s_nationkey::varchar FROM supplier",
)
def conform(spark, sf_dir):
    schema = {"cohort": "string", "cell": "string", "name": "string", "measure": "double", "broad_id": "string"}
    a = H.conform(table(spark, sf_dir, "customer").withColumn("cohort", F.lit("A")), schema, {"cell": "c_custkey", "name": "c_name", "measure": "c_acctbal"})
    b = H.conform(table(spark, sf_dir, "supplier").withColumn("cohort", F.lit("B")), schema, {"cell": "s_suppkey", "name": "s_name", "broad_id": "s_nationkey"})
    return H.union_cohorts(a, b.drop("measure"))


@register(
    "j01_j02_dimension_join",
    "SELECT o_orderkey, o_custkey::varchar AS cust, d.c_name, d.c_mktsegment FROM orders LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c_custkey) rn FROM (SELECT *, c_custkey % 700 AS k FROM customer)) WHERE rn = 1) d ON o_custkey::varchar = d.k::varchar",
)
def dimension(spark, sf_dir):
    dim = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % 700).select("k", "c_custkey", "c_name", "c_mktsegment")
    out = H.with_dimension(table(spark, sf_dir, "orders"), dim, "o_custkey", "k", ["c_custkey"])
    return out.select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"), "c_name", "c_mktsegment")


@register(
    "j04_m01_concordance",
    with_sql(
        f"""SELECT drug, n, CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) END rho FROM (SELECT drug, count(*) n, corr(rx, ry) r FROM (SELECT drug, {AVG_RANK.format(p='drug', v='x')} rx, {AVG_RANK.format(p='drug', v='y')} ry
        FROM (SELECT cell, drug, max(CASE WHEN cohort = 'A' THEN auc END) x, max(CASE WHEN cohort = 'B' THEN auc END) y FROM response GROUP BY ALL) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY drug) WHERE n >= 8""",
        RESPONSE,
    ),
)
def concordance(spark, sf_dir):
    return H.spearman(H.paired(response(spark, sf_dir), "A", "B", "auc"), "drug").withColumn("rho", R6("rho"))


@register(
    "j05_shared_subset",
    with_sql("SELECT cohort, cell, drug, round(auc, 6) auc FROM response WHERE cell IN (SELECT cell FROM response WHERE cohort = 'A' INTERSECT SELECT cell FROM response WHERE cohort = 'B') AND drug IN (SELECT drug FROM response WHERE cohort = 'A' INTERSECT SELECT drug FROM response WHERE cohort = 'B')", RESPONSE),
)
def shared(spark, sf_dir):
    return H.shared_subset(response(spark, sf_dir), "A", "B").select("cohort", "cell", "drug", R6("auc").alias("auc"))


_COUNTS = "SELECT '{i}' item, s AS \"set\", n FROM (SELECT count(*) FILTER (WHERE a) a, count(*) FILTER (WHERE b) b, count(*) u, count(*) FILTER (WHERE a AND b) i FROM (SELECT {i}, bool_or(cohort = 'A') a, bool_or(cohort = 'B') b FROM response GROUP BY 1)), LATERAL (VALUES ('a', a), ('b', b), ('union', u), ('shared', i)) v(s, n)"


@register("a22_set_counts", with_sql(_COUNTS.format(i="cell") + " UNION ALL " + _COUNTS.format(i="drug"), RESPONSE))
def set_counts(spark, sf_dir):
    return H.set_counts(response(spark, sf_dir), "A", "B")


_NORM = "regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"


@register(
    "p25_cell_key",
    f"""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN coalesce(nullif(trim(d), ''), 'SANGER:' || nullif(trim(s), ''), 'A:' || {_NORM.format(c='c_name')}) ELSE coalesce(nullif(trim(d), ''), 'B:' || nullif(trim(m), ''), 'B:' || {_NORM.format(c='c_name')}) END row_key
    FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'ACH-' || c_custkey WHEN c_custkey % 3 = 1 THEN '' END d, CASE WHEN c_custkey % 4 = 1 THEN 'SIDM' || c_custkey END s, CASE WHEN c_custkey % 5 = 1 THEN c_custkey::varchar END m FROM customer)""",
)
def cell_key(spark, sf_dir):
    k, c = F.col("c_custkey"), table(spark, sf_dir, "customer")
    depmap = F.when(k % 3 == 0, F.concat(F.lit("ACH-"), k)).when(k % 3 == 1, "")
    key = H.cell_key(depmap, F.when(k % 4 == 1, F.concat(F.lit("SIDM"), k)), F.when(k % 5 == 1, k.cast("string")), F.col("c_name"), F.when(F.col("c_nationkey") % 2 == 0, "A").otherwise("B"))
    return c.select("c_custkey", key.alias("row_key"))


_DRUGS = """drugs AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END cohort, p_name AS name, CASE WHEN p_partkey % 5 <> 0 THEN 'K' || (p_partkey % 97) || '-X' || p_partkey END inchikey FROM part),
blocks AS (SELECT split_part(inchikey, '-', 1) b, count(DISTINCT cohort) n FROM drugs WHERE inchikey IS NOT NULL GROUP BY 1)"""


def _drugs(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, "A").otherwise("B").alias("cohort"), F.col("p_name").alias("name"), F.when(k % 5 != 0, F.concat(F.lit("K"), k % 97, F.lit("-X"), k)).alias("inchikey"))


@register(
    "p26_drug_identity",
    with_sql("SELECT p_partkey, coalesce(b, 'name:' || cohort || ':' || regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) drug_uid, CASE WHEN b IS NULL THEN 'unresolved' WHEN n > 1 THEN 'inchikey' ELSE 'cohort_only' END match_channel FROM drugs LEFT JOIN blocks ON split_part(inchikey, '-', 1) = b", _DRUGS),
)
def drug_identity(spark, sf_dir):
    return H.drug_identity(_drugs(spark, sf_dir)).select("p_partkey", "drug_uid", "match_channel")


@register(
    "j14_same_name_different_structure",
    """WITH d AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END cohort, p_name nname, p_brand ik_block FROM part), s AS (SELECT nname, list_sort(list(DISTINCT ik_block) FILTER (WHERE cohort = 'A')) a, list_sort(list(DISTINCT ik_block) FILTER (WHERE cohort = 'B')) b FROM d GROUP BY 1)
    SELECT nname, array_to_string(a, ';') blocks_a, array_to_string(b, ';') blocks_b FROM s WHERE len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b)""",
)
def same_name(spark, sf_dir):
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(F.when(k % 2 == 0, "A").otherwise("B").alias("cohort"), F.col("p_name").alias("nname"), F.col("p_brand").alias("ik_block"))
    return H.same_name_different_structure(d, "A", "B")


@register(
    "p24_disease_label",
    """SELECT c_custkey, coalesce(nullif(trim(code), ''), 'SITE_' || regexp_replace(regexp_replace(upper(nullif(trim(site), '')), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 'UNKNOWN') disease,
    CASE WHEN nullif(trim(code), '') IS NOT NULL THEN 'tcga_code' WHEN nullif(trim(site), '') IS NOT NULL THEN 'site_primary' ELSE 'unknown' END disease_source
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN ' ' END code, CASE WHEN c_custkey % 4 <> 0 THEN n_name || ' / ' || c_mktsegment END site FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
)
def disease_label(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.when(k % 3 == 0, F.col("c_mktsegment")).when(k % 3 == 1, " ")
    label, source = H.disease_label(code, F.when(k % 4 != 0, F.concat("n_name", F.lit(" / "), "c_mktsegment")))
    return c.select(k, label.alias("disease"), source.alias("disease_source"))


@register(
    "j06_j07_resolve_ladder",
    f"SELECT s_suppkey, coalesce(a.n_nationkey, b.n_nationkey) AS resolved FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN 'nation ' || s_nationkey ELSE 'x' END raw FROM supplier) LEFT JOIN nation a ON raw = a.n_name LEFT JOIN (SELECT n_nationkey, {_NORM.format(c='n_name')} nn FROM nation) b ON {_NORM.format(c='n2')} = nn".replace("(SELECT *,", "(SELECT *, (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) || '.' AS n2,"),
)
def ladder(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.concat("n_name", F.lit(".")).alias("n2"))), "s_nationkey")
    s = s.withColumn("raw", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("nation "), "s_nationkey")).otherwise("x"))
    normed = nation.withColumn("nn", X.norm_id(F.col("n_name")))
    out = H.resolve(s, "resolved", [(nation, "n_name", "n_nationkey", F.col("raw")), (normed, "nn", "n_nationkey", X.norm_id(F.col("n2")))])
    return out.select("s_suppkey", "resolved")


@register(
    "f06_s14_first_resolved",
    """WITH c AS (SELECT p_partkey, [p_name || ' (x)', p_name, p_brand, p_type] cand FROM part), l AS (SELECT lower(p_type) k, min(p_partkey)::varchar v FROM part GROUP BY 1 UNION ALL SELECT lower(p_brand), CASE WHEN min(p_partkey) % 2 = 0 THEN min(p_partkey)::varchar ELSE '' END FROM part GROUP BY 1),
    t AS (SELECT p_partkey, lower(cand[i]) k, i FROM c, range(1, 5) r(i)) SELECT c.p_partkey, min_by(nullif(v, ''), i) FILTER (WHERE nullif(v, '') IS NOT NULL) AS ik FROM c LEFT JOIN t ON c.p_partkey = t.p_partkey LEFT JOIN l ON t.k = l.k GROUP BY 1""",
)
def first_resolved(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    low = p.groupBy("p_type").agg(F.min("p_partkey").cast("string").alias("ik")).select(F.col("p_type").alias("key"), "ik")
    brand = p.groupBy("p_brand").agg(F.min("p_partkey").alias("m")).select(F.col("p_brand").alias("key"), F.when(F.col("m") % 2 == 0, F.col("m").cast("string")).otherwise("").alias("ik"))
    cand = p.select("p_partkey", F.array(F.concat("p_name", F.lit(" (x)")), "p_name", "p_brand", "p_type").alias("cand"))
    return H.first_resolved(cand, "p_partkey", "cand", low.union(brand), "key", "ik").select("p_partkey", "ik")


@register(
    "a03_a05_samples",
    with_sql(
        """SELECT r.cell, count(*) n_rows, count(DISTINCT drug) n_drugs, bool_or(cohort = 'A') in_a, bool_or(cohort = 'B') in_b, count(DISTINCT CASE WHEN cohort = 'A' THEN drug END) n_drugs_a, count(DISTINCT CASE WHEN cohort = 'B' THEN drug END) n_drugs_b, any_value(l.label) AS label
        FROM response r LEFT JOIN (SELECT vec_id cell, label FROM embeddings) l ON r.cell = l.cell GROUP BY r.cell""",
        RESPONSE,
    ),
)
def samples(spark, sf_dir):
    return H.samples(response(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), "label"), "A", "B")


@register("w09_keep_first", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) rn FROM orders) WHERE rn = 1")
def w09(spark, sf_dir):
    return keep_first(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@register("a17_value_counts", "SELECT o_orderpriority, count(*) n FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority")


@register("w03_average_rank", f"SELECT event_id, {AVG_RANK.format(p='event_type', v='round(value)')} AS avg_rank FROM events")
def avg_rank(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("v", F.round("value")).select("event_id", average_rank("v", "event_type").alias("avg_rank"))


@register(
    "a18_quantiles",
    with_sql("SELECT drug, round(quantile_cont(auc, 0.05), 6) p05, round(quantile_cont(auc, 0.5), 6) p50, round(quantile_cont(auc, 0.95), 6) p95, round(avg((auc > 30000)::int), 6) frac FROM response GROUP BY 1", RESPONSE),
)
def quantiles(spark, sf_dir):
    q = lambda p, n: R6(F.percentile("auc", F.lit(p))).alias(n)
    return response(spark, sf_dir).groupBy("drug").agg(q(0.05, "p05"), q(0.5, "p50"), q(0.95, "p95"), R6(F.avg((F.col("auc") > 30000).cast("int"))).alias("frac"))


_TEXT_SQL = """SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') f01, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') f02,
 regexp_replace(regexp_replace(dirty, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') f03, nullif(split_part(p_brand || '-Q', '-', 1), '') f04,
 trim(regexp_replace(regexp_replace(dirty, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) f05, split_part(p_name || '.2', '.', 1) f07,
 replace(trim(upper(split_part(' ' || p_type || '/a-b = x', '=', 1))), ' ', '').replace('/', '_').replace('-', '_') f10, lower(replace(p_type, ' ', '_').replace('_', ' ')) f11,
 try_cast(CASE WHEN p_partkey % 3 = 0 THEN 'junk' WHEN p_partkey % 3 = 1 THEN p_retailprice::varchar ELSE NULL END AS double) f12,
 len(list_filter(list_transform(string_split(p_name || '/ a //b', '/'), lambda x: trim(x)), lambda x: x <> '')) f13, replace(p_brand || '/x', '/', '-') f17, p_brand || '-x__' || p_type f25
 FROM (SELECT *, '  ' || p_name || ' (' || p_brand || ')  -- ' || p_type || '!' AS dirty FROM part)"""


@register("f01_f25_text_functions", _TEXT_SQL)
def text_functions(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    dirty = F.concat(F.lit("  "), name, F.lit(" ("), brand, F.lit(")  -- "), kind, F.lit("!"))
    return p.select(
        "p_partkey", X.norm_id(name).alias("f01"), X.norm_name(name).alias("f02"), X.slug(dirty).alias("f03"), X.block(F.concat(brand, F.lit("-Q"))).alias("f04"), X.clean_name(dirty).alias("f05"), X.first_token(F.concat(name, F.lit(".2"))).alias("f07"),
        X.norm_label(F.concat(F.lit(" "), kind, F.lit("/a-b = x"))).alias("f10"), X.prettify(F.replace(kind, F.lit(" "), F.lit("_"))).alias("f11"),
        X.to_float(F.when(k % 3 == 0, "junk").when(k % 3 == 1, F.col("p_retailprice").cast("string"))).alias("f12"), F.size(X.split_genes(F.concat(name, F.lit("/ a //b")))).cast("long").alias("f13"),
        X.file_safe(F.concat(brand, F.lit("/x"))).alias("f17"), X.unit_key(F.concat(brand, F.lit("/x")), kind).alias("f25"),
    )


@register(
    "f08_clean_target",
    "SELECT p_partkey, nullif(array_to_string(list_distinct_in_order, ', '), '') AS target FROM (SELECT p_partkey, list_filter(s, lambda x, i: list_position(s, x) = i) list_distinct_in_order FROM (SELECT p_partkey, list_filter(list_transform(string_split(replace(p_type || '; ;' || p_type || ',' || p_brand || ';z', ';', ','), ','), lambda x: trim(x)), lambda x: x <> '')[1:3] s FROM part))",
)
def target(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.clean_target(F.concat("p_type", F.lit("; ;"), "p_type", F.lit(","), "p_brand", F.lit(";z"))).alias("target"))


@register(
    "p18_actionable",
    "SELECT p_partkey, coalesce(trim(n) <> '' AND NOT regexp_matches(trim(n), '(?i)^(\\d+|BRD[-_ ]?[A-Za-z]?\\d.*|BD[A-Z]{1,5}\\d.*|NSC[-_ ]?\\d.*|SID\\s*\\d+|CIL\\d+)$') AND NOT contains(lower(n), 'digoxin') AND NOT contains(lower(n), 'picolin'), false) ok FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'BRD-K' || p_partkey WHEN 3 THEN 'nsc ' || p_partkey WHEN 4 THEN p_partkey::varchar WHEN 5 THEN 'Digoxin ' || p_name ELSE p_name END n FROM part)",
)
def actionable(spark, sf_dir):
    k = F.col("p_partkey")
    n = F.when(k % 7 == 0, None).when(k % 7 == 1, " ").when(k % 7 == 2, F.concat(F.lit("BRD-K"), k)).when(k % 7 == 3, F.concat(F.lit("nsc "), k)).when(k % 7 == 4, k.cast("string")).when(k % 7 == 5, F.concat(F.lit("Digoxin "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(k, X.actionable(n).alias("ok"))


@register(
    "a11_a12_display_names",
    "WITH r AS (SELECT p_brand uid, p_name n, CASE WHEN p_partkey % 3 = 0 THEN ' ; ' ELSE p_type || ';' || p_type END t, p_partkey o FROM part), m AS (SELECT uid, n, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, n) rn FROM r GROUP BY uid, n), f AS (SELECT uid, split_part(min_by(t, o), ';', 1) target FROM r WHERE t <> ' ; ' GROUP BY 1) SELECT m.uid, m.n drug_name, f.target FROM m LEFT JOIN f ON m.uid = f.uid WHERE rn = 1",
)
def display_names(spark, sf_dir):
    from heddle.operators.documents import display_names as run

    r = table(spark, sf_dir, "part").select(F.col("p_brand").alias("uid"), F.col("p_name").alias("n"), F.when(F.col("p_partkey") % 3 == 0, " ; ").otherwise(F.concat("p_type", F.lit(";"), "p_type")).alias("t"), F.col("p_partkey").alias("o"))
    return run(r, "uid", "n", "t", "o")
