"""Two screens as one long response table: crosswalk keys, union, collapse, z-scores, shared subset, checks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.stats import average_rank, keep_first, percent_rank_average, safe_corr
from heddle.functions.text import block, norm_id, norm_name, slug

#: MIN_GROUP_N: below this many values a (cohort, drug) group gets no z-score.
LEAST_GROUP = 5


def conform(df: DataFrame, columns: dict[str, str], mapping: dict[str, str] | None = None) -> DataFrame:
    """Columns by name and type in a fixed order, missing ones null; ``mapping`` is target -> source."""
    mapping = mapping or {}
    source = lambda c: mapping.get(c, c)
    return df.select(*((F.col(f"`{source(c)}`") if source(c) in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


def union_cohorts(*frames: DataFrame) -> DataFrame:
    """Rows of all, columns by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_dimension(fact: DataFrame, dim: DataFrame, left: str, right: str, order: list[str]) -> DataFrame:
    """Left join with the first row of each key of a dimension, keys compared as strings."""
    first = keep_first(dim.where(F.col(right).isNotNull()), [right], order).withColumnRenamed(right, "__key")
    return fact.join(first, F.col(left).cast("string") == F.col("__key").cast("string"), "left").drop("__key")


def lost_keys(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """How many measured rows a null key would lose, per key and in all."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    measured = F.col(value).isNotNull()
    return df.agg(F.count_if(measured & any_null).alias("lost"), *(F.count_if(measured & F.col(k).isNull()).alias(f"null_{k}") for k in keys))


def collapse(df: DataFrame, keys: list[str], measures: list[str], firsts: list[str], order: str) -> DataFrame:
    """One row per key: measures as means, the rest as first non-null values; one aggregation for both."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return df.dropna(subset=keys).groupBy(*keys).agg(*(F.avg(m).alias(m) for m in measures), *(first(c) for c in firsts))


def add_metric(df: DataFrame, value: str = "auc", keys: tuple[str, ...] = ("cohort", "drug"), least: int = LEAST_GROUP) -> DataFrame:
    """sens_z and sens_rank of each group.

    The z-score needs a mean and a deviation per group: one small row of each meets the rows, which are neither shuffled nor sorted.
    The rank needs its group sorted; where nobody reads it, Spark leaves it out.
    """
    names = {k: f"__k{n}" for n, k in enumerate(keys)}
    c = F.col(value)
    groups = df.groupBy(*(F.col(k).alias(n) for k, n in names.items())).agg(F.count(c).alias("__n"), F.avg(c).alias("__m"), F.stddev_samp(c).alias("__d"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    z = F.when((F.col("__n") >= least) & (F.col("__d") > 0), (c - F.col("__m")) / F.col("__d"))
    met = df.join(F.broadcast(groups), same, "left").withColumn("sens_z", z).drop(*names.values(), "__n", "__m", "__d")
    return met.withColumn("sens_rank", percent_rank_average(value, *keys, least=least))


def shared_subset(df: DataFrame, a: str, b: str, cohort: str = "cohort", keys: tuple[str, ...] = ("cell", "drug")) -> DataFrame:
    """Rows whose keys are in both cohorts."""
    out = df
    for k in keys:
        # the intersection of both cohorts' keys, by one aggregation in place of two scans
        sides = df.groupBy(k).agg(F.bool_or(F.col(cohort) == a).alias("__a"), F.bool_or(F.col(cohort) == b).alias("__b")).where("__a and __b")
        out = out.join(sides.select(k), k, "left_semi")
    return out


def paired(df: DataFrame, a: str, b: str, value: str, cohort: str = "cohort", keys: tuple[str, ...] = ("cell", "drug")) -> DataFrame:
    """Both cohorts' values side by side, by one aggregation in place of a self-join."""
    side = lambda c, n: F.max(F.when(F.col(cohort) == c, F.col(value))).alias(n)
    return df.groupBy(*keys).agg(side(a, "x"), side(b, "y")).dropna(subset=["x", "y"])


def spearman(df: DataFrame, group: str, x: str = "x", y: str = "y", least: int = 8) -> DataFrame:
    """Rank correlation per group with at least ``least`` pairs; null where a side is constant."""
    ranked = df.withColumn("__rx", average_rank(x, group)).withColumn("__ry", average_rank(y, group))
    return ranked.groupBy(group).agg(F.count("*").alias("n"), safe_corr("__rx", "__ry").alias("rho")).where(F.col("n") >= least)


def set_counts(df: DataFrame, a: str, b: str, items: tuple[str, ...] = ("cell", "drug"), cohort: str = "cohort") -> DataFrame:
    """Distinct items of cohort a, b, the union and the intersection; two aggregations for each item."""
    out = None
    for item in items:
        flags = df.groupBy(item).agg(F.bool_or(F.col(cohort) == a).alias("in_a"), F.bool_or(F.col(cohort) == b).alias("in_b")).where(F.col(item).isNotNull())
        one = flags.agg(F.count_if("in_a").alias("a"), F.count_if("in_b").alias("b"), F.count("*").alias("u"), F.count_if(F.col("in_a") & F.col("in_b")).alias("i"))
        long = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("set"), F.col(c).alias("n")) for n, c in (("a", "a"), ("b", "b"), ("union", "u"), ("shared", "i"))))).alias("r")).select(F.lit(item).alias("item"), "r.set", "r.n")
        out = long if out is None else out.unionAll(long)
    return out


def cell_key(depmap: Column, sanger: Column, master: Column, name: Column, cohort: Column, first: str = "A", second: str = "B") -> Column:
    """P25: the first identifier that is there, with its kind; the normalised name in the end."""
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.when(cohort == first, F.coalesce(filled(depmap), F.concat(F.lit("SANGER:"), filled(sanger)), F.concat(F.lit(f"{first}:"), norm_id(name)))).otherwise(
        F.coalesce(filled(depmap), F.concat(F.lit(f"{second}:"), filled(master)), F.concat(F.lit(f"{second}:"), norm_id(name)))
    )


def drug_identity(drugs: DataFrame, cohort: str = "cohort", key: str = "inchikey", name: str = "name") -> DataFrame:
    """``inchikey`` if the other cohort has the structure block too, ``cohort_only`` if not, ``unresolved`` without one."""
    own = drugs.withColumn("ik_block", block(F.col(key)))
    blocks = own.where("ik_block is not null").groupBy("ik_block").agg(F.countDistinct(cohort).alias("__cohorts"))
    met = own.join(blocks, "ik_block", "left")
    channel = F.when(F.col("ik_block").isNull(), "unresolved").when(F.col("__cohorts") > 1, "inchikey").otherwise("cohort_only")
    uid = F.coalesce("ik_block", F.concat(F.lit("name:"), F.col(cohort), F.lit(":"), norm_name(F.col(name))))
    return met.withColumn("drug_uid", uid).withColumn("match_channel", channel).drop("__cohorts")


def disease_label(code: Column, site: Column) -> tuple[Column, Column]:
    """Code, else the site as SITE_..., else UNKNOWN; and where the label is from."""
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    label = F.coalesce(filled(code), F.concat(F.lit("SITE_"), slug(F.upper(filled(site)))), F.lit("UNKNOWN"))
    source = F.when(filled(code).isNotNull(), "tcga_code").when(filled(site).isNotNull(), "site_primary").otherwise("unknown")
    return label, source


def same_name_different_structure(drugs: DataFrame, a: str, b: str, cohort: str = "cohort", name: str = "nname", key: str = "ik_block") -> DataFrame:
    """Names in both cohorts whose structure blocks have nothing in common."""
    sets = drugs.where(F.col(key).isNotNull()).groupBy(name).agg(*(F.array_sort(F.collect_set(F.when(F.col(cohort) == c, F.col(key)))).alias(n) for c, n in ((a, "a"), (b, "b"))))
    odd = sets.where((F.size("a") > 0) & (F.size("b") > 0) & ~F.arrays_overlap("a", "b"))
    return odd.select(name, F.array_join("a", ";").alias("blocks_a"), F.array_join("b", ";").alias("blocks_b"))


def resolve(df: DataFrame, column: str, ladder: list[tuple[DataFrame, str, str, Column]]) -> DataFrame:
    """The first rung of lookups that knows the value; each rung is (table, its key, its result, key expression)."""
    out = df
    for n, (lookup, key, result, expr) in enumerate(ladder):
        one = lookup.select(F.col(key).alias(f"__k{n}"), F.col(result).alias(f"__r{n}"))
        out = out.withColumn(f"__e{n}", expr).join(one, F.col(f"__e{n}") == F.col(f"__k{n}"), "left")
    names = [f"__{p}{n}" for n in range(len(ladder)) for p in "ker"]
    return out.withColumn(column, F.coalesce(*(F.col(f"__r{n}") for n in range(len(ladder))))).drop(*names)


def first_resolved(df: DataFrame, id_col: str, candidates: str, lookup: DataFrame, key: str, result: str) -> DataFrame:
    """Of an ordered candidate list, the result of the first that an offline table knows.

    In the table an empty result means: known to be unknown.
    """
    tried = df.select(id_col, F.posexplode(candidates).alias("__pos", "__name")).withColumn("__n", F.lower("__name"))
    known = lookup.select(F.lower(key).alias("__n"), F.nullif(F.col(result), F.lit("")).alias("__r")).where("__r is not null")
    found = tried.join(known, "__n").groupBy(id_col).agg(F.min_by("__r", "__pos").alias(result))
    return df.join(found, id_col, "left")


def samples(response: DataFrame, labels: DataFrame | None, a: str, b: str, cell: str = "cell", drug: str = "drug", cohort: str = "cohort") -> DataFrame:
    """One row per cell: rows, drugs, cohorts, drugs per cohort, and its labels."""
    in_ = lambda c: F.col(cohort) == c
    out = response.groupBy(cell).agg(
        F.count("*").alias("n_rows"), F.countDistinct(drug).alias("n_drugs"), F.bool_or(in_(a)).alias("in_a"), F.bool_or(in_(b)).alias("in_b"),
        F.countDistinct(F.when(in_(a), F.col(drug))).alias("n_drugs_a"), F.countDistinct(F.when(in_(b), F.col(drug))).alias("n_drugs_b"),
    )
    return out if labels is None else out.join(labels, cell, "left")
