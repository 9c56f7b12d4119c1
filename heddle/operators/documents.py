"""Per-cell documents: two ranked arms of drugs, nested, one JSON document per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.stats import keep_first
from heddle.functions.text import PROBE_STATUS, actionable, clean_target, nan_to_null, pretty_disease


def display_names(df: DataFrame, uid: str, name: str, target: str, order: str) -> DataFrame:
    """Per drug the most frequent name (ties: smallest) and the first usable target."""
    counts = df.where(F.col(name).isNotNull()).groupBy(uid, name).agg(F.count("*").alias("__n"))
    names = keep_first(counts, [uid], [F.desc("__n"), F.asc(name)]).select(uid, F.col(name).alias("drug_name"))
    usable = df.withColumn("__t", clean_target(F.col(target))).where("__t is not null")
    targets = usable.groupBy(uid).agg(F.min_by("__t", order).alias("target"))
    every = df.select(uid).distinct()
    return every.join(names, uid, "left").join(targets, uid, "left").select(uid, F.coalesce("drug_name", F.col(uid).cast("string")).alias("drug_name"), "target")


def without_probes(drugs: DataFrame, status: DataFrame, uid: str, column: str = "status") -> DataFrame:
    """Drugs none of whose ids is a tool compound."""
    probes = status.where(F.col(column).isin(*PROBE_STATUS)).select(uid).distinct()
    return drugs.join(probes, uid, "left_anti")


def broad_spectrum(response: DataFrame, disease: str, drug: str, z: str, least: int = 5, top: int = 15, name: str | None = None) -> DataFrame:
    """Per disease the drugs with the lowest mean z, among those with enough rows and a usable name.

    Filters come before the top-N.  ``n_lines`` counts rows.
    """
    means = response.groupBy(disease, drug).agg(F.avg(z).alias("disease_sens"), F.count("*").alias("n_lines"), *([F.first(name).alias(name)] if name else []))
    means = means.where((F.col("n_lines") >= least) & F.col("disease_sens").isNotNull())
    if name:
        means = means.where(actionable(F.col(name)))
    w = Window.partitionBy(disease).orderBy("disease_sens", drug)
    return means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def mechanism(signature: DataFrame, disease: str, drug: str, max_p: float = 0.01, top: int = 20) -> DataFrame:
    """Per disease the panels with small permutation p, by z and then rho, nulls last."""
    w = Window.partitionBy(disease).orderBy(F.desc_nulls_last("perm_z"), F.desc_nulls_last("rho"), drug)
    return signature.where(F.col("perm_p") <= max_p).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def documents(cells: DataFrame, broad: DataFrame, mech: DataFrame, cell: str, name: str, disease: str, drug: str, line: DataFrame) -> DataFrame:
    """(cell, document): nested struct per cell.  Arms are collected per disease, which bounds them by their top-N,
    and only then joined with the cells; ``line`` has (cell, drug, line_sens, ic50) for the cell's own values."""
    own = line.select(cell, drug, nan_to_null(F.col("line_sens")).alias("line_sens"), nan_to_null(F.col("ic50")).alias("ic50"))
    arms = cells.select(cell, disease).join(broad, disease).join(own, [cell, drug], "left")
    first = arms.groupBy(cell).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(drug).alias("drug"), F.round("disease_sens", 3).alias("disease_sens"), F.round("line_sens", 3).alias("line_sens"), F.round("ic50", 3).alias("ic50_uM"), "n_lines"))).alias("broad_spectrum"))
    second = mech.groupBy(disease).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(drug).alias("drug"), F.round("perm_p", 4).alias("perm_p"), F.round("perm_z", 2).alias("perm_z"), F.round("rho", 3).alias("rho")))).alias("mechanism"))
    n = cells.groupBy(disease).agg(F.count("*").alias("n_disease_lines"))
    out = cells.join(first, cell, "left").join(second, disease, "left").join(n, disease)
    mixed = F.col(disease).startswith("SITE_") | (F.upper(disease) == "UNABLE TO CLASSIFY")
    empty = lambda c: F.coalesce(F.col(c), F.array())
    return out.select(
        cell,
        F.struct(
            F.col(cell).alias("cell"), F.col(name).alias("name"), pretty_disease(F.col(disease)).alias("disease"), mixed.alias("mixed_lineage"),
            F.size(empty("broad_spectrum")).alias("n_drugs"), "n_disease_lines", empty("broad_spectrum").alias("broad_spectrum"), empty("mechanism").alias("mechanism"),
        ).alias("document"),
    )
