"""Feature layers in long form (feature, cell, value), and the wide edges where they are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.stats import keep_first
from heddle.functions.text import to_float


def presence(df: DataFrame, cell: str, feature: str, prefix: str = "", features: list[str] | None = None) -> DataFrame:
    """0/1 columns, one per feature, named with a prefix; give ``features`` to spare the pass that lists them."""
    named = df.select(cell, F.concat(F.lit(prefix), F.col(feature)).alias("__f")).where("__f is not null")
    wide = named.groupBy(cell).pivot("__f", [f"{prefix}{f}" for f in features] if features else None).agg(F.max(F.lit(1)))
    return wide.fillna(0)


def presence_long(df: DataFrame, profiled: DataFrame, cell: str, feature: str) -> DataFrame:
    """(cell, feature, value) for every profiled cell and every feature seen, zeros filled in."""
    seen = df.select(cell, feature).distinct().withColumn("value", F.lit(1))
    grid = profiled.select(cell).distinct().crossJoin(df.select(feature).distinct().where(F.col(feature).isNotNull()))
    return grid.join(seen, [cell, feature], "left").select(cell, feature, F.coalesce("value", F.lit(0)).alias("value"))


def wide_presence_complete(df: DataFrame, profiled: DataFrame, cell: str, feature: str, prefix: str, features: list[str] | None = None) -> DataFrame:
    """Rows of all profiled cells; those without any feature are all zeros."""
    return profiled.select(cell).distinct().join(presence(df, cell, feature, prefix, features), cell, "left").fillna(0)


def driver_events(df: DataFrame, passed: str, driver: str, drivers: list[str], count: str, least: int = 3) -> DataFrame:
    """Rows that passed and are either a known driver or frequent enough; a count that is no number is 0."""
    return df.where((F.upper(passed) == "TRUE") & (F.col(driver).isin(drivers) | (F.coalesce(to_float(F.col(count)), F.lit(0.0)) >= least)))


def any_flag(*flags: str) -> Column:
    """Whether any of the flags is true; null is false."""
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(F.col(f), F.lit(False))
    return out


def unpivot_numeric(df: DataFrame, cell: str, columns: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Wide text columns as (cell, feature, number); junk is null."""
    return df.select(cell, *(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).unpivot([cell], columns, feature, value).withColumn(value, to_float(F.col(value)))


def locus_mean(df: DataFrame, gene: str, cell: str, value: str) -> DataFrame:
    """Mean over the loci of a gene."""
    return df.groupBy(gene, cell).agg(F.avg(value).alias(value))


def features_as_rows(df: DataFrame, feature: str, cell: str, value: str, cells: list) -> DataFrame:
    """A wide matrix with one row per feature and one column per cell; only for a stated list of cells."""
    return df.groupBy(feature).pivot(cell, cells).agg(F.first(value))


def coverage(cells: DataFrame, layers: DataFrame, label: str, cell: str, layer: str, names: list[str]) -> DataFrame:
    """Cells per label, and of these the ones that each layer has, as counts and fractions."""
    has = layers.select(cell, layer).distinct()
    met = cells.select(cell, label).distinct().join(has, cell, "left")
    counts = met.groupBy(label).agg(F.countDistinct(cell).alias("n_cells"), *(F.countDistinct(F.when(F.col(layer) == n, F.col(cell))).alias(n) for n in names))
    return counts.select("*", *((F.col(n) / F.col("n_cells")).alias(f"{n}_fraction") for n in names))


def attach(rows: DataFrame, layer: DataFrame, cell: str, feature: str, value: str, binary: bool) -> DataFrame:
    """The layer's value for each row and feature; absent cells are marked, and get 0 or the mean over present rows."""
    features = layer.select(feature).distinct()
    grid = rows.crossJoin(features)
    has = layer.select(cell).distinct().withColumn("__has", F.lit(1))
    met = grid.join(layer.select(cell, feature, value), [cell, feature], "left").join(has, cell, "left")
    fill = F.lit(0.0) if binary else F.avg(value).over(Window.partitionBy(feature))
    return met.withColumn("missing", F.when(F.col("__has").isNull(), 1).otherwise(0)).withColumn(value, F.coalesce(F.col(value).cast("double"), fill)).drop("__has")


def impute_mean(df: DataFrame, feature: str, value: str) -> DataFrame:
    """Nulls become the feature's mean."""
    return df.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(feature))))


def collapse_symbols(df: DataFrame, symbol: str, feature: str, value: str) -> DataFrame:
    """Of the features that share a symbol, the one with the highest mean (ties: first name)."""
    means = df.groupBy(symbol, feature).agg(F.avg(value).alias("mean_value"))
    return keep_first(means, [symbol], [F.desc("mean_value"), F.asc(feature)])


def varying(df: DataFrame, feature: str, value: str) -> DataFrame:
    """The features that are not constant."""
    return df.groupBy(feature).agg(F.stddev_pop(value).alias("sd")).where("sd > 0")


def top_variance(df: DataFrame, feature: str, value: str, n: int = 8000) -> DataFrame:
    """The features of highest sample variance."""
    return df.groupBy(feature).agg(F.var_samp(value).alias("variance")).orderBy(F.desc("variance"), F.asc(feature)).limit(n)


def doubled_genome(doublings: Column) -> Column:
    """At least one genome doubling; no number is false."""
    return F.coalesce(to_float(doublings) >= 1, F.lit(False))


def log1p_matrix(df: DataFrame, value: str) -> DataFrame:
    """P03."""
    return df.withColumn(value, F.log1p(value))
