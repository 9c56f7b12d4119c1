"""Grouped cross-validation in closed form: folds, leave-fold-out means, residuals, metrics, intervals, ranking metrics.

A model that predicts a mean of the training folds needs no fit per fold: the mean without fold f is
(sum - sum of f) / (n - n of f), two windows or two aggregations in place of k passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.stats import average_rank, md5_order, safe_corr
from heddle.operators import ordering
from heddle.session import hold


def folds(df: DataFrame, group: str, k: int = 5, repeats: int = 1, seed: int = 0) -> DataFrame:
    """(repeat, group, fold): distinct groups shuffled by hash and dealt into near-equal folds, as ntile() deals."""
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    reps = groups.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return deal(reps, ["repeat"], group, k, seed).select(group, "repeat", "fold")


def deal(groups: DataFrame, within: list[str], group: str, k: int, seed: int) -> DataFrame:
    """Adds ``fold`` to distinct groups, dealt anew for each value of ``within``.

    No task orders all groups: they are numbered inside the 4,096 ranges of the hash's first digits, and the ranges'
    counts give the offsets.
    """
    reps = groups.withColumn("__h", md5_order(seed, *within, group)).withColumn("__b", F.substring("__h", 1, 3))
    counts = reps.groupBy(*within, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*within)
    offsets = counts.select(*within, "__b", (F.sum("__c").over(w.orderBy("__b")) - F.col("__c")).alias("__o"), F.sum("__c").over(w).alias("__n"))
    rn = F.row_number().over(Window.partitionBy(*within, "__b").orderBy("__h", group)) - 1
    at = reps.withColumn("__r", rn).join(offsets, [*within, "__b"]).withColumn("__r", F.col("__r") + F.col("__o"))
    small, extra = F.floor(F.col("__n") / k), F.col("__n") % k
    fold = F.when(F.col("__r") < extra * (small + 1), F.floor(F.col("__r") / (small + 1))).otherwise(extra + F.floor((F.col("__r") - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    return at.select(*groups.columns, fold.cast("int").alias("fold"))


def check_groups(df: DataFrame, group: str) -> int:
    """At least two groups, or an error."""
    n = df.select(F.countDistinct(group)).first()[0]
    if n < 2:
        raise ValueError(f"cannot split {n} group(s)")
    return n


def _fold_sums(df: DataFrame, y: str, fold: str, within: list[str], keys: list[str]) -> DataFrame:
    """Sums and counts per (within, keys, fold): small, and all that means over other folds need."""
    return df.groupBy(*within, *keys, fold).agg(F.coalesce(F.sum(y), F.lit(0.0)).alias("__s"), F.count(y).alias("__n"))


def other_folds(s: Column, n: Column, fold: str, keys: list[str]) -> Column:
    """The mean over the same keys in other folds, as windows over a table of sums; null if there are no rows."""
    every, own = Window.partitionBy(*keys), Window.partitionBy(*keys, fold)
    return F.try_divide(F.sum(s).over(every) - F.sum(s).over(own), F.nullif(F.sum(n).over(every) - F.sum(n).over(own), F.lit(0)))


def leave_fold_out(df: DataFrame, y: str, fold: str, keys: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """Adds the mean of y over rows with the same keys in other folds; null if there are none."""
    within = within or []
    sums = _fold_sums(df, y, fold, within, keys).withColumn(name, other_folds(F.col("__s"), F.col("__n"), fold, [*within, *keys]))
    means = sums.drop("__s", "__n")
    return df.join(means if keys else F.broadcast(means), [*within, *keys, fold])


def _ladder(df: DataFrame, y: str, fold: str, within: list[str], rungs: list[list[str]]) -> DataFrame:
    """One row per (within, all keys, fold) with ``base``: the mean over other folds of the first rung that has rows.

    All rungs come from one table of sums of the finest keys, so the rows themselves are read once for it.  It has a row per label and
    fold, whatever the number of rows, and is broadcast, so that rows are not shuffled to meet it.
    """
    keys = list(dict.fromkeys(k for r in rungs for k in r))
    sums = _fold_sums(df, y, fold, within, keys)
    return sums.withColumn("base", F.coalesce(*(other_folds(F.col("__s"), F.col("__n"), fold, [*within, *r]) for r in rungs)))


def drug_mean(df: DataFrame, y: str, drug: str, fold: str, within: list[str]) -> DataFrame:
    """The drug's mean over the other folds, else the mean of all other rows."""
    means = _ladder(df, y, fold, within, [[drug], []]).withColumnRenamed("base", "y_pred")
    return df.join(F.broadcast(means.drop("__s", "__n")), [*within, drug, fold])


def residual(df: DataFrame, y: str, drug: str, fold: str, within: list[str], disease: str | None = None) -> DataFrame:
    """Y less the mean over other folds, of the drug, or of (disease, drug) with drug and global as fallbacks."""
    rungs = [[disease, drug]] if disease else []
    means = _ladder(df, y, fold, within, [*rungs, [drug], []]).drop("__s", "__n")
    return df.join(F.broadcast(means), [*within, *([disease] if disease else []), drug, fold]).withColumn("residual", F.col(y) - F.col("base"))


def tissue_oracle(df: DataFrame, y: str, cell: str, drug: str, disease: str, fold: str, within: list[str]) -> DataFrame:
    """The residual of the drug predicted by the disease's mean residual over the other folds; 0 if it has none.

    Residuals add up from the same sums: those of (disease, drug, fold) less their count times the base.
    """
    sums = _fold_sums(df, y, fold, within, [disease, drug])
    base = F.coalesce(*(other_folds(F.col("__s"), F.col("__n"), fold, [*within, *r]) for r in ([drug], [])))
    left = sums.withColumn("base", base).withColumn("__r", F.col("__s") - F.col("__n") * F.col("base"))
    means = left.withColumn("y_pred", F.coalesce(other_folds(F.col("__r"), F.col("__n"), fold, [*within, disease]), F.lit(0.0)))
    met = df.join(F.broadcast(means.drop("__s", "__n", "__r")), [*within, disease, drug, fold])
    return met.withColumn("residual", F.col(y) - F.col("base"))


def regression_metrics(df: DataFrame, keys: list[str], y: str = "y", pred: str = "y_pred", least: int = 3, spread: bool = False) -> DataFrame:
    """Spearman, Pearson, RMSE and R2 over finite pairs; null with fewer than ``least`` rows or without spread.

    ``spread`` ranks groups of any size over many tasks (pan-cancer units); without it, a task ranks each group.
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    pairs = df.where(ok(y) & ok(pred)).select(*dict.fromkeys([*keys, y, pred]))
    if spread:
        pairs = hold(pairs)
        ranked = ordering.average_ranks(ordering.average_ranks(pairs, keys, y, "__ry"), keys, pred, "__rp")
    else:
        ranked = pairs.withColumn("__ry", average_rank(y, *keys)).withColumn("__rp", average_rank(pred, *keys))
    sse = F.sum(F.pow(F.col(y) - F.col(pred), 2))
    n = F.count("*")
    some = lambda c: F.when(n >= least, c)
    return ranked.groupBy(*keys).agg(
        n.alias("n"), some(safe_corr("__ry", "__rp")).alias("spearman"), some(safe_corr(y, pred)).alias("pearson"),
        some(F.sqrt(sse / n)).alias("rmse"), some(1 - F.try_divide(sse, F.nullif(F.var_pop(y) * n, F.lit(0.0)))).alias("r2"),
    )


def summarize(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, deviation, normal 95 % interval, range and number over repeats; one repeat has an interval of width 0."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    n, sd = F.count(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    half = 1.96 * sd / F.sqrt(n)
    return finite.groupBy(*keys).agg(F.avg(value).alias("mean"), sd.alias("sd"), (F.avg(value) - half).alias("lo"), (F.avg(value) + half).alias("hi"), F.min(value).alias("min"), F.max(value).alias("max"), n.alias("n"))


def per_line_ranking(df: DataFrame, keys: list[str], item: str, y: str = "y", pred: str = "y_pred", k: int = 3, least: int = 3) -> DataFrame:
    """Per line: top-k hit rate, Kendall's tau-b, Spearman and NDCG@k with tied predictions sharing their gain.

    Lower values rank first, ties by item.  One shuffle makes an array of each line, whose items (drugs) must fit in one; batches
    of lines are ranked and their inversions counted at once.  ``ordering.kendall_spread`` serves longer lines.
    """
    rows = df.where(F.col(pred).isNotNull() & F.col(y).isNotNull())
    listed = F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(y).cast("double").alias("y"), F.col(pred).cast("double").alias("p"))))
    lines = rows.groupBy(*keys).agg(listed.alias("__r")).where(F.size("__r") >= least).select(*keys, F.col("__r.y").alias("__y"), F.col("__r.p").alias("__p"))
    kinds = (pa.int32(), *[pa.float64()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = batch.column(len(keys)), batch.column(len(keys) + 1)
            line = np.repeat(np.arange(len(batch)), own.value_lengths().to_numpy(zero_copy_only=False))
            found = ordering.ranking_metrics(line, own.flatten().to_numpy(zero_copy_only=False), other.flatten().to_numpy(zero_copy_only=False), len(batch), k)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(v, t, from_pandas=True) for v, t in zip(found.values(), kinds, strict=True))], names=[*keys, *found])

    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return lines.mapInArrow(run, f"{shape}, {ordering.RANKING}")


def compare_arms(df: DataFrame, keys: list[str], model: str, value: str, arms: list[str]) -> DataFrame:
    """One column per model arm."""
    return df.groupBy(*keys).agg(*(F.max(F.when(F.col(model) == a, F.col(value))).alias(a) for a in arms))


def arm_deltas(results: DataFrame, keys: list[str], arms: list[str], value: str = "spearman") -> DataFrame:
    """One column per arm and, for each arm after the first, its gain over the one before."""
    wide = compare_arms(results, keys, "model", value, arms)
    return wide.select("*", *((F.col(b) - F.col(a)).alias(f"delta_{b}") for a, b in zip(arms, arms[1:], strict=False)))


def cohort_summary(results: DataFrame, cohort: str = "cohort", disease: str = "disease") -> DataFrame:
    """Per cohort and model: diseases, mean Spearman, mean width of the interval, and how many lie above 0."""
    return results.groupBy(cohort, "model").agg(
        F.countDistinct(disease).alias("n_diseases"), F.avg("spearman").alias("mean_spearman"), F.avg(F.col("spearman_hi") - F.col("spearman_lo")).alias("mean_ci_width"),
        F.count_if(F.col("spearman_lo") > 0).alias("n_above_zero"),
    )
