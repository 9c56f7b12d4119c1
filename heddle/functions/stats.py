"""Statistics as column expressions: safe under ANSI mode, nulls where nothing is defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson's r as an aggregate; null on a constant column, where corr() raises an error."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def average_rank(value: str, *partition: str) -> Column:
    """Rank with ties averaged, among non-null values of the partition."""
    c = F.col(value)
    same = F.count(c).over(Window.partitionBy(*partition, value))
    rank = F.rank().over(Window.partitionBy(*partition).orderBy(c.asc_nulls_last()))
    return F.when(c.isNotNull(), rank + (same - 1) / F.lit(2.0))


def percent_rank_average(value: str, *partition: str, least: int = 5) -> Column:
    """Average rank over count; null below ``least`` values."""
    n = F.count(value).over(Window.partitionBy(*partition))
    return F.when(n >= least, average_rank(value, *partition) / n)


def z_score(value: str, *partition: str, least: int = 5) -> Column:
    """Distance from the group's mean in sample deviations; null below ``least`` values or without spread."""
    w = Window.partitionBy(*partition)
    sd, n = F.stddev_samp(value).over(w), F.count(value).over(w)
    return F.when((n >= least) & (sd > 0), (F.col(value) - F.avg(value).over(w)) / sd)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first by an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_value_of(value: str, order: str) -> Column:
    """The first non-null value by an explicit order, as an aggregate."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))


def rows_of(partition: list[str], order: list[Column | str]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def quartile_of_rank(value: str, ties: str, *partition: str, bins: int = 4) -> Column:
    """Quantile bin of the first-come rank, in closed form; not the same as ntile()."""
    rn = F.row_number().over(Window.partitionBy(*partition).orderBy(value, ties))
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    at = F.when(n > 1, (rn - 1) * F.lit(float(bins)) / (n - 1)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0), F.ceil(F.round(at, 9)) - 1).cast("int")


def erf(x: Column) -> Column:
    """F16: Abramowitz and Stegun 7.1.26, error below 1.5e-7."""
    t = 1 / (1 + F.lit(0.3275911) * F.abs(x))
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_percentile(z: Column) -> Column:
    return 50 * (1 + erf(z / F.lit(2**0.5)))


def dot(a: Column, b: Column) -> Column:
    """inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def md5_order(seed: object, *ids: str) -> Column:
    """An order that is the same on any number of executors and in any engine with md5()."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def log_factorials(n: Column) -> Column:
    return F.aggregate(F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, x: s + F.ln(x.cast("double")))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, p), exact, summed in log space; 1 for k <= 0."""
    ln_n = log_factorials(n)

    def term(i: Column) -> Column:
        i = i.cast("int")
        return F.exp(ln_n - log_factorials(i) - log_factorials(n - i) + i * F.ln(p) + (n - i) * F.ln(1 - p))

    total = F.aggregate(F.when(k <= n, F.sequence(k.cast("int"), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + term(i))
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def benjamini_hochberg(p: str, *partition: str, ties: str) -> Column:
    """Adjusted p-values."""
    w = Window.partitionBy(*partition)
    rank = F.row_number().over(w.orderBy(F.asc(p), F.asc(ties)))
    n = F.count(p).over(w)
    raw = F.col(p) * n / rank
    down = w.orderBy(F.desc(p), F.desc(ties)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.least(F.lit(1.0), F.min(raw).over(down))
