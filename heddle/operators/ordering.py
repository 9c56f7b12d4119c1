"""Ranks, quantiles and Kendall's tau of groups of any size: no task sorts a whole group.

Equal values are added up first, so a value that many rows have is one entry.  Groups with many distinct values are cut
into ranges at values taken from a sample by hash, which is the same on every evaluation; equal values never part.  Counts per
range give the offsets, and only ranges are sorted.  What is collected is the splitters: at most ``most_ranges`` of them,
however many rows there are, as ranges grow with the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.session import hold

_SAMPLES = 64


def _same(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A join on columns that may be null."""
    names = {c: f"__j{k}" for k, c in enumerate(columns)}
    other = right.withColumnsRenamed(names)
    met = F.lit(True)
    for c, n in names.items():
        met = met & left[c].eqNullSafe(other[n])
    return left.join(other, met, how).drop(*names.values())


class Ranges:
    """The distinct non-null values of each group with their counts, in ranges of about ``rows`` values."""

    def __init__(self, df: DataFrame, keys: list[str], value: str, rows: int = 200_000, most_ranges: int = 20_000):
        self.keys, self.value = keys, value
        counts = hold(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c")))  # read for sizes, sample, offsets and ranks
        sizes = counts.groupBy(*keys).agg(F.count("*").alias("__m"))
        total = sizes.agg(F.sum("__m")).first()[0] or 0
        held = max(rows, 1, -(-total // most_ranges))
        big = sizes.where(F.col("__m") > held)
        # fewer than most_ranges groups are that big, and each is cut into its size over held
        wanted = [(tuple(r[k] for k in keys), -(-r["__m"] // held), r["__m"]) for r in big.collect()]
        self.ranges = sum(n for _, n, _ in wanted)
        kinds = [counts.schema[k].dataType.simpleString() for k in keys]
        splits = self._splits(counts, big, wanted, held) if wanted else {}
        spark, named = df.sparkSession, ", ".join(f"`{k}` {t}" for k, t in zip(keys, kinds, strict=True))
        table = spark.createDataFrame([(*k, s) for k, s in splits.items()], f"{named + ', ' if keys else ''}__s array<{counts.schema[value].dataType.simpleString()}>")
        placed = _same(counts, F.broadcast(table), keys, "left") if splits else counts.withColumn("__s", F.lit(None).cast(table.schema["__s"].dataType))
        self.splits = table
        self.counts = placed.withColumn("__b", _place(F.col("__s"), F.col(value))).drop("__s")
        per = self.counts.groupBy(*keys, "__b").agg(F.sum("__c").alias("__n"))
        self.offsets = per.withColumn("__o", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__n"))

    def _splits(self, counts: DataFrame, big: DataFrame, wanted: list, held: int) -> dict:
        rate = _SAMPLES / held
        drawn = _same(counts, F.broadcast(big), self.keys, "inner") if self.keys else counts
        mark = F.pmod(F.xxhash64(self.value), F.lit(1 << 30)) / float(1 << 30)
        found: dict[tuple, list] = {}
        for r in drawn.where(mark < rate).select(*self.keys, self.value).collect():
            found.setdefault(tuple(r[k] for k in self.keys), []).append(r[self.value])
        out = {}
        for key, n, _ in wanted:
            line = sorted(found.get(key, []), key=lambda v: (v != v, v))  # NaN is the largest, as in Spark
            out[key] = [line[k * len(line) // n] for k in range(1, n)] if len(line) >= n else line
        return out

    def ranked(self) -> DataFrame:
        """(keys, value, __c, __b, __less): how many values of the group are smaller."""
        w = Window.partitionBy(*self.keys, "__b").orderBy(self.value).rowsBetween(Window.unboundedPreceding, -1)
        inside = self.counts.withColumn("__l", F.coalesce(F.sum("__c").over(w), F.lit(0)))
        return _same(inside, self.offsets.drop("__n"), [*self.keys, "__b"], "inner").withColumn("__less", F.col("__l") + F.col("__o")).drop("__l", "__o")

    def block(self, df: DataFrame, name: str) -> DataFrame:
        """Adds the number of the range that a row's value is in."""
        met = _same(df, F.broadcast(self.splits), self.keys, "left")
        return met.withColumn(name, _place(F.col("__s"), F.col(self.value))).drop("__s")


def _place(splits: Column, value: Column) -> Column:
    """How many splits are below the value, by halving; 0 without splits."""
    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(splits), F.lit(0)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        lower = F.get(splits, mid) < value
        done = s["lo"] >= s["hi"]
        return F.when(done, s).otherwise(F.when(lower, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi"))))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(15)), start, step)["lo"]
    return F.when(splits.isNull(), F.lit(0)).otherwise(found)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str, rows: int = 200_000) -> DataFrame:
    """Adds the rank of each non-null value in its group, ties averaged; null for null."""
    found = Ranges(df, keys, value, rows).ranked()
    ranks = found.select(*keys, value, (F.col("__less") + (F.col("__c") + 1) / F.lit(2.0)).alias(name))
    return _same(df, ranks, [*keys, value], "left")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], rows: int = 200_000) -> DataFrame:
    """(keys, prob, quantile) with linear interpolation; only the ranges that hold a wanted order statistic are sorted."""
    ranges = Ranges(df, keys, value, rows)
    n = ranges.offsets.groupBy(*keys).agg(F.sum("__n").alias("__t"))
    at = (F.col("__t") - 1) * F.col("prob")
    each = n.select(*keys, "__t", F.explode(F.array(*(F.lit(float(p)) for p in probs))).alias("prob")).withColumns({"__f": at - F.floor(at), "__p": F.floor(at)})
    spots = each.select(*keys, "prob", "__f", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("__p").alias("p")), F.struct(F.lit(1).alias("k"), F.least(F.col("__p") + 1, F.col("__t") - 1).alias("p")))).alias("__w"))
    inside = _same(spots, ranges.offsets, keys, "inner") if keys else spots.crossJoin(ranges.offsets)
    spots = inside.where("__w.p >= __o and __w.p < __o + __n").drop("__o", "__n")
    needed = spots.select(*keys, "__b").distinct()
    some = _same(ranges.counts, needed, [*keys, "__b"], "left_semi")
    ranges.counts = some
    hit = _same(spots, ranges.ranked(), [*keys, "__b"], "inner").where(f"__w.p >= __less and __w.p < __less + __c")  # noqa: F541
    pick = lambda k: F.max(F.when(F.col("__w.k") == k, F.col(value)))
    ends = hit.groupBy(*keys, "prob", "__f").agg(pick(0).alias("__a"), pick(1).alias("__z"))
    return ends.select(*keys, "prob", (F.col("__a") + F.when(F.col("__f") > 0, F.col("__f") * (F.col("__z") - F.col("__a"))).otherwise(0.0)).alias("quantile"))


def inversions(line: np.ndarray, rank: np.ndarray, lines: int) -> np.ndarray:
    """Per line, the pairs that stand in the wrong order; ``line`` is sorted, ranks are distinct inside a line and from 0.

    By the bits of the ranks: pairs whose ranks first differ in a bit are wrong where the one with the bit stands first.  Each bit
    is one stable order of all elements by the bits above it.
    """
    out = np.zeros(lines, np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length()):
        above = rank >> (bit + 1)
        order = np.lexsort((above, line))
        one = (rank[order] >> bit) & 1
        group = np.flatnonzero(np.append(True, (line[order][1:] != line[order][:-1]) | (above[order][1:] != above[order][:-1]))) if len(order) else np.zeros(0, np.int64)
        before = np.cumsum(one) - one
        before -= np.repeat(before[group], np.diff(np.append(group, len(order))))
        out += np.bincount(line[order], weights=np.where(one == 0, before, 0), minlength=lines).astype(np.int64)
    return out


def wrong_pairs(line: np.ndarray, y: np.ndarray, p: np.ndarray, lines: int) -> np.ndarray:
    """Per line, the pairs that y and p order differently, ties in neither."""
    order = np.lexsort((y, p, line))
    line, y = line[order], y[order]
    # y's place in its line; equal ones in the order that they stand in are no inversion
    place = np.empty(len(y), np.int64)
    by_y = np.lexsort((np.arange(len(y)), y, line))
    starts = np.searchsorted(line, line[by_y])
    place[by_y] = np.arange(len(y)) - starts
    return inversions(line, place, lines)


def tied_pairs(line: np.ndarray, lines: int, *values: np.ndarray) -> np.ndarray:
    """Per line, the pairs that are equal in all of these values."""
    order = np.lexsort((*values, line))
    new = np.append(True, np.any([v[order][1:] != v[order][:-1] for v in (line, *values)], axis=0)) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(order)))
    return np.bincount(line[order][starts], weights=runs * (runs - 1) / 2, minlength=lines).astype(np.int64)


def kendall_spread(df: DataFrame, keys: list[str], y: str, pred: str, rows: int = 200_000) -> DataFrame:
    """(keys, n, kendall_tau) for groups of any size, tau-b; null if one of the two has no spread.

    Rows lie in a grid of ranges of y and ranges of the prediction.  Pairs in one range of y are counted there, pairs in one
    range of the prediction by their ranges of y, and all others by the counts of the grid's cells.
    """
    both = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).select(*keys, F.col(y).cast("double").alias("__y"), F.col(pred).cast("double").alias("__p"))
    by_y, by_p = Ranges(both, keys, "__y", rows), Ranges(both, keys, "__p", rows)
    # equal rows are one with a number, so that a value which many rows have stays small
    grid = by_p.block(by_y.block(both.groupBy(*keys, "__y", "__p").agg(F.count("*").alias("__c")), "__by"), "__bp")
    kinds = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in keys)
    out = f"{kinds + ', ' if keys else ''}__wrong double"

    def count(pdf: pd.DataFrame, level: str) -> float:
        """Wrong pairs by (level, prediction), with the numbers of rows as weights."""
        v, p, c = pdf[level].to_numpy(), pdf["__p"].to_numpy(), pdf["__c"].to_numpy(float)
        order = np.lexsort((v, p))
        v, c = v[order], c[order]
        return float(_weighted_inversions(v, c))

    inside_y = grid.groupBy(*keys, "__by").applyInPandas(lambda key, pdf: pd.DataFrame([[*key[: len(keys)], count(pdf, "__y")]], columns=[*keys, "__wrong"]), out)
    inside_p = grid.groupBy(*keys, "__bp").applyInPandas(lambda key, pdf: pd.DataFrame([[*key[: len(keys)], count(pdf, "__by")]], columns=[*keys, "__wrong"]), out)
    cells = grid.groupBy(*keys, "__by", "__bp").agg(F.sum("__c").cast("double").alias("__n"))
    # of each cell: how many rows lie in smaller ranges of the prediction and larger ranges of y
    rows_of = Window.partitionBy(*keys, "__by").orderBy("__bp").rowsBetween(Window.unboundedPreceding, -1)
    left = cells.select(*keys, "__by", "__bp", "__n")
    blocks = cells.select(*keys, "__bp").distinct()
    full = _same(cells.select(*keys, "__by").distinct().withColumnRenamed("__by", "__ry"), blocks, keys, "inner") if keys else cells.select(F.col("__by").alias("__ry")).distinct().crossJoin(blocks)
    before = _same(full.withColumnRenamed("__ry", "__by"), left, [*keys, "__by", "__bp"], "left").withColumn("__n", F.coalesce("__n", F.lit(0.0))).withColumn("__before", F.coalesce(F.sum("__n").over(rows_of), F.lit(0.0)))
    above = Window.partitionBy(*keys, "__bp").orderBy(F.desc("__by")).rowsBetween(Window.unboundedPreceding, -1)
    cross = before.withColumn("__larger", F.coalesce(F.sum("__before").over(above), F.lit(0.0))).groupBy(*keys).agg(F.sum(F.col("__n") * F.col("__larger")).alias("__wrong"))
    wrong = inside_y.unionByName(inside_p).unionByName(cross).groupBy(*keys).agg(F.sum("__wrong").alias("__d"))
    pairs = lambda c: F.sum(c * (c - 1) / F.lit(2.0))
    # ties from the counts of values and of pairs of values
    n = both.groupBy(*keys).agg(F.count("*").alias("n"))
    for name, columns in (("__ty", ["__y"]), ("__tp", ["__p"]), ("__tb", ["__y", "__p"])):
        n = _same(n, grid.groupBy(*keys, *columns).agg(F.sum("__c").cast("double").alias("__k")).groupBy(*keys).agg(pairs(F.col("__k")).alias(name)), keys, "left") if keys else n.crossJoin(grid.groupBy(*columns).agg(F.sum("__c").cast("double").alias("__k")).agg(pairs(F.col("__k")).alias(name)))
    met = _same(n, wrong, keys, "left") if keys else n.crossJoin(wrong)
    every = F.col("n") * (F.col("n") - 1) / F.lit(2.0)
    net = every - F.col("__ty") - F.col("__tp") + F.col("__tb") - 2 * F.col("__d")
    return met.select(*keys, "n", F.try_divide(net, F.nullif(F.sqrt((every - F.col("__ty")) * (every - F.col("__tp"))), F.lit(0.0))).alias("kendall_tau"))


def _weighted_inversions(v: np.ndarray, c: np.ndarray) -> float:
    """Sum of c_i c_j over i before j with v_i > v_j; elements of one prediction stand in the order of v, so they add nothing."""
    place = np.unique(v, return_inverse=True)[1].astype(np.int64)
    total = 0.0
    for bit in range(int(place.max(initial=0)).bit_length()):
        above = place >> (bit + 1)
        order = np.argsort(above, kind="stable")
        one, w, a = (place[order] >> bit) & 1, c[order], above[order]
        group = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        ones = np.cumsum(one * w) - one * w
        ones -= np.repeat(ones[group], np.diff(np.append(group, len(order))))
        total += float((np.where(one == 0, w, 0.0) * ones).sum())
    return total


def line_ranks(line: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Ranks from 1 inside each line, ties averaged; NaN is the largest value and equal to itself, as in Spark."""
    odd = np.isnan(v)
    plain = np.where(odd, 0.0, v)
    order = np.lexsort((plain, odd, line))
    cut = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in (line, odd, plain)], axis=0)) if len(order) else np.zeros(0, bool)
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(order)))
    first = np.searchsorted(line[order], line[order])
    out = np.empty(len(v))
    out[order] = np.repeat(start + (size - 1) / 2.0, size) - first + 1
    return out


def line_spearman(line: np.ndarray, a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray, lines: int) -> np.ndarray:
    """Rank correlation per line of the rows that have both; ranks are among all that have the value.  NaN without spread."""
    ra, rb = np.zeros(len(a)), np.zeros(len(b))
    ra[has_a], rb[has_b] = line_ranks(line[has_a], a[has_a]), line_ranks(line[has_b], b[has_b])
    both = has_a & has_b
    at, x, y = line[both], ra[both], rb[both]
    n = np.bincount(at, minlength=lines)
    total = lambda v: np.bincount(at, weights=v, minlength=lines)
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = x - (total(x) / n)[at], y - (total(y) / n)[at]
        spread = total(x * x) * total(y * y)
        return np.where(spread > 0, total(x * y) / np.sqrt(spread), np.nan)


RANKING = "n_items int, topk_hit_rate double, kendall_tau double, spearman double, ndcg double"


def ranking_metrics(line: np.ndarray, y: np.ndarray, p: np.ndarray, lines: int, k: int) -> dict[str, np.ndarray]:
    """M12, W14 of many lines at once; ``line`` is sorted, and inside a line elements stand in the order that breaks ties."""
    n = np.bincount(line, minlength=lines)
    first = np.cumsum(n) - n
    top = np.minimum(k, n)
    at = np.arange(len(line))

    def place(v: np.ndarray) -> np.ndarray:
        out = np.empty(len(v), np.int64)
        out[np.lexsort((at, v, line))] = at - first[line]
        return out

    def runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the run of equal values that each element is in, and the runs' sizes."""
        order = np.lexsort((v, line))
        new = np.append(True, (line[order][1:] != line[order][:-1]) | (v[order][1:] != v[order][:-1])) if len(v) else np.zeros(0, bool)
        run = np.empty(len(v), np.int64)
        run[order] = np.cumsum(new) - 1
        return run, np.bincount(run)

    def total(v: np.ndarray) -> np.ndarray:
        return np.bincount(line, weights=v, minlength=lines)

    by_y, by_p = place(y), place(p)
    (run_y, size_y), (run_p, size_p) = runs(y), runs(p)
    mean_place = lambda run, size, spot: (np.bincount(run, weights=spot) / size)[run]
    ry, rp = mean_place(run_y, size_y, by_y), mean_place(run_p, size_p, by_p)
    best = np.full(lines, -np.inf)
    np.maximum.at(best, line, y)
    gain = best[line] - y
    shared = (np.bincount(run_p, weights=gain) / size_p)[run_p]
    kk = top[line]
    dcg = total(np.where(by_p < kk, shared / np.log2(by_p + 2.0), 0.0))
    ideal = total(np.where(by_y < kk, gain / np.log2(by_y + 2.0), 0.0))
    hits = total(((by_y < kk) & (by_p < kk)).astype(float))
    middle = (n - 1) / 2.0
    dy, dp = ry - middle[line], rp - middle[line]
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = total(dy * dp) / np.sqrt(total(dy * dy) * total(dp * dp))
        every = n * (n - 1) / 2.0
        ty, tp, tb = tied_pairs(line, lines, y), tied_pairs(line, lines, p), tied_pairs(line, lines, y, p)
        tau = (every - ty - tp + tb - 2.0 * wrong_pairs(line, y, p, lines)) / np.sqrt((every - ty) * (every - tp))
        ndcg = np.where(ideal > 0, dcg / ideal, np.nan)
        real = (ty < every) & (tp < every)
        return {"n_items": n, "topk_hit_rate": hits / top, "kendall_tau": np.where(real, tau, np.nan), "spearman": np.where(real, rho, np.nan), "ndcg": np.where(real, ndcg, np.nan)}
