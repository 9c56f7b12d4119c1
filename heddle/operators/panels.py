"""Panels (disease, drug): support filters, chunks, shards, ranked feature lists and enrichment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.stats import benjamini_hochberg
from heddle.operators import ordering


def cohort_filter(df: DataFrame, cohort: str, column: str = "cohort") -> DataFrame:
    """One cohort, in any case; ``both`` keeps all."""
    if cohort.lower() == "both":
        return df
    return df.where(F.lower(column) == cohort.lower())


def supported(df: DataFrame, item: str, counted: str, least: int) -> DataFrame:
    """Rows of items with at least ``least`` distinct values; the item list stays distributed."""
    good = df.groupBy(item).agg(F.countDistinct(counted).alias("n")).where(F.col("n") >= least)
    return df.join(good.select(item), item, "left_semi")


def supported_in_group(df: DataFrame, group: list[str], counted: str, least: int) -> DataFrame:
    """By distinct values inside each group; aggregated before the shuffle, not gathered in a window."""
    n = df.groupBy(*group).agg(F.countDistinct(counted).alias("__n")).where(F.col("__n") >= least)
    return df.join(n.drop("__n"), group, "left_semi")


def panels_by_rows(df: DataFrame, value: str, cell: str = "cell", keys: tuple[str, ...] = ("disease", "drug"), least: int = 20, least_sd: float = 0.3) -> DataFrame:
    """Panels with enough cells and enough spread of their rows."""
    return df.groupBy(*keys).agg(F.countDistinct(cell).alias("n_lines"), F.stddev_samp(value).alias("sd_y")).where((F.col("n_lines") >= least) & (F.col("sd_y") >= least_sd))


def panels_by_means(df: DataFrame, value: str, cell: str = "cell", keys: tuple[str, ...] = ("disease", "drug"), least: int = 20, least_sd: float = 1.0) -> DataFrame:
    """The same after a mean per cell."""
    means = df.groupBy(*keys, cell).agg(F.avg(value).alias("y"))
    return means.groupBy(*keys).agg(F.count("y").alias("n"), F.stddev_samp("y").alias("sd")).where((F.col("n") >= least) & (F.col("sd") >= least_sd))


def named_like(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    """Rows whose name matches one of the patterns, in any case."""
    return df.where(F.col(column).rlike("(?i)" + "|".join(parts)))


def head_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def even_chunks(df: DataFrame, group: str, item: str, size: int) -> DataFrame:
    """Chunk numbers from 0 of near-equal chunks of at most ``size`` items; the larger ones come first.

    ntile() wants a constant, so its rule is written out: with n items in c chunks the first n mod c have one more.
    """
    w = Window.partitionBy(group)
    n, rn = F.count("*").over(w), F.row_number().over(w.orderBy(item)) - 1
    chunks = F.ceil(n / F.lit(float(size)))
    small, extra = F.floor(n / chunks), n % chunks
    at = F.when(rn < extra * (small + 1), F.floor(rn / (small + 1))).otherwise(extra + F.floor((rn - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    return df.withColumn("chunk", at.cast("int"))


def shards(df: DataFrame, group: str, item: str, size: int) -> DataFrame:
    """A row per chunk with its items as JSON."""
    return even_chunks(df, group, item, size).groupBy(group, "chunk").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"), F.count("*").alias("n_items"))


def spearman_features(expression: DataFrame, response: DataFrame, panel: list[str], cell: str, feature: str, value: str, y: str, sign: float = -1.0) -> DataFrame:
    """Rank correlation of every feature with ``sign * y`` in each panel; null without spread.

    One shuffle makes an array of each (panel, feature), as long as the panel has cells; batches of arrays are ranked at once.
    """
    met = response.select(*panel, cell, F.col(y).cast("double").alias("__y")).join(expression.select(cell, feature, F.col(value).cast("double").alias("__v")), cell)
    lists = met.groupBy(*panel, feature).agg(F.collect_list(F.struct("__v", "__y")).alias("__r")).select(*panel, feature, F.col("__r.__v").alias("__v"), F.col("__r.__y").alias("__y"))
    keys = [*panel, feature]
    kinds = ", ".join(f"`{k}` {lists.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, t = batch.column(len(keys)), batch.column(len(keys) + 1)
            n = x.value_lengths().to_numpy(zero_copy_only=False)
            line = np.repeat(np.arange(len(batch)), n)
            (a, has_a), (b, has_b) = ((c.flatten().to_numpy(zero_copy_only=False), c.flatten().is_valid().to_numpy(zero_copy_only=False)) for c in (x, t))
            rho = ordering.line_spearman(line, a, sign * b, has_a, has_b, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(n, pa.int64()), pa.array(rho, pa.float64(), from_pandas=True)], names=[*keys, "n", "rho"])

    return lists.mapInArrow(run, f"{kinds}, n long, rho double")


def ranked_list(rho: DataFrame, panel: list[str], feature: str) -> DataFrame:
    """Features of each panel by descending rho, nulls left out."""
    return head_per_group(rho.where("rho is not null"), panel, [F.desc("rho"), F.asc(feature)], (1 << 31) - 1)


def enrichment(stats: DataFrame, sets: DataFrame, panel: list[str], feature: str, stat: str, name: str, exponent: float = 1.0, least: int = 5, most: int = 500) -> DataFrame:
    """Running-sum enrichment score of each panel and set, with its leading edge.

    Down the ranked list a hit adds ``|stat|^exponent`` over its sum, a miss subtracts 1 / misses; the score is the sum
    furthest from 0.  Hits only change the sum at their own place, so just these rows are formed, with the misses
    before them in closed form: rows grow with set memberships, not with panels x sets x features.  The hits of a panel and set
    are one sorted array, no longer than the panel's list, and batches of these are summed at once.
    """
    w = Window.partitionBy(*panel)
    ranked = stats.withColumn("__r", F.row_number().over(w.orderBy(F.desc(stat), F.asc(feature)))).withColumn("__n", F.count("*").over(w))
    hits = ranked.join(sets.select(F.col(name), F.col(feature)).distinct(), feature)
    entry = F.struct(F.col("__r").alias("r"), F.pow(F.abs(stat), exponent).cast("double").alias("w"), F.col(feature).cast("string").alias("f"))
    gathered = hits.groupBy(*panel, name).agg(F.count("*").cast("long").alias("size"), F.max("__n").cast("long").alias("__n"), F.array_sort(F.collect_list(entry)).alias("__h"))
    lists = gathered.where((F.col("size") >= least) & (F.col("size") <= most))
    keys = [*panel, name, "size"]
    kinds = ", ".join(f"`{k}` {lists.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own = {c: batch.column(batch.schema.get_field_index(c)) for c in (*keys, "__n", "r", "w", "f")}
            size = own["size"].to_numpy()
            r, weight, f = own["r"].flatten().to_numpy(), own["w"].flatten().to_numpy(), own["f"].flatten().to_pylist()
            scores, edges = running_sums(size, own["__n"].to_numpy(), r, weight)
            ends = np.cumsum(size)
            told = ["/".join(sorted(x for x, e in zip(f[i:j], edges[i:j], strict=True) if e)) for i, j in zip((ends - size).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(own[k] for k in keys), pa.array(scores), pa.array(told, pa.string())], names=[*keys, "es", "leading_edge"])

    return lists.select(*keys, "__n", F.col("__h.r").alias("r"), F.col("__h.w").alias("w"), F.col("__h.f").alias("f")).mapInArrow(run, f"{kinds}, es double, leading_edge string")


def running_sums(size: np.ndarray, n: np.ndarray, r: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of sets whose hits stand one after another, with ranks from 1 of n, and which hits are in the leading edge."""
    start = np.cumsum(size) - size
    at = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(r)) - start[at] + 1
    total = np.add.reduceat(weight, start)[at]
    own = np.divide(weight, total, out=1.0 / size[at], where=total > 0)
    run = np.cumsum(own)
    share = run - (run[start] - own[start])[at]
    misses = (n - size)[at]
    miss = np.divide((r - k).astype(float), misses, out=np.zeros(len(r)), where=misses > 0)
    top, low = share - miss, share - own - miss  # just after and just before a hit
    most, least = np.maximum.reduceat(top, start), np.minimum.reduceat(low, start)
    up = np.round(most, 9) >= -np.round(least, 9)  # equal depths both ways count as up, whatever the last bits
    first = np.full(len(size), len(r))
    np.minimum.at(first, at[top == most[at]], np.flatnonzero(top == most[at]))
    last = np.full(len(size), -1)
    np.maximum.at(last, at[low == least[at]], np.flatnonzero(low == least[at]))
    place = np.arange(len(r))
    return np.where(up, most, least), np.where(up[at], place <= first[at], place >= last[at])


def enrichment_significance(stats: DataFrame, sets: DataFrame, panel: list[str], feature: str, stat: str, name: str, perms: int = 1000, seed: int = 0, exponent: float = 1.0, least: int = 5, most: int = 500) -> DataFrame:
    """Enrichment with its normalised score, permutation p and adjusted p per panel.

    A permutation renumbers each panel's features by hash, and the null set of size k is the features numbered 1 to k; so one
    renumbering serves all sizes.  Scores are compared with null scores of their own sign and size: p is (1 + those at least as
    far from 0) / (1 + all of them), the normalised score is the score over their mean distance.
    """
    from heddle.functions.stats import md5_order

    real = enrichment(stats, sets, panel, feature, stat, name, exponent, least, most)
    sizes = real.select(F.col("size").alias("__z")).distinct()
    each = stats.where(F.col(stat).isNotNull()).select(*panel, feature, stat).withColumn("__perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    number = F.row_number().over(Window.partitionBy(*panel, "__perm").orderBy(md5_order(seed, "__perm", feature), feature))
    mixed = each.withColumn("__f", number).drop(feature)
    # at most ``most`` sizes, so at most most * most / 2 memberships
    null_sets = sizes.select("__z", F.explode(F.sequence(F.lit(1).cast("int"), F.col("__z").cast("int"))).alias("__f"))
    null = enrichment(mixed, null_sets, [*panel, "__perm"], "__f", stat, "__z", exponent, 1, most).select(*panel, F.col("__z").alias("size"), F.col("es").alias("__e"), (F.col("es") >= 0).alias("__up"))
    met = real.withColumn("__up", F.col("es") >= 0).join(null, [*panel, "size", "__up"], "left")
    far = F.count_if(F.round(F.abs("__e"), 9) >= F.round(F.abs("es"), 9))
    scored = met.groupBy(*panel, name, "size", "es", "leading_edge").agg(F.try_divide(F.first("es"), F.avg(F.abs("__e"))).alias("nes"), ((1 + far) / (1 + F.count("__e"))).alias("p"))
    return adjusted(scored, "p", panel, name)


def single_sample_enrichment(expression: DataFrame, sets: DataFrame, cell: str, feature: str, value: str, name: str, exponent: float = 0.25, least: int = 5, most: int = 500) -> DataFrame:
    """Per cell and set, the sum over all ranks of hit share minus miss share.

    Over a list of n features, a hit at rank r counts in n - r + 1 places, so the sum is closed over the hits alone.
    """
    w = Window.partitionBy(cell)
    # ranks run from n (highest value) to 1; a hit weighs its rank to the exponent
    ranked = expression.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc(value), F.asc(feature))))
    hits = ranked.join(sets.select(name, feature).distinct(), feature).withColumn("__w", F.pow((F.col("__n") - F.col("__r") + 1).cast("double"), exponent))
    after = F.col("__n") - F.col("__r") + 1
    g = hits.groupBy(cell, name, "__n").agg(F.count("*").alias("size"), F.sum(F.col("__w") * after).alias("a"), F.sum("__w").alias("b"), F.sum(after).alias("c"))
    g = g.where((F.col("size") >= least) & (F.col("size") <= most))
    every = F.col("__n") * (F.col("__n") + 1) / 2.0
    miss = F.when(F.col("__n") > F.col("size"), (every - F.col("c")) / (F.col("__n") - F.col("size"))).otherwise(0.0)
    return g.select(cell, name, "size", (F.col("a") / F.col("b") - miss).alias("score"))


def adjusted(df: DataFrame, p: str, panel: list[str], ties: str) -> DataFrame:
    """M27."""
    return df.withColumn("padj", benjamini_hochberg(p, *panel, ties=ties))
