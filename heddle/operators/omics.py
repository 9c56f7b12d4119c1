"""Omics layers: cleaners that give (cell, feature, value) in long form, the layer registry and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.stats import keep_first
from heddle.functions.text import to_float
from heddle.operators import layers as L
from heddle.sources import tables

#: The layers in the order in which they are built, and how their gaps are filled.
LAYERS = {
    "mutations": "binary", "fusions": "binary", "methylation": "continuous", "metabolomics": "continuous", "rppa": "continuous",
    "mirna": "continuous", "chromatin": "continuous", "cn_summary": "continuous",
}


def _profiled_presence(df: DataFrame, events: DataFrame, cell: str, feature: str, prefix: str) -> DataFrame:
    named = events.where(F.col(cell).isNotNull() & F.col(feature).isNotNull()).select(cell, F.concat(F.lit(prefix), F.col(feature)).alias("feature"))
    return L.presence_long(named, df.where(F.col(cell).isNotNull()), cell, "feature")


def fusions(df: DataFrame, cell: str, name: str, left: str, right: str, passed: str, count: str, drivers: list[str], least: int = 3) -> DataFrame:
    """0/1 of each fusion that passed and has a driver as partner or is recurrent; profiled cells without any are zeros."""
    known = F.when(F.col(left).isin(drivers), F.col(left)).otherwise(F.col(right))
    events = L.driver_events(df.withColumn("__partner", known), passed, "__partner", drivers, count, least)
    return _profiled_presence(df, events, cell, name, "fus_")


def mutations(df: DataFrame, cell: str, gene: str, flags: list[str], genes: list[str]) -> DataFrame:
    """0/1 of each panel gene with a functional variant; every sequenced cell has rows."""
    events = df.where(F.col(gene).isin(genes) & L.any_flag(*flags))
    return _profiled_presence(df, events, cell, gene, "mut_")


def methylation(df: DataFrame, locus: str, samples: list[str], cells: DataFrame, genes: list[str]) -> DataFrame:
    """Mean over the loci of each gene, of the samples that ``cells(sample, cell)`` resolves; the first sample of a cell counts."""
    own = F.split(F.col(locus), "_")[0]
    loci = df.where(F.contains(F.col(locus), F.lit("_")) & own.isin(genes)).withColumn("__gene", own)
    long = loci.select("__gene", *(to_float(F.col(f"`{s}`").cast("string")).alias(s) for s in samples)).unpivot(["__gene"], samples, "sample", "value")
    means = L.locus_mean(long, "__gene", "sample", "value")
    met = means.join(cells.where("cell is not null"), "sample")
    return keep_first(met, ["cell", "__gene"], ["sample"]).select("cell", F.concat(F.lit("meth_"), "__gene").alias("feature"), "value")


def numeric_layer(df: DataFrame, key: str, columns: list[str], cells: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """Wide text columns as numbers; keys are cells, or go through ``cells(sample, cell)``, the resolved ladder.

    Of several rows of one cell the first by its key counts.
    """
    long = L.unpivot_numeric(df.where(F.col(key).isNotNull()).select(F.col(key).alias("sample"), *(F.col(f"`{c}`") for c in columns)), "sample", columns)
    met = long.join(cells.where("cell is not null"), "sample") if cells is not None else long.withColumn("cell", F.col("sample"))
    first = keep_first(met, ["cell", "feature"], ["sample"])
    return first.select("cell", F.concat(F.lit(prefix), "feature").alias("feature"), "value")


def annotation(df: DataFrame) -> DataFrame:
    """The antibody to gene table goes through as it is."""
    return df


def summary(layers: dict[str, DataFrame], universe: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Per layer its features, cells, cells of the universe and kind; layers that aren't registered need a kind."""
    kinds = LAYERS | (kinds or {})
    out = None
    inside = universe.select("cell").distinct().withColumn("__in", F.lit(True))
    for name, layer in layers.items():
        if name not in kinds:
            raise KeyError(f"unknown layer {name!r}; known: {', '.join(kinds)}")
        cells = layer.select("cell").distinct().join(inside, "cell", "left")
        counts = cells.agg(F.count("*").alias("n_cells_total"), F.count("__in").alias("n_cells_in_universe"))
        one = layer.agg(F.countDistinct("feature").alias("n_features")).crossJoin(counts).select(F.lit(name).alias("layer"), "n_features", "n_cells_total", "n_cells_in_universe", F.lit(kinds[name]).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


#: The cleaner of each layer; all give (cell, feature, value).
CLEANERS = {
    "mutations": mutations, "fusions": fusions, "methylation": methylation, "metabolomics": numeric_layer, "rppa": numeric_layer,
    "mirna": numeric_layer, "chromatin": numeric_layer, "cn_summary": numeric_layer,
}


def kind_of(layer: DataFrame) -> str:
    """Whole numbers are presence, so their gaps are zeros; other values get their feature's mean."""
    return "binary" if layer.schema["value"].dataType.typeName() in ("byte", "short", "integer", "long", "boolean") else "continuous"


def clean(sources: dict[str, dict]) -> dict[str, DataFrame]:
    """Each named layer by its registered cleaner, with that cleaner's arguments."""
    unknown = [n for n in sources if n not in CLEANERS]
    if unknown:
        raise KeyError(f"unknown layers {unknown}; known: {', '.join(CLEANERS)}")
    return {n: CLEANERS[n](**sources[n]) for n in CLEANERS if n in sources}


def build(layers: dict[str, DataFrame], samples: DataFrame, path: str, slices: bool = True) -> tuple[DataFrame, DataFrame]:
    """Writes all layers and their slices by disease, and returns (coverage, summary), which it writes as well.

    ::

        path/all/<layer>                       (cell, feature, value)
        path/by_disease/<layer>/disease_slug=  the rows of the disease's cells
        path/coverage, path/layer_summary      delimited text

    A layer is cleaned and written once; slices, coverage and summary read what was written.
    """
    spark = samples.sparkSession
    stored = {}
    for name, layer in layers.items():
        layer.write.mode("overwrite").parquet(f"{path}/all/{name}")
        stored[name] = spark.read.parquet(f"{path}/all/{name}")
        if slices:
            own = stored[name].join(samples.select("cell", "disease"), "cell")
            tables.write_partitioned(own, f"{path}/by_disease/{name}", "disease")
    has = None
    for name, layer in stored.items():
        one = layer.select("cell").distinct().withColumn("layer", F.lit(name))
        has = one if has is None else has.unionByName(one)
    coverage = L.coverage(samples, has, "disease", "cell", "layer", list(stored))
    found = summary(stored, samples, {n: kind_of(layer) for n, layer in stored.items()})
    tables.write_text(coverage, f"{path}/coverage")
    tables.write_text(found, f"{path}/layer_summary")
    return coverage, found
