"""Readers and writers: delimited text, Parquet, JSON checkpoints, GSEA tables, partitioned and per-document sinks."""

from __future__ import annotations

import csv
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heddle.functions.text import blank_to_null, file_safe, name_prefix, slug, split_genes, to_float, to_int


def read_table(spark: SparkSession, path: str, sep: str | None = None, schema: StructType | str | None = None, sheet: str | None = None) -> DataFrame:
    """By the path's ending: spreadsheets (the first sheet or a named one), tab or comma separated text, Parquet, JSON."""
    low = path.lower().removesuffix(".gz")
    if low.endswith((".xlsx", ".xlsm")):
        from heddle.sources.workbook import read_workbook

        return read_workbook(spark, path, sheet)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    sep = sep or ("\t" if low.endswith((".tsv", ".txt")) else ",")
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """Names from the schema alone."""
    return spark.read.parquet(path).columns


def read_columns(spark: SparkSession, path: str, always: list[str], wanted: Iterable[str], parts: int | None = None) -> DataFrame:
    """The wanted columns that are there; ``parts`` spreads a file that cannot be split, as gzip text."""
    df = read_table(spark, path)
    wanted = set(wanted)
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c in always or c in wanted))
    return df.repartition(parts) if parts else df


def read_checkpoints(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The result rows of all readable checkpoint files that ended well."""
    full = f"{schema}, _broken string"
    df = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return df.where("_broken is null and ok").select(F.explode("rows").alias("r")).select("r.*")


#: The names under which GSEA tools write a column, in order of preference.
ALIASES = {
    "description": ("Description", "pathway", "ID", "Term"),
    "nes": ("NES", "nes"),
    "padj": ("p.adjust", "padj", "p_adjust", "FDR", "qvalue", "qvalues", "adj.P.Val"),
}


def by_alias(columns: list[str], names: Iterable[str]) -> Column:
    """the first filled one of the columns that are there."""
    there = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def gsea_rows(df: DataFrame) -> DataFrame:
    """(description, nes, padj) by aliases; rows without description or finite NES are dropped, a missing padj stays null."""
    out = df.select(by_alias(df.columns, ALIASES["description"]).alias("description"), to_float(by_alias(df.columns, ALIASES["nes"])).alias("nes"), to_float(by_alias(df.columns, ALIASES["padj"])).alias("padj"))
    return out.where("description is not null and nes is not null")


def parse_text_table(spark: SparkSession, text: str) -> DataFrame:
    """A pasted table; tab-separated if it has at least as many tabs as commas in its first line."""
    lines = [line for line in text.strip().splitlines() if line.strip()]
    if not lines:
        return spark.createDataFrame([], "description string, nes double, padj double")
    sep = "\t" if lines[0].count("\t") >= lines[0].count(",") else ","
    names = [c.strip() for c in next(csv.reader([lines[0]], delimiter=sep))]  # a quoted name may hold the separator
    schema = ", ".join("`{}` string".format(n.replace("`", "``")) for n in names)
    raw = spark.createDataFrame([(line,) for line in lines[1:]], "line string")
    return gsea_rows(raw.select(F.from_csv("line", F.lit(schema), {"sep": sep}).alias("r")).select("r.*"))


#: Canonical field -> column of the usual result files.
DEFAULT_MAPPING = {"pathway": "Description", "nes": "NES", "padj": "p.adjust", "pval": "pvalue", "size": "setSize", "leading_edge": "core_enrichment"}


def apply_mapping(df: DataFrame, mapping: dict[str, str] | None = None, name: Column | str = "result", collection: str | None = None) -> DataFrame:
    """Canonical rows by an explicit mapping; rows whose pathway, NES or padj cannot be read are dropped.

    Without ``collection`` it is the prefix before ``_`` if all pathways have the same one.
    """
    mapping = mapping or dict(DEFAULT_MAPPING)
    missing = [mapping[k] for k in ("pathway", "nes", "padj") if mapping.get(k) not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    col = lambda k: F.col(f"`{mapping[k]}`").cast("string") if mapping.get(k) in df.columns else F.lit(None).cast("string")
    out = df.select(
        (F.lit(name) if isinstance(name, str) else name).alias("result"), blank_to_null(col("pathway")).alias("pathway"), to_float(col("nes")).alias("nes"), to_float(col("padj")).alias("padj"),
        to_float(col("pval")).alias("pval"), to_int(col("size")).alias("size"), F.coalesce(split_genes(col("leading_edge")), F.array().cast("array<string>")).alias("leading_edge"),
    ).where("pathway is not null and nes is not null and padj is not null")
    if collection is not None:
        return out.withColumn("collection", F.lit(collection))
    prefix = name_prefix(F.col("pathway"))
    one = out.groupBy("result").agg(F.when(F.countDistinct(prefix) == 1, F.max(prefix)).alias("collection"))
    return out.join(one, "result", "left")


def read_results(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Canonical rows of result files, each named by its file's stem."""
    df = read_table(spark, path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)*$", 1)
    return apply_mapping(df.withColumn("__stem", stem), mapping, F.col("__stem"))


def layer_path(root: str, layer: str) -> str:
    """Where a layer lies, by its name's prefix."""
    return f"{root}/pathway/{layer.removeprefix('pathway_')}" if layer.startswith("pathway_") else f"{root}/omics/{layer}"


def write_partitioned(df: DataFrame, path: str, label: str, only_coded: str | None = None) -> None:
    """Parquet with a folder per label; ``only_coded`` leaves out rows without a code."""
    rows = df.where(F.col(only_coded).isNotNull()) if only_coded else df
    rows.withColumn(f"{label}_slug", slug(F.col(label))).write.mode("overwrite").partitionBy(f"{label}_slug").parquet(path)


def write_text(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """S18."""
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def write_ranked_lists(df: DataFrame, path: str, panel: list[str], feature: str, stat: str) -> None:
    """Headerless tab-separated lists, a folder per panel."""
    key = F.concat_ws("__", *(file_safe(F.col(p).cast("string")) for p in panel))
    df.select(key.alias("panel"), F.concat_ws("\t", F.col(feature).cast("string"), F.col(stat).cast("string")).alias("value")).write.mode("overwrite").partitionBy("panel").text(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, path: str, key: str, document: str) -> None:
    """One compact JSON document per key, in a folder per key, and a sorted index of the keys.

    ``document_sink`` writes a file per key and publishes all of them in one commit, where driver and executors share the folder.
    """
    text = df.select(F.col(key).cast("string").alias("key"), F.to_json(document, {"ignoreNullFields": "false"}).alias("value"))
    text.write.mode("overwrite").partitionBy("key").text(f"{path}/documents")
    text.select("key").orderBy("key").write.mode("overwrite").json(f"{path}/index")


def write_vectors(df: DataFrame, path: str) -> None:
    """A vector bundle as Parquet with array columns."""
    df.write.mode("overwrite").parquet(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small report table; the metric rows are few by then."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
