"""The analogue of the two screens on the supplied star schema, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.harmonize import add_metric
from heddle.session import ship_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_path(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per measurement; ``ord`` is a unique order.  Cells come last, so that rows of a cell meet, and groups by cell need no shuffle."""
    t = lambda n: table(spark, sf_dir, n)
    return (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.when(F.col("l_linestatus") == "O", "A").otherwise("B").alias("cohort"), F.col("o_custkey").alias("cell"), F.col("c_name").alias("cell_name"), F.col("p_brand").alias("drug"), F.col("p_name").alias("drug_name"),
            F.col("p_type").alias("target"), F.col("c_mktsegment").alias("disease"), F.col("l_extendedprice").alias("auc"), F.col("l_quantity").alias("qty"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
        )
    )


RAW = """raw AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'B' END cohort, o_custkey cell, c_name cell_name, p_brand drug, p_name drug_name, p_type target, c_mktsegment disease,
  l_extendedprice auc, l_quantity qty, lpad(l_orderkey::varchar, 12, '0') || '|' || lpad(l_linenumber::varchar, 12, '0') || '|' || lpad(l_partkey::varchar, 12, '0') || '|' || lpad(l_suppkey::varchar, 12, '0') ord
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir).groupBy("cohort", "cell", "drug", "disease").agg(F.avg("auc").alias("auc"))


RESPONSE = RAW + ", response AS (SELECT cohort, cell, drug, disease, avg(auc) auc FROM raw GROUP BY ALL)"


def metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_metric(response(spark, sf_dir))


AVG_RANK = "(rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0)"
METRIC = (
    RESPONSE
    + """, metric AS (SELECT *, CASE WHEN count(auc) OVER g >= 5 AND stddev_samp(auc) OVER g > 0 THEN (auc - avg(auc) OVER g) / stddev_samp(auc) OVER g END sens_z,
  CASE WHEN count(auc) OVER g >= 5 THEN """
    + AVG_RANK.format(p="cohort, drug", v="auc")
    + """ / count(auc) OVER g END sens_rank FROM response WINDOW g AS (PARTITION BY cohort, drug))"""
)


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, gene, value) from the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.posexplode("embedding").alias("gene", "value")).withColumn("value", F.col("value").cast("double"))


EXPRESSION = "expression AS (SELECT vec_id cell, g - 1 AS gene, embedding[g]::double AS value FROM embeddings, range(1, 65) r(g))"


def panel_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(disease, drug, cell, y): mean z per cell over cohorts, for cells with expression."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"))
    return metric(spark, sf_dir).join(cells, "cell", "left_semi").groupBy("disease", "drug", "cell").agg(F.avg("sens_z").alias("y"))


PANEL_MEANS = METRIC + ", panel AS (SELECT disease, drug, cell, avg(sens_z) y FROM metric WHERE cell IN (SELECT vec_id FROM embeddings) GROUP BY ALL)"


def with_sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body
