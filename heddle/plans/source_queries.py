"""Round trips: a given table written by each sink and read by its reader again; the rows must be the table's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.plans.fixture import table
from heddle.plans.registry import register
from heddle.session import shared_folder
from heddle.sources import document_sink as D
from heddle.sources import sync as Y
from heddle.sources import tables as S
from heddle.streaming import incremental as I


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _typed(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like.schema))


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@register("s03_s12_s18_tab_separated", _CUSTOMER)
def tab_separated(spark, sf_dir):
    c, path = _customer(spark, sf_dir), _place(spark) + ".tsv"
    S.write_text(c, path, "\t")
    return _typed(S.read_table(spark, path), c)


@register("s04_s18_comma_separated_subset", "SELECT c_custkey, c_mktsegment FROM customer")
def comma_separated(spark, sf_dir):
    """A column subset is asked for, with a name that the file doesn't have."""
    c, path = _customer(spark, sf_dir), _place(spark) + ".csv"
    S.write_text(c, path)
    return _typed(S.read_columns(spark, path, ["c_custkey"], ["c_mktsegment", "nothing"]), c.select("c_custkey", "c_mktsegment"))


@register("s05_gzip_chosen_columns", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def gzip_columns(spark, sf_dir):
    """Compressed text whose columns are chosen from a table of names."""
    p, path = table(spark, sf_dir, "part"), _place(spark) + ".tsv"
    p.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    wanted = [r["name"] for r in spark.createDataFrame([("p_brand",), ("p_retailprice",)], "name string").collect()]
    return _typed(S.read_columns(spark, path, ["p_partkey"], wanted, 4), p.select("p_partkey", "p_brand", "p_retailprice"))


@register("s07_s08_s16_s17_partitioned", "SELECT c_custkey, c_nationkey, c_mktsegment, regexp_replace(regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS folder FROM customer")
def partitioned(spark, sf_dir):
    """A folder per segment, read with a projection; the schema alone says which columns there are."""
    path = _place(spark) + ".parquet"
    S.write_partitioned(_customer(spark, sf_dir), path, "c_mktsegment")
    there = S.columns_of(spark, path)
    return S.read_columns(spark, path, ["c_custkey", "c_nationkey"], [c for c in there if c.startswith("c_mkt")]).select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_mktsegment_slug").alias("folder"))


@register("l20_coded_only", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey % 3 <> 0")
def coded_only(spark, sf_dir):
    path = _place(spark) + ".parquet"
    coded = _customer(spark, sf_dir).withColumn("code", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey")))
    S.write_partitioned(coded, path, "c_mktsegment", "code")
    return S.read_columns(spark, path, ["c_custkey"], ["c_mktsegment"])


@register("s09_s19_json_records", "SELECT event_id, user_id, event_type, value FROM events")
def json_records(spark, sf_dir):
    e, path = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), _place(spark) + ".json"
    S.write_records(e, path)
    return _typed(S.read_table(spark, path), e)


@register("s10_checkpoints", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_nationkey % 4 <> 0")
def checkpoints(spark, sf_dir):
    """A file per unit of work, of which those that failed and the broken ones are left out."""
    path = _place(spark)
    rows = _customer(spark, sf_dir).groupBy("c_nationkey").agg(F.collect_list(F.struct("c_nationkey", "c_custkey", "c_acctbal")).alias("rows")).withColumn("ok", F.col("c_nationkey") % 4 != 0)
    rows.select(F.to_json(F.struct("ok", "rows")).alias("value"), F.col("c_nationkey").alias("unit")).write.partitionBy("unit").text(path)
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(f"{path}/unit=-1")
    return S.read_checkpoints(spark, f"{path}/*", "ok boolean, rows array<struct<c_nationkey:int,c_custkey:bigint,c_acctbal:double>>")


@register("s11_vector_bundle", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: floor(256 * x::double)))::bigint AS checksum, len(embedding) AS width FROM embeddings")
def vector_bundle(spark, sf_dir):
    path = _place(spark)
    S.write_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    whole = F.aggregate(F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return spark.read.parquet(path).select("vec_id", whole.alias("checksum"), F.size("embedding").cast("long").alias("width"))


@register("s18_ranked_lists", "SELECT replace(p_brand, '/', '-') AS panel, p_name AS feature, round(p_retailprice, 2) AS stat FROM part")
def ranked_lists(spark, sf_dir):
    path = _place(spark)
    S.write_ranked_lists(table(spark, sf_dir, "part").withColumn("stat", F.round("p_retailprice", 2)), path, ["p_brand"], "p_name", "stat")
    parts = F.split("value", "\t")
    return spark.read.text(path).select("panel", parts[0].alias("feature"), parts[1].cast("double").alias("stat"))


@register("s20_documents", "SELECT c_nationkey::varchar AS key, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def documents(spark, sf_dir):
    """A document per nation through the sink, read again from the version that counts."""
    path = _place(spark)
    rows = _customer(spark, sf_dir).groupBy("c_nationkey").agg(F.struct(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.lit(float("nan")).alias("none")).alias("d"))
    D.write(rows, path, "c_nationkey", "d")
    back = D.read(spark, path).select("key", F.from_json("value", "n bigint, total double, none double").alias("d"))
    return back.where("d.none is null").select("key", "d.n", "d.total")


@register("s21_markdown", "SELECT count(*) + 2 AS lines FROM region")
def markdown(spark, sf_dir):
    lines = S.markdown(table(spark, sf_dir, "region")).split("\n")
    return spark.createDataFrame([(len(lines),)], "lines long")


@register("s23_sync", _CUSTOMER + " UNION ALL SELECT -1, 'second run', 0, 0, NULL")
def synced(spark, sf_dir):
    """The table's files brought to another folder; a second run brings nothing."""
    c, source, target = _customer(spark, sf_dir), _place(spark), _place(spark)
    c.write.parquet(f"{source}/customer")
    Y.sync(spark, source, target)
    again = Y.sync(spark, source, target)
    told = spark.createDataFrame([(-1, "second run", again, float(again), None)], c.schema)
    return spark.read.schema(c.schema).parquet(f"{target}/customer").unionByName(told)


@register("l11_layer_path", "SELECT c_custkey, c_acctbal FROM customer")
def layer_by_prefix(spark, sf_dir):
    """A layer is found by its name's prefix."""
    root = _place(spark)
    half = _customer(spark, sf_dir).select("c_custkey", "c_acctbal")
    half.where("c_custkey % 2 = 0").write.parquet(S.layer_path(root, "pathway_balance"))
    half.where("c_custkey % 2 = 1").write.parquet(S.layer_path(root, "balance"))
    return spark.read.parquet(f"{root}/pathway/balance").unionByName(spark.read.parquet(f"{root}/omics/balance"))


@register("s06_stream_entities", "SELECT DISTINCT user_id, event_type FROM events")
def stream_entities(spark, sf_dir):
    """Entities of a folder that is read as a stream, in two runs over one checkpoint."""
    e, root = table(spark, sf_dir, "events"), _place(spark)
    for k in range(2):
        e.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{root}/in")
        I.run_available(I.distinct_entities(spark, f"{root}/in", e.schema, ["user_id", "event_type"], "ts", "60 days"), f"{root}/out", f"{root}/mark").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("user_id", "event_type")
