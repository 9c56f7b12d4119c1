"""Readers, writers and the incremental variants."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from heddle.operators import documents as D
from heddle.sources import tables as S
from heddle.streaming import incremental as I
from tests.conftest import SMALL


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("gene_id\ts1\ts2\nG1\t1\t2\n")
    assert S.read_table(spark, f"{tmp_path}/a.tsv").collect() == S.read_table(spark, f"{tmp_path}/b.csv").collect()
    assert S.read_columns(spark, f"{tmp_path}/c.txt.gz", ["gene_id"], ["s2", "s9"], 2).columns == ["gene_id", "s2"]
    assert S.columns_of(spark, f"{SMALL}/part.parquet")[0] == "p_partkey"


def test_checkpoints(spark, tmp_path):
    rows = [{"disease": "d", "rho": 0.5}, {"disease": "e", "rho": None}]
    (tmp_path / "1.json").write_text(json.dumps({"ok": True, "secs": 1.0, "rows": rows}))
    (tmp_path / "2.json").write_text(json.dumps({"ok": False, "rows": [], "error": "x"}))
    (tmp_path / "3.json").write_text("{broken")
    got = S.read_checkpoints(spark, str(tmp_path), "ok boolean, secs double, rows array<struct<disease:string,rho:double>>, error string")
    assert sorted(tuple(r) for r in got.collect()) == [("d", 0.5), ("e", None)]


def test_text_table(spark):
    tab = "Description\tNES\tp.adjust\tqvalue\nA, b\t1.5\t\t0.2\nB\tInf\t0.1\t\n\t2\t0.1\t\nC\tx\t0\t\nD\t-1\tNA\t\n"
    assert sorted((r.description, r.nes, r.padj) for r in S.parse_text_table(spark, tab).collect()) == [("A, b", 1.5, 0.2), ("D", -1.0, None)]
    assert S.parse_text_table(spark, "pathway,NES\nq,1").count() == 1 and S.parse_text_table(spark, " ").count() == 0


def test_mapping(spark, tmp_path):
    (tmp_path / "run_one.csv").write_text("Description,NES,p.adjust,pvalue,setSize,core_enrichment\nR_A,1.2,0.01,0.001,10,X/Y\nR_B,bad,0.1,,5,\nR_C,2,,,5,Z\n")
    got = S.read_results(spark, f"{tmp_path}/run_one.csv").collect()
    assert [(r.result, r.pathway, r.size, r.leading_edge, r.collection) for r in got] == [("run_one", "R_A", 10, ["X", "Y"], "R")]
    with pytest.raises(ValueError, match="missing columns"):
        S.apply_mapping(spark.range(1), None)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("COAD/READ", "c1", 1.0), ("BRCA", "c2", None)], "disease string, code string, v double")
    S.write_partitioned(df, f"{tmp_path}/p", "disease")
    assert spark.read.parquet(f"{tmp_path}/p").where("disease_slug = 'COAD_READ'").count() == 1
    S.write_text(df, f"{tmp_path}/t", "\t")
    S.write_records(df, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
    S.write_ranked_lists(df, f"{tmp_path}/rnk", ["disease"], "code", "v")
    assert spark.read.text(f"{tmp_path}/rnk").count() == 2
    S.write_documents(df.select("code", F.struct("disease", "v").alias("d")), f"{tmp_path}/d", "code", "d")
    got = {r["key"]: json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/d/documents").collect()}
    assert got == {"c1": {"disease": "COAD/READ", "v": 1.0}, "c2": {"disease": "BRCA", "v": None}}
    assert [r["key"] for r in spark.read.json(f"{tmp_path}/d/index").collect()] == ["c1", "c2"]
    assert S.markdown(df).count("\n") == 3
    assert S.layer_path("r", "pathway_x").endswith("pathway/x") and S.layer_path("r", "rppa").endswith("omics/rppa")


def test_documents_invariants(spark):
    from heddle.plans.fixture import metric, table

    m = metric(spark, SMALL)
    broad = D.broad_spectrum(m, "disease", "drug", "sens_z")
    cells = table(spark, SMALL, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("disease"))
    line = m.groupBy("cell", "drug").agg(F.avg("sens_z").alias("line_sens"), F.lit(None).cast("double").alias("ic50"))
    mech = D.mechanism(broad.select("disease", "drug", F.lit(0.005).alias("perm_p"), F.col("disease_sens").alias("perm_z"), F.lit(0.1).alias("rho")), "disease", "drug", top=5)
    docs = [r.document for r in D.documents(cells, broad, mech, "cell", "name", "disease", "drug", line).collect()]
    assert len(docs) == cells.count()
    by_disease = {}
    for d in docs:
        sens = [x.disease_sens for x in d.broad_spectrum]
        assert sens == sorted(sens) and len(sens) <= 15 and len(d.mechanism) <= 5
        z = [x.perm_z for x in d.mechanism]
        assert z == sorted(z, reverse=True)
        arm = [(x.drug, x.disease_sens, x.n_lines) for x in d.broad_spectrum]
        assert by_disease.setdefault(d.disease, arm) == arm


def test_streams(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = f"{tmp_path}/in"
    source.where("event_id % 2 = 0").write.parquet(folder)
    stream = I.distinct_entities(spark, folder, source.schema, ["user_id", "event_type"], "ts", "60 days")
    I.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    source.where("event_id % 2 = 1").write.mode("append").parquet(folder)
    I.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").select("user_id", "event_type").count() == source.select("user_id", "event_type").distinct().count()
    counts = I.windowed_counts(spark, folder, source.schema, "ts", ["event_type"])
    assert counts.isStreaming and counts.columns == ["start", "event_type", "n"]


def test_unfinished(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a", True), ("b", False)], "k string, ok boolean")
    assert [r.k for r in I.unfinished(tasks, done, ["k"]).collect()] == ["c"]
    assert sorted(r.k for r in I.unfinished(tasks, done, ["k"], retry_failed=True).collect()) == ["b", "c"]
