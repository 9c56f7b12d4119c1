"""What outlives a run: the document sink, the sync, the lookup cache and the streams' keyed state."""

from __future__ import annotations

import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import resolver as R
from heddle.sources import document_sink as D
from heddle.sources import sync as Y
from heddle.streaming import state as T


def test_documents_become_visible_at_once(spark, tmp_path):
    path = f"{tmp_path}/docs"
    keys = ["ACH-1", "b/c", "ü key", "x" * 300, "", "b_c"] + [f"k{n:03d}" for n in range(40)]
    rows = [(k, {"v": float("nan") if n % 5 == 0 else n / 2, "list": [1.0, float("inf")], "none": None}) for n, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "key string, doc struct<v double, list array<double>, none string>").repartition(5)
    D.write(df, path, "key", "doc")
    version = Path(path) / "versions" / (Path(path) / "CURRENT").read_text()
    index = [json.loads(line) for line in (version / "index.jsonl").read_text().splitlines()]
    assert [r["key"] for r in index] == sorted(keys) and len({r["file"] for r in index}) == len(keys)
    for n, k in enumerate(keys):
        text = (version / next(r["file"] for r in index if r["key"] == k)).read_text()
        assert " " not in text and json.loads(text) == {"v": None if n % 5 == 0 else n / 2, "list": [1.0, None], "none": None}
    assert {r["key"] for r in D.read(spark, path).collect()} == set(keys) and not list((Path(path) / "_pending").iterdir())
    # a task that fails leaves the old version, whole
    with pytest.raises(Exception, match="key"):
        D.write(df.withColumn("key", F.when(F.col("key") != "k007", F.col("key"))), path, "key", "doc")
    assert (Path(path) / "CURRENT").read_text() == version.name and len(D.read(spark, path).collect()) == len(keys) and not list((Path(path) / "_pending").iterdir())
    with pytest.raises(Exception, match="two documents"):
        D.write(df.union(df.limit(1)), path, "key", "doc")
    assert (Path(path) / "CURRENT").read_text() == version.name
    D.write(df.limit(3), path, "key", "doc")
    assert D.read(spark, path).count() == 3 and len(list((Path(path) / "versions").iterdir())) == 1


def test_attempts_outside_the_commit_vanish(tmp_path):
    writer = D.Writer(str(tmp_path))
    for name in ("part-00000-1", "part-00000-2"):
        (writer.pending / name).mkdir(parents=True)
        (writer.pending / name / "a.json").write_text("{}")
        (writer.pending / name / "_keys.jsonl").write_text('"a"\n')
    writer.commit([D.Part("part-00000-2", 1), None])
    version = tmp_path / "versions" / writer.job
    assert [p.name for p in version.iterdir() if p.is_dir()] == ["part-00000-2"] and json.loads((version / "index.jsonl").read_text())["file"] == "part-00000-2/a.json"


def test_sync_copies_what_changed(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "deep" / "er").mkdir(parents=True)
    for n in range(5):
        (source / "deep" / f"{n} file.bin").write_bytes(bytes([n]) * (n * 1000))
    (source / "deep" / "er" / "x.txt").write_text("x")
    assert Y.sync(spark, str(source), str(target)) == 6
    stamps = {p: p.stat().st_mtime_ns for p in target.rglob("*") if p.is_file()}
    assert Y.sync(spark, str(source), str(target)) == 0 and {p: p.stat().st_mtime_ns for p in target.rglob("*") if p.is_file()} == stamps
    (source / "deep" / "2 file.bin").write_bytes(b"new")
    (source / "new.txt").write_text("n")
    # a run that broke off before its manifest: its files are there, and the next run still counts them as open
    (target / "new.txt").write_text("half")
    assert Y.sync(spark, str(source), str(target)) == 2
    same = lambda: {str(p.relative_to(source)): p.read_bytes() for p in source.rglob("*") if p.is_file()} == {str(p.relative_to(target)): p.read_bytes() for p in target.rglob("*") if p.is_file() and "_manifest" not in str(p)}
    assert same() and Y.sync(spark, str(source), str(target)) == 0


def test_names_are_asked_once_and_slowly(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def lookup(name):
        import os
        import time
        import uuid

        with open(os.path.join(str(log), uuid.uuid4().hex), "w") as f:
            f.write(f"{time.time()} {name}")
        return f"KEY-{name}" if "x" in name else None

    resolver = R.Resolver(spark, f"{tmp_path}/cache", lookup, rate=40.0, slots=2)
    df = spark.createDataFrame([(1, ["a", "x1", "x2"]), (2, ["b", " a "]), (3, ["x1"]), (4, []), (5, None), (6, ["", None, "x3"])], "id int, names array<string>")
    asked = lambda: sorted(p.read_text().split(" ", 1) for p in log.iterdir())
    got = {r["id"]: r["key"] for r in resolver.resolve(df, "id", "names", "key").collect()}
    assert got == {1: "KEY-x1", 2: None, 3: "KEY-x1", 4: None, 5: None, 6: "KEY-x3"}
    names = [n for _, n in asked()]
    assert sorted(names) == ["a", "b", "x1", "x3"]  # x2 was never needed
    again = R.Resolver(spark, f"{tmp_path}/cache", lookup, rate=40.0, slots=2)
    assert {r["id"]: r["key"] for r in again.resolve(df, "id", "names", "key").collect()} == got and len(asked()) == 4
    assert again.learn(spark.createDataFrame([(f"n{k}",) for k in range(24)], "name string")) == 24
    times = sorted(float(t) for t, n in asked() if n.startswith("n"))
    assert all(b - a > 0.95 * 23 / 40.0 / 2 - 1e-3 for a, b in [(times[0], times[-1])])
    for k in range(len(times)):  # in any second no more than the rate, and a token for each slot
        assert sum(times[k] <= t < times[k] + 0.25 for t in times) <= 0.25 * 40 + 2
    with pytest.raises(ValueError, match="rate"):
        R.Resolver(spark, f"{tmp_path}/cache", lookup, rate=0)


def test_bucket_keeps_its_rate():
    now = [0.0]
    bucket = R.Bucket(4.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    spent = []
    for k in range(20):
        bucket.take()
        spent.append(now[0])
        now[0] += 0.1 if k % 3 else 0.7
    assert spent[0] == 0.25 and all(sum(t <= u < t + 1 for u in spent) <= 5 for t in spent)


def test_keyed_state_equals_the_batch(spark, tmp_path):
    from heddle.operators.harmonize import add_metric

    rng = np.random.default_rng(2)
    rows = [(c, d, f"c{k}", float(np.round(rng.normal(), 2))) for c in "AB" for d in ("x", "y", "z") for k in range(12 if d != "z" else 3) for _ in range(int(rng.integers(1, 4)))]
    rows += [("A", "x", "c0", None), ("A", "x", None, 1.0)]
    order = rng.permutation(len(rows))
    kind = "cohort string, drug string, cell string, value double"
    folder, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        for part in np.array_split(order, 3):  # each batch is a query of its own, that starts from the checkpoint
            spark.createDataFrame([rows[k] for k in part], kind).write.mode("append").parquet(folder)
            stream = T.sensitivities(spark.readStream.schema(kind).parquet(folder))
            T.run_available(stream, out, mark).awaitTermination()
        got = {(r["cohort"], r["drug"], r["cell"]): (r["value"], r["sens_z"], r["sens_rank"]) for r in T.latest(spark, out).collect()}
        batch = spark.createDataFrame(rows, kind).where("cell is not null and value is not null").groupBy("cohort", "drug", "cell").agg(F.avg("value").alias("auc"))
        want = {(r["cohort"], r["drug"], r["cell"]): (r["auc"], r["sens_z"], r["sens_rank"]) for r in add_metric(batch).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            for a, b in zip(got[k], v, strict=True):
                assert (b is None and (a is None or math.isnan(a))) or abs(a - b) < 1e-9
        T.run_available(T.sensitivities(spark.readStream.schema(kind).parquet(folder)), out, mark).awaitTermination()
        assert {(r["cohort"], r["drug"], r["cell"]): (r["value"], r["sens_z"], r["sens_rank"]) for r in T.latest(spark, out).collect()}.keys() == got.keys()
    finally:
        if provider is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
