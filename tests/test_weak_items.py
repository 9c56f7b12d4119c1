"""Spreadsheets, filled layers, the service's answer, the layer driver, and plain versions of nested cross-validation."""

from __future__ import annotations

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import models as M
from heddle.operators import omics as O
from heddle.operators import pooled as P
from heddle.operators import vectors as V
from heddle.sources import tables as S
from tests.test_pooled import descent


def workbook(path, sheets, shared=True):
    """A small file as spreadsheet programs write it; sheets are name -> rows of values."""
    ns, strings = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', []

    def cell(k, r, v):
        ref = f"{chr(65 + k) if k < 26 else 'A' + chr(65 + k - 26)}{r}"
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, str):
            if not shared:
                return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
            strings.append(v)
            return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            lines = "".join(f'<row r="{r}">{"".join(cell(c, r, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{lines}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>")


@pytest.mark.parametrize("shared", [True, False])
def test_workbooks(spark, tmp_path, shared):
    wide = [f"c{k}" for k in range(30)]
    workbook(tmp_path / "a.xlsx", {"first": [["id", "name", "x`y"], [1, "Zoë &amp; co", 1.5], [], [2, None, True], [3, "last"]], "other": [wide, list(range(30))]}, shared)
    got = S.read_table(spark, f"{tmp_path}/a.xlsx")
    assert got.columns == ["id", "name", "x`y"] and [tuple(r) for r in got.collect()] == [("1", "Zoë & co", "1.5"), ("2", None, "TRUE"), ("3", "last", None)]
    named = S.read_table(spark, f"{tmp_path}/a.xlsx", sheet="other")
    assert named.columns == wide and named.first()["c29"] == "29"
    with pytest.raises(Exception, match="no sheet"):
        S.read_table(spark, f"{tmp_path}/a.xlsx", sheet="third")
    workbook(tmp_path / "b.xlsx", {"first": [["name", "id"], ["more", 4]]}, shared)
    assert {tuple(r) for r in S.read_table(spark, f"{tmp_path}/*.xlsx").select("id", "name").collect()} == {("1", "Zoë & co"), ("2", None), ("3", "last"), ("4", "more")}


def test_pasted_header_with_a_quoted_separator(spark):
    got = S.parse_text_table(spark, 'Description,NES,p.adjust,"note, long"\nA,1.5,0.1,x\n').collect()
    assert [(r.description, r.nes, r.padj) for r in got] == [("A", 1.5, 0.1)]


def plain_fill(rows, layer, by, binary):
    out = {}
    for unit in {r[by] for r in rows}:
        own = [r["cell"] for r in rows if r[by] == unit]
        width = max(len(v) for v in layer.values() if v is not None)
        there = [c for c in own if layer.get(c) is not None and any(x is not None for x in layer[c])]
        mean = [np.mean([layer[c][k] for c in there if layer[c][k] is not None] or [0.0]) for k in range(width)]
        for c in set(own):
            v = layer[c] if c in there else [None] * width
            out[unit, c] = [x if x is not None else 0.0 if binary else mean[k] for k, x in enumerate(v)] + [float(c not in there)]
    return out


@pytest.mark.parametrize("binary", [False, True])
def test_layers_are_filled_by_rows(spark, binary):
    """Cells count as often as they have rows; single gaps are filled as well, in each unit on its own."""
    layer = {"a": [1.0, None, 4.0], "b": [3.0, 8.0, None], "c": None, "d": [None, None, None], "e": [7.0, 1.0, 1.0]}
    rows = [{"unit": u, "cell": c, "k": k} for u, cells in (("u", "aaabcd"), ("v", "bee"), ("w", "c")) for k, c in enumerate(cells)]
    df = spark.createDataFrame([(r["unit"], r["cell"], r["k"]) for r in rows], "unit string, cell string, k int")
    vectors = spark.createDataFrame([(c, v) for c, v in layer.items() if v is not None], "cell string, meth array<double>")
    want = plain_fill(rows, layer, "unit", binary)
    got = P.attach_vectors(df, vectors, "cell", "meth", binary, ["unit"]).collect()
    assert len(got) == len(rows) and all(np.allclose(r["meth"], want[r["unit"], r["cell"]]) for r in got)
    one = plain_fill([r | {"all": 0} for r in rows], layer, "all", binary)
    assert all(np.allclose(r["meth"], one[0, r["cell"]]) for r in P.attach_vectors(df, vectors, "cell", "meth", binary).collect())


def test_answers_of_the_service(spark):
    rng = np.random.default_rng(1)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    names = {f"P{k}": unit(rng.normal(size=6)) for k in range(8)}
    atlas = spark.createDataFrame([(f"d{k}", "AB"[k % 2], unit(rng.normal(size=6))) for k in range(12)], "drug_uid string, disease string, vector array<double>")
    cache = spark.createDataFrame(list(names.items()), "name string, vector array<double>")
    search = V.SignatureSearch(atlas)
    table = spark.createDataFrame([("P0", 2.0, 0.01), ("P1", 1.5, 0.1), ("P2", -2.0, 0.01), ("unknown", 3.0, 0.01)], "description string, nes double, padj double")
    head, matches = search.request(table, cache, 5, "A")
    got = matches.collect()
    assert head["engine"] == "real" and head["n_input_pathways"] == 4 and head["note"] == "" and head["warnings"] == ["suppressed: few pathways"]
    q = np.array(names["P0"]) * 2 + np.array(names["P1"]) * 1.5
    q /= np.linalg.norm(q)
    best = {r["drug_uid"]: r["cosine"] for r in got}
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and {r["disease"] for r in got} == {"A"}
    for r in atlas.collect():
        assert r["drug_uid"] not in best or abs(best[r["drug_uid"]] - float(np.dot(q, r["vector"]))) < 1e-9
    assert "not in the atlas" in search.request(table, cache, 3, "C")[0]["note"]
    for bad, k in ((table.limit(1), 5), (table, 0), (table, 201)):
        with pytest.raises(ValueError, match="at least 2|top_k"):
            search.request(bad, cache, k)
    # nothing passes the cut-offs: all rows with padj <= 1 count
    weak = spark.createDataFrame([("P0", 0.5, 0.9), ("P1", 0.2, None)], "description string, nes double, padj double")
    assert search.request(weak, cache, 3)[1].count() == 3


def test_layer_driver(spark, tmp_path):
    samples = spark.createDataFrame([(1, "X/Y"), (2, "X/Y"), (3, "Z")], "cell long, disease string")
    wide = spark.createDataFrame([(1, "0.5", "x"), (3, "2", "1"), (9, "1", "1")], "key long, a string, b string")
    layers = O.clean({"rppa": {"df": wide, "key": "key", "columns": ["a", "b"]}, "mutations": {"df": spark.createDataFrame([(1, "G", True), (2, "G", False)], "cell long, gene string, hot boolean"), "cell": "cell", "gene": "gene", "flags": ["hot"], "genes": ["G"]}})
    assert list(layers) == ["mutations", "rppa"] and [O.kind_of(v) for v in layers.values()] == ["binary", "continuous"]
    coverage, summary = O.build(layers, samples, str(tmp_path))
    assert {r["disease"]: (r["n_cells"], r["mutations"], r["rppa"]) for r in coverage.collect()} == {"X/Y": (2, 2, 1), "Z": (1, 0, 1)}
    assert {r["layer"]: (r["n_features"], r["n_cells_total"], r["n_cells_in_universe"], r["kind"]) for r in summary.collect()} == {"mutations": (1, 2, 2, "binary"), "rppa": (2, 3, 2, "continuous")}
    assert spark.read.parquet(f"{tmp_path}/by_disease/rppa").where("disease_slug = 'X_Y'").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/coverage").count() == 2
    with pytest.raises(KeyError, match="unknown layers"):
        O.clean({"other": {}})


def data(n=36, p=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    return x, x[:, 0] + 0.3 * rng.normal(size=n), np.array([f"c{k // 2:02d}" for k in range(n)])


def plain_cv(x, y, g, grid, fit, outer, inner, seed, flat):
    """Nested (or flat) cross-validation by loops."""
    fold, out = M.deal(g, outer, seed), np.zeros(len(y))

    def best(tr):
        part = M.deal(g[tr], inner, seed)
        loss = [sum(((fit(x[tr][part != f], y[tr][part != f], p)(x[tr][part == f]) - y[tr][part == f]) ** 2).sum() for f in np.unique(part)) for p in grid]
        return grid[int(np.argmin(loss))]

    every = np.ones(len(y), bool)
    for f in np.unique(fold):
        tr = fold != f
        out[~tr] = fit(x[tr], y[tr], best(every if flat else tr))(x[~tr])
    return out


@pytest.mark.parametrize("flat", [False, True])
def test_nested_cv_equals_loops(spark, flat):
    x, y, g = data()
    df = spark.createDataFrame([("p", f"r{k:02d}", c, float(t), v.tolist()) for k, (c, t, v) in enumerate(zip(g, y, x, strict=True))], "panel string, row string, cell string, y double, x array<double>")
    got = {r["id"]: r["y_pred"] for r in M.nested_cv(df, ["panel"], "cell", "y", "x", "enet", 3, 2, flat=flat, ident="row").collect()}
    want = plain_cv(x, y, g, M.MODELS["enet"][1], lambda a, b, p: descent(a, b, p["alpha"], p["l1"]), 3, 2, 0, flat)
    assert all(abs(got[f"r{k:02d}"] - v) < 1e-4 for k, v in enumerate(want))


def test_signature_model_equals_its_definition():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (30, 12)).astype(float), rng.normal(size=30)
    x[:, 5] = 1.0

    def ranked(v):
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    rho = np.array([np.corrcoef(ranked(c), ranked(-y))[0, 1] if c.std() else 0.0 for c in x.T])
    top = sorted(range(12), key=lambda k: (-abs(rho[k]), k))[:4]
    score = ((x[:, top] - x[:, top].mean(0)) / x[:, top].std(0)) @ rho[top]
    line = np.polyfit(score, y, 1)
    assert np.allclose(M.signature_model(x, y, 4)(x), np.polyval(line, score))


def test_components_equal_the_decomposition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(15, 40)) * rng.uniform(0.1, 5, 40)
    df = spark.createDataFrame([("p", f"c{k:02d}", v.tolist()) for k, v in enumerate(x)], "panel string, cell string, x array<double>")
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    for r in M.pca(df, ["panel"], "cell", "x", 4).collect():
        k, c = int(r["cell"][1:]), r["component"]
        assert abs(abs(r["score"]) - abs(u[k, c] * s[c])) < 1e-9 and abs(r["explained"] - s[c] ** 2 / (s**2).sum()) < 1e-12


def test_optimism(spark):
    x, y, g = data(40, 6, 2)
    df = spark.createDataFrame([("p", f"r{k:02d}", c, float(t), v.tolist()) for k, (c, t, v) in enumerate(zip(g, y, x, strict=True))], "panel string, row string, cell string, y double, x array<double>")
    r = M.optimism(df, ["panel"], "cell", "y", "x", "enet", 3, 2, ident="row").collect()[0]
    for kind, flat in (("flat", True), ("nested", False)):
        p = plain_cv(x, y, g, M.MODELS["enet"][1], lambda a, b, p: descent(a, b, p["alpha"], p["l1"]), 3, 2, 0, flat)
        assert abs(r[f"{kind}_rmse"] - np.sqrt(((y - p) ** 2).mean())) < 1e-4
    assert abs(r["optimism_rmse"] - (r["nested_rmse"] - r["flat_rmse"])) < 1e-12


def test_best_match_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(lab, f"{lab}{k}", (v / np.linalg.norm(v)).tolist()) for lab, n in (("a", 7), ("b", 3), ("c", 1)) for k in range(n) for v in [rng.normal(size=5)]]
    df = spark.createDataFrame(rows, "label string, id string, v array<double>")
    sets = {lab: np.array([r[2] for r in rows if r[0] == lab]) for lab in "abc"}
    for block in (2, 100):
        got = {(r["a"], r["b"]): r["similarity"] for r in V.best_match_all(df, "label", "id", "v", block).collect()}
        for (a, b), value in got.items():
            s = np.clip(sets[a] @ sets[b].T, -1, 1)
            assert abs(value - (s.max(1).mean() + s.max(0).mean()) / 2) < 1e-12
        assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}


def test_encoder_runs_for_unknown_names_alone(spark, tmp_path):
    from heddle.operators import workloads as L

    folder = str(tmp_path)

    def encoder():
        import os
        import uuid

        def encode(names):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write("\n".join(names))
            return np.array([[float(len(n)), 1.0] for n in names])

        return encode

    cache = spark.createDataFrame([("a", [9.0, 9.0])], "name string, v array<double>")
    names = spark.createDataFrame([("a",), ("bb",), ("bb",), (None,), (" ",), ("ccc",)], "name string")
    out, fresh = L.embed(names, cache, "name", "v", encoder)
    assert sorted((str(r["name"]), r["v"]) for r in out.collect()) == [(" ", None), ("None", None), ("a", [9.0, 9.0]), ("bb", [2.0, 1.0]), ("bb", [2.0, 1.0]), ("ccc", [3.0, 1.0])]
    asked = sorted(n for p in tmp_path.iterdir() for n in p.read_text().split("\n"))
    assert asked == ["bb", "ccc"]
    known = cache.unionByName(fresh)
    assert L.embed(names, known, "name", "v", encoder)[1].count() == 0 and len(list(tmp_path.iterdir())) == len({p.name for p in tmp_path.iterdir()})
    assert sorted(n for p in tmp_path.iterdir() for n in p.read_text().split("\n")) == asked


def test_quota_is_off(spark):
    V.quota()
    with pytest.raises(NotImplementedError):
        V.quota(True)
