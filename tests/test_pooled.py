"""The pooled elastic net against plain loops, its solver against closed forms, and the design."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from heddle.operators import models as M
from heddle.operators import pooled as P


def descent(x, y, alpha, l1, rounds=3000):
    """Coordinate descent, one weight after another."""
    mean, sd, n = x.mean(0), x.std(0), len(y)
    z, r, w = (x - mean) / np.where(sd > 0, sd, 1), y - y.mean(), np.zeros(x.shape[1])
    for _ in range(rounds):
        old = w.copy()
        for j in range(len(w)):
            rho = z[:, j] @ r / n + (z[:, j] ** 2).mean() * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / ((z[:, j] ** 2).mean() + alpha * (1 - l1)) if sd[j] > 0 else 0.0
            r -= z[:, j] * (new - w[j])
            w[j] = new
        if np.abs(w - old).max() < 1e-11:
            break
    return lambda v: (v - mean) / np.where(sd > 0, sd, 1) @ w + y.mean()


@pytest.mark.parametrize(("n", "p"), [(40, 6), (12, 30)])
def test_elastic_net(n, p):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, p)) * rng.uniform(0.1, 9, p) + 3, rng.normal(size=n)
    x[:, 1] = 5.0
    for alpha, l1 in ((0.01, 0.2), (0.1, 0.5), (1.0, 0.9), (0.3, 0.0)):
        assert np.allclose(M.elastic_net(x, y, alpha, l1)(x), descent(x, y, alpha, l1)(x), atol=2e-5)
    z = (np.delete(x, 1, 1) - np.delete(x, 1, 1).mean(0)) / np.delete(x, 1, 1).std(0)
    ridge = z @ np.linalg.solve(z.T @ z / n + 0.3 * np.eye(p - 1), z.T @ (y - y.mean()) / n) + y.mean()
    assert np.allclose(M.elastic_net(x, y, 0.3, 0.0)(x), ridge, atol=1e-5)


def fold_of(groups, k, seed, *within):
    order = sorted(groups, key=lambda g: (hashlib.md5("|".join(map(str, (seed, *within, g))).encode()).hexdigest(), g))
    return {g: f for f, part in enumerate(np.array_split(np.array(order), k)) for g in part.tolist()}


def brute(rows, target, split, outer, inner, seed, grid):
    """{(unit, cell, drug): (target, prediction)}."""
    out = {}
    fold = fold_of({r[split] for r in rows}, outer, seed, 0)
    for unit in {r["unit"] for r in rows}:
        for f in range(outer):
            mine = [r for r in rows if r["unit"] == unit]
            train, test = [r for r in mine if fold[r[split]] != f], [r for r in mine if fold[r[split]] == f]

            def base(r, train=train):
                for keys in {"raw": [], "drug": [["drug"], []], "disease_drug": [["disease", "drug"], ["drug"], []]}[target]:
                    same = [t["y"] for t in train if all(t[k] == r[k] for k in keys)]
                    if same:
                        return np.mean(same)
                return 0.0

            part = fold_of({r["cell"] for r in train}, inner, seed + 1, unit, 0, f)
            x, y, of = np.array([r["x"] for r in train]), np.array([r["y"] - base(r) for r in train]), np.array([part[r["cell"]] for r in train])
            loss = [sum(((descent(x[of != i], y[of != i], *g)(x[of == i]) - y[of == i]) ** 2).sum() for i in range(inner)) for g in grid]
            model = descent(x, y, *grid[int(np.argmin(loss))])
            for r in test:
                out[unit, r["cell"], r["drug"]] = (r["y"] - base(r), model(np.array([r["x"]]))[0])
    return out


@pytest.mark.parametrize(("target", "split"), [("raw", "cell"), ("drug", "cell"), ("disease_drug", "cell"), ("drug", "drug")])
def test_elastic_net_cv(spark, target, split):
    rng, rows = np.random.default_rng(3), []
    for cell in range(16):
        x = rng.normal(size=3).round(3).tolist()
        for drug in ("a", "b", "c", "d"):
            if rng.random() < 0.9:
                rows.append({"unit": "u" if cell < 9 or drug < "c" else "v", "cell": cell, "drug": drug, "disease": "xy"[cell % 2], "y": round(float(x[0] + ord(drug) % 3 + cell % 2 + rng.normal() * 0.2), 3), "x": x})
    if split == "drug":
        rows = [r | {"unit": "u"} for r in rows]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "unit string, cell long, drug string, disease string, y double, x array<double>")
    alphas, l1s = [0.05, 0.8], (0.2, 0.9)
    got = P.elastic_net_cv(df, ["unit"], "cell", "y", "x", target, "drug", "disease", None if split == "cell" else split, 3, 2, 1, 0, alphas, l1s).collect()
    want = brute(rows, target, split, 3, 2, 0, [(a, l1) for a in alphas for l1 in l1s])
    assert len(got) == len(rows) and all(r.ok for r in got)
    for r in got:
        assert np.allclose((r.y, r.y_pred), want[r.unit, r.cell, r.drug], atol=1e-4)


def test_errors_and_small_units(spark):
    df = spark.createDataFrame([("u", k, "a", 1.0 * k, [1.0 * k]) for k in range(3)] + [("u", 9, "b", None, [1.0]), ("u", 8, "b", 1.0, None)], "unit string, cell long, drug string, y double, x array<double>")
    with pytest.raises(ValueError, match="drug"):
        P.elastic_net_cv(df, ["unit"], "cell", "y", "x", "drug")
    with pytest.raises(ValueError, match="disease"):
        P.elastic_net_cv(df, ["unit"], "cell", "y", "x", "disease_drug", "drug")
    with pytest.raises(KeyError, match="unknown target"):
        P.elastic_net_cv(df, ["unit"], "cell", "y", "x", "tissue", "drug")
    got = P.elastic_net_cv(df, ["unit"], "cell", "y", "x").collect()
    assert len(got) == 3 and not any(r.ok for r in got) and {r.error for r in got} == {"too few groups or rows to tune"}


def test_design(spark):
    rows = spark.createDataFrame([("u", c, d, 0.5) for c in range(5) for d in ("a", "b") if (c, d) != (4, "a")], "unit string, cell long, drug string, y double")
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(c, rng.normal(size=4).tolist()) for c in range(5)], "cell long, v array<double>")
    layer = spark.createDataFrame([(c, [float(c), 2.0]) for c in range(3)], "cell long, meth array<double>")
    got = P.design(rows, vectors, ["unit"], "cell", "drug", "v", 3, omics={"meth": (layer, False)}).collect()
    assert len(got) == 9 and all(len(r.x) == 3 + 2 + 3 and r.n_lines == 5 and r.n_drugs == 2 and r.n_pcs == 3 for r in got)
    for r in got:
        assert r.x[3:5] == ([1.0, 0.0] if r.drug == "a" else [0.0, 1.0])
        assert r.x[5:] == ([float(r.cell), 2.0, 0.0] if r.cell < 3 else [1.0, 2.0, 1.0])
