"""Holds queries against their SQL: rows as sorted tuples, columns by name."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        v = float(v)
        return None if math.isnan(v) else v + 0.0
    return str(v)


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    got_names = df.columns
    got = rows([tuple(r) for r in df.collect()], got_names)
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows(cur.fetchall(), want_names)
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} / {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} / {len(want)} rows; {got[:1]} / {want[:1]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else ""
