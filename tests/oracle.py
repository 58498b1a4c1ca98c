"""Run a registered query and its SQL side by side (Spark against DuckDB)."""

from __future__ import annotations

import math
import os
import pathlib

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        return (3, round(v, 6) + 0.0)
    if isinstance(v, int):
        return (3, float(v))
    if isinstance(v, (list, tuple)):
        return (5, str([norm(x) for x in v]))
    return (4, str(v))


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql, sf_dir, tol=1e-6):
    df = query(spark, sf_dir)
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_cols, want = table([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = 0
    first = None
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if a == b:
                continue
            if a[0] == 3 and b[0] == 3 and abs(a[1] - b[1]) <= tol * max(1.0, abs(b[1])):
                continue
            bad += 1
            first = first or (g, w)
            break
    return f"{bad} of {len(got)} rows differ, first {first}" if bad else ""


SF = os.environ.get("WEFTLINE_SF_DIR", "/root/testdata/sf0.01")
