"""Runs a registered query on Spark and its SQL on DuckDB and compares rows as multisets."""
from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return f"{v:.6f}"
    return v


def compare(spark, con, query, sql, sf_dir: str) -> str | None:
    """None when equal, otherwise a short description of the difference."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    index = [names.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in index) for r in res.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}; first got {got[:2]} want {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ, e.g. {cols}: {bad[0]}"
    return None if got else "EMPTY"
