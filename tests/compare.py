"""Hold queries against their SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def normal(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark, sf_dir: str, f, sql: str) -> str:
    """What differs, or nothing."""
    df = f(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = database(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = normal(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    here, there = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} and {len(want)} rows; {len(here)} and {len(there)} differ: {sorted(here)[:2]} {sorted(there)[:2]}"
