"""Runs queries in Spark and their SQL in DuckDB and compares rows whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(f"{sf}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    return repr(int(v)) if isinstance(v, int) else str(v)


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    got = df.toArrow()
    done = con.execute(sql)
    heads = [d[0] for d in done.description]
    if sorted(got.column_names) != sorted(heads):
        return f"columns {sorted(got.column_names)} and {sorted(heads)}"
    names = sorted(heads)
    order = [heads.index(n) for n in names]
    a = sorted(zip(*([plain(v) for v in got[n].to_pylist()] for n in names), strict=True))
    b = sorted(tuple(plain(r[i]) for i in order) for r in done.fetchall())
    if a == b:
        return ""
    only = [x for x in zip(a, b) if x[0] != x[1]][:2]
    return f"{len(a)} and {len(b)} rows, {sum(x != y for x, y in zip(a, b))} differ; {names}: {only}"
