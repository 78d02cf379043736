"""Row-for-row comparison of a Spark result with DuckDB's."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return v
    if hasattr(v, "as_tuple"):
        return int(v) if v == int(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((x is None, str(type(x)) if not isinstance(x, (int, float)) else "n", x if isinstance(x, (int, float)) else str(x)) for x in r)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def compare(df, con, sql):
    """None if equal, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}: {got[1][:2]} vs {want[1][:2]}"
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            if x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9)):
                return f"{got[0]}: {a} vs {b}"
    return None
