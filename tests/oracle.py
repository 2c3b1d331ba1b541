"""Run a registered query and its DuckDB text and compare the two results."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


LAST_SQL_SECONDS = [0.0]


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        if name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, float):
        return value
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def _key(row):
    return tuple(
        (v is None, type(v).__name__ in ("int", "float"), round(v, 4) if isinstance(v, (int, float)) else str(v))
        for v in row
    )


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=_key)


def _near(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(df, con, sql) -> tuple[str, int]:
    """('exact' | 'near' | description of the difference, row count)."""
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    started = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    LAST_SQL_SECONDS[0] = time.time() - started
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(set(got_cols) ^ set(want_cols))}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    names = sorted(got_cols)
    status = "exact"
    for g, w in zip(got, want):
        for name, a, b in zip(names, g, w):
            if a != b or (type(a) is not type(b) and not (a is None or b is None)):
                if not _near(a, b):
                    return f"{name}: {a!r} vs {b!r} in {g} vs {w}", len(got)
                status = "near"
                if type(a) is not type(b):
                    status = f"near ({name}: {type(a).__name__} vs {type(b).__name__})"
    return status, len(got)
