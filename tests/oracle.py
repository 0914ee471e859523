"""Run a registered query and its SQL twin on the same tables and compare values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _kind(s: pd.Series) -> str:
    if s.dtype == object or str(s.dtype) in ("str", "string"):
        vals = [v for v in s if v is not None and v == v]
        if vals and all(isinstance(v, bool) for v in vals):
            return "bool"
        return "text"
    if s.dtype.kind == "b":
        return "bool"
    return "number"


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for row in df[cols].itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA or v is pd.NaT:
                cells.append(None)
            elif isinstance(v, (bool,)) or type(v).__name__ == "bool_":
                cells.append(bool(v))
            elif isinstance(v, (int, float)) or hasattr(v, "dtype"):
                cells.append(float(v))
            else:
                cells.append(v if isinstance(v, str) else str(v))
        out.append(tuple(cells))
    return sorted(out, key=_order)


def _order(row: tuple) -> tuple:
    exact = tuple((c is None, str(type(c)), c if c is not None else 0) for c in row if not isinstance(c, float) or (math.isfinite(c) and c == int(c)))
    return (len(exact), exact, tuple(round(c, 3) for c in row if isinstance(c, float)), row)


def _same(x: tuple, y: tuple) -> bool:
    return all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-11) if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(x, y))


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    got = spark_df.toPandas()
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if len(got) == 0:
        return "no rows"
    for c in got.columns:
        if _kind(got[c]) != _kind(want[c]) and got[c].notna().any() and want[c].notna().any():
            return f"type of {c}: {got[c].dtype} / {want[c].dtype}"
    a, b = _rows(got), _rows(want)
    bad = [(x, y) for x, y in zip(a, b) if not _same(x, y)]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ ({sorted(got.columns)}): {bad[0][0]} != {bad[0][1]}"
    return None
