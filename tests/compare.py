"""Compare a query with its SQL equivalent, row for row, regardless of order."""

from __future__ import annotations

import math

import duckdb

from folioflow.plans.views import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def type_name(v) -> str:
    return "none" if v is None else type(v).__name__


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """An empty text when both sides agree, else what differs."""
    res = con.execute(sql)
    want_cols = [c[0] for c in res.description]
    want_raw = res.fetchall()
    got_raw = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    got, want = rows_of(df.columns, got_raw), rows_of(want_cols, want_raw)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. only here {list(set(got) - set(want))[:2]} only there {list(set(want) - set(got))[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{sum(a != b for a, b in zip(got, want))} rows differ, e.g. {g} != {w}"[:900]
    if got_raw:
        gt = {c: {type_name(r[i]) for r in got_raw} - {"none"} for i, c in enumerate(df.columns)}
        wt = {c: {type_name(r[i]) for r in want_raw} - {"none"} for i, c in enumerate(want_cols)}
        bad = {c: (gt[c], wt[c]) for c in gt if gt[c] != wt[c]}
        if bad:
            return f"types {bad}"
    return ""
