"""Row-by-row comparison of a query with its oracle (used by tests and by hand)."""

from __future__ import annotations

import glob
import math
import os


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def differences(df, con, sql: str) -> str:
    """Empty text when both sides hold the same rows, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_cols, want = _rows(names, cursor.fetchall())
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, oracle has {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = [(c, {type(r[i]).__name__ for r in got} ^ {type(r[i]).__name__ for r in want})
             for i, c in enumerate(got_cols)]
    types = [t for t in types if t[1]]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; first {bad[0]}"
    return f"types differ {types}" if types else ""
