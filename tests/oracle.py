"""A Spark result against DuckDB's over the same tables."""

from __future__ import annotations

import datetime
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def differences(frame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if columns and the bag of rows agree."""
    columns = sorted(frame.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    have = Counter(tuple(plain(r[c]) for c in columns) for r in frame.select(*columns).collect())
    if want == have:
        return ""
    return f"{sum(have.values())} and {sum(want.values())} rows; only Spark: {list((have - want).items())[:3]}; only DuckDB: {list((want - have).items())[:3]}"
