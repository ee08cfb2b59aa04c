"""Rows of a query against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "tolist"):
        return tuple(map(normal, value.tolist()))
    return tuple(map(normal, value)) if isinstance(value, (list, tuple)) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in found), key=repr)


def expected(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return sorted(columns), rows(columns, got.fetchall())
