"""Run a query and its SQL twin on the same tables and compare all values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _sorted(rows: list[tuple]) -> list[tuple]:
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    return sorted(clean, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(df.columns)
    got = con.execute(sql)
    place = {c[0]: i for i, c in enumerate(got.description)}
    assert sorted(place) == names
    want = _sorted([tuple(r[place[n]] for n in names) for r in got.fetchall()])
    assert _sorted([tuple(r[n] for n in names) for r in df.collect()]) == want
