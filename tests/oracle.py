"""Runs a registered query in Spark and its SQL twin in DuckDB, and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v: object) -> str:
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(int(v)) if v == int(v) else repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def spark_rows(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted("|".join(map(plain, row)) for row in df.select(*columns).collect())


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted("|".join(plain(row[i]) for i in order) for row in cursor.fetchall())
