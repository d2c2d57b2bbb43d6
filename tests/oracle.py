"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import math
import os
import pathlib

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf: str = SF):
    con = duckdb.connect()
    for path in sorted(pathlib.Path(sf).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (int(value) if value == int(value) and abs(value) < 1e15 else value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def duck_rows(con, sql):
    result = con.sql(sql)
    return sorted(result.columns), rows_of(result.columns, result.fetchall())


# Spark type names and the DuckDB types they must meet.
TYPES = {
    "tinyint": "TINYINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def type_clashes(df, con, sql):
    duck = dict(zip(*(lambda r: (r.columns, [str(t) for t in r.types]))(con.sql(sql))))
    return {name: (kind, duck.get(name)) for name, kind in df.dtypes if TYPES.get(kind) != duck.get(name)}
