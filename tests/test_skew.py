"""All queries once more on tables in which one key holds a third of the rows."""

import pathlib

import duckdb
import pytest
from oracle import connect, duck_rows, spark_rows

from parley.catalog import ORACLES, QUERIES

BASE = pathlib.Path("/root/testdata/sf0.001")

# Rows added to the small tables: half as many again, all under one key.
ADDED = {
    "conversations": """SELECT 900000 AS conv_id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS turn,
        CASE WHEN row_number() OVER (ORDER BY conv_id, turn) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, text
      FROM base LIMIT {half}""",
    "documents": """SELECT 900000 + row_number() OVER (ORDER BY base.doc_id) AS doc_id, f.text, f.lang, f.source, f.n_chars
      FROM base, (SELECT * FROM base ORDER BY n_chars DESC LIMIT 1) f LIMIT {half}""",
    "events": """SELECT 900000 + row_number() OVER (ORDER BY event_id) AS event_id, ts, 1::bigint AS user_id, 'click' AS event_type,
        value, props FROM base LIMIT {half}""",
    "lineitem": """SELECT 7::bigint AS l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
        l_returnflag, l_linestatus, l_shipdate FROM base LIMIT {half}""",
    "embeddings": """SELECT 900000 + row_number() OVER (ORDER BY vec_id) AS vec_id, embedding, 3 AS label
      FROM base LIMIT {half}""",
    "pages": """SELECT 900000 + row_number() OVER (ORDER BY page_id) AS page_id, 'http://one.example/llama' AS url, '' AS html
      FROM base LIMIT {half}""",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for path in BASE.glob("*.parquet"):
        con.sql(f"CREATE OR REPLACE TABLE base AS SELECT * FROM read_parquet('{path}')")
        if path.stem in ADDED:
            half = con.sql("SELECT count(*) // 2 FROM base").fetchall()[0][0]
            con.sql(f"INSERT INTO base {ADDED[path.stem].format(half=half)}")
        con.sql(f"COPY base TO '{out / path.name}' (FORMAT parquet)")
    return str(out)


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_under_skew(spark, duck, folder, name):
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(duck, ORACLES[name])
