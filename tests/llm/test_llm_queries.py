"""Every query of the subpackage against its SQL, on small tables and on tables with hot groups."""

import pytest
from oracle import connect, duck_rows, spark_rows, type_clashes

from parley.llm.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    """A third of the documents are one text, one near copy each has a changed word; a page holds links."""
    out = tmp_path_factory.mktemp("hot")
    con = connect(FOLDER)
    con.sql(
        f"""COPY (SELECT * FROM documents UNION ALL
        SELECT 900000 + d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN f.text ELSE f.text || ' extra' || d.doc_id END, f.lang, f.source, f.n_chars
        FROM documents d, (SELECT * FROM documents WHERE n_chars BETWEEN 800 AND 900 LIMIT 1) f LIMIT 320) TO '{out}/documents.parquet' (FORMAT parquet)"""
    )
    con.sql(
        f"""COPY (SELECT * FROM pages UNION ALL SELECT * FROM (VALUES
        (900001, 'http://a.example.net/x', '<html><head><link href="/y" rel=canonical></head></html>'),
        (900002, 'https://A.example.net/y#z', '<meta http-equiv="refresh" content="0; url=http://b.com/de/1">'),
        (900003, 'https://c.com/fr/1', '<!-- <link rel=canonical href="//b.com/de/1"> --><LINK REL="canonical" HREF="//b.com/de/1?q=1&amp;r=2">'),
        (900004, 'https://d.net/', '<link rel="canonical" href="https://c.com/fr/1"><link rel="stylesheet" href="https://b.com/de/1">'),
        (900005, 'mailto:x@b.com', NULL), (900006, NULL, '<article><p>One &amp; two</p><p> three<br>four</p></article>'), (900007, '', '')) t(page_id, url, html))
        TO '{out}/pages.parquet' (FORMAT parquet)"""
    )
    con.sql(
        f"""COPY (SELECT * FROM embeddings UNION ALL SELECT 900000 + vec_id, CASE WHEN vec_id % 4 < 2 THEN f ELSE list_transform(f, lambda x, i: CASE WHEN i = vec_id % 64 THEN x + 0.01 ELSE x END)::FLOAT[] END, 1
        FROM embeddings, (SELECT embedding AS f FROM embeddings LIMIT 1) LIMIT 700) TO '{out}/embeddings.parquet' (FORMAT parquet)"""
    )
    for name in ("labels", "benchmark"):
        con.sql(f"COPY {name} TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("skewed", [False, True])
def test_same_rows(spark, hot, name, skewed):
    folder = hot if skewed else FOLDER
    con = connect(folder)
    df = QUERIES[name](spark, folder)
    assert spark_rows(df) == duck_rows(con, ORACLES[name])
    assert not type_clashes(df, con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_on_hot_groups(spark, hot, name):
    assert QUERIES[name](spark, hot).count() > 0


def test_native_query_runs_no_python(spark):
    plan = QUERIES["op5_redirect_equivalence"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_all_operators_are_there():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
