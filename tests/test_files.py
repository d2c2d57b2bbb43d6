"""Checks of whole files, and finished work told by an output folder."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from parley.operators import filters as fl
from parley.sources import checks as ck
from parley.sources import writers as wr


def spoil(path, at=None, keep=None):
    """Overwrites four bytes at a place, or keeps the first bytes alone."""
    data = pathlib.Path(path).read_bytes()
    pathlib.Path(path).write_bytes(data[:keep] if keep is not None else data[:at] + b"\xff" * 40 + data[at + 40 :])


@pytest.fixture
def folder(spark, tmp_path):
    df = spark.range(4000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    df.repartition(6).write.parquet(str(tmp_path / "a"))
    names = sorted((tmp_path / "a").glob("*.parquet"))
    spoil(names[0], keep=names[0].stat().st_size // 2)  # cut short
    spoil(names[1], keep=0)  # empty
    spoil(names[2], at=200)  # damaged inside a page
    (tmp_path / "a" / "b").mkdir()
    (tmp_path / "a" / "b" / "no.parquet").write_text("not a table")
    (tmp_path / "a" / "note.txt").write_text("not listed")
    return str(tmp_path / "a")


def test_every_listed_file_has_a_row(spark, folder):
    rows = {pathlib.Path(r["path"]).name: r for r in ck.check_files(spark, folder, files_per_task=2).collect()}
    names = sorted(n for n in rows if n != "no.parquet")
    assert len(rows) == 7
    assert [rows[n]["is_valid"] for n in names] == [False, False, False, True, True, True]
    assert not rows["no.parquet"]["is_valid"]
    assert all((r["error"] is None) == r["is_valid"] == (r["rows"] is not None) for r in rows.values())
    assert all(pathlib.Path(r["path"].removeprefix("file://")).stat().st_size == r["length"] for r in rows.values())
    total = fl.validation_summary(ck.check_files(spark, folder)).collect()[0]
    assert (total["total"], total["valid"], total["corrupt"]) == (7, 3, 4)


def test_rejects_are_the_corrupt_ones(spark, folder, tmp_path):
    checked = ck.check_files(spark, folder)
    wr.write_reject_list(checked.where(~F.col("is_valid")), str(tmp_path / "rejects"))
    rejects = spark.read.text(str(tmp_path / "rejects")).withColumnRenamed("value", "path")
    assert fl.remove_listed(checked, rejects, "path").count() == 3


def test_lines(spark, tmp_path):
    lines = [json.dumps({"a": k, "text": "é" * 1000}) for k in range(9000)]  # over more than one read
    (tmp_path / "good.json").write_text("\n".join(lines))
    (tmp_path / "blank.json").write_text("\n\n" + lines[0] + "\n\n")
    (tmp_path / "bad.json").write_text("\n".join([*lines[:7000], lines[0][:-1], *lines[7001:]]) + "\n")
    (tmp_path / "empty.json").write_text("")
    rows = {pathlib.Path(r["path"]).name: r for r in ck.check_files(spark, str(tmp_path), "json").collect()}
    assert {n: r["rows"] for n, r in rows.items()} == {"good.json": 9000, "blank.json": 1, "bad.json": None, "empty.json": 0}
    assert rows["bad.json"]["error"].startswith("ValueError: line 7001: ")


def test_done_by_names_and_by_tables(spark, tmp_path):
    assert ck.done_keys(spark, str(tmp_path / "none")).count() == ck.written_keys(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "out" / "0").mkdir(parents=True)
    assert ck.done_keys(spark, str(tmp_path / "out")).count() == 0
    for k in (3, 14):
        (tmp_path / "out" / "0" / f"data_{k}.pt").write_text("x")
    (tmp_path / "out" / "other.pt").write_text("x")
    assert sorted(r["index"] for r in ck.done_keys(spark, str(tmp_path / "out")).collect()) == [3, 14]
    wr.write_bucketed(spark.range(5).select(F.col("id").alias("index"), (F.col("id") % 2).alias("bucket")), str(tmp_path / "tables"))
    assert sorted(r["index"] for r in ck.written_keys(spark, str(tmp_path / "tables")).collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("bits", [8, 1 << 16])
def test_skip_many_done(spark, bits):
    df = spark.range(2000).select(F.when(F.col("id") % 100 > 0, F.col("id")).alias("k"), F.lit("wide").alias("text"))
    done = spark.createDataFrame([(k,) for k in [*range(0, 2000, 3), *range(0, 2000, 9), None, 5000]], "k int")
    out = fl.skip_many_done(df, done, "k", bits=bits)
    assert out.columns == ["k", "text"]
    got = [r["k"] for r in out.collect()]
    assert sorted(x for x in got if x is not None) == [k for k in range(2000) if k % 3 and k % 100] and got.count(None) == 20
    assert sorted(map(str, got)) == sorted(str(r["k"]) for r in fl.skip_done(df, done, "k").collect())
    assert fl.skip_many_done(df, done.limit(0), "k", bits=bits).count() == 2000


def test_what_passes_the_filter_is_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(20_000).select(F.col("id").alias("k"), F.lit("wide").alias("text"))
        out = fl.skip_many_done(df, spark.range(0, 20_000, 20).select(F.col("id").alias("k")), "k", bits=1 << 16)
        assert out.count() == 19_000
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        kept = plan.split("Union")[1]
        first = kept[: kept.index("Range")]
        assert "Exchange" not in first.split("Subquery")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
