"""Packed sets of ids against plain Python sets."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions.bitmaps import bitmap_of, bitmaps_by, in_bitmap
from parley.operators import vocab as vo


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1000])
def test_membership(spark, size):
    rng = random.Random(size)
    chosen = {k for k in range(size) if rng.random() < 0.3} | {size - 1}
    given = [*chosen, *chosen, None, -1, -64, size, size + 64]
    df = spark.createDataFrame([(k,) for k in given], "id int").repartition(3)
    bits = bitmap_of(df, "id", size)
    assert len(bits.collect()[0]["bits"]) == -(-size // 64)
    asked = spark.createDataFrame([(k,) for k in [*range(-70, size + 70), None]], "v int")
    got = asked.withColumn("hit", in_bitmap(bits.scalar(), F.col("v"), size)).collect()
    assert {r["v"]: r["hit"] for r in got} == {v: v in chosen for v in [*range(-70, size + 70), None]}


def test_an_empty_set(spark):
    none = spark.range(0)
    assert bitmap_of(none, "id", 130).collect()[0]["bits"] == [0, 0, 0]
    assert bitmaps_by(none.withColumn("r", F.lit(1)), "r", "id", 130).collect()[0]["sets"] == []


def test_masks_by_row_and_by_array_agree_without_a_join(spark):
    t2d = spark.range(100).select(F.col("id").cast("int").alias("token_id"), (F.col("id") % 3 == 0).alias("in_draft"))
    rows = [(1, [0, 1, 3, 99, 100, -1], [1, 1, 1, 1, 1, 1]), (2, [], []), (3, None, None), (4, [6, 9, None], [0, 1, 1])]
    df = spark.createDataFrame(rows, "index int, input_ids array<int>, loss_mask array<int>")
    whole = vo.array_in_draft(df, t2d, 100)
    assert {r["index"]: r["position_mask"] for r in whole.collect()} == {1: [1, 0, 1, 1, 0, 0], 2: [], 3: None, 4: [0, 1, 0]}
    long = df.select("index", F.posexplode(F.arrays_zip("input_ids", "loss_mask")).alias("i", "x")).select("index", "i", F.col("x.input_ids").alias("target"), F.col("x.loss_mask").alias("loss_mask"))
    by_row = vo.supervised_in_draft(long, t2d, 100)
    assert [r["position_mask"] for r in by_row.orderBy("index", "i").collect()] == [1, 0, 1, 1, 0, 0, 0, 1, 0]
    for out in (whole, by_row):
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_map_of_several_sizes_has_no_join(spark):
    freq = spark.createDataFrame([(k, 100 - k) for k in range(50)], "token_id int, freq long")
    draft = vo.draft_vocab(freq, [4, 20], eos=49)
    t2d = vo.t2d_mask(spark, draft, 64)
    assert "Join" not in t2d._jdf.queryExecution().executedPlan().toString()
    got = {(r["r"], r["token_id"]) for r in t2d.where("in_draft").collect()}
    assert got == {(r, t) for r in (4, 20) for t in [*range(r - 1), 49]}
    assert t2d.count() == 128
