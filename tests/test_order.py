"""Positions, samples, splits and plans against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parley.operators import order


def numbers(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(F.col("id"))


def md5_order(seed, keys):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("n,parts", [(0, 4), (1, 4), (7, 4), (5000, 1), (5000, 13)])
def test_global_position(spark, n, parts):
    df = numbers(spark, n).select((F.col("id") * 7919 % 10007).alias("k"), "id")
    rows = order.global_position(df, ["k", "id"], partitions=parts, total="n").collect()
    assert sorted((r["k"], r["id"]) for r in rows) == [(r["k"], r["id"]) for r in sorted(rows, key=lambda r: r["pos"])]
    assert sorted(r["pos"] for r in rows) == list(range(n))
    assert {r["n"] for r in rows} <= {n}


def test_descending_and_text_keys(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "k string, v int")
    rows = order.global_position(df, "k").collect()
    assert {r["k"]: r["pos"] for r in rows} == {"a": 0, "b": 1, "c": 2}


def test_a_key_that_many_rows_share_is_spread(spark):
    """A third of the rows have the same key; no partition may get all of them."""
    df = numbers(spark, 9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    placed = order.global_position(df, "k", partitions=9)
    assert sorted(r["pos"] for r in placed.select("pos").collect()) == list(range(9000))
    in_order = [r["k"] for r in placed.orderBy("pos").select("k").collect()]
    assert in_order == sorted(in_order)
    tied = df.withColumn("_tie", F.xxhash64("k", "id")).repartitionByRange(9, "k", "_tie")
    sizes = [r["count"] for r in tied.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2000


def test_positions_do_not_depend_on_the_layout(spark):
    df = numbers(spark, 3000, 1).select((F.col("id") % 5).alias("k"), "id")
    one = {r["id"]: r["pos"] for r in order.global_position(df, "k", partitions=3).collect()}
    two = {r["id"]: r["pos"] for r in order.global_position(df.repartition(7), "k", partitions=8).collect()}
    assert one == two


def test_shuffle_is_the_hash_order(spark):
    df = numbers(spark, 1000)
    expected = md5_order(42, range(1000))
    assert [r["id"] for r in order.seeded_shuffle(df, "id", 42).collect()] == expected
    for digits in (1, 4):
        rows = order.shuffled_position(df, "id", 42, digits=digits).collect()
        assert [r["id"] for r in sorted(rows, key=lambda r: r["pos"])] == expected
    assert expected != md5_order(43, range(1000))


@pytest.mark.parametrize("n", [0, 1, 10, 999, 1000, 5000])
def test_cap_sample(spark, n):
    got = {r["id"] for r in order.cap_sample(numbers(spark, 1000), n, "id", 7).collect()}
    assert got == set(md5_order(7, range(1000))[:n])


@pytest.mark.parametrize("ratio", [0.0, 0.05, 0.3, 0.999, 1.0])
def test_ratio_sample(spark, ratio):
    got = {r["id"] for r in order.ratio_sample(numbers(spark, 777), ratio, "id", 1).collect()}
    assert got == set(md5_order(1, range(777))[: int(777 * ratio)])


def test_slices(spark):
    df = numbers(spark, 45)

    def positions(k):
        return sorted(r["pos"] for r in order.slice_by_rank(df, k, 0.05, "id").collect())

    assert positions(0) == [0, 1]
    placed = order.positioned(df, "id")
    assert sorted(r["pos"] for r in order.slice_by_rank(placed, 20, 0.05).collect()) == [40, 41]
    with pytest.raises(ValueError):
        order.round_robin_shard(df, 3)
    assert positions(20) == [40, 41]
    assert positions(22) == [44]
    assert positions(23) == []


def test_round_robin(spark):
    rows = order.round_robin_shard(numbers(spark, 7), 3, "id").orderBy("id").collect()
    assert [r["shard"] for r in rows] == [0, 1, 2, 0, 1, 2, 0]


@pytest.mark.parametrize("n,train", [(21, 19), (20, 19), (1, 0), (100, 95)])
def test_split(spark, n, train):
    rows = order.train_val_split(numbers(spark, n), "id").collect()
    assert sorted(r["id"] for r in rows if r["split"] == "train") == list(range(train))
    assert len(rows) == n


@pytest.mark.parametrize("n,ranks", [(10, 4), (8, 4), (2, 7), (1, 3), (0, 3)])
def test_epoch_plan(spark, n, ranks):
    plan = order.epoch_plan(numbers(spark, n), 2, ranks, "id", 42).collect()
    steps = -(-n // ranks)
    expected = md5_order("42:2", range(n))
    padded = [expected[i % n] for i in range(steps * ranks)] if n else []
    assert sorted((r["step"], r["rank"], r["id"]) for r in plan) == sorted(
        (i // ranks, i % ranks, x) for i, x in enumerate(padded)
    )


def test_epochs_differ_and_validation_does_not(spark):
    df = numbers(spark, 50)

    def at(epoch, shuffle):
        return sorted((r["id"], r["rank"], r["step"]) for r in order.epoch_plan(df, epoch, 2, "id", 1, shuffle).collect())

    assert at(0, True) != at(1, True)
    assert at(0, False) == at(1, False) == [(i, i % 2, i // 2) for i in range(50)]


def test_batches_and_resume(spark):
    plan = order.batch_plan(order.epoch_plan(numbers(spark, 24), 0, 2, "id", 1), 4)
    sizes = {(r["rank"], r["batch"]): r["count"] for r in plan.groupBy("rank", "batch").count().collect()}
    assert sizes == {(rank, batch): 4 for rank in (0, 1) for batch in (0, 1, 2)}
    left = order.resume_from_step(plan, 9).collect()
    assert sorted({r["step"] for r in left}) == [9, 10, 11]


def test_every_nth(spark):
    df = spark.createDataFrame([(f"d{i}",) for i in range(1, 8)], "name string")
    kept = sorted(r["name"] for r in order.drop_every_nth(df, "name", 3).collect())
    assert kept == ["d1", "d2", "d4", "d5", "d7"]
    gone = order.drop_every_nth(df, "name", 3, preview=True).collect()
    assert [(r["name"], r["n_dropped"]) for r in gone] == [("d3", 2), ("d6", 2)]


def test_limit(spark):
    df = numbers(spark, 30_000)
    assert order.limit_samples(df, None, "id").count() == 30_000
    for n in (5, 9_999, 20_000):
        assert sorted(r["id"] for r in order.limit_samples(df, n, "id").collect()) == list(range(n))
    # Equal keys are told apart in one way, on either side of any size.
    tied = df.selectExpr("id", "id % 3 AS k")
    low, high = ({r["id"] for r in order.limit_samples(tied, n, "k").collect()} for n in (9_000, 10_500))
    assert len(low) == 9_000 and low < high and len(high) == 10_500


def test_equal_rows_fill_more_than_one_partition(spark):
    same = spark.range(100_000).selectExpr("1 AS k")
    placed = order.global_position(same, "k", partitions=8)
    assert sorted(r["pos"] for r in placed.collect()) == list(range(100_000))
    # The rows were written by eight tasks of about the same size.
    from pyspark.sql import functions as F

    table = placed.inputFiles()
    sizes = [r["count"] for r in spark.read.parquet(*table).groupBy(F.col("_metadata.file_name")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_a_sample_that_drops_nothing_shuffles_no_rows(spark):
    df = numbers(spark, 1000)
    plan = order.cap_sample(df, 10_000, "id", 7)._jdf.queryExecution().executedPlan().toString()
    head = plan.split("Subquery")[0]
    assert "Window" not in head and "Exchange hashpartitioning(_seg" not in head


def next_valid_by_loop(flags):
    n, out = len(flags), []
    for i in range(n):
        out.append(next(((i + d) % n for d in range(n) if flags[(i + d) % n]), None))
    return out


@pytest.mark.parametrize("segment", [1, 3, 7, 1000])
def test_next_valid(spark, segment):
    rng = random.Random(segment)
    for flags in (
        [False, True, False, True, False],
        [False] * 6,
        [True] * 4,
        [False] * 40 + [True] + [False] * 60,
        [rng.random() < 0.2 for _ in range(200)],
    ):
        df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "id int, ok boolean")
        rows = order.next_valid(df, "id", "ok", segment_rows=segment).orderBy("id").collect()
        assert [r["use_pos"] for r in rows] == next_valid_by_loop(flags)


@pytest.mark.parametrize("segment_rows", [3, 1000])
def test_next_valid_brings_columns_along(spark, segment_rows):
    df = spark.createDataFrame([(k, k in (4, 5, 17), f"t{k}") for k in range(23)], "k int, ok boolean, text string")
    rows = order.next_valid(df, "k", "ok", segment_rows=segment_rows, carry={"text": "use_text", "k": "use_k"}).collect()
    for r in rows:
        use = next((j for j in (4, 5, 17) if j >= r["k"]), 4)
        assert (r["use_pos"], r["use_k"], r["use_text"]) == (use, use, f"t{use}")
    none = order.next_valid(df.withColumn("ok", F.lit(False)), "k", "ok", carry={"text": "use_text"})
    assert {(r["use_pos"], r["use_text"]) for r in none.collect()} == {(None, None)}


def test_next_valid_grows_no_frame_from_the_current_row(spark):
    # Such a frame is worked out anew for each row: n * n / 2 steps for a segment of n rows, in one task.
    df = numbers(spark, 1000).withColumn("ok", F.col("id") % 7 == 3)
    plan = order.next_valid(df, "id", "ok", carry={"id": "use_id"})._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(([^)]*\)?[^)]*)\)", plan)
    assert frames and not [f for f in frames if "unboundedfollowing$" in f and "unboundedpreceding$" not in f]
