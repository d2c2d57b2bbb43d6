"""Stored positions, keyed permutations, samples and first rows: results against plain Python, and plans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parley.operators import order, stored
from parley.operators.permute import halves, passes, permute, permuted


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def numbers(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select("id")


# ------------------------------------------------------------ stored positions


@pytest.fixture
def corpus(spark, tmp_path):
    """300 rows in order in seven files of different sizes, with a very long row in one."""
    path = str(tmp_path / "corpus")
    rows = [(k, "x" * (100_000 if k == 250 else k % 50)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, text string").repartitionByRange(4, "id").sortWithinPartitions("id")
    df.write.option("maxRecordsPerFile", 60).parquet(path)
    return path


def test_positions_follow_the_files(spark, corpus):
    rows = stored.scan_in_order(spark, corpus).collect()
    assert sorted((r["id"], r["pos"], r["n_rows"]) for r in rows) == [(k, k, 300) for k in range(300)]
    files = stored.stored_rows(spark.read.parquet(corpus)).collect()
    assert sum(r["rows"] for r in files) == 300 and len(files) == 8


def test_split_of_stored_rows_moves_none(spark, corpus):
    out = order.train_val_split(stored.scan_in_order(spark, corpus))
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 285, "val": 15}
    plan = executed(out)
    for exchange in re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition)[^\n]*", plan):
        assert "text" not in exchange and "id#" not in exchange
    # The side with the text goes from the scan to the join without an exchange.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_parts_are_ordered_by_number(spark):
    names = ["d/part-100000-a.parquet", "d/part-99999-a.parquet", "c/x.parquet", "d/part-00002-b-c001.parquet", "d/part-00002-b-c000.parquet", "d/b.parquet"]
    df = spark.createDataFrame([(f"s3://{n}",) for n in names], "path string").orderBy(*stored.file_order("path"))
    assert [r["path"][5:] for r in df.collect()] == ["c/x.parquet", "d/b.parquet", names[4], names[3], names[1], names[0]]


def test_no_rows_and_clashing_columns(spark, tmp_path):
    spark.range(0).select("id", F.lit("a").alias("total")).write.parquet(str(tmp_path / "none"))
    assert stored.scan_in_order(spark, str(tmp_path / "none")).collect() == []
    spark.range(3).select("id", F.lit("a").alias("path"), F.lit(1).alias("start")).coalesce(1).write.parquet(str(tmp_path / "some"))
    assert [(r["path"], r["pos"]) for r in stored.scan_in_order(spark, str(tmp_path / "some")).orderBy("pos").collect()] == [("a", 0), ("a", 1), ("a", 2)]


# -------------------------------------------------------------- permutations


def by_hand(n, key):
    out = []
    for x in range(n):
        y = permuted(x, n, key)
        while y >= n:
            y = permuted(y, n, key)
        out.append(y)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 97, 1000])
def test_every_epoch_is_another_permutation(spark, n):
    got = {}
    for key in ("42:1", "42:2"):
        rows = permute(numbers(spark, n), "id", n, key, out="to").collect()
        got[key] = [r["to"] for r in sorted(rows, key=lambda r: r["id"])]
        assert got[key] == by_hand(n, key)
        assert sorted(got[key]) == list(range(n))
    if n > 90:
        moved = sum(a != b for a, b in zip(got["42:1"], got["42:2"]))
        assert moved > 0.9 * n
        assert abs(sum(a * b for a, b in enumerate(got["42:1"])) / n - (n - 1) ** 2 / 4) < 0.12 * n * n / 4


def test_passes_are_enough_and_no_more(spark):
    for n in range(1, 400):
        a, b = halves(n)
        assert n <= a * b < n + a
        worst = 0
        for x in range(n):
            y, steps = permuted(x, n, "k"), 1
            while y >= n:
                y, steps = permuted(y, n, "k"), steps + 1
            worst = max(worst, steps)
        assert worst <= passes(n, "k") <= a + 1


def test_keyed_plan(spark):
    n, ranks = 101, 4
    placed = numbers(spark, n).withColumn("pos", F.col("id"))
    plan = order.epoch_plan_keyed(placed, n, 3, ranks, 9)
    to = by_hand(n, "9:3")
    expected = [(x, (q % ranks), q // ranks) for x in range(n) for q in (to[x], to[x] + n) if q < 104]
    assert sorted((r["id"], r["rank"], r["step"]) for r in plan.collect()) == sorted(expected)
    assert "Exchange" not in executed(plan)


def test_validation_and_optimiser_steps(spark):
    placed = numbers(spark, 50).withColumn("pos", F.col("id"))
    plan = order.validation_plan(placed, 50, 3, 4).collect()
    assert len(plan) == 51
    for r in plan:
        assert r["batch"] == r["step"] // 8 and r["slot"] == r["step"] % 8
    assert [r["id"] for r in sorted(plan, key=lambda r: (r["step"], r["rank"]))] == [*range(50), 0]
    train = order.batch_plan(order.epoch_plan_keyed(placed, 50, 0, 2, 1), 4, accumulation=3)
    steps = {r["opt_step"]: r for r in order.optimiser_steps(train, 4, 3, 2).collect()}
    assert [(steps[k]["rows"], steps[k]["batches"], steps[k]["is_full"]) for k in (0, 1, 2)] == [(24, 6, True), (24, 6, True), (2, 2, False)]
    assert order.batch_sizes(4, 3, 2) == {"train": 4, "val": 8, "global": 24}


# ------------------------------------------------------------ samples, first rows


@pytest.mark.parametrize("n", [0, 100, 5000])
def test_samples_read_their_input_twice(spark, n):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def look(k):
        seen.add(1)
        return k

    df = numbers(spark, 2000).select(look("id").alias("id"), F.lit("long text").alias("text"))
    assert len(order.cap_sample(df, n, "id", 7).collect()) == min(n, 2000)
    assert seen.value <= 4000 + min(n, 2000)  # the rows that stay work it out once more behind the filter


def test_nothing_is_worked_out_where_all_rows_stay(spark):
    df = numbers(spark, 10)
    assert order.cap_sample(df, 10, "id", 7, rows=10) is df


def row_order(r):
    return tuple((v is not None, v) for v in r)


@pytest.mark.parametrize("n", [0, 1, 57, 1500, 2999, 3000, 9000])
@pytest.mark.parametrize("edge_rows", [10, 400])
def test_first_rows(spark, n, edge_rows):
    rng = random.Random(5)
    rows = [(None if rng.random() < 0.1 else rng.randrange(40), rng.randrange(10_000)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = order.limit_samples(df, n, ["a", "b"], edge_rows=edge_rows, sample_rows=100).collect()
    assert sorted(map(row_order, got)) == sorted(map(row_order, rows))[:n]


def test_first_rows_among_equal_ones(spark):
    df = spark.createDataFrame([(k // 900, "x") for k in range(3000)], "a int, b string")
    got = order.limit_samples(df, 1000, "a", edge_rows=50, sample_rows=100).collect()
    assert sorted(r["a"] for r in got) == [0] * 900 + [1] * 100


def test_ties_like_before(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), "id")
    placed = order.global_position(df, "k", pos="at")
    expected = {r["id"] for r in placed.where("at < 1234").collect()}
    assert {r["id"] for r in order.limit_samples(df, 1234, "k", edge_rows=20, sample_rows=100).collect()} == expected


def test_first_rows_shuffle_the_edge_alone(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).write.parquet(path)
    df = order.limit_samples(spark.read.parquet(path), 9_000, "id", edge_rows=500, sample_rows=1000)
    plan = executed(df)
    assert df.count() == 9_000
    assert "Union" in plan and "PushedFilters: [Or(IsNull(id),LessThanOrEqual(id" in plan
    assert "hashpartitioning" not in plan
