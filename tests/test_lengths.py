"""Length statistics against numpy, and composition reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import filters as fl
from parley.operators import lengths as ln


def lengths(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def test_written_out(spark):
    row = ln.length_stats(lengths(spark, [1, 2, 3, 4]), "x").collect()[0].asDict()
    expected = dict(count=4, min=1, max=4, mean=2.5, median=2.5, std=1.118034, p25=1.75, p75=3.25, p90=3.7, p95=3.85, p99=3.97)
    assert row == pytest.approx(expected, abs=1e-6)


def test_empty_gives_zeros(spark):
    row = ln.length_stats(lengths(spark, []), "x").collect()[0].asDict()
    assert set(row.values()) == {0} and len(row) == 11


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.integers(0, 50, 500), rng.integers(1_000_000, 1_000_500, 300), np.full(400, 7)])
    row = ln.length_stats(lengths(spark, values.tolist()), "x").collect()[0]
    assert row["std"] == pytest.approx(np.std(values), rel=1e-9)
    for p in (25, 75, 90, 95, 99):
        assert row[f"p{p}"] == pytest.approx(np.percentile(values, p))
    assert (row["mean"], row["median"]) == pytest.approx((values.mean(), np.median(values)))


def test_large_lengths_do_not_overflow(spark):
    values = [2_000_000_000] * 5 + [1]
    row = ln.length_stats(lengths(spark, values), "x").collect()[0]
    assert row["mean"] == pytest.approx(np.mean(values)) and row["std"] == pytest.approx(np.std(values), rel=1e-6)


def test_histogram_like_numpy(spark):
    values = np.random.default_rng(5).integers(3, 900, 2000)
    rows = {r["bin"]: r for r in ln.length_histogram(lengths(spark, values.tolist()), "x", 50).collect()}
    density, edges = np.histogram(values, bins=50, density=True)
    counts, _ = np.histogram(values, bins=50)
    for i in range(50):
        assert rows[i]["count"] == counts[i]
        assert rows[i]["density"] == pytest.approx(density[i])
        assert rows[i]["bin_start"] == pytest.approx(edges[i])
        assert rows[i]["axis_limit"] == pytest.approx(np.percentile(values, 95))


def test_histogram_of_one_value(spark):
    rows = ln.length_histogram(lengths(spark, [4, 4]), "x", 10).collect()
    density, edges = np.histogram([4, 4], bins=10, density=True)
    assert [r["density"] for r in sorted(rows, key=lambda r: r["bin"])] == pytest.approx(list(density))
    assert [r["bin_start"] for r in sorted(rows, key=lambda r: r["bin"])] == pytest.approx(list(edges[:-1]))
    assert ln.length_histogram(lengths(spark, []), "x", 10).count() == 0


def test_cdf(spark):
    rows = ln.length_cdf(lengths(spark, [1, 1, 2, 5]), "x").orderBy("length").collect()
    assert [(r["length"], r["cdf"]) for r in rows] == [(1, 0.5), (2, 0.75), (5, 1.0)]


def test_report_leaves_out_a_dataset_without_text(spark):
    df = spark.createDataFrame([("a", "x yy"), ("a", ""), ("b", ""), ("b", None)], "dataset string, text string")
    rows = ln.length_report(df, "dataset").collect()
    assert {(r["dataset"], r["unit"]): r["max"] for r in rows} == {("a", "chars"): 4, ("a", "words"): 2, ("a", "tokens"): 2}
    kept, counts = fl.nonempty_text(df)
    assert kept.count() == 1 and counts.collect()[0].asDict() == {"valid": 1, "empty": 3}


def test_tokens_are_zero_where_the_tokeniser_gives_nothing(spark):
    df = spark.createDataFrame([("ab",)], "text string")
    row = ln.text_lengths(df, tokenise=lambda t: F.lit(None).cast("array<int>")).collect()[0]
    assert (row["chars"], row["words"], row["tokens"]) == (2, 1, 0)


def test_first_of_each_source(spark):
    rows = [(9, [("user", "untagged")], None), (3, [("user", "late")], "a"), (1, [("user", "early"), ("assistant", "x")], "a"), (2, [], "b")]
    df = spark.createDataFrame(rows, "key int, conversations array<struct<from:string,value:string>>, source string")
    got = {r["source"]: r for r in ln.first_per_source(df, "key").collect()}
    assert got["a"]["n_turns"] == 2 and got["a"]["first_turn"]["value"] == "early"
    assert got[None]["first_turn"]["value"] == "untagged"
    assert got["b"]["n_turns"] == 0 and got["b"]["first_turn"] is None


@pytest.mark.parametrize("k,error", [(200, 0.0133), (800, 0.0033)])
def test_sketches_keep_their_error(spark, k, error):
    # Values of a range that an exact percentile would hold one by one; half of one group is a single value.
    wide = F.when(F.col("id") % 4 == 0, F.lit(5)).otherwise(F.abs(F.xxhash64("id")) % F.lit(10**15))
    df = spark.range(0, 60_000, 1, 6).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 97 > 0, wide).alias("x"), (F.col("id") % 3).alias("part"))
    fine = ln.length_sketch(df, "x", ["g", "part"], k)
    stats = ln.sketch_stats(ln.merge_sketches(fine, ["g"], k), ["g"])
    exact = {r["g"]: r for r in df.groupBy("g").agg(F.count("x").alias("count"), F.min("x").alias("min"), F.max("x").alias("max")).collect()}
    assert {r["g"]: (r["count"], r["min"], r["max"]) for r in stats.collect()} == {g: (r["count"], r["min"], r["max"]) for g, r in exact.items()}
    off = [r["error"] for r in ln.sketch_error(df, "x", stats, "g").collect()]
    assert len(off) == 2 and max(off) <= 2 * error
    size = fine.agg(F.max(F.length("sketch"))).collect()[0][0]
    assert size < 100 * k
