"""Metric roll-ups, vectors and examples on small written-out tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.functions import vectors as vc
from parley.functions.arrays import BUCKETS
from parley.operators import evaluate as ev
from parley.operators import examples as ex
from parley.operators import filters as fl


def test_masked_accuracy(spark):
    rows = [(0, 5, 5, 1, 1), (0, 5, 6, 1, 1), (0, 7, 7, 1, 1), (1, 1, 1, 0, 0)]
    df = spark.createDataFrame(rows, "k int, pred int, target int, position_mask int, loss_mask int")
    got = {r["k"]: r["accuracy"] for r in ev.masked_accuracy(df, position_mask="position_mask").collect()}
    assert got == {0: pytest.approx(2 / 3.000001), 1: 0.0}


def test_topk(spark):
    rows = [(1, [1, 2, 3], 1, 1), (1, [1, 2, 3], 3, 1), (1, [1, 2, 3], 9, 1), (1, [1, 2, 3], 1, 0)]
    df = spark.createDataFrame(rows, "pred int, top_ids array<int>, target int, loss_mask int")
    row = ev.topk_accuracy(df).collect()[0]
    assert (row["correct"], row["total"], row["top1"], row["top2"], row["top3"]) == (1, 3, 1, 1, 2)
    assert row["top3_acc"] == pytest.approx(2 / 3.00001)


def test_discounted(spark):
    df = spark.createDataFrame([(0, 1, k, 1.0) for k in range(3)], "epoch int, step int, k int, loss double")
    assert ev.discounted_loss(df).collect()[0]["total_loss"] == pytest.approx(2.44)


def test_epoch_means(spark):
    rows = [(0, 0, 0, 1.0, 0.0), (0, 0, 0, 3.0, 1.0), (0, 1, 0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "epoch int, rank int, k int, loss double, acc double")
    got = {m: ev.epoch_rollup(df, m).collect()[0]["loss"] for m in ("rank0", "rank_means", "pooled")}
    assert got == {"rank0": 2.0, "rank_means": 3.5, "pooled": 3.0}
    with pytest.raises(ValueError):
        ev.epoch_rollup(df, "median")


def test_layers(spark):
    rows = [(1, 0, 16, [3.0, 4.0]), (1, 0, 2, [1.0, 2.0]), (1, 0, 32, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "index long, position int, layer int, vec array<float>")
    row = ev.concat_layers(df).collect()[0]
    assert row["states"] == [1.0, 2.0, 3.0, 4.0] and row["last_state"] == [9.0, 9.0]
    assert ev.concat_layers(df, keep_last=False).collect()[0]["states"] == [1.0, 2.0, 3.0, 4.0, 9.0, 9.0]


def test_losses_like_numpy(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 3, (40, 16)), rng.normal(0, 3, (40, 16))
    mask = rng.integers(0, 2, 40)
    rows = [(a[i].tolist(), b[i].tolist(), int(mask[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, m int")
    d = np.abs(a - b)
    l1 = np.where(d < 1, 0.5 * d * d, d - 0.5).mean(1)
    assert ev.smooth_l1(df, "a", "b", "m").collect()[0]["vloss"] == pytest.approx((l1 * mask).sum() / 40)

    def soft(x, y):
        p = np.exp(y - y.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top = x.max(1, keepdims=True)
        logq = x - top - np.log(np.exp(x - top).sum(1, keepdims=True))
        return -(p * logq).sum(1)

    whole = ev.soft_cross_entropy(df, "a", "b", "m").collect()[0]["ploss"]
    assert whole == pytest.approx((soft(a, b) * mask).sum() / 40, rel=1e-12)
    draft = [1, 4, 9]
    part = ev.soft_cross_entropy(df.withColumn("a", F.slice("a", 1, 3)), "a", "b", "m", draft=draft)
    assert part.collect()[0]["ploss"] == pytest.approx((soft(a[:, :3], b[:, draft]) * mask).sum() / 40, rel=1e-12)


def test_large_logits_stay_finite(spark):
    df = spark.createDataFrame([([1000.0, 0.0], [1000.0, 0.0], 1)], "a array<double>, b array<double>, m int")
    assert math.isfinite(ev.soft_cross_entropy(df, "a", "b", "m").collect()[0]["ploss"])


def test_wide_logits(spark):
    """The cost is linear in the width: a vocabulary-sized row takes no time."""
    df = spark.range(2).select(F.transform(F.sequence(F.lit(0), F.lit(32767)), lambda i: (i % 97) / 10.0).alias("a"))
    row = df.select(vc.cross_entropy(F.col("a"), F.col("a")).alias("x")).collect()[0]
    x = np.arange(32768) % 97 / 10.0
    p = np.exp(x - x.max())
    p /= p.sum()
    assert row["x"] == pytest.approx(-(p * np.log(p)).sum())


def test_noise_is_bounded_and_repeatable(spark):
    df = spark.createDataFrame([(i, [0.0] * 64) for i in range(200)], "id int, v array<double>")
    noisy = df.select("id", vc.uniform_noise(F.col("v"), F.col("id"), std=0.2, seed=1).alias("n"))
    first, again = noisy.collect(), noisy.repartition(5).collect()
    values = np.array([r["n"] for r in first])
    assert np.abs(values).max() <= 0.5 * 0.2 * 512 / 64 and abs(values.mean()) < 0.02
    assert {r["id"]: r["n"] for r in first} == {r["id"]: r["n"] for r in again}


def test_alignment(spark):
    df = spark.createDataFrame([([1, 2, 3], [0, 1, 1], [7, 8, 9]), ([1], [1], [7])], "input_ids array<int>, loss_mask array<int>, states array<int>")

    def rows(mode):
        return [r.asDict() for r in ex.align_shift(df, mode).collect()]

    off, on, old = rows("offline"), rows("online"), rows("older")
    assert off[0] == {"input_ids": [2, 3], "loss_mask": [0, 1, 0], "states": [7, 8, 9]}
    assert on[0] == {"input_ids": [2, 3], "loss_mask": [1, 1], "states": [7, 8]}
    assert on[1] == {"input_ids": [], "loss_mask": [1], "states": [7]}
    assert old[0]["target"] == [8, 9] and old[0]["loss_mask"] == [0, 1, 0]
    with pytest.raises(ValueError):
        ex.align_shift(df, "sideways")


def test_integrity(spark):
    rows = [(1, [1, 2], [0, 1], 2), (2, None, [0], 1), (3, [1], None, 1), (4, [1, 2], [0, 1], 3), (5, [1, 2], [0], 2), (6, [1], [2], 1), (7, [1], [None], 1)]
    df = spark.createDataFrame(rows, "index int, input_ids array<int>, loss_mask array<int>, seq_len int")
    checked = fl.integrity_check(df)
    got = {r["index"]: r["error"] for r in checked.collect()}
    assert got[1] is None and got[2] == "input_ids missing" and got[3] == "loss_mask missing"
    assert got[4] == "seq_len is not the number of ids" and got[5] == "loss_mask has another length"
    assert got[6] == got[7] == "loss_mask holds other values than 0 and 1"
    assert fl.validation_summary(checked).collect()[0].asDict() == {"total": 7, "valid": 1, "corrupt": 6}


def test_run_stats_of_nothing(spark):
    df = spark.createDataFrame([], "seq_len int")
    row = ex.run_stats(df, 10, BUCKETS).collect()[0]
    assert (row["max_seq_len"], row["dropped_count"]) == (0, 0) and set(row["bucket_stats"].values()) == {0}
    assert {r["rows"] for r in ex.bucket_counts(df).collect()} == {0}


def test_caps(spark):
    df = spark.createDataFrame([(n,) for n in (10, 2048, 2049)], "seq_len int")
    kept, dropped = fl.length_cap(df, 2048)
    assert kept.count() == 2 and dropped.collect()[0]["dropped"] == 1
    assert ex.run_stats(df, 2048).collect()[0].asDict() == {"max_seq_len": 2048, "dropped_count": 1}


def test_directory_limits(spark):
    df = spark.createDataFrame([("x",), ("a-b",), ("16K-32K",), ("2K-4K",)], "name string")
    assert ex.parse_bucket_max(df).collect()[0]["max_len"] == 32768
    assert ex.parse_bucket_max(df, largest=True).collect()[0]["max_len"] == 32768
    assert ex.parse_bucket_max(df.limit(0), default=99).collect()[0]["max_len"] == 99
