"""Masks against a plain loop over positions."""

import random

import pytest
from pyspark.sql import functions as F

from parley.functions import masks as mk

FUNCTIONS = {"qwen": mk.loss_mask_qwen, "llama": mk.loss_mask_llama, "legacy": mk.loss_mask_legacy}


def by_loop(family, length, turn_len, instr_len):
    """The rule of each family, position by position."""
    if turn_len is None:
        return [1] * length
    cur, zeros = 1, set()
    for i, (t, k) in enumerate(zip(turn_len, instr_len)):
        if family == "legacy":
            k -= 1
        if family == "qwen":
            span = (0, cur + k - 2) if i == 0 else (cur - 2, cur + k - 1)
            step = t + 2
        else:
            span = (cur, cur + k - 2) if i == 0 else (cur - 3, cur + k + 1)
            step = t + (0 if i == 0 else 3)
        zeros.update(range(*span))
        cur += step
    return [int(1 <= p < cur and p not in zeros) for p in range(length)]


def starts_by_loop(family, turn_len):
    out = [1]
    for i, t in enumerate(turn_len):
        out.append(out[-1] + t + (2 if family == "qwen" else (0 if i == 0 else 3)))
    return out


def cases(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        turns = None if rng.random() < 0.05 else rng.randint(0, 6)
        t = None if turns is None else [rng.randint(1, 30) for _ in range(turns)]
        # Now and then an instruction is counted longer than its turn.
        k = None if turns is None else [min(rng.randint(0, x + 2), x + 2) for x in t]
        full = 0 if t is None else sum(t) + 3 * len(t)
        yield i, rng.randint(0, max(full + 10, 5)), t, k


@pytest.mark.parametrize("family", sorted(FUNCTIONS))
def test_random_cases(spark, family):
    rows = list(cases(400, seed=sum(map(ord, family))))
    df = spark.createDataFrame(rows, "id int, L int, t array<int>, k array<int>")
    mask = FUNCTIONS[family](F.col("L"), F.col("t"), F.col("k"))
    got = {r["id"]: r["m"] for r in df.select("id", mask.alias("m")).collect()}
    for i, length, t, k in rows:
        assert got[i] == by_loop(family, length, t, k), (length, t, k)


@pytest.mark.parametrize("family", sorted(FUNCTIONS))
def test_turn_starts(spark, family):
    rows = [(i, t) for i, _, t, _ in cases(100, seed=3) if t is not None]
    df = spark.createDataFrame(rows, "id int, t array<int>")
    got = {r["id"]: r["s"] for r in df.select("id", mk.cumulative_turn_start(F.col("t"), family).alias("s")).collect()}
    for i, t in rows:
        assert got[i] == starts_by_loop(family, t)


@pytest.mark.parametrize(
    "family,length,t,k,expected",
    [
        ("qwen", 8, [7], [4], [0, 0, 0, 1, 1, 1, 1, 1]),
        ("llama", 8, [6], [4], [0, 0, 0, 1, 1, 1, 1, 0]),
        ("legacy", 8, [6], [4], [0, 0, 1, 1, 1, 1, 1, 0]),
        ("qwen", 3, None, None, [1, 1, 1]),
        ("qwen", 0, [7], [4], []),
        ("llama", 4, [], [], [0, 0, 0, 0]),
    ],
)
def test_written_out(spark, family, length, t, k, expected):
    df = spark.createDataFrame([(length, t, k)], "L int, t array<int>, k array<int>")
    mask = FUNCTIONS[family](F.col("L"), F.col("t"), F.col("k"))
    assert df.select(mask.alias("m")).collect()[0]["m"] == expected


def test_a_very_long_conversation(spark):
    """Ten thousand turns in one record."""
    t, k = [6] * 10_000, [3] * 10_000
    df = spark.createDataFrame([(90_000, t, k)], "L int, t array<int>, k array<int>")
    got = df.select(mk.loss_mask_llama(F.col("L"), F.col("t"), F.col("k")).alias("m")).collect()[0]["m"]
    assert got == by_loop("llama", 90_000, t, k)


def test_unknown_family():
    with pytest.raises(ValueError):
        mk.loss_mask(F.col("L"), F.col("t"), F.col("k"), "generic")


def test_zero_last_and_supervised(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 0, 1]), ([], [])], "ids array<int>, mask array<int>")
    rows = df.select(
        mk.zero_last_mask(F.col("mask")).alias("z"), mk.supervised_tokens(F.col("ids"), F.col("mask")).alias("s")
    ).collect()
    assert [(r["z"], r["s"]) for r in rows] == [([1, 0, 0], [1, 3]), ([], [])]
