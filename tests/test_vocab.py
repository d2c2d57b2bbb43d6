"""Draft vocabularies: written-out cases and what must always hold."""

import pytest
from pyspark.sql import functions as F

from parley.catalog import inputs as inp
from parley.functions import tokens as tk
from parley.operators import vocab as vo
from parley.plans.vocabulary import draft_vocabulary, text_token_freq

FOLDER = "/root/testdata/sf0.001"


def freq_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "token_id int, freq long")


def maps(draft):
    return {r["token_id"]: r["offset"] for r in vo.d2t_offsets(draft).collect()}


COUNTS = {7: 30, 3: 20, 9: 10}


def test_eos_inside(spark):
    assert maps(vo.draft_vocab(freq_of(spark, COUNTS), 2, eos=3)) == {3: 3, 7: 6}


def test_eos_injected(spark):
    freq = freq_of(spark, COUNTS)
    assert maps(vo.draft_vocab(freq, 2, eos=1)) == {1: 1, 7: 6}
    assert vo.draft_coverage(freq, 2, eos=1).collect()[0]["coverage"] == pytest.approx(30 / 60)
    assert vo.draft_coverage(freq, 2).collect()[0]["coverage"] == pytest.approx(50 / 60)
    rare = freq_of(spark, {**COUNTS, 1: 2})
    assert vo.draft_coverage(rare, 2, eos=1, include_injected=True).collect()[0]["covered"] == 32
    assert vo.draft_coverage(rare, 2, eos=1).collect()[0]["covered"] == 30


def test_only_place_goes_to_eos(spark):
    assert maps(vo.draft_vocab(freq_of(spark, COUNTS), 1, eos=1)) == {1: 1}


def test_more_places_than_tokens(spark):
    freq = freq_of(spark, COUNTS)
    assert len(maps(vo.draft_vocab(freq, 10, eos=9))) == 3
    assert sorted(maps(vo.draft_vocab(freq, 10, eos=1))) == [1, 3, 7, 9]
    assert sorted(maps(vo.draft_vocab(freq, 3, eos=1))) == [1, 3, 7]


def test_ties_go_to_the_smaller_id(spark):
    assert sorted(maps(vo.draft_vocab(freq_of(spark, {5: 4, 2: 4, 8: 4}), 2))) == [2, 5]


def test_empty_corpus(spark):
    found = draft_vocabulary(freq_of(spark, {}), 4, 10, eos=1)
    assert found.d2t.count() == 0
    assert found.t2d.where("in_draft").count() == 0
    assert found.coverage.count() == 0
    assert vo.token_totals(found.freq).collect()[0]["total_tokens"] == 0


def test_what_always_holds(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    freq = text_token_freq(docs, vocab_size=4096)
    ids = docs.select(tk.tokenise(F.col("text")).alias("ids"))
    assert freq.agg(F.sum("freq")).collect()[0][0] == ids.agg(F.sum(F.size("ids"))).collect()[0][0]
    for eos in (None, 4095):
        found = draft_vocabulary(freq, [16, 300, 2000], 4096, eos)
        d2t = found.d2t.collect()
        assert all(r["draft_id"] + r["offset"] == r["token_id"] for r in d2t)
        per_size = {r: [x for x in d2t if x["r"] == r] for r in (16, 300, 2000)}
        flags = found.t2d.where("in_draft").groupBy("r").count().collect()
        assert {r["r"]: r["count"] for r in flags} == {r: len(rows) for r, rows in per_size.items()} == {16: 16, 300: 300, 2000: 2000}
        assert found.t2d.count() == 3 * 4096
        for rows in per_size.values():
            assert sorted(x["draft_id"] for x in rows) == list(range(len(rows)))


def test_one_size_at_a_time_gives_the_same(spark):
    freq = text_token_freq(spark.read.parquet(f"{FOLDER}/documents.parquet"), vocab_size=4096)
    together = {(r["r"], r["token_id"]) for r in vo.draft_vocab(freq, [50, 64], 4095).collect()}
    alone = {(r, x["token_id"]) for r in (50, 64) for x in vo.draft_vocab(freq, r, 4095).collect()}
    assert together == alone


def test_maps_compared(spark):
    a = vo.d2t_offsets(vo.draft_vocab(freq_of(spark, COUNTS), 3))
    row = vo.vocab_map_diff(a, a).collect()[0]
    assert row["equal"] and row["max_diff"] == 0 and row["mean_diff"] == 0 and row["differing"] == 0
    short = vo.d2t_offsets(vo.draft_vocab(freq_of(spark, COUNTS), 2))
    row = vo.vocab_map_diff(a, short).collect()[0]
    assert not row["equal"] and row["max_diff"] is None and (row["size_a"], row["size_b"]) == (3, 2)
    x = vo.t2d_mask(spark, freq_of(spark, {1: 1}), 4)
    y = vo.t2d_mask(spark, freq_of(spark, {2: 1}), 4)
    assert vo.vocab_map_diff(x, y).collect()[0]["differing"] == 2


def test_decode(spark):
    vocab = spark.createDataFrame([(1, "a"), (2, "b")], "token_id int, token string")
    df = spark.createDataFrame([(1, [1, 2, 1]), (2, []), (3, [9])], "id int, input_ids array<int>")
    got = {r["id"]: r["text"] for r in vo.decode_tokens(df, vocab, "id", 100).collect()}
    assert got == {1: "aba", 2: "", 3: "<token_9>"}


def test_top_share_names_what_it_can(spark):
    vocab = spark.createDataFrame([(7, "x")], "token_id int, token string")
    rows = vo.token_top_share(freq_of(spark, COUNTS), 2, vocab).orderBy("rank").collect()
    assert [(r["token_id"], r["token"], r["percent"]) for r in rows] == [(7, "x", 50.0), (3, None, pytest.approx(100 / 3))]


def test_both_ways_to_count_agree(spark):
    ex = inp.examples(spark, FOLDER)
    everything = vo.token_freq_all(ex).collect()
    ones = ex.withColumn("loss_mask", F.transform("input_ids", lambda _: F.lit(1)))
    assert sorted(everything) == sorted(vo.token_freq_supervised(ones).collect())
