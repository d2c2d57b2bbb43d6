"""Counts that come with a write."""

import pytest
from pyspark.sql import functions as F

from parley.functions.arrays import BUCKETS
from parley.operators import examples as ex
from parley.operators import filters as fl
from parley.plans.training import write_chat_examples


def counting(spark, df, column):
    """The rows with a column that counts how often it is worked out."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def look(_):
        seen.add(1)
        return True

    return df.withColumn("_seen", look(column)), seen


def lengths(spark):
    return spark.createDataFrame([(1, 5), (2, 20), (3, None), (4, 10), (5, 11)], "index long, seq_len int")


def test_counts_come_with_the_action(spark, tmp_path):
    df, seen = counting(spark, lengths(spark), "index")
    kept, counts = fl.observed(df, fl.cap_rule(10))
    kept.write.parquet(str(tmp_path / "out"))
    assert counts.get == {"dropped": 3}
    assert seen.value == 5
    assert sorted(r["index"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4]


@pytest.mark.parametrize(
    "rule,schema",
    [
        (lambda: fl.cap_rule(10), "dropped long"),
        (lambda: ex.run_rule(10), "max_seq_len int, dropped_count long"),
        (lambda: fl.text_rule("text"), "valid long, empty long"),
        (lambda: fl.train_cap_rule(2), "dropped long"),
    ],
)
@pytest.mark.parametrize("n", [0, 5])
def test_observed_like_counted(spark, rule, schema, n):
    df = lengths(spark).limit(n).withColumn("text", F.when(F.col("index") > 1, F.lit("x" * 3)).otherwise("")).withColumn("text", F.when(F.col("index") < 5, F.col("text")))
    df = df.withColumn("input_ids", F.when(F.col("seq_len").isNotNull(), F.sequence(F.lit(1), F.col("index"))))
    rule = rule()
    kept, counts = fl.observed(df, rule)
    rows = kept.collect()
    assert sorted(rows) == sorted(rule.kept(df).collect())
    assert fl.observed_row(spark, counts, schema).collect() == rule.counted(df).collect()


def test_a_filter_does_not_go_below_the_counts(spark):
    kept, counts = fl.observed(spark.range(100).withColumn("seq_len", F.col("id").cast("int")), fl.cap_rule(49))
    assert kept.where("id > 40").count() == 9
    assert counts.get == {"dropped": 50}


def test_examples_are_worked_out_once(spark, tmp_path):
    turns = [[("user", "one two"), ("assistant", "three " * n)] for n in (1, 4, 4000)]
    records = spark.createDataFrame([(k, t) for k, t in enumerate(turns)], "index long, conversations array<struct<from:string,value:string>>")
    records, seen = counting(spark, records, "index")
    records = records.withColumn("index", F.when(F.col("_seen"), F.col("index"))).drop("_seen")
    run = write_chat_examples(records, "index", "qwen", str(tmp_path), max_len=32768, cap=100)
    stats = run.stats.collect()[0]
    assert seen.value == 3
    assert stats["dropped_count"] == 1 and stats["bucket_stats"] == {label: 2 if label == "0K-2K" else 0 for _, _, label in BUCKETS}
    assert {r["index"]: r["seq_len"] for r in run.written.collect()} and max(r["seq_len"] for r in run.written.collect()) == stats["max_seq_len"]
    assert seen.value == 3
