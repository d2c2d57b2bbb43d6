"""Hand-written records: roles, layouts, texts, words, arrays."""

import pytest
from pyspark.sql import functions as F

from parley.functions import arrays as ar
from parley.functions import text as tx
from parley.functions import tokens as tk
from parley.functions import turns as tn
from parley.operators import filters as fl
from parley.operators import normalise as nm

TURNS = "turns array<struct<from:string,value:string>>"


def one(df, column):
    return df.select(column.alias("x")).collect()[0]["x"]


def chat(spark, *turns):
    return spark.createDataFrame([(list(turns),)], TURNS)


def plain(turns):
    return None if turns is None else [tuple(t) for t in turns]


def test_role_modes(spark):
    df = chat(spark, ("human", "a"), ("system", "b"), ("gpt", "c"), ("tool", "d"))

    def roles(mode):
        out = one(df, tn.role_map(F.col("turns"), mode))
        return None if out is None else [t["from"] for t in out]

    assert roles("coerce") == ["user", "assistant", "assistant", "assistant"]
    assert roles("drop") == ["user", "assistant"]
    assert roles("keep") == ["human", "system", "gpt", "tool"]
    assert roles("reject") is None
    with pytest.raises(ValueError):
        tn.role_map(F.col("turns"), "guess")


def test_null_role_is_unknown(spark):
    df = chat(spark, (None, "a"), ("user", "b"))
    assert plain(one(df, tn.role_map(F.col("turns"), "drop"))) == [("user", "b")]
    assert plain(one(df, tn.role_map(F.col("turns"), "coerce"))) == [("assistant", "a"), ("assistant", "b")]
    assert one(df, tn.alternates(F.col("turns"))) is False


def test_parity_and_prefix(spark):
    df = spark.createDataFrame([(["q", "a", None],)], "xs array<string>")
    turns = tn.roles_by_parity(F.col("xs"))
    assert plain(one(df, turns)) == [("user", "q"), ("assistant", "a"), ("user", "")]
    assert plain(one(df, tn.assistant_prefix(turns, "llama")))[1] == ("assistant", " a")
    assert plain(one(df, tn.assistant_prefix(turns, "qwen")))[1] == ("assistant", "a")


def test_leading_nonuser(spark):
    df = chat(spark, ("system", "s"), ("assistant", "a"), ("user", "u"))
    assert plain(one(df, tn.drop_leading_nonuser(F.col("turns")))) == [("assistant", "a"), ("user", "u")]
    assert one(chat(spark), tn.drop_leading_nonuser(F.col("turns"))) == []


def test_alternation_quarantine(spark):
    rows = [(1, [("user", "a"), ("assistant", "b")]), (2, [("user", "a"), ("user", "b")]), (3, None)]
    good, bad = fl.role_alternation(spark.createDataFrame(rows, f"id int, {TURNS}"))
    assert [r["id"] for r in good.collect()] == [1]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_messages_and_pairs(spark):
    schema = "id int, messages array<struct<role:string,content:string>>"
    rows = [(1, [("user", "a"), ("user", None)]), (2, [("user", "a"), ("assistant", "b")]), (3, None)]
    df = spark.createDataFrame(rows, schema)
    assert [r["id"] for r in fl.min_messages(df).collect()] == [2]
    pairs = spark.createDataFrame([("a", ""), (None, "b"), ("a", "b")], "prompt string, response string")
    assert fl.nonempty_pair(pairs).count() == 1
    found = nm.dispatch_by_column(pairs, "qwen").collect()
    assert [plain(r["turns"]) for r in found] == [[("user", "a"), ("assistant", "b")]]


def test_min_turns(spark):
    df = spark.createDataFrame([([("user", "a")],), ([("user", "a"), ("assistant", "b")],), (None,)], TURNS)
    df = df.withColumnRenamed("turns", "conversations")
    assert fl.min_turns(df).count() == 1
    assert fl.nonempty_turns(df).count() == 2


def test_dispatch_by_record(spark):
    schema = (
        "id int, conversations array<struct<from:string,value:string>>, "
        "messages array<struct<role:string,content:string>>, text string, prompt string, response string"
    )
    two = [("human", "q"), ("gpt", "a")]
    rows = [
        (1, two, [("user", "x"), ("user", "y")], "t", None, None),
        (2, two[:1], [("user", "x"), ("user", "y")], None, None, None),
        (3, None, [("user", "x"), ("assistant", "y")], None, None, None),
        (4, None, None, "plain", "p", "r"),
        (5, None, None, None, "p", "r"),
        (6, None, None, None, "p", None),
    ]
    df = spark.createDataFrame(rows, schema)
    counted = {r["id"]: r for r in nm.dispatch_by_record(df, "llama", with_text=True, keep=("id",)).collect()}
    assert plain(counted[1]["turns"]) == [("user", "q"), ("assistant", " a")]
    assert counted[2]["turns"] is None and counted[2]["form"] == "conversations"
    assert plain(counted[3]["turns"])[1] == ("assistant", " y")
    assert counted[4]["text"] == "plain" and counted[4]["turns"] is None
    assert plain(counted[5]["turns"]) == [("user", "p"), ("assistant", "r")]  # pairs are never prefixed
    bare = nm.dispatch_by_record(df, "llama", with_text=True, keep=("id",), prefix_forms=("conversations",))
    bare = {r["id"]: r["turns"] for r in bare.collect()}
    assert plain(bare[1])[1] == ("assistant", " a")
    assert plain(bare[3])[1] == ("assistant", "y") and plain(bare[5])[1] == ("assistant", "r")
    assert counted[6]["form"] == "other" and counted[6]["text"] == '{"prompt":"p"}'
    other = nm.dispatch_by_record(df, "llama", keep=("id",))
    made = {r["id"]: r for r in other.collect()}
    assert plain(made[1]["turns"]) == [("human", "q"), ("gpt", "a")]
    assert made[4]["form"] == "pair" and made[6]["form"] is None
    kept, dropped = nm.usable_records(other)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 4, 5]
    assert dropped.collect()[0]["dropped"] == 2


def test_unknown_layout(spark):
    with pytest.raises(ValueError):
        nm.dispatch_by_column(spark.range(1), "qwen")


def test_plain_turns_layout(spark):
    df = spark.createDataFrame([(["q", "a"],), (["q"],)], "conversations array<string>")
    found = nm.dispatch_by_column(df, "llama").collect()
    assert [plain(r["turns"]) for r in found] == [[("user", "q"), ("assistant", " a")]]


def test_extract_text(spark):
    df = spark.createDataFrame([([("user", "a"), ("user", ""), ("user", "b")],), ([],), (None,)], TURNS)
    df = df.withColumnRenamed("turns", "conversations")
    for kind in ("sharegpt", "openthoughts"):
        got = [r["x"] for r in df.select(nm.extract_text(df, kind).alias("x")).collect()]
        assert got == ["a b", "", ""], kind
    fallback = spark.createDataFrame([("x", None, "later"), ("x", "first", "later")], "id string, my_dialogue string, Content string")
    got = [r["x"] for r in fallback.select(nm.extract_text(fallback, "ultrachat").alias("x")).collect()]
    assert got == ["later", "first"]
    lists = spark.createDataFrame([(["", ""], "later"), ([], "later"), (["a", "", "b"], "later")], "my_text array<string>, content string")
    got = [r["x"] for r in lists.select(nm.extract_text(lists, "sharegpt").alias("x")).collect()]
    assert got == ["", "later", "a b"]
    strings = spark.createDataFrame([(["a", "", "b"],)], "messages array<string>")
    assert one(strings, nm.extract_text(strings, "openthoughts")) == "a  b"
    # A list of strings ends the search, also when all of them are empty; an empty list does not.
    rows = [([""], "later", ""), (["", ""], "later", " "), ([], "later", "later"), (None, "later", "later")]
    ended = spark.createDataFrame(rows, "messages array<string>, text string, want string")
    assert all(r["x"] == r["want"] for r in ended.select("want", nm.extract_text(ended.drop("want"), "openthoughts").alias("x")).collect())
    # A conversation of empty strings sends the search to the columns by name, in their order.
    rows = [([""], "later", ""), (["a", ""], "later", "a"), (None, "later", "later")]
    empty = spark.createDataFrame(rows, "conversation array<string>, text string, want string")
    assert all(r["x"] == r["want"] for r in empty.select("want", nm.extract_text(empty.drop("want"), "openthoughts").alias("x")).collect())
    none = spark.createDataFrame([(1,)], "id int")
    assert one(none, nm.extract_text(none, "sharegpt")) == ""
    both = spark.createDataFrame([([("m", "c")], "t")], "messages array<struct<content:string,text:string>>, text string")
    assert one(both, nm.extract_text(both, "openthoughts")) == "m"


def test_words_are_those_of_str_split(spark):
    blanks = "\x1c\x1d\x1e\x1f\x0b\x0c\r\x85\xa0        　"
    texts = [
        "  a b\tc\n",
        "",
        "   ",
        "".join(f"w{i}{c}" for i, c in enumerate(blanks)),
        blanks,
        "no​break zero﻿width᠎here\x00nul",
        "ünï cödé 漢字 テスト \U0001f642 ok",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", tk.words(F.col("t")).alias("w")).collect()}
    assert got == {i: t.split() for i, t in enumerate(texts)}


def test_render_split_and_prefix(spark):
    df = chat(spark, ("system", "s"), ("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2"))
    for family in tk.FAMILIES:
        sep = tk.SEPARATORS[family]
        text = tk.render_chat(F.col("turns"), family)
        parts = one(df, tk.split_turns(text, sep["user"]))
        assert len(parts) == 2 and sep["user"] in parts[0], family
        kept = one(df, tk.valid_turn_prefix(tk.split_turns(text, sep["user"]), sep["assistant"]))
        assert kept == parts
        assert one(df, tk.instruction_part(tk.split_turns(text, sep["user"])[1], sep["assistant"])).endswith(sep["assistant"])
    assert one(df, tk.split_turns(F.lit("nothing here"), "<sep>")) is None
    assert one(df, tk.split_turns(F.lit("a.b.c"), ".")) == ["a.b", "c"]
    assert one(chat(spark, ("tool", "x")), tk.render_chat(F.col("turns"), "qwen")) is None


def test_prefix_stops_at_the_first_bad_turn(spark):
    df = spark.createDataFrame([(["q|a", "q|a|b", "q|a"],), (["q|a", "", "q|a"],), (["qa"],), ([],)], "ts array<string>")
    got = [r["x"] for r in df.select(tk.valid_turn_prefix(F.col("ts"), "|").alias("x")).collect()]
    assert got == [["q|a"], ["q|a"], [], []]


def test_families(spark):
    paths = ["/m/DeepSeek-R1-Distill-Qwen-7B", "/m/qwen-llama", "/m/Llama-3", "/m/other"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r["f"] for r in df.select(tk.family_of(F.col("p")).alias("f")).collect()]
    assert got == ["deepseek", "qwen", "llama", "generic"]
    assert tk.family_separators(spark).count() == 4


def test_previews(spark):
    df = spark.createDataFrame([("a" * 5,), ("a" * 6,)], "t string")
    assert [r["x"] for r in df.select(tx.preview_text(F.col("t"), 5).alias("x")).collect()] == ["a" * 5, "a" * 5 + "..."]
    assert one(df, tx.percent(F.lit(1), F.lit(0))) is None


def test_buckets_and_directory_names(spark):
    lengths = [0, 2047, 2048, 32767, 32768]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    got = [r["b"] for r in df.select(ar.length_bucket(F.col("n")).alias("b")).collect()]
    assert got == ["0K-2K", "0K-2K", "2K-4K", "16K-32K", None]
    names = {"0K-2K": 2048, "a-300": 300, "a-b": None, "x": None, "a- 7 -9": 7, "a-1.5K": 1536, "a-": None, "a-K": None}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["v"] for r in df.select("name", ar.bucket_max(F.col("name")).alias("v")).collect()}
    assert got == names


def test_padding_and_shifting(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert one(df, ar.pad_ids(F.col("a"), 4)) == [1, 2, 3, 0]
    assert one(df, ar.attention_mask(F.col("a"), 4)) == [1, 1, 1, 0]
    assert one(df, ar.attention_mask(F.col("a"), 5, extra=1)) == [1, 1, 1, 1, 0]
    assert one(df, ar.pad_ids(F.col("a"), 2, overflow="crop")) == [1, 2]
    with pytest.raises(Exception, match="longer than the pad length"):
        one(df, ar.pad_ids(F.col("a"), 2))
    assert one(df, ar.shift_zero_fill(F.col("a"))) == [2, 3, 0]
    assert one(df, ar.shift_zero_fill(F.col("a"), left=True)) == [0, 1, 2]
    assert one(df, ar.shift_zero_fill(F.col("a"), 5)) == [0, 0, 0]
