"""Write, read back, compare; each in a new folder."""

import json

import pytest
from pyspark.sql import functions as F

from parley import schemas, session
from parley.functions.arrays import length_bucket
from parley.operators import batches as bt
from parley.operators import filters as fl
from parley.operators import vocab as vo
from parley.sources import readers as rd
from parley.sources import writers as wr


def rows(df):
    return sorted(map(repr, df.collect()))


def test_json_array_and_lines(spark, tmp_path):
    records = [{"id": "a", "conversations": [{"from": "human", "value": "hé"}], "extra": 1}, {"id": "b"}]
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    one = rd.scan_json(spark, str(tmp_path / "array.json"), schemas.SHAREGPT)
    two = rd.scan_json(spark, str(tmp_path / "lines.json"), schemas.SHAREGPT, multiline=False)
    assert rows(one) == rows(two) and one.count() == 2
    assert one.schema == schemas.SHAREGPT


def test_named_split_of_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, n in (("train_sft-00000-of-00002", 2), ("train_sft-00001-of-00002", 3), ("test_sft-00000-of-00001", 5)):
        pq.write_table(pa.table({"x": list(range(n))}), tmp_path / f"{name}.parquet")
    assert rd.scan_parquet(spark, str(tmp_path), "train_sft").count() == 5
    assert rd.scan_parquet(spark, str(tmp_path)).count() == 10


def test_first_available(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "saved"))
    paths = [str(tmp_path / "data"), str(tmp_path / "saved")]
    assert rd.scan_first_available(spark, paths).count() == 3
    with pytest.raises(FileNotFoundError):
        rd.scan_first_available(spark, paths[:1])


def test_manifest(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("b.pt", "a.ckpt", "deep/c.pt", "d.txt"):
        (tmp_path / name).write_bytes(b"12")
    found = rd.file_manifest(spark, str(tmp_path), (".pt", ".ckpt")).collect()
    assert sorted((r["name"], r["length"]) for r in found) == [("a.ckpt", 2), ("b.pt", 2), ("c.pt", 2)]
    with pytest.raises(FileNotFoundError):
        rd.file_manifest(spark, str(tmp_path), (".json",))


def test_pretokenised(spark, tmp_path):
    lines = [{"input_ids": [1, 2], "attention_mask": [1, 0]}, {"input_ids": [3]}, {"text": "a b c"}, {}]
    (tmp_path / "x.json").write_text("\n".join(json.dumps(x) for x in lines))
    got = [r.asDict() for r in rd.scan_pretokenised(spark, str(tmp_path / "x.json"), max_len=2).collect()]
    assert [(r["input_ids"], r["attention_mask"], r["loss_mask"]) for r in got[:2]] == [
        ([1, 2], [1, 0], [1, 1]),
        ([3], [1], [1]),
    ]
    assert [len(r["input_ids"]) for r in got] == [2, 1, 2, 0]
    assert got[3]["attention_mask"] == got[3]["loss_mask"] == []


def test_examples(spark, tmp_path):
    df = spark.createDataFrame([(i, [1] * i, i) for i in range(1, 9)], "index long, input_ids array<int>, seq_len int")
    wr.write_examples(df, str(tmp_path / "ex"), files=2)
    assert len(list((tmp_path / "ex").glob("part-*"))) <= 2
    back = rd.scan_examples(spark, str(tmp_path / "ex")).collect()
    assert all(r["loss_mask"] == r["attention_mask"] == [1] * r["index"] for r in back)
    with pytest.raises(Exception, match="already exists"):
        wr.write_examples(df, str(tmp_path / "ex"))


def test_buckets_are_directories(spark, tmp_path):
    df = spark.createDataFrame([(n,) for n in (1, 3000, 40000)], "seq_len int")
    wr.write_bucketed(df.withColumn("bucket", length_bucket(F.col("seq_len"))), str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").glob("bucket=*")) == ["bucket=0K-2K", "bucket=2K-4K"]
    back = spark.read.parquet(str(tmp_path / "b")).where("bucket = '2K-4K'")
    assert "PartitionFilters: [isnotnull(bucket" in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 1


def test_vocabulary_map(spark, tmp_path):
    freq = spark.createDataFrame([(7, 3), (2, 5)], "token_id int, freq long")
    draft = vo.draft_vocab(freq, 2)
    path = str(tmp_path / "map")
    wr.write_vocab_map(vo.d2t_offsets(draft), vo.t2d_mask(spark, draft, 10), path, "m")
    d2t, t2d, report = rd.scan_vocab_map(spark, path)
    row = report.collect()[0]
    assert (row["d2t_size"], row["t2d_size"], row["t2d_true"], row["min_offset"], row["max_offset"]) == (2, 10, 2, 2, 6)
    plain = rd.vocab_map_report(d2t.drop("model", "r"), t2d.drop("model", "r")).collect()[0]
    assert plain["t2d_true"] == 2
    with pytest.raises(FileNotFoundError):
        rd.scan_vocab_map(spark, str(tmp_path / "none"))


def test_stats_and_rejects(spark, tmp_path):
    wr.write_stats(spark.createDataFrame([(5, 1)], "max_seq_len int, dropped_count long"), str(tmp_path / "s"))
    text = next((tmp_path / "s").glob("part-*")).read_text()
    assert json.loads(text) == {"max_seq_len": 5, "dropped_count": 1}
    wr.write_reject_list(spark.createDataFrame([("a/b.pt",)], "path string"), str(tmp_path / "r"))
    listed = spark.read.text(str(tmp_path / "r")).withColumnRenamed("value", "path")
    files = spark.createDataFrame([("a/b.pt",), ("a/c.pt",)], "path string")
    assert [r["path"] for r in fl.remove_listed(files, listed, "path").collect()] == ["a/c.pt"]


def test_corrupt_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"index": 1, "input_ids": [1]}\n{"index": 2, "inp')
    df = spark.read.schema("index long, input_ids array<int>, _corrupt_record string").json(str(tmp_path / "x.json"))
    checked = fl.integrity_check(df, rules=(("input_ids missing", "input_ids is not null"),))
    assert sorted((r["is_valid"], r["error"] or "") for r in checked.collect()) == [(False, "corrupt record"), (True, "")]


def test_scratch_folders():
    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default=None):
            return self.named if key == "spark.checkpoint.dir" else default

    class Session:
        def __init__(self, named, master):
            self.conf = Conf(named)
            self.sparkContext = type("Context", (), {"master": master})

    assert session.scratch_path(Session("hdfs:/shared/", "yarn"), "x").startswith("hdfs:/shared/x-")
    with pytest.raises(RuntimeError):
        session.scratch_path(Session(None, "yarn"), "x")
    local = Session(None, "local[2]")
    assert session.scratch_path(local, "x") != session.scratch_path(local, "x")


def test_scratch_scope_removes_its_tables(spark):
    df = spark.range(10)
    with session.scratch_scope(spark):
        inside = session.materialise(df, "inside")
        path = inside.inputFiles()[0]
        assert inside.count() == 10
    outside = session.materialise(df, "outside")
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()
    assert outside.count() == 10


def test_user_functions(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "boom")], "id int, text string")

    def factory():
        def encode(text):
            if text == "boom":
                raise ValueError(text)
            return [len(w) for w in text.split()]

        return encode

    encode = bt.pluggable_tokeniser(factory)
    found = df.select("id", encode("text").alias("x")).select("id", "x.*")
    assert {r["id"]: (r["ids"], r["error"]) for r in found.collect()} == {1: ([1, 1], None), 2: (None, None), 3: (None, "ValueError: boom")}
    kept, failed = bt.split_failed(found)
    assert {r["id"] for r in kept.collect()} == {1, 2} and [r["id"] for r in failed.collect()] == [3]
    many = bt.pluggable_tokeniser(lambda: lambda texts: [factory()(t) for t in texts], batched=True)
    assert df.select("id", many("text").alias("x")).select("id", "x.*").collect() == found.collect()
    tokens = vo.token_freq_all(df, bt.ids_only(encode)("text")).collect()
    assert [(r["token_id"], r["freq"]) for r in tokens] == [(1, 2)]
    kept = bt.map_batches(df, lambda f: f[f["id"] > 1][["id"]], "id int")
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]
    assert bt.row_transform(df, None) is df


def test_plugged_tokenisers_hold_a_piece_at_a_time(spark):
    # One Arrow batch of 300 rows; the tokeniser tells how much text it was given in one call.
    texts = [None, "", "é" * 40, "a " * 300, *["w" * (k % 23) for k in range(296)]]
    rows = [(k, t, None if t is None or k % 5 == 0 else [t, t[:3]], [t] if k % 2 else None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, turns array<string>, instr array<string>").coalesce(1)

    def factory():
        return lambda texts: [[sum(len(t.encode()) for t in texts), *range(len(t))] for t in texts]

    one = bt.pluggable_tokeniser(factory, batched=True, piece=200)
    got = {r["id"]: r["x"] for r in df.select("id", one("text").alias("x")).collect()}
    assert len(got) == 300 and got[0]["ids"] is None and got[0]["error"] is None
    assert all(got[k]["ids"][1:] == list(range(len(t))) for k, t in enumerate(texts) if t is not None)
    assert all(got[k]["ids"][0] <= 200 for k in range(1, 300) if k != 3) and got[3]["ids"][0] == 600
    chat = bt.pluggable_chat_encoder(factory, batched=True, piece=200)
    made = {r["id"]: r["x"] for r in df.select("id", chat("text", "turns", "instr").alias("x")).collect()}
    for k, text, turns, instr in rows:
        assert made[k]["ids"] is None if text is None else made[k]["ids"][0] <= 200 or k == 3
        assert made[k]["turn_len"] == (None if turns is None else [len(t) + 1 for t in turns])
        assert made[k]["instr_len"] == (None if instr is None else [None if t is None else len(t) + 1 for t in instr])
        assert made[k]["error"] is None


def test_plugged_tokeniser_in_other_operators(spark, tmp_path):
    from parley.operators import lengths as ln

    encode = bt.ids_only(bt.pluggable_tokeniser(lambda: lambda text: list(range(len(text)))))
    df = spark.createDataFrame([("a", "ab c"), ("a", "x")], "dataset string, text string")
    rows = {r["unit"]: r["max"] for r in ln.length_report(df, "dataset", tokenise=encode).collect()}
    assert rows == {"chars": 4, "words": 2, "tokens": 4}
    (tmp_path / "x.json").write_text('{"text": "abc"}\n{"input_ids": [7]}')
    got = rd.scan_pretokenised(spark, str(tmp_path / "x.json"), encode, max_len=2).collect()
    assert sorted(r["input_ids"] for r in got) == [[0, 1], [7]]
    assert all(r["loss_mask"] == [1] * len(r["input_ids"]) for r in got)


def test_profile(spark):
    df = spark.createDataFrame([("x" * 200, [("a", 1)], {"k": 1})], "t string, l array<struct<p:string,q:int>>, m map<string,int>")
    cells = {r["column"]: r for r in rd.profile_schema(df).collect()}
    assert cells["t"]["shown"] == "x" * 100 + "..." and cells["l"]["shown"] == "list with 1 items" and cells["l"]["keys"] == "p,q"
