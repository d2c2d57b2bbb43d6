"""The whole way of the README's example, from chats to batches, over one small corpus."""

from pyspark.sql import functions as F

from parley.catalog import inputs as inp
from parley.operators import filters as fl
from parley.operators import order, stored
from parley.operators import vocab as vo
from parley.plans.mix import Corpus, mixed_corpus
from parley.plans.training import training_batches, training_positions, write_chat_examples
from parley.plans.vocabulary import chat_token_freq, draft_vocabulary
from parley.session import scratch_scope
from parley.sources import checks, readers, writers

FOLDER = "/root/testdata/sf0.001"


def test_from_mix_to_batches(spark, tmp_path):
    path = str(tmp_path)
    with scratch_scope(spark):
        chats = inp.ultrachat(spark, FOLDER)
        n = chats.count()
        mixed = mixed_corpus([Corpus("ultra", chats, "ultrachat", key="conv_id", cap=n - 3)], seed=42)
        writers.write_corpus(mixed, f"{path}/mixed")
        corpus = readers.scan_corpus(spark, f"{path}/mixed")
        assert corpus.count() == n - 3

        split = order.train_val_split(stored.scan_in_order(spark, f"{path}/mixed"), frac=0.8)
        assert [r["key"] for r in split.orderBy("pos").collect()] == [r["key"] for r in mixed.collect()]
        train = split.where("split = 'train'").drop("split", "n_rows", "pos")
        assert train.count() == int(0.8 * (n - 3))

        counts = chat_token_freq(train.select("conversations"), "qwen")
        assert counts.report.collect()[0]["records"] == train.count()
        maps = draft_vocabulary(counts.freq, r=256, vocab_size=128_256, eos=7)
        writers.write_vocab_map(maps.d2t, maps.t2d, f"{path}/vocab", model="m")
        d2t, t2d, report = readers.scan_vocab_map(spark, f"{path}/vocab")
        assert d2t.count() == 256 and t2d.where("in_draft").count() == 256

        records = train.select(F.col("key").alias("index"), "conversations")
        run = write_chat_examples(records, "index", "qwen", f"{path}/run", max_len=32768, cap=600)
        stats = run.stats.collect()[0]
        examples = spark.read.parquet(f"{path}/run/examples").where("bucket <> 'none'")
        assert examples.count() + stats["dropped_count"] == train.count()
        assert set(checks.written_keys(spark, f"{path}/run/examples").collect()) == set(records.select("index").collect())
        again = fl.skip_done(records, checks.written_keys(spark, f"{path}/run/examples"), "index")
        assert again.count() == 0
        checked = checks.check_files(spark, f"{path}/run/examples")
        assert fl.validation_summary(checked).collect()[0]["corrupt"] == 0

        masked = vo.array_in_draft(examples, maps.t2d, 128_256)
        assert masked.where(F.exists(F.zip_with("position_mask", "loss_mask", lambda a, b: a > b), lambda x: x)).count() == 0

        positions = training_positions(examples, 600)
        seen = []
        for epoch in (0, 1):
            batches, dropped = training_batches(examples, epoch, ranks=2, batch_size=4, cap=600, positions=positions)
            rows = batches.select("index", "rank", "batch", "slot", F.size("input_ids").alias("n"), F.size("loss_mask").alias("m"), "pad_len").collect()
            assert {r["index"] for r in rows} == {r["index"] for r in examples.select("index").collect()}
            assert all(r["n"] == r["m"] == r["pad_len"] for r in rows)
            assert len({(r["rank"], r["batch"], r["slot"]) for r in rows}) == len(rows)
            assert dropped.collect()[0]["dropped"] == 0
            seen.append([r["index"] for r in sorted(rows, key=lambda r: (r["rank"], r["batch"], r["slot"]))])
        assert seen[0] != seen[1]
