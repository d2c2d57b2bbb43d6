"""Conversations to masked token sequences, and those to padded batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from parley.functions import arrays as ar
from parley.functions import masks as mk
from parley.functions import tokens as tk
from parley.functions import turns as tn
from parley.operators import examples as ex
from parley.operators import filters as fl
from parley.operators import normalise as nm
from parley.operators import order
from parley.sources import writers as wr


def encode_words(text: Column, turns: Column, instructions: Column) -> Column:
    """The built-in word tokeniser in the shape of ``pluggable_chat_encoder``; it never fails."""

    def count(texts: Column) -> Column:
        return F.transform(texts, lambda t: F.size(tk.words(t)))

    return F.struct(
        tk.tokenise(text).alias("ids"),
        count(turns).alias("turn_len"),
        count(instructions).alias("instr_len"),
        F.lit(None).cast("string").alias("error"),
    )


def chat_examples(
    df: DataFrame,
    key: str,
    family: str,
    turns: str = "turns",
    max_len: int = 32768,
    model_limit: int | None = None,
    encode=encode_words,
    legacy: bool = False,
) -> DataFrame:
    """(index, input_ids, loss_mask, seq_len, fallback, error) from canonical turns.

    Rendered once; a conversation without a template for a role is its texts joined
    instead (``fallback``). Ids are cut at the smaller of ``max_len`` and
    ``model_limit``. ``encode`` maps (text, turns, instructions) to ids, counts and an
    error; a row with an error has no ids, ``batches.split_failed`` sets them apart.
    """
    limit = max_len if model_limit is None else min(max_len, model_limit)
    sep = tk.SEPARATORS[family]
    rendered = df.select(
        F.col(key).alias("index"), F.col(turns).alias("_raw"), tk.render_chat(F.col(turns), family).alias("_form")
    )
    texts = rendered.select(
        "index", tn.concat_fallback(F.col("_form"), F.col("_raw")).alias("_text"), F.col("_form").isNull().alias("fallback")
    )
    usable = tk.valid_turn_prefix(tk.split_turns(F.col("_text"), sep["user"]), sep["assistant"])
    parts = texts.withColumn("_turns", usable)
    instructions = F.transform("_turns", lambda t: tk.instruction_part(t, sep["assistant"]))
    counted = parts.select("index", "fallback", encode(F.col("_text"), F.col("_turns"), instructions).alias("_e"))
    cut = counted.select(
        "index",
        "fallback",
        "_e.error",
        tk.truncate_ids(F.col("_e.ids"), limit).alias("input_ids"),
        F.col("_e.turn_len").alias("_t"),
        F.col("_e.instr_len").alias("_k"),
    )
    mask = mk.loss_mask(F.size("input_ids"), F.col("_t"), F.col("_k"), "legacy" if legacy else family)
    found = F.col("input_ids").isNotNull()
    return cut.select(
        "index",
        "input_ids",
        F.when(found, mask).alias("loss_mask"),
        F.when(found, F.size("input_ids")).alias("seq_len"),
        "fallback",
        "error",
    )


@dataclass(frozen=True)
class ExamplesRun:
    """What an examples run wrote and what it left out."""

    written: DataFrame  # (index, seq_len, bucket)
    failed: DataFrame  # (index, error)
    stats: DataFrame  # max_seq_len, dropped_count, bucket_stats
    path: str


def write_chat_examples(
    records: DataFrame,
    key: str,
    family: str,
    path: str,
    max_len: int,
    cap: int,
    done: DataFrame | None = None,
    edges=ar.BUCKETS,
    encode=encode_words,
) -> ExamplesRun:
    """Records in any chat layout to bucketed examples: choose the layout, skip what is done, render,
    encode, mask, drop above ``cap`` with a count, write by bucket with the statistics beside.

    Everything is worked out once, into ``path``/examples (rows without a bucket keep
    the bucket ``none``), and counted on the way there; what is returned reads from there.
    """
    spark = records.sparkSession
    turns = nm.dispatch_by_record(records, family, keep=(key,))
    todo = turns if done is None else fl.skip_done(turns, done, key)
    made = chat_examples(todo.where(F.col("turns").isNotNull()), key, family, max_len=max_len, encode=encode)
    counts, rule = Observation(), ex.run_rule(cap, edges)
    bucket = F.when(F.col("seq_len") <= cap, ar.length_bucket(F.col("seq_len"), edges))
    named = made.observe(counts, *rule.counts).withColumn("bucket", F.coalesce(bucket, F.lit("none")))
    wr.write_bucketed(named, f"{path}/examples")
    labels = ", ".join(f"`{label}` long" for _, _, label in edges)
    got = counts.get
    row = tuple(got[x] for x in ("max_seq_len", "dropped_count", *[label for _, _, label in edges]))
    stats = ex.stats_row(spark.createDataFrame([row], f"max_seq_len int, dropped_count long, {labels}"), edges)
    wr.write_stats(stats, f"{path}/stats")
    schema = "index long, input_ids array<int>, loss_mask array<int>, seq_len int, fallback boolean, error string, bucket string"
    back = spark.read.schema(schema).parquet(f"{path}/examples")
    written = back.where("bucket <> 'none'").select("index", "seq_len", "bucket")
    return ExamplesRun(written, back.where("error IS NOT NULL").select("index", "error"), stats, path)


def _placed_lengths(examples: DataFrame, cap: int, substitute: bool) -> DataFrame:
    """(index, _index, _len): the place of a row in the plan, the row that stands there, its length."""
    lengths = examples.select("index", "seq_len")
    usable = F.coalesce(F.col("seq_len") <= cap, F.lit(False))
    if not substitute:
        return lengths.where(usable).select("index", F.col("index").alias("_index"), F.col("seq_len").alias("_len"))
    stand_in = {"index": "_index", "seq_len": "_len"}
    placed = order.next_valid(lengths.withColumn("_ok", usable), "index", "_ok", carry=stand_in)
    return placed.where("use_pos IS NOT NULL").select("index", "_index", "_len")


def training_positions(examples: DataFrame, cap: int, substitute: bool = False) -> tuple[DataFrame, int]:
    """Positions of the rows that ``training_batches`` deals, by index, made once for all epochs."""
    return order.epoch_positions(_placed_lengths(examples, cap, substitute), "index")


def training_batches(
    examples: DataFrame,
    epoch: int,
    ranks: int,
    batch_size: int,
    cap: int,
    seed: int = 42,
    n: int | None = None,
    substitute: bool = False,
    positions: tuple[DataFrame, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(padded rows of one epoch, placed by (rank, batch, slot); one row with the number above ``cap``).

    Rows longer than ``cap``, or of unknown length, are left out and counted. With
    ``substitute`` they keep their place in the plan and the next usable row in the
    order of the index, wrapping round, stands in for them.

    ``positions``, as ``training_positions`` gives them, takes the place of sorting by a hash
    in every epoch: the plan is then worked out row by row from positions made once.

    The plan and the width of each batch are made from keys and lengths alone and
    joined back, so sequences are shuffled once. ``n`` pads to a fixed width.
    ``examples`` is read more than once and should be a written table.
    """
    kept, dropped = fl.length_cap(examples, cap)
    if positions is None:
        lengths = _placed_lengths(examples, cap, substitute)
        dealt = order.epoch_plan(lengths, epoch, ranks, "index", seed)
    else:
        dealt = order.epoch_plan_keyed(*positions, epoch, ranks, seed).drop("pos")
    plan = order.batch_plan(dealt, batch_size)
    plan = plan.withColumn("pad_len", F.max("_len").over(Window.partitionBy("rank", "batch")))
    plan = plan.select(F.col("_index").alias("index"), F.col("index").alias("place"), "epoch", "rank", "step", "batch", "slot", "pad_len")
    rows = ex.align_shift(kept, "offline").join(plan, "index")
    return ex.collate(rows, ("rank", "batch"), n=n), dropped
