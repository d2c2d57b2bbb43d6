"""From token sequences to training batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import arrays as ar
from parley.operators.filters import Rule
from parley.session import broadcast_within


def bucket_counts(df: DataFrame, edges=ar.BUCKETS, length: str = "seq_len") -> DataFrame:
    """AGG-12: rows per length bucket, zero for an empty one; rows outside all buckets are not counted."""
    named = df.select(ar.length_bucket(F.col(length), edges).alias("bucket")).where(F.col("bucket").isNotNull())
    counts = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    names = df.sparkSession.createDataFrame([(label,) for _, _, label in edges], "bucket string")
    joined = names.join(broadcast_within(counts, len(edges)), "bucket", "left")
    return joined.select("bucket", F.coalesce("rows", F.lit(0)).alias("rows"))


def run_rule(cap: int, edges=None, length: str = "seq_len") -> Rule:
    """AGG-13: what an examples run keeps, with ``max_seq_len``, ``dropped_count`` and, per bucket of ``edges``, a
    count named after it. A null length, and with ``edges`` a length outside all of them, is dropped."""
    keep = F.coalesce(F.col(length) <= cap, F.lit(False))
    buckets: list[Column] = []
    if edges is not None:
        bucket = ar.length_bucket(F.col(length), edges)
        keep = keep & bucket.isNotNull()
        buckets = [F.count_if(keep & (bucket == label)).alias(label) for _, _, label in edges]
    longest = F.coalesce(F.max(F.when(keep, F.col(length))), F.lit(0)).alias("max_seq_len")
    return Rule(keep, (longest, F.count_if(~keep).alias("dropped_count"), *buckets))


def run_stats(df: DataFrame, cap: int, edges=None, length: str = "seq_len") -> DataFrame:
    """AGG-13: one row with the longest kept sequence and the number dropped.

    With ``edges`` rows outside all buckets are dropped too, and ``bucket_stats``
    maps every bucket to its number of rows.
    """
    return stats_row(run_rule(cap, edges, length).counted(df), edges)


def stats_row(counts: DataFrame, edges=None) -> DataFrame:
    """The counts of ``run_rule`` with the buckets as one map."""
    if edges is None:
        return counts
    pairs = [x for _, _, label in edges for x in (F.lit(label), F.col(f"`{label}`"))]
    return counts.select("max_seq_len", "dropped_count", F.create_map(*pairs).alias("bucket_stats"))


def align_shift(df: DataFrame, mode: str = "offline") -> DataFrame:
    """ARR-12: next-token alignment of ids, states and mask.

    ``offline``  ids without the first; states and mask whole, last mask element 0
    ``online``   ids and mask without the first, states without the last
                 (a single state or mask element stays)
    ``older``    ids without the first; ``target`` is the states without the first,
                 last mask element 0
    ``states`` may be missing.
    """
    from parley.functions.masks import zero_last_mask

    ids, mask = F.col("input_ids"), F.col("loss_mask")
    has_states = "states" in df.columns
    columns = {"input_ids": ar.tail_of(ids)}
    if mode == "online":
        columns["loss_mask"] = F.when(F.size(mask) > 1, ar.tail_of(mask)).otherwise(mask)
        if has_states:
            columns["states"] = F.when(F.size("states") > 1, ar.head_of(F.col("states"))).otherwise(F.col("states"))
    elif mode in ("offline", "older"):
        columns["loss_mask"] = zero_last_mask(mask)
        if mode == "older" and has_states:
            columns["target"] = ar.tail_of(F.col("states"))
    else:
        raise ValueError(f"unknown alignment {mode!r}")
    return df.withColumns(columns)


def batch_max_len(df: DataFrame, batch=("batch",), ids: str = "input_ids") -> DataFrame:
    """AGG-15: the longest sequence of each batch."""
    return df.groupBy(*batch).agg(F.max(F.size(ids)).alias("max_len"))


def collate(
    df: DataFrame, batch=("batch",), n: int | None = None, extra: int = 0, overflow: str = "error"
) -> DataFrame:
    """ARR-15/16: pad ids and mask of each row to the batch maximum (or ``n``) and add the attention mask.

    The maximum counts the mask too, which is one longer than the ids after an
    offline alignment. A column ``pad_len`` that is there already is used as it is.
    """
    if n is not None:
        df = df.withColumn("pad_len", F.lit(n))
    elif "pad_len" not in df.columns:
        # A batch holds a fixed number of rows, so one window per batch is small.
        longest = F.greatest(F.size("input_ids") + extra, F.size("loss_mask"))
        df = df.withColumn("pad_len", F.max(longest).over(Window.partitionBy(*batch)))
    width = F.col("pad_len")
    return df.withColumns(
        {
            "attention_mask": ar.attention_mask(F.col("input_ids"), width, extra),
            "input_ids": ar.pad_to(F.col("input_ids"), width, overflow),
            "loss_mask": ar.pad_to(F.col("loss_mask"), width, overflow),
        }
    )


def parse_bucket_max(names: DataFrame, default: int = 2048, name: str = "name", largest: bool = False) -> DataFrame:
    """ARR-14: one row with the length limit told by directory names.

    The first name in sorted order that can be read decides, as do its quirks
    (``16K-32K`` sorts before ``2K-4K``); ``largest`` takes the greatest instead.
    """
    value = ar.bucket_max(F.col(name))
    readable = names.select(F.col(name), value.alias("v")).where(F.col("v").isNotNull())
    chosen = F.max("v") if largest else F.min_by("v", name)
    return readable.agg(F.coalesce(chosen, F.lit(default)).alias("max_len"))


def with_default_masks(df: DataFrame, masks=("attention_mask", "loss_mask")) -> DataFrame:
    """All-ones masks where a record has none (SRC-6, SRC-7)."""
    ones = F.array_repeat(F.lit(1), F.size("input_ids"))

    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("array<int>"), ones) if name in df.columns else ones

    return df.withColumns({name: value(name) for name in masks})
