"""Token frequencies and the reduced draft vocabulary built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.bitmaps import bitmap_of, bitmaps_by, in_bitmap
from parley.session import broadcast_within


def token_freq_all(df: DataFrame, ids: str | Column = "input_ids") -> DataFrame:
    """AGG-1: how often each token occurs. ``ids`` is an array column.

    Counts are combined before the shuffle, so a frequent token costs one row per task.
    """
    return df.select(F.explode(ids).alias("token_id")).groupBy("token_id").agg(F.count(F.lit(1)).alias("freq"))


def token_freq_supervised(df: DataFrame, ids: str = "input_ids", mask: str = "loss_mask") -> DataFrame:
    """AGG-2: the same over positions whose mask is 1."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(ids).alias("t"), F.col(mask).alias("m"))).alias("x"))
    return (
        pairs.where("x.m = 1")
        .groupBy(F.col("x.t").alias("token_id"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def token_totals(freq: DataFrame) -> DataFrame:
    """AGG-3."""
    return freq.agg(
        F.coalesce(F.sum("freq"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("distinct_tokens")
    )


def freq_order(freq: DataFrame) -> DataFrame:
    """ORD-9: by frequency, ties by token id."""
    return freq.orderBy(F.desc("freq"), F.asc("token_id"))


def top_tokens(freq: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent tokens with their rank (1, 2, ...)."""
    by_rank = Window.orderBy(F.desc("freq"), F.asc("token_id"))
    return freq_order(freq).limit(k).withColumn("rank", F.row_number().over(by_rank))


def token_top_share(freq: DataFrame, k: int = 10, vocab: DataFrame | None = None) -> DataFrame:
    """AGG-4: rank, token, count and percent of all tokens; token texts when ``vocab`` is given."""
    total = freq.agg(F.sum("freq").alias("t")).scalar()
    top = top_tokens(freq, k).withColumn("percent", F.col("freq") / total * 100.0)
    if vocab is not None:
        named = vocab.join(broadcast_within(top.select("token_id"), k), "token_id", "left_semi")
        top = top.join(broadcast_within(named.select("token_id", "token"), k), "token_id", "left")
    return top


def eos_member(top: DataFrame, eos: int) -> DataFrame:
    """JON-6: one row, is ``eos`` among the tokens of ``top``?"""
    return top.agg(
        F.lit(eos).alias("eos"), F.coalesce(F.bool_or(F.col("token_id") == eos), F.lit(False)).alias("included")
    )


def members(bits: DataFrame, ids, vocab_size: int) -> DataFrame:
    """JON-6 for several ids against one packed set, as ``draft_bitmap`` gives: (token_id, included)."""
    asked = bits.select("bits", F.explode(F.array(*[F.lit(int(i)) for i in ids])).alias("token_id"))
    return asked.select("token_id", in_bitmap(F.col("bits"), F.col("token_id"), vocab_size).alias("included"))


def draft_bitmap(draft: DataFrame, vocab_size: int) -> DataFrame:
    """One row with the packed set ``bits`` of the draft's ids; ``draft`` is a draft vocabulary or a ``t2d`` map of one size."""
    chosen = draft.where("in_draft") if "in_draft" in draft.columns else draft
    return bitmap_of(chosen, "token_id", vocab_size)


def draft_vocab(freq: DataFrame, r, eos: int | None = None) -> DataFrame:
    """AGG-5: the ``r`` most frequent tokens, for one or several ``r`` at once.

    When ``eos`` is given and not among them it takes the last place. Rows are
    (r, token_id, freq, rank, injected); rank and freq are null for an injected eos.
    """
    sizes = sorted({int(r)} if isinstance(r, int) else {int(x) for x in r})
    ranked = top_tokens(freq, sizes[-1])
    per_size = (
        ranked.withColumn("r", F.explode(F.array(*[F.lit(s) for s in sizes])))
        .where(F.col("rank") <= F.col("r"))
        .withColumn("injected", F.lit(False))
    )
    columns = ["r", "token_id", "freq", "rank", "injected"]
    if eos is None:
        return per_size.select(columns)
    eos_rank = F.min(F.when(F.col("token_id") == eos, F.col("rank"))).over(Window.partitionBy("r"))
    itself = F.struct("token_id", "freq", "rank", "injected")
    types = freq.schema
    added = F.struct(
        F.lit(eos).cast(types["token_id"].dataType).alias("token_id"),
        F.lit(None).cast(types["freq"].dataType).alias("freq"),
        F.lit(None).cast("int").alias("rank"),
        F.lit(True).alias("injected"),
    )
    # The last row makes room; the first one brings eos along (with r = 1 they are the same row).
    missing = F.col("_eos").isNull()
    rows = F.filter(
        F.array(F.when(~missing | (F.col("rank") < F.col("r")), itself), F.when(missing & (F.col("rank") == 1), added)),
        lambda x: x.isNotNull(),
    )
    return per_size.withColumn("_eos", eos_rank).select("r", F.explode(rows).alias("x")).select("r", "x.*")


def draft_coverage(freq: DataFrame, r, eos: int | None = None, include_injected: bool = False) -> DataFrame:
    """AGG-6: share of all occurrences that the draft vocabulary covers, per ``r``.

    An injected eos adds nothing unless ``include_injected``.
    """
    own = F.sum(F.when(F.col("token_id") == eos, F.col("freq"))) if eos is not None else F.lit(0)
    sums = freq.agg(F.struct(F.sum("freq").alias("total"), F.coalesce(own, F.lit(0)).alias("eos")).alias("s")).scalar()
    covered = F.sum(F.coalesce("freq", F.lit(0)))
    chosen = draft_vocab(freq, r, eos).groupBy("r").agg(
        F.count(F.lit(1)).alias("tokens"),
        covered.alias("covered"),
        F.max(F.col("injected").cast("int")).alias("_injected"),
    )
    if include_injected and eos is not None:
        chosen = chosen.withColumn("covered", F.col("covered") + F.col("_injected") * sums["eos"])
    return chosen.drop("_injected").withColumn("coverage", F.col("covered") / sums["total"])


def d2t_offsets(draft: DataFrame) -> DataFrame:
    """WIN-2: ids in ascending order get draft ids 0, 1, ...; offset = token id - draft id.

    With a column ``r`` one map per size. A map has at most r rows.
    """
    by = ["r"] if "r" in draft.columns else []
    place = F.row_number().over(Window.partitionBy(*by).orderBy("token_id")) - 1
    return draft.select(
        *by,
        place.cast("int").alias("draft_id"),
        F.col("token_id").cast("int").alias("token_id"),
        (F.col("token_id") - place).cast("int").alias("offset"),
    )


def t2d_mask(spark: SparkSession, draft: DataFrame, vocab_size: int) -> DataFrame:
    """JON-1: for every id of the target vocabulary, is it in the draft?

    The draft is one packed set per size, which every id is tested against.
    """
    by = ["r"] if "r" in draft.columns else []
    target = spark.range(vocab_size).select(F.col("id").cast("int").alias("token_id"))
    if not by:
        bits = draft_bitmap(draft, vocab_size).scalar()
        return target.select("token_id", in_bitmap(bits, F.col("token_id"), vocab_size).alias("in_draft"))
    # As many sets as sizes, in the order of the sizes.
    bits = bitmaps_by(draft, "r", "token_id", vocab_size).scalar()
    rows = target.select("token_id", F.explode(bits).alias("_s"))
    return rows.select("_s.key", "token_id", in_bitmap(F.col("_s.bits"), F.col("token_id"), vocab_size).alias("in_draft")).withColumnRenamed("key", "r")


def supervised_in_draft(
    tokens: DataFrame, t2d: DataFrame, vocab_size: int, target: str = "target", mask: str = "loss_mask"
) -> DataFrame:
    """JON-2: adds ``position_mask`` = target is in the draft vocabulary, times the loss mask.

    Each position is tested against the packed set of the draft's ids; there is no join.
    """
    bits = draft_bitmap(t2d, vocab_size).scalar()
    known = in_bitmap(bits, F.col(target), vocab_size).cast("int")
    return tokens.withColumn("position_mask", (known * F.col(mask)).cast("int"))


def array_in_draft(df: DataFrame, t2d: DataFrame, vocab_size: int, ids: str = "input_ids", mask: str = "loss_mask") -> DataFrame:
    """JON-2 over whole sequences: adds ``position_mask``, an array, from arrays of ids and mask."""
    bits = draft_bitmap(t2d, vocab_size).scalar()
    rows = df.withColumn("_bits", bits)
    own = F.zip_with(ids, mask, lambda t, m: (in_bitmap(F.col("_bits"), t, vocab_size).cast("int") * m).cast("int"))
    return rows.withColumn("position_mask", own).drop("_bits")


def draft_to_target(df: DataFrame, d2t: DataFrame, max_rows: int, draft_id: str = "draft_id") -> DataFrame:
    """JON-3: adds ``token_id`` = draft id + offset; null for an id outside the map."""
    offsets = d2t.select(F.col("draft_id").alias(draft_id), "offset")
    joined = df.join(broadcast_within(offsets, max_rows), draft_id, "left")
    return joined.withColumn("token_id", F.col(draft_id) + F.col("offset")).drop("offset")


def vocab_map_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """JON-4: compare two maps, both as ``d2t`` (offsets) or both as ``t2d`` (flags).

    One row: sizes, whether they are equal, largest and mean difference of the
    offsets or the number of differing flags. Differences are null for maps of
    different sizes, which are not comparable.
    """
    key, value = ("draft_id", "offset") if "offset" in a.columns else ("token_id", "in_draft")
    left = a.select(key, F.col(value).cast("long").alias("_a"))
    right = b.select(key, F.col(value).cast("long").alias("_b"))
    both = left.join(right, key, "full_outer")
    off = F.abs(F.col("_a") - F.col("_b"))
    sums = both.agg(
        F.count("_a").alias("size_a"),
        F.count("_b").alias("size_b"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"),
        F.max(off).alias("max_diff"),
        F.avg(off).alias("mean_diff"),
    )
    same = F.col("size_a") == F.col("size_b")
    return sums.select(
        "size_a",
        "size_b",
        (same & (F.col("differing") == 0)).alias("equal"),
        F.when(same, F.col("differing")).alias("differing"),
        F.when(same, F.coalesce("max_diff", F.lit(0))).alias("max_diff"),
        F.when(same, F.coalesce("mean_diff", F.lit(0.0))).alias("mean_diff"),
    )


def decode_tokens(df: DataFrame, vocab: DataFrame, key: str, vocab_size: int, ids: str = "input_ids", sep: str = "") -> DataFrame:
    """JON-5: ids back to text. ``vocab`` is (token_id, token); an unknown id shows as ``<token_N>``.

    ``vocab_size`` bounds the rows of the vocabulary. It is broadcast, so that frequent
    tokens stay where they are; beyond the limit of broadcasts, sizes decide.
    """
    rows = df.select(key, F.posexplode_outer(ids).alias("_pos", "token_id"))
    named = rows.join(broadcast_within(vocab.select("token_id", "token"), vocab_size), "token_id", "left")
    text = F.coalesce("token", F.concat(F.lit("<token_"), F.col("token_id").cast("string"), F.lit(">")))
    one = F.when(F.col("_pos").isNotNull(), F.struct("_pos", text.alias("text")))
    back = named.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_t"))
    return back.select(key, F.array_join(F.transform("_t", lambda t: t["text"]), sep).alias("text"))
