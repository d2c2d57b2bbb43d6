"""Positions, shuffles, samples, shards, splits and batch plans.

Two ways to number rows, neither of which sorts everything in one task:

``global_position``    by given columns: one range shuffle, written once, so that
                       counting and numbering see the same partitions
``shuffled_position``  by ``md5(seed:key)``: the leading hex digits of the hash cut
                       the rows into even segments, so nothing has to be written
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.permute import permute

from parley.session import broadcast_within, materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _names(order_by) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def _starts(counts: DataFrame, segment: str, bound: int) -> DataFrame:
    """(segment, n, start, total) from (segment, n); at most ``bound`` rows."""
    before = Window.orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(segment).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(
        segment,
        "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"),
        F.sum("n").over(everything).alias("_total"),
    )
    return broadcast_within(starts, bound)


def global_position(
    df: DataFrame, order_by, pos: str = "pos", total: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Add ``pos`` = 0, 1, 2, ... in the order of ``order_by``.

    Rows with equal keys are told apart by a hash of all their columns, and equal rows
    by where they come from, so that neither lie in one partition. The ranged rows are
    written once; from then on their places are fixed. Keep ``df`` narrow, and a
    written table or cheap to work out: finding the ranges reads it once more.
    ``total`` names a column for the number of rows.
    """
    keys = _names(order_by)
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    tied = tied.withColumn("_from", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(parts, *keys, "_tie", "_from").sortWithinPartitions(*keys, "_tie", "_from")
    ranged = ranged.drop("_tie", "_from")
    rows = materialise(ranged.withColumn("_mid", F.monotonically_increasing_id()), "position")
    part = F.shiftright("_mid", _ROW_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    starts = _starts(counts, "_part", parts)
    row = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    out = rows.withColumn("_part", part).join(starts, "_part")
    extra = [F.col("_total").alias(total)] if total else []
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + row).alias(pos), *extra)


def positioned(df: DataFrame, order_by) -> DataFrame:
    """Add ``pos`` and ``n_rows`` once; the operators below then take ``order_by=None``."""
    return global_position(df, order_by, total="n_rows")


def _placed(df: DataFrame, order_by) -> DataFrame:
    if order_by is not None:
        return positioned(df, order_by)
    missing = {"pos", "n_rows"} - set(df.columns)
    if missing:
        raise ValueError(f"without order_by the rows need {sorted(missing)}")
    return df


def _unplaced(df: DataFrame, order_by, *names: str) -> DataFrame:
    return df if order_by is None else df.drop(*names)


def shuffle_key(key, seed) -> Column:
    """The hash a seeded shuffle sorts by."""
    columns = [F.col(k) if isinstance(k, str) else k for k in ([key] if isinstance(key, (str, Column)) else key)]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def seeded_shuffle(df: DataFrame, key, seed) -> DataFrame:
    """ORD-1: a permutation that depends on the seed and the row keys only."""
    return df.withColumn("_h", shuffle_key(key, seed)).orderBy("_h", *_names(key)).drop("_h")


def shuffled_position(
    df: DataFrame,
    key,
    seed,
    pos: str = "pos",
    total: str | None = None,
    digits: int = 4,
) -> DataFrame:
    """The position each row gets in ``seeded_shuffle``, without sorting globally.

    ``key`` must be unique: the hash then spreads the rows evenly over the segments.
    """
    rows = df.withColumn("_h", shuffle_key(key, seed))
    segment = F.substring("_h", 1, digits)
    counts = rows.groupBy(segment.alias("_seg")).agg(F.count(F.lit(1)).alias("n"))
    starts = _starts(counts, "_seg", 16**digits)
    inside = Window.partitionBy("_seg").orderBy("_h", *_names(key))
    out = rows.withColumn("_seg", segment).join(starts, "_seg")
    out = out.withColumn("_pos", F.col("_start") + F.row_number().over(inside) - 1)
    extra = [F.col("_total").alias(total)] if total else []
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_pos").alias(pos), *extra)


def _first_shuffled(df: DataFrame, key, seed, limit: Column, digits: int = 4) -> DataFrame:
    """The first rows of ``seeded_shuffle``; ``limit`` may use ``_total``, the number of rows.

    Hashes alone go through one exchange, by their leading digits. Segments are counted
    behind it, and the one on the edge is ranked there as well, to find the last hash that
    stays; both read the same exchange. The rows themselves pass through a filter and
    are not shuffled. ``df`` is read twice, once for its keys alone.
    """
    rows = df.withColumn("_h", shuffle_key(key, seed))
    segment = F.substring("_h", 1, digits)
    # One column, so that no reader of the exchange wants less than another; the number of partitions is given for the same reason.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = rows.select("_h").repartition(parts, segment)
    starts = _starts(hashes.groupBy(segment.alias("_seg")).agg(F.count(F.lit(1)).alias("n")), "_seg", 16**digits)
    whole = starts.where(F.col("_start") + F.col("n") <= limit).agg(F.max("_seg").alias("x")).scalar()
    edge = starts.where((F.col("_start") < limit) & (F.col("_start") + F.col("n") > limit))
    edge = broadcast_within(edge.select("_seg", (limit - F.col("_start")).alias("_room")), 1)
    ranked = hashes.withColumn("_seg", segment).join(edge, "_seg")
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("_seg").orderBy("_h")))
    last = ranked.where(F.col("_rank") <= F.col("_room")).agg(F.max("_h").alias("x")).scalar()
    stays = F.coalesce(segment <= whole, F.lit(False)) | F.coalesce(F.col("_h") <= last, F.lit(False))
    return rows.where(stays).drop("_h")


def cap_sample(df: DataFrame, n: int, key, seed, rows: int | None = None) -> DataFrame:
    """ORD-2: all rows when there are at most ``n``, else ``n`` of them chosen by the seed.

    ``rows`` is the number of rows where it is known, as from the footers of a stored
    table; if it is within ``n``, nothing is worked out.
    """
    if rows is not None and rows <= n:
        return df
    return _first_shuffled(df, key, seed, F.lit(n))


def ratio_sample(df: DataFrame, ratio: float, key, seed) -> DataFrame:
    """ORD-3: ``int(rows * ratio)`` rows chosen by the seed."""
    keep = F.floor(F.col("_total") * F.lit(float(ratio)))
    return _first_shuffled(df, key, seed, keep)


def slice_by_rank(df: DataFrame, k: int, ratio: float, order_by=None) -> DataFrame:
    """ORD-4: the k-th slice of ``int(rows * ratio)`` rows; adds ``pos``."""
    placed = _placed(df, order_by)
    size = F.floor(F.col("n_rows") * F.lit(float(ratio)))
    stop = F.least(size * (k + 1), F.col("n_rows"))
    return _unplaced(placed.where((F.col("pos") >= size * k) & (F.col("pos") < stop)), order_by, "n_rows")


def round_robin_shard(df: DataFrame, n: int, order_by=None) -> DataFrame:
    """ORD-5: adds ``pos`` and ``shard`` = position modulo ``n``."""
    sharded = _placed(df, order_by).withColumn("shard", (F.col("pos") % n).cast("int"))
    return _unplaced(sharded, order_by, "n_rows")


def train_val_split(df: DataFrame, order_by=None, frac: float = 0.95) -> DataFrame:
    """ORD-6: adds ``pos`` and ``split``; the first ``int(frac * rows)`` rows are train."""
    cut = F.floor(F.col("n_rows") * F.lit(float(frac)))
    split = F.when(F.col("pos") < cut, "train").otherwise("val")
    return _unplaced(_placed(df, order_by).withColumn("split", split), order_by, "n_rows")


def epoch_plan(df: DataFrame, epoch: int, ranks: int, key, seed, shuffle: bool = True) -> DataFrame:
    """ORD-7: (rank, step) for every row of one epoch.

    Positions run round robin over the ranks. The last round is filled up with
    rows from the start, so every rank has the same number of steps.
    """
    if shuffle:
        placed = shuffled_position(df, key, f"{seed}:{epoch}", pos="_p", total="_n")
    else:
        placed = global_position(df, key, pos="_p", total="_n")
    return _dealt(placed, df.columns, epoch, ranks)


def epoch_plan_keyed(placed: DataFrame, n: int, epoch: int, ranks: int, seed, pos: str = "pos", shuffle: bool = True) -> DataFrame:
    """ORD-7 over rows that have positions 0 .. n - 1 already, as from ``stored_position`` or a table made once.

    Every epoch is another permutation of the positions, worked out row by row, so rows
    stay where they are in all epochs. Each rank gets as many steps, as in ``epoch_plan``.
    """
    rows = placed.withColumn("_n", F.lit(n).cast("long"))
    if shuffle:
        rows = permute(rows, pos, n, f"{seed}:{epoch}", out="_p")
    else:
        rows = rows.withColumn("_p", F.col(pos).cast("long"))
    return _dealt(rows, placed.columns, epoch, ranks)


def epoch_positions(df: DataFrame, key) -> tuple[DataFrame, int]:
    """(rows with ``pos``, their number) for ``epoch_plan_keyed``: placed and written once for all epochs. Keep ``df`` narrow."""
    placed = materialise(global_position(df, key), "epochs")
    return placed, placed.count()


def _dealt(placed: DataFrame, columns: list[str], epoch: int, ranks: int) -> DataFrame:
    padded = F.ceil(F.col("_n") / ranks) * ranks
    copies = F.floor((padded - 1 - F.col("_p")) / F.col("_n"))
    spread = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
    at = F.col("_p") + F.col("_copy") * F.col("_n")
    return spread.select(
        *[F.col(f"`{c}`") for c in columns],
        F.lit(epoch).alias("epoch"),
        (at % ranks).cast("int").alias("rank"),
        F.floor(at / ranks).alias("step"),
    )


def batch_plan(plan: DataFrame, size: int, accumulation: int | None = None) -> DataFrame:
    """ORD-8: consecutive steps of a rank form batches of ``size`` rows; adds ``batch`` and ``slot``.

    With ``accumulation`` that many batches of every rank make one step of the optimiser,
    ``opt_step``; the last one may have fewer.
    """
    out = plan.withColumn("batch", F.floor(F.col("step") / size)).withColumn("slot", (F.col("step") % size).cast("int"))
    return out if accumulation is None else out.withColumn("opt_step", F.floor(F.col("batch") / accumulation))


def batch_sizes(size: int, accumulation: int, ranks: int) -> dict[str, int]:
    """ORD-8: rows per batch in training, in validation, and per optimiser step over all ranks."""
    return {"train": size, "val": 2 * size, "global": size * accumulation * ranks}


def validation_plan(placed: DataFrame, n: int, ranks: int, size: int, pos: str = "pos") -> DataFrame:
    """ORD-8: the validation side, in stored order: batches of twice the size, the same ones in every epoch."""
    plan = epoch_plan_keyed(placed, n, 0, ranks, None, pos, shuffle=False).drop("epoch")
    return batch_plan(plan, batch_sizes(size, 1, ranks)["val"])


def optimiser_steps(plan: DataFrame, size: int, accumulation: int, ranks: int) -> DataFrame:
    """ORD-8: (opt_step, rows, batches, is_full) over all ranks; ``plan`` is a ``batch_plan`` with accumulation."""
    whole = batch_sizes(size, accumulation, ranks)["global"]
    steps = plan.groupBy("opt_step").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("rank", "batch").alias("batches"))
    return steps.withColumn("is_full", F.col("rows") == whole)


def resume_from_step(plan: DataFrame, start_step: int, step: str = "step") -> DataFrame:
    """FLT-13: what is left of a plan when the steps before ``start_step`` are done."""
    return plan.where(F.col(step) >= start_step)


def drop_every_nth(df: DataFrame, order_by=None, n: int = 3, preview: bool = False) -> DataFrame:
    """FLT-9: in sorted order drop rows n, 2n, 3n, ...

    With ``preview`` nothing is dropped; the result is the first ten rows that
    would go, each with the number of all rows that would.
    """
    placed = _placed(df, order_by)
    nth = (F.col("pos") + 1) % n == 0
    if not preview:
        return _unplaced(placed.where(~nth), order_by, "pos", "n_rows")
    gone = placed.where(nth).withColumn("n_dropped", F.floor(F.col("n_rows") / n))
    return _unplaced(gone.orderBy("pos").limit(10), order_by, "pos", "n_rows")


def name_order(df: DataFrame, name: str = "name") -> DataFrame:
    """ORD-10."""
    return df.orderBy(name)


def limit_samples(df: DataFrame, n: int | None, order_by, edge_rows: int = 1_000_000, sample_rows: int = 10_000) -> DataFrame:
    """ORD-11: the first ``n`` rows in a given order, equal keys by a hash of the row; all rows when ``n`` is None.

    A bounded sample of the keys gives two cuts around the n-th row, a count tells how many
    rows lie below and between them, and so on inside until at most ``edge_rows`` are
    between. Rows below the cuts pass through a filter; those between are ranked, and they alone
    are shuffled. Where equal rows alone fill the edge, it is put in order by
    ``global_position``. ``df`` is read for its keys twice a round, each time fewer of
    them, then once for either part.
    """
    if n is None:
        return df
    total = df.count()
    if n >= total:
        return df
    keys = _names(order_by)
    tied = df.withColumn("_row_hash", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    cuts = _Cuts(tied, [*keys, "_row_hash"])
    first, inside = 0, total
    while inside > edge_rows:
        lower, upper = cuts.narrowed(n - first, inside, sample_rows)
        low, high = cuts.count(lower, upper, inside)
        if low >= n - first:
            lower, low = cuts.lower, 0
        if high < n - first:
            upper, high = cuts.upper, inside
        if high - low == inside:
            break
        cuts.lower, cuts.upper = lower, upper
        first, inside = first + low, high - low
    edge = cuts.between()
    if inside <= edge_rows:
        edge = edge.orderBy(*keys, "_row_hash").limit(n - first)
    else:
        edge = global_position(edge, [*keys, "_row_hash"], pos="_at").where(F.col("_at") < n - first).drop("_at")
    out = edge if cuts.lower is None else cuts.below().unionByName(edge)
    return out.drop("_row_hash")


class _Cuts:
    """Rows between two places in an order; a place is the values of all keys, None is open."""

    def __init__(self, df: DataFrame, keys: list[str]):
        self.df, self.keys, self.lower, self.upper = df, keys, None, None
        self.types = [f.dataType for f in df.select(*keys).schema.fields]
        self.place = F.struct(*keys)

    def _at(self, values) -> Column:
        return F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(values, self.types, self.keys)])

    def _first_key(self, values, below: bool) -> Column:
        """The same cut by the first key alone, which a scan can use to leave out what lies beyond."""
        key, value = F.col(self.keys[0]), values[0]
        if value is None or value != value:
            return F.lit(True)
        bound = F.lit(value).cast(self.types[0])
        return (key.isNull() | (key <= bound)) if below else key >= bound

    def below(self) -> DataFrame:
        return self.df.where(self._first_key(self.lower, True) & (self.place < self._at(self.lower)))

    def between(self) -> DataFrame:
        out = self.df
        if self.lower is not None:
            out = out.where(self._first_key(self.lower, False) & (self.place >= self._at(self.lower)))
        if self.upper is not None:
            out = out.where(self._first_key(self.upper, True) & (self.place < self._at(self.upper)))
        return out

    def narrowed(self, n: int, rows: int, most: int):
        """Two places with the n-th of ``rows`` rows in all likelihood between them, from at most 4 * ``most`` sampled places."""
        grain = 1 << 30
        chance = int(min(1.0, most / rows) * grain)
        drawn = self.between().where(F.pmod(F.xxhash64("_row_hash", F.lit(rows)), F.lit(grain)) < chance)
        sample = drawn.select(*self.keys).orderBy(*self.keys).limit(4 * most).collect()
        share = n / rows
        room = 4 * (share * (1 - share) * len(sample)) ** 0.5 + 4
        low, high = math.floor(share * len(sample) - room), math.ceil(share * len(sample) + room)
        return sample[low] if 0 <= low < len(sample) else self.lower, sample[high] if 0 <= high < len(sample) else self.upper

    def count(self, lower, upper, rows: int) -> tuple[int, int]:
        """How many of the rows between lie below either place."""
        low = F.count_if(self.place < self._at(lower)) if lower is not None else F.lit(0)
        high = F.count_if(self.place < self._at(upper)) if upper is not None else F.lit(rows)
        got = self.between().agg(low.alias("low"), high.alias("high")).collect()[0]
        return got["low"], got["high"]


def next_valid(
    df: DataFrame, order_by, valid: str, pos: str = "pos", out: str = "use_pos", segment_rows: int = 1_000_000, carry: dict[str, str] | None = None
) -> DataFrame:
    """WIN-4: for each row the position of the next usable row, itself included, wrapping round.

    ``carry`` maps columns of that row to names under which they come along, which saves a join
    by position. Rows are looked at in segments of equal size; only one usable row per
    segment is carried between them. Null when no row is usable. Windows run from the last
    row back to the first: a frame that ends at the current row grows by one row at a time,
    one that starts there would be worked out anew for each row.
    """
    placed = global_position(df, order_by, pos=pos, total="_n")
    taken = carry or {}
    seg = F.floor(F.col(pos) / segment_rows)
    at = F.when(F.col(valid), F.struct(F.col(pos).alias("_at"), *[F.col(c).alias(name) for c, name in taken.items()]))
    ahead = Window.partitionBy("_seg").orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumn("_seg", seg).withColumn("_here", F.last(at, ignorenulls=True).over(ahead))

    firsts = placed.groupBy(seg.alias("_seg")).agg(F.min_by(at, F.when(F.col(valid), F.col(pos))).alias("_first"))
    later = Window.orderBy(F.desc("_seg")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("_seg")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.last("_first", ignorenulls=True)
    carried = firsts.select("_seg", F.coalesce(first.over(later), first.over(whole)).alias("_later"))
    found = rows.join(carried, "_seg").withColumn("_use", F.coalesce("_here", "_later"))
    extra = {out: F.col("_use._at")} | {name: F.col(f"_use.{name}") for name in taken.values()}
    return found.withColumns(extra).drop("_seg", "_here", "_later", "_use", "_n")
