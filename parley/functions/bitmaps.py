"""Sets of small ids as packed bits: one bit an id, tested by an expression instead of a join.

A set over ids 0 .. size - 1 is an array of size / 64 longs, some 16 KB for a vocabulary of
128,256, whatever the number of rows that are tested against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = 64


def _words(df: DataFrame, ids: Column, size: int, *by: str) -> DataFrame:
    """(by, _word, _bits), one bit set in each row."""
    named = df.select(*by, ids.cast("long").alias("_id")).where(F.col("_id").between(0, size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_id") % _WORD).cast("int"))
    return named.select(*by, F.expr(f"_id div {_WORD}").alias("_word"), bit.alias("_bits"))


def bitmap_of(df: DataFrame, ids: str | Column, size: int) -> DataFrame:
    """One row with ``bits``, the set of ``ids`` as longs.

    Bits of one long are combined before the shuffle; size / 64 rows come together at the end.
    """
    column = F.col(ids) if isinstance(ids, str) else ids
    every = df.sparkSession.range(-(-size // _WORD)).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = _words(df, column, size).unionByName(every).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    held = F.sort_array(F.collect_list(F.struct("_word", "_bits")))
    return words.agg(F.transform(held, lambda w: w["_bits"]).alias("bits"))


def bitmaps_by(df: DataFrame, by: str, ids: str, size: int) -> DataFrame:
    """One row with ``sets``, an array of (key, bits) in the order of the keys; for few keys and a vocabulary's size."""
    words = _words(df, F.col(ids), size, by).groupBy(by, "_word").agg(F.bit_or("_bits").alias("_bits"))
    held = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(-(-size // _WORD) - 1).cast("long"))
    bits = F.transform(every, lambda k: F.coalesce(F.try_element_at(held, k), F.lit(0).cast("long")))
    each = words.groupBy(by).agg(bits.alias("bits"))
    return each.agg(F.sort_array(F.collect_list(F.struct(F.col(by).alias("key"), "bits"))).alias("sets"))


def in_bitmap(bits: Column, value: Column, size: int) -> Column:
    """Whether ``value`` is in the set; false for null and for what is outside 0 .. size - 1."""
    inside = value.between(0, size - 1)
    word = F.get(bits, F.call_function("shiftright", value.cast("long"), F.lit(6)).cast("int"))
    bit = F.getbit(word, (value % _WORD).cast("int"))
    return F.coalesce(F.when(inside, bit == 1), F.lit(False))
