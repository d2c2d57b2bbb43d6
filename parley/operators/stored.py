"""Positions of stored rows, from their files: nothing is sorted, shuffled or written.

A Parquet reader tells each row's file and its number in the file. With the rows per
file, which come from the files' footers, a running sum over the files gives every row its
position in stored order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.session import broadcast_within

_PATH, _ROW = "_metadata.file_path", "_metadata.row_index"


def file_order(path: str | Column) -> list[Column]:
    """Folder, number of the part if the name has one, name: part 100000 comes behind part 99999."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(path, "/"), -1)
    number = F.try_element_at(F.regexp_extract_all(name, F.lit(r"^part-(\d{1,18})"), F.lit(1)), F.lit(1)).cast("long")
    return [F.regexp_replace(path, "[^/]*$", ""), number, name]


def stored_rows(df: DataFrame) -> DataFrame:
    """(path, rows, start, total) of every file with rows, in stored order; only footers are read.

    ``df`` is what a reader of Parquet gave, with nothing done to it.
    """
    counts = df.select(F.col(_PATH).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy(*file_order("path")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(*file_order("path")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.coalesce(F.sum("rows").over(before), F.lit(0))
    return counts.select("path", "rows", start.alias("start"), F.sum("rows").over(every).alias("total"))


def stored_position(df: DataFrame, pos: str = "pos", total: str | None = "n_rows") -> DataFrame:
    """Adds ``pos`` = 0, 1, 2, ... in stored order and, unless None, ``total``, the number of rows.

    ``df`` is what a reader of Parquet gave, with nothing done to it. The rows stay where
    they are read; the table of files is broadcast, for the reader has listed them and knows how
    many there are. Then the operators of ``order`` take ``order_by=None``.
    """
    files = stored_rows(df).select(F.col("path").alias("_path"), F.col("start").alias("_start"), F.col("total").alias("_total"))
    rows = df.select("*", F.col(_PATH).alias("_path"), F.col(_ROW).alias("_row"))
    placed = rows.join(broadcast_within(files, len(df.inputFiles())), "_path")
    extra = [F.col("_total").alias(total)] if total else []
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + F.col("_row")).alias(pos), *extra)


def scan_in_order(spark: SparkSession, path: str, pos: str = "pos", total: str | None = "n_rows") -> DataFrame:
    """SRC-4 with positions: a saved corpus and where each row stands in it."""
    return stored_position(spark.read.parquet(path), pos, total)
