"""Writers for corpora, example tables, vocabulary maps and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-1."""
    df.write.mode(mode).parquet(path)


def write_examples(df: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> None:
    """SNK-2: one row per example; ``files`` bounds the number of files."""
    out = df.repartition(files, "index") if files else df
    out.write.mode(mode).parquet(path)


def write_bucketed(
    df: DataFrame, path: str, bucket: str = "bucket", rows_per_file: int = 1_000_000, mode: str = "errorifexists"
) -> None:
    """SNK-3: one directory per length bucket; rows without a bucket are not written.

    There is no shuffle by bucket: every task writes its own file per bucket, so a
    bucket that holds most rows is still written by many tasks.
    """
    kept = df.where(F.col(bucket).isNotNull())
    kept.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(bucket).parquet(path)


def write_stats(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-4: a report (a few rows) as one JSON file."""
    df.coalesce(1).write.mode(mode).json(path)


def write_vocab_map(
    d2t: DataFrame, t2d: DataFrame, path: str, model: str, r: int | None = None, mode: str = "errorifexists"
) -> None:
    """SNK-5: ``d2t`` and ``t2d`` below ``path``, partitioned by model and size.

    ``r`` is taken from the tables when they hold several sizes.
    """
    for name, table in (("d2t", d2t), ("t2d", t2d)):
        size = F.col("r") if r is None else F.lit(r)
        out = table.withColumns({"model": F.lit(model), "r": size})
        out.write.mode(mode).partitionBy("model", "r").parquet(f"{path}/{name}")


def write_reject_list(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """SNK-6: paths, one per line."""
    df.select(F.col("path").cast("string")).write.mode(mode).text(path)
