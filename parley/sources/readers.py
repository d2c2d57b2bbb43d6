"""Readers for chat corpora, example tables and vocabulary maps."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import tokens as tk
from parley.functions.text import preview_text
from parley.operators.examples import with_default_masks
from parley.schemas import PRETOKENISED


def scan_json(spark: SparkSession, path, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """SRC-1: a JSON corpus; one array per file when ``multiline``, else one record per line.

    A file holding one array is read by one task. Line files are split, so prefer
    them for large corpora.
    """
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def scan_parquet(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC-2: a Parquet directory, or the files (or folders) of one named split in it, ``<split>-*``."""
    return spark.read.parquet(path if split is None else f"{path}/{split}-*")


def scan_first_available(spark: SparkSession, paths) -> DataFrame:
    """SRC-3: the first of ``paths`` that can be read as Parquet."""
    missing = None
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            missing = error
    raise FileNotFoundError(f"none of {list(paths)} can be read") from missing


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC-4: a corpus saved by ``write_corpus``."""
    return spark.read.parquet(path)


def file_manifest(spark: SparkSession, path: str, exts=(".parquet",)) -> DataFrame:
    """SRC-5: path, name, length and time of every file below ``path`` with one of the extensions.

    The files are listed, not read; one without a byte, which Spark's scan passes over, has
    length 0 and no time. An empty listing is an error.
    """
    pattern = "{" + ",".join(f"*{e}" for e in exts) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    files = found.select("path", "length", "modificationTime")
    listed = [re.sub("^file:/+", "file:/", unquote(p)) for p in found.inputFiles()]  # the reader's own listing
    empty = spark.createDataFrame([(p,) for p in listed], "path string").join(files.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path")), "path", "left_anti")
    files = files.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime")))
    if not listed:
        raise FileNotFoundError(f"no {'/'.join(exts)} files below {path}")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


def complete_pretokenised(df: DataFrame, tokenise=tk.tokenise, max_len: int | None = None) -> DataFrame:
    """SRC-6: take ids where a record has them, else tokenise its text; missing masks are all ones."""
    made = tokenise(F.coalesce("text", F.lit("")))
    if max_len is not None:
        made = tk.truncate_ids(made, max_len)
    fresh = F.col("input_ids").isNull()
    ids = F.when(fresh, made).otherwise(F.col("input_ids"))
    given = F.when(~fresh, F.col("attention_mask"))
    out = df.withColumns({"input_ids": ids, "attention_mask": given}).drop("loss_mask")
    return with_default_masks(out)


def scan_pretokenised(spark: SparkSession, path, tokenise=tk.tokenise, max_len: int | None = None) -> DataFrame:
    """SRC-6: JSON lines of ``{text, input_ids, attention_mask}``."""
    return complete_pretokenised(spark.read.schema(PRETOKENISED).json(path), tokenise, max_len)


def scan_examples(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: processed examples; missing masks are all ones."""
    return with_default_masks(spark.read.parquet(path))


def scan_vocab_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-8: (d2t, t2d, one-row report); fails when either table is absent.

    ``path`` is the folder of one map, e.g. ``<root>/model=<m>/r=<r>`` is read with
    ``<root>`` and a filter on its partition columns.
    """
    try:
        d2t, t2d = spark.read.parquet(f"{path}/d2t"), spark.read.parquet(f"{path}/t2d")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FileNotFoundError(f"{path} must hold both d2t and t2d") from error
    return d2t, t2d, vocab_map_report(d2t, t2d)


def vocab_map_report(d2t: DataFrame, t2d: DataFrame) -> DataFrame:
    """Sizes and extremes of a map, one row per (model, r) when it holds several."""
    by = [c for c in ("model", "r") if c in d2t.columns]
    left = d2t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("d2t_size"), F.min("offset").alias("min_offset"), F.max("offset").alias("max_offset")
    )
    right = t2d.groupBy(*by).agg(F.count(F.lit(1)).alias("t2d_size"), F.count_if("in_draft").alias("t2d_true"))
    if by:
        return left.join(right, by)
    sizes = right.select(F.struct("t2d_size", "t2d_true").alias("s")).scalar()
    return left.withColumn("_s", sizes).select("d2t_size", "min_offset", "max_offset", "_s.t2d_size", "_s.t2d_true")


def profile_schema(df: DataFrame, n: int = 5, width: int = 100, order_by=None) -> DataFrame:
    """SRC-9: one row per sample row and column: type, a cut text or a list length, keys of records.

    Without ``order_by`` any ``n`` rows are shown.
    """
    rows = df.orderBy(*order_by) if order_by else df
    rows = rows.limit(n)
    cells = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        shown, keys = preview_text(col.cast("string"), width) if not isinstance(kind, T.ArrayType) else None, ""
        if isinstance(kind, T.ArrayType):
            shown = F.concat(F.lit("list with "), F.size(col).cast("string"), F.lit(" items"))
            if isinstance(kind.elementType, T.StructType):
                keys = ",".join(kind.elementType.fieldNames())
        elif isinstance(kind, T.StructType):
            keys = ",".join(kind.fieldNames())
        cells.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(kind.simpleString()).alias("type"),
                shown.alias("shown"),
                F.lit(keys).alias("keys"),
            )
        )
    key = [c for c in (order_by or []) if c in df.columns]
    samples = rows.select(*[F.col(c).alias(f"row_{c}") for c in key], F.explode(F.array(*cells)).alias("c"))
    return samples.select(*[f"row_{c}" for c in key], "c.*")
