"""Checks of whole files, each opened by itself in a task."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.readers import file_manifest

_CHUNK = 4 << 20
CHECKED = "path string, name string, length long, is_valid boolean, error string, rows long"


def _parquet_rows(source) -> int:
    """Reads every column chunk of a Parquet file, one row group at a time."""
    import pyarrow.parquet as pq

    file = pq.ParquetFile(source)
    rows = 0
    for group in range(file.num_row_groups):
        for batch in file.iter_batches(batch_size=8192, row_groups=[group]):
            rows += batch.num_rows
    if rows != file.metadata.num_rows:
        raise ValueError(f"{rows} rows where the footer says {file.metadata.num_rows}")
    return rows


def _json_rows(source) -> int:
    """Parses every line of a file of JSON lines; blank ones are passed over."""
    rows, number, rest = 0, 0, b""
    while True:
        data = source.read(_CHUNK)
        lines = (rest + data).split(b"\n")
        rest = lines.pop() if data else b""
        for line in lines:
            number += 1
            if line.strip():
                try:
                    json.loads(line)
                except ValueError as error:
                    raise ValueError(f"line {number}: {error}") from None
                rows += 1
        if not data:
            return rows


OPENERS = {"parquet": _parquet_rows, "json": _json_rows}


def check_files(spark: SparkSession, path: str, kind: str = "parquet", exts=None, files_per_task: int = 16) -> DataFrame:
    """FLT-10 per file: (path, name, length, is_valid, error, rows) of every file listed below ``path``.

    ``kind`` is ``parquet``, whose pages are all decoded, or ``json``, of JSON lines, which are
    all parsed. A file that cannot be opened or read to its end is a row with the
    error's text, and does not stop the others. A task holds one file at a time, a
    row group or a few megabytes of it. Files are dealt to tasks by count, hashed
    by path, so that neighbours in a folder of long files part.
    """
    reader = OPENERS[kind]
    files = file_manifest(spark, path, exts or (f".{kind}",)).select("path", "name", "length")
    tasks = max(1, -(-files.count() // files_per_task))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for row in frame.itertuples(index=False):
                rows, error = None, None
                try:
                    system, place = fs.FileSystem.from_uri(row.path)
                    with system.open_input_file(place) as source:
                        rows = reader(source)
                except Exception as problem:  # whatever keeps a file from loading is its result
                    error = f"{type(problem).__name__}: {problem}"[:1000]
                yield pd.DataFrame([(row.path, row.name, row.length, error is None, error, rows)], columns=["path", "name", "length", "is_valid", "error", "rows"]).astype({"rows": "Int64"})

    spread = files.select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"), "name", "length").repartition(tasks, F.xxhash64("path"))
    return spread.mapInPandas(run, CHECKED)


def done_keys(spark: SparkSession, path: str, pattern: str = r"^data_(\d+)\.", exts=(".parquet", ".pt")) -> DataFrame:
    """FLT-12: (index) of the outputs that lie below ``path``, told by their names; none where nothing was written yet.

    ``pattern`` takes the index out of a file's name. Files are listed, not read.
    """
    none = spark.createDataFrame([], "index long")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return none
    try:
        files = file_manifest(spark, path, exts)
    except FileNotFoundError:
        return none
    found = files.select(F.regexp_extract("name", pattern, 1).alias("i")).where("i <> ''")
    return found.select(F.col("i").cast("long").alias("index")).distinct()


def written_keys(spark: SparkSession, path: str, key: str = "index") -> DataFrame:
    """FLT-12: the keys of the example tables below ``path``; none where nothing was written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{key} long")
    return spark.read.schema(f"{key} long").option("recursiveFileLookup", True).parquet(path).distinct()
