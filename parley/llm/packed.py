"""Integer arrays of a piece of the corpus as small binary values, and pieces of bounded size.

A piece is a run of documents that stays together from stage to stage: what it asks of
the corpus goes out once for each distinct key, and the answers come back to the piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from parley.session import scratch_path

_PLANES = 8


def squeeze(values: np.ndarray) -> bytes:
    """Integers from 0 up, least byte of all first, then the next; high bytes cost next to nothing."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, _PLANES)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(_PLANES, -1)
    return np.ascontiguousarray(raw.T).view("<i8").reshape(-1)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """The rows in tables of about ``most`` bytes of text over the borders of batches; a longer text is alone."""
    waiting, held = [], 0
    for batch in batches:
        sizes = pc.coalesce(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                if i > at:
                    waiting.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(waiting)
                waiting, held, at = [], 0, i
            held += size + 8
        if batch.num_rows > at:
            waiting.append(batch.slice(at))
    if waiting:
        yield pa.Table.from_batches(waiting)


def written(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    """``df`` in the shared folder: where, and the rows read from there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing will read again."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)
