"""User functions over batches of rows, and tokenisers built once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """UDF-1: ``fn`` over Arrow batches; it may drop or add rows, and its columns replace the input's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(run, schema)


def row_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """UDF-2: an optional step made of column functions."""
    return df if fn is None else df.transform(fn)


Encode = Callable[[str], list[int]]
EncodeBatch = Callable[[list[str]], list[list[int]]]


class _Guarded:
    """A tokeniser that tells of each text whether it could be encoded.

    ``factory`` returns ``encode(text) -> ids``, or, with ``batched``,
    ``encode(texts) -> list of ids``. A batch that fails is done again text by text.
    """

    def __init__(self, factory, batched: bool):
        made = factory()
        self.batch: EncodeBatch = made if batched else lambda texts: [made(t) for t in texts]

    def __call__(self, texts: list[str | None]) -> list[tuple[list[int] | None, str | None]]:
        filled = [k for k, t in enumerate(texts) if t is not None]
        out: list[tuple[list[int] | None, str | None]] = [(None, None)] * len(texts)
        try:
            for k, ids in zip(filled, self.batch([texts[k] for k in filled]), strict=True):
                out[k] = (list(ids), None)
        except Exception:  # whatever a tokeniser may raise; the message goes into the row
            for k in filled:
                try:
                    out[k] = (list(self.batch([texts[k]])[0]), None)
                except Exception as error:
                    out[k] = (None, f"{type(error).__name__}: {error}")
        return out


# Ids are Python objects until they are in Arrow, at some 40 bytes each: texts are encoded in pieces of so many bytes.
PIECE_BYTES = 1 << 20


def _bytes(column: pa.Array) -> np.ndarray:
    """Bytes of text in each row of a column of strings or of lists of strings."""
    if not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type)):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(_bytes(column.values))])
    return np.diff(before[column.offsets.to_numpy(zero_copy_only=False)])


def _pieces(columns: list[pa.Array], most: int) -> Iterator[list[list]]:
    """The same rows in pieces of at most ``most`` bytes of text, as Python lists; a longer row is alone in its piece."""
    ends = np.cumsum(sum(_bytes(c) for c in columns))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield [c.slice(at, to - at).to_pylist() for c in columns]
        at = to


def _struct(rows: list[tuple], **types: pa.DataType) -> pa.StructArray:
    columns = zip(*rows, strict=True)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


_IDS = pa.list_(pa.int32())


def pluggable_tokeniser(factory: Callable[[], Encode | EncodeBatch], batched: bool = False, piece: int = PIECE_BYTES):
    """UDF-3: a column function from text to ``struct<ids, error>`` around any tokeniser.

    ``factory`` runs once per task. Texts arrive in Arrow batches and are encoded in pieces of
    ``piece`` bytes, so that a worker holds the ids of one piece however many rows are in a batch. A null
    text has neither ids nor an error; a text that cannot be encoded has an error and no ids,
    so that nothing goes missing without a trace (``split_failed`` counts them).
    """

    @F.arrow_udf("ids array<int>, error string")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokeniser = _Guarded(factory, batched)
        for texts in batches:
            for (part,) in _pieces([texts], piece):
                yield _struct(tokeniser(part), ids=_IDS, error=pa.string())

    # Marked so that the optimiser neither copies the call nor moves filters below it.
    return encode.asNondeterministic()


def pluggable_chat_encoder(factory: Callable[[], Encode | EncodeBatch], batched: bool = False, piece: int = PIECE_BYTES):
    """The same for a rendered conversation and its parts, in one call per piece of a batch of rows.

    A column function from (text, turns, instructions) to ``struct<ids, turn_len,
    instr_len, error>``: ids of the text, and the number of ids of each part. A row
    fails as a whole, with the first error of its texts.
    """

    def encoded(tokeniser: _Guarded, texts: list, turns: list, instructions: list) -> list[tuple]:
        flat: list[str | None] = []
        spans = []
        for text, *parts in zip(texts, turns, instructions):
            lists = [[] if p is None else p for p in parts]
            spans.append((len(flat), len(lists[0]), len(lists[1])))
            flat += [text, *lists[0], *lists[1]]
        done = tokeniser(flat)
        rows = []
        for at, n, m in spans:
            own = done[at : at + 1 + n + m]
            error = next((e for _, e in own if e), None)
            sizes = [None if ids is None else len(ids) for ids, _ in own[1:]]
            rows.append((None, None, None, error) if error else (own[0][0], sizes[:n], sizes[n:], None))
        for k, (t, i) in enumerate(zip(turns, instructions)):  # no separator, no parts: not the same as none
            rows[k] = (rows[k][0], None if t is None else rows[k][1], None if i is None else rows[k][2], rows[k][3])
        return rows

    @F.arrow_udf("ids array<int>, turn_len array<int>, instr_len array<int>, error string")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tokeniser = _Guarded(factory, batched)
        for columns in batches:
            for part in _pieces(list(columns), piece):
                yield _struct(encoded(tokeniser, *part), ids=_IDS, turn_len=_IDS, instr_len=_IDS, error=pa.string())

    return encode.asNondeterministic()


def ids_only(encode):
    """A plugged tokeniser where only ids are wanted: null for a text that fails."""
    return lambda text: encode(text)["ids"]


def split_failed(df: DataFrame, error: str | Column = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error; the others, with it)."""
    failed = (F.col(error) if isinstance(error, str) else error).isNotNull()
    return df.where(~failed), df.where(failed)
