"""Arrays of a fixed size that all tasks fill together: counts, and sets of hashes.

Each task fills an array of its own and gives it out in compressed blocks; blocks are
combined by a shuffle, a bounded piece per task, and only the result, whose size is a
parameter, comes to the driver and goes out again as a broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parley.llm.words import U64, mix
from parley.session import shuffles_freed

BLOCKS = 64
ROWS = "block long, data binary"


def give_out(array: np.ndarray) -> pa.RecordBatch:
    parts = [zlib.compress(p.tobytes(), 1) for p in np.split(array, BLOCKS)]
    return pa.RecordBatch.from_pydict({"block": np.arange(BLOCKS), "data": pa.array(parts, pa.binary())})


def combined(rows: DataFrame, kind: type, combine: Callable, size: int) -> np.ndarray:
    """The arrays of all tasks in one; zeros if there was no task."""

    def fold(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                got = np.frombuffer(zlib.decompress(data.as_py()), kind)
                held[block] = combine(held[block], got) if block in held else got
        if held:
            yield pa.RecordBatch.from_pydict({"block": list(held), "data": pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())})

    with shuffles_freed(rows.sparkSession):
        done = rows.repartition(BLOCKS, "block").mapInArrow(fold, ROWS).collect()  # one row per block
    if not done:
        return np.zeros(size, kind)
    return np.concatenate([np.frombuffer(zlib.decompress(r["data"]), kind) for r in sorted(done, key=lambda r: r["block"])])


class HashSet:
    """Which hashes may be in a set: none that is gets lost, and few others pass while the set is smaller than ``bits``."""

    def __init__(self, array: np.ndarray):
        self.array = array

    @classmethod
    def of(cls, df: DataFrame, column: str, bits: int = 1 << 26) -> HashSet:
        def fill(batches):
            array = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                at = cls.places(batch.column(0).to_numpy(), bits)
                np.bitwise_or.at(array, at >> 3, (1 << (at & 7)).astype(np.uint8))
            yield give_out(array)

        return cls(combined(df.select(column).mapInArrow(fill, ROWS), np.uint8, np.bitwise_or, bits // 8))

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> np.ndarray:
        return (mix(hashes.view(U64)) & U64(bits - 1)).astype(np.int64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes, len(self.array) * 8)
        return (self.array[at >> 3] >> (at & 7) & 1).astype(bool)


def distinct_by_owner(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners in order, and each owner's different values in order."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new]


def within_groups(sizes: np.ndarray, most: int) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i before j, inside each of the neighbouring groups, none larger than ``most``."""
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(end))
    for step in range(1, most):
        at = at[at + step < end[at]]
        if not len(at):
            return
        yield at, at + step
