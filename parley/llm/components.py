"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import discard, materialise

CHUNK = 1 << 19  # edges of a task that become trees at once


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", chunk: int = CHUNK) -> DataFrame:
    """(id, component): the smallest id that each id in an edge reaches.

    Alternates two steps until all edges form stars: every node hangs its larger
    neighbours, then its smaller ones, on the smallest node it knows. The first is a
    minimum per node (combined before the shuffle) and a join. Where ids are longs, each
    task that reads edges first makes trees of them, ``chunk`` at a time: most paths go there,
    and no node has more smaller neighbours than there are chunks, so these are gathered.
    Other ids take functions of Spark only, and a minimum and a join again. Rounds grow with the
    logarithm of the longest path at most. Each step is written to the shared folder, and the one before removed.
    Null ids and loops are left out.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    numbers = all(kind == "bigint" for _, kind in pairs.dtypes)
    now = materialise(pairs if numbers else pairs.distinct(), "edges")
    while True:
        now = _merged(now, chunk) if numbers else now
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        near = materialise(both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")), "near")
        # In a star, the smallest node has larger neighbours alone, and any other node has one neighbour.
        if not near.where("low < u AND low < high").count():
            discard(now)
            return near.select(F.col("u").alias("id"), F.least("u", "low").alias("component"))
        large = now.join(near.select(F.col("u").alias("v"), F.least("u", "low").alias("m")), "v").select("u", "m")
        next_ = materialise(_gathered(large) if numbers else _joined(large.distinct()), "edges")
        discard(now, near)
        now = next_


def _merged(now: DataFrame, chunk: int) -> DataFrame:
    """Trees of the edges of each task, and of these trees where Spark reads them, as small files, in half as many tasks or fewer."""
    tasks = now.rdd.getNumPartitions()
    while True:
        trees = materialise(now.mapInArrow(_trees(chunk), "u long, v long"), "trees")
        discard(now)
        now = trees
        before, tasks = tasks, now.rdd.getNumPartitions()
        if 2 * tasks > before:
            return now


def _gathered(large: DataFrame) -> DataFrame:
    known = large.groupBy("u").agg(F.array_sort(F.collect_set("m")).alias("m"))
    rest = F.transform(F.slice("m", 2, F.size("m")), lambda m: F.struct(m.alias("u"), F.get("m", F.lit(0)).alias("v")))
    own = F.struct("u", F.get("m", F.lit(0)).alias("v"))
    return known.select(F.explode(F.concat(F.array(own), rest)).alias("e")).select("e.*")


def _joined(large: DataFrame) -> DataFrame:
    least = large.groupBy("u").agg(F.min("m").alias("v"))
    small = large.join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v")
    return small.union(least).distinct()


def _trees(chunk: int):
    """Edges from each node to the smallest one that it reaches by the edges of a chunk."""

    def trees(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = np.arange(len(ids))
        while True:
            x, y = root[at[: len(u)]], root[at[len(u) :]]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        hung = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_pydict({"u": ids[hung], "v": ids[root[hung]]})

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, chunk):
                held.append(batch.slice(k, chunk))
                n += held[-1].num_rows
                if n >= chunk:
                    yield trees(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("u", "v")))
                    held, n = [], 0
        if held:
            yield trees(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("u", "v")))

    return run
