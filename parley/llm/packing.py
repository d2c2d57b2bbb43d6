"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

No bin holds two pieces of one source or of one duplicate cluster. Bins are ordered
by what is left in them and carry a bitmap of their sources and clusters. A piece
goes to the tightest bin that holds it; while that bin's bitmap meets the piece's,
the search goes on to its successor, and past the last one a new bin opens.

Rows are dealt by a hash into shards of a bounded size, whose number grows with the
rows, so a hot source spreads over all of them; each shard is packed by itself, the
longest piece first. Bins hold the pieces of one shard, so conflicts never cross.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.words import slices, split
from parley.session import materialise

BINS = "shard long, bin long, slot int, doc_id long, source string, cluster long, piece int, first_word long, n_words long, start long, room_left long"


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[int]:
    """The bin of each piece, pieces taken in the given order."""
    left: list[tuple[int, int]] = []  # (room, bin), tightest first; of equal bins the older one
    bits: list[int] = []
    out = []
    for size, mask in zip(sizes, masks):
        k = bisect_left(left, (size, -1))
        while k < len(left) and bits[left[k][1]] & mask:
            k += 1
        room, own = left.pop(k) if k < len(left) else (capacity, len(bits))
        if own == len(bits):
            bits.append(0)
        bits[own] |= mask
        insort(left, (room - size, own))
        out.append(own)
    return out


def masks_of(sources: list, clusters: list) -> list[int]:
    """A bit for each source, and for each cluster that has two pieces here. Null conflicts with nothing."""
    seen, shared = set(), set()
    for c in clusters:
        (shared if c in seen else seen).add(c)
    bit = {x: 1 << k for k, x in enumerate([*{("s", s): 0 for s in sources if s is not None}, *{("c", c): 0 for c in clusters if c in shared and c is not None}])}
    return [bit.get(("s", s), 0) | bit.get(("c", c), 0) for s, c in zip(sources, clusters)]


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "tie", "piece", "copy"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        plain = lambda c: [None if pd.isna(x) else x for x in rows[c]]
        rows["bin"] = best_fit(rows["n_words"].tolist(), masks_of(plain("source"), plain("cluster")), capacity)
        rows = rows.sort_values("bin", kind="stable", ignore_index=True)
        by = rows.groupby("bin")
        rows["slot"] = by.cumcount().astype("int32")
        rows["start"] = by["n_words"].cumsum() - rows["n_words"]
        rows["room_left"] = capacity - by["n_words"].transform("sum")
        return rows[[c.split()[0] for c in BINS.split(", ")]]

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cluster, tie, n_words); documents that differ in case and white space alone are one cluster, ``tie`` tells them apart."""

    def run(batches):
        for part in slices(batches, "text"):
            n = split(part.column("text")).counts.astype(np.int64)
            names = ("doc_id", "source", "cluster", "tie")
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n)], [*names, "n_words"])

    text = F.col("text").cast("string")
    cluster = F.xxhash64(F.lower(F.array_join(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(text != "", cluster).alias("cluster"), F.xxhash64(text, "source").alias("tie"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, cluster long, tie long, n_words long")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``copy`` = 0, 1, 2, ... among rows with equal keys; ``rows`` is a written table.

    Equal rows are numbered within their part of the table, from where the parts before end, so
    that not even very many of them come together.
    """
    parts = rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    counts = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part")
    starts = counts.withColumn("_start", F.sum("_n").over(before) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys))).where("_all > 1")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "_part"]]
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_row")) - 1
    placed = parts.withColumn("_at", inside).alias("r").join(starts.alias("s"), same, "left")
    return placed.select(*[f"r.{c}" for c in rows.columns], (F.col("_at") + F.coalesce("_start", F.lit(0))).alias("copy"))


def pack(docs: DataFrame, capacity: int = 2048, shard_rows: int = 4096) -> DataFrame:
    """One row per piece of a document: its bin, slot and first word there.

    A document of more than ``capacity`` words is cut into full pieces and a rest, so
    no word is lost. Null or empty texts are pieces of no words; they still get a bin.
    Null sources, and texts that are null or empty, conflict with nothing. Repeated rows
    are packed each, and are duplicates of one another. Other columns are ignored.
    """
    counted = word_counts(docs)
    last = F.greatest(F.lit(0), F.ceil(F.col("n_words") / capacity) - 1).cast("int")
    pieces = counted.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.withColumn("first_word", F.col("piece").cast("long") * capacity)
    pieces = materialise(pieces.withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("n_words") - F.col("first_word"))), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    # Dealt and ordered by what a row is, not by where it lies, so any layout of the table gives the same bins.
    dealt = numbered(pieces, ["doc_id", "tie", "piece"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", "piece", "copy"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_pack(capacity), BINS)
