"""Vector codes by k-means in integers, with Drake-Hamerly adaptive bounds.

Vectors are cut into parts, each part position with its own codebook. A part keeps its
``b`` closest entries in the order of lower bounds on their distances, and one outer
bound for all other entries. When entries move, the bounds shrink by how far they moved;
a candidate whose bound stays above the distance to the part's own entry cannot win and
is not looked at. Only uncertain candidates are measured, in whole numbers, and only a
part whose outer bound fails is measured against its whole codebook. ``b`` follows what
the round before needed.

A round is one pass over the written parts with their bounds. Tasks give sums and
counts per entry, whose number is fixed, and the parts with new bounds are written for
the next round, so a lost executor reads the last round again and no earlier one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.packed import discard, written
from parley.session import BROADCAST_ROWS, materialise

SCALE = 1024
MOST = 1 << 27  # scaled components beyond this could overflow the long that holds an error
EXACT = 1 << 23  # below it, all squared distances of up to 64 components are whole numbers in a double
SALTS = 32
_SLACK = 1e-9  # relative rounding of a bound


@dataclass
class Bounds:
    """For each row: its closest entries, lower bounds on their distances, and one bound for all others."""

    near: np.ndarray  # (n, b) entry numbers; column 0 is the row's own entry
    low: np.ndarray  # (n, b) bounds, ascending from column 1 on
    outer: np.ndarray  # (n,)

    def pack(self) -> list[bytes]:
        """One value a row: a byte for each entry, then the bounds in four bytes, rounded down."""
        exact = np.concatenate([self.low, self.outer[:, None]], axis=1)
        rows = np.nextafter(exact.astype("<f4"), np.float32(-np.inf), where=np.isfinite(exact), out=exact.astype("<f4"))
        raw = np.concatenate([self.near.astype(np.uint8), np.ascontiguousarray(rows).view(np.uint8)], axis=1)
        return [r.tobytes() for r in raw]

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Bounds:
        b = (len(blobs[0]) - 4) // 5
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
        low = np.ascontiguousarray(raw[:, b:]).view("<f4").astype(np.float64)
        return cls(raw[:, :b].astype(np.int64), low[:, :-1].copy(), low[:, -1].copy())


def squared(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances, exact."""
    if max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0)) < EXACT and rows.shape[1] <= 64:
        a, c = rows.astype(np.float64), entries.astype(np.float64)
        return np.rint((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((rows - e) ** 2).sum(axis=1) for e in entries], axis=1)


def full_search(rows: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, Bounds]:
    """(squared distance to the nearest entry, bounds); ties go to the lower number."""
    far = squared(rows, entries)
    b = min(b, far.shape[1])
    order = np.argsort(far, axis=1, kind="stable")[:, : b + 1]
    sorted_far = np.sqrt(np.take_along_axis(far, order, axis=1))
    outer = sorted_far[:, b] if order.shape[1] > b else np.full(len(rows), np.inf)
    own = np.take_along_axis(far, order[:, :1], axis=1)[:, 0]
    return own, Bounds(order[:, :b], sorted_far[:, :b] * (1 - _SLACK), outer * (1 - _SLACK))


def bounded_search(rows: np.ndarray, entries: np.ndarray, moved: np.ndarray, old: Bounds, b: int) -> tuple[np.ndarray, Bounds, int]:
    """The same after entries moved, by the bounds of the round before; keeps ``b`` candidates.

    The number told is how many candidates the row that needed most of them looked at.
    """
    held = old.near.shape[1]
    low = (old.low - moved[old.near]) * (1 - _SLACK) - _SLACK
    outer = (old.outer - moved.max()) * (1 - _SLACK) - _SLACK
    own = ((rows - entries[old.near[:, 0]]) ** 2).sum(axis=1)
    reach = np.sqrt(own) * (1 + _SLACK) + _SLACK
    lost = outer <= reach
    doubt = low <= reach[:, None]
    doubt[:, 0] = False
    needed = np.where(doubt.any(axis=1), held - np.argmax(doubt[:, ::-1], axis=1), 1)
    near, best = old.near.copy(), own.copy()
    low[:, 0] = reach * (1 - 3 * _SLACK) - 3 * _SLACK
    some = np.flatnonzero(~lost & doubt.any(axis=1))
    if len(some):
        # Uncertain candidates are measured in whole numbers; the others keep their bounds.
        row, column = np.nonzero(doubt[some])
        exact = np.full((len(some), held), np.iinfo(np.int64).max)
        exact[:, 0] = own[some]
        exact[row, column] = ((rows[some[row]] - entries[near[some[row], column]]) ** 2).sum(axis=1)
        tight = np.sqrt(exact[row, column]) * (1 - _SLACK)
        low[some[row], column] = tight
        least = exact.min(axis=1)
        name = np.where(exact == least[:, None], near[some], np.iinfo(np.int64).max)
        place = np.argmin(name, axis=1)
        low[some, place] = -1  # to the front
        order = np.argsort(low[some], axis=1, kind="stable")
        # The own entry goes first whatever its bound says.
        near[some] = np.take_along_axis(near[some], order, axis=1)
        low[some] = np.take_along_axis(low[some], order, axis=1)
        best[some] = least
        low[some, 0] = np.sqrt(least) * (1 - _SLACK)
    rest = np.flatnonzero(~lost)
    if held > 2 and len(rest):
        order = np.argsort(low[rest][:, 1:], axis=1, kind="stable") + 1
        near[rest, 1:] = np.take_along_axis(near[rest], order, axis=1)
        low[rest, 1:] = np.take_along_axis(low[rest], order, axis=1)
    if b < held:  # what is no longer kept falls under the outer bound
        outer = np.minimum(outer, low[:, b:].min(axis=1))
        near, low = near[:, :b], low[:, :b]
    all_ = np.flatnonzero(lost)
    if len(all_):
        best[all_], fresh = full_search(rows[all_], entries, near.shape[1])
        near[all_], low[all_], outer[all_] = fresh.near, fresh.low, fresh.outer
    return best, Bounds(near, low, outer), int(needed[~lost].max(initial=1))


def _update(entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    used = counts > 0
    new = entries.copy()
    new[used] = sums[used] // counts[used][:, None]  # numpy rounds all quotients down
    return new


def _ints(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * SCALE).reshape(-1, dim)
    if np.abs(scaled).max(initial=0) > MOST:
        raise ValueError(f"a component is beyond {MOST // SCALE} either way: its squared error need not fit in a long")
    return scaled.astype(np.int64)


def _stored(binary: pa.Array, dim: int) -> np.ndarray:
    """Rows of int32 written as binary."""
    return np.frombuffer(b"".join(binary.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def encode_vectors(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    candidates: int = 8,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, codes) of every vector that can be coded.

    Components become floor(1024 x). Each codebook begins with that part of the
    ``entries`` smallest ids (of at most 256), takes ``rounds`` assignments and means, and
    is then assigned once more. ``codes`` is the array behind the hexadecimal ``code``;
    ``label_error`` sums the errors of equal labels, nulls together.

    Left out: vectors that are null, hold null, NaN or infinite components, or have another
    length than most. That length has to be divisible by ``parts``. Null ids are coded too
    and come last among the seeds; repeated rows count as often as they stand. Fewer rows
    than entries give as many entries. Components beyond 131,072 either way are an error,
    since ``error`` is a long. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    kind = rows.schema["label"].dataType.simpleString()
    id_type = vectors.schema[vec_id].dataType.simpleString()
    shape = f"{vec_id} {id_type}, code string, error long, label_error long, codebooks_sha256 string, codes array<int>"
    if not sizes:
        return spark.createDataFrame([], shape)
    dim = sizes[0]["n"]
    if dim % parts or not 0 < entries <= 256:
        raise ValueError(f"{dim} components do not make {parts} equal parts, or {entries} entries are not 1 to 256")
    good, width = good.where(F.size("v") == dim), dim // parts

    def scale(batches):
        for batch in batches:
            ints = _ints(batch.column("v"), dim).astype("<i4")
            blobs = pa.array([r.tobytes() for r in ints], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), blobs], ["id", "label", "ints"])

    path, base = written(good.mapInArrow(scale, f"id long, label {kind}, ints binary"), "codes")
    # At most 256 rows; rows of one id by their bytes.
    seeds = base.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    seed = np.frombuffer(b"".join(bytes(r["ints"]) for r in seeds), "<i4").reshape(-1, dim).astype(np.int64)
    books = [seed[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    k = len(seed)
    state = ", ".join(f"b{p} binary" for p in range(parts))
    names = [f"b{p}" for p in range(parts)]
    moved: list[np.ndarray] | None = None
    b = [min(candidates, k)] * parts

    def assign(books, moved, b):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                ints = _stored(batch.column("ints"), dim)
                error, code, packed, needs = np.zeros(len(ints), np.int64), [], [], []
                for p in range(parts):
                    own = ints[:, p * width : (p + 1) * width]
                    if moved is None:
                        (best, bounds), needed = full_search(own, books[p], b[p]), 1
                    else:
                        best, bounds, needed = bounded_search(own, books[p], moved[p], Bounds.unpack(batch.column(names[p]).to_pylist()), b[p])
                    error += best
                    code.append(bounds.near[:, 0])
                    packed.append(pa.array(bounds.pack(), pa.binary()))
                    needs.append(needed)
                codes = np.ascontiguousarray(np.stack(code, axis=1).astype(np.uint8))
                columns = [batch.column("id"), batch.column("label"), batch.column("ints"), *packed]
                columns += [pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)]
                columns.append(pa.array([needs] * len(ints), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "ints", *names, "code", "error", "needs"])

        return run

    def tally(batches):
        held: dict = {}
        for batch in batches:
            if batch.num_rows:
                ints = _stored(batch.column("ints"), dim)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    sums, counts = held.setdefault(p, (np.zeros((k, width), np.int64), np.zeros(k, np.int64)))
                    np.add.at(sums, code[:, p], ints[:, p * width : (p + 1) * width])
                    counts += np.bincount(code[:, p], minlength=k)
        for p, (sums, counts) in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"part": np.full(len(used), p, np.int32), "entry": used.astype(np.int32), "n": counts[used], "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})

    schema = f"id long, label {kind}, ints binary, {state}, code binary, error long, needs array<int>"
    table = base
    for step in range(rounds + 1):
        before, kept = path, table.select("id", "label", "ints", *(names if moved is not None else []))
        path, table = written(kept.mapInArrow(assign(books, moved, b), schema), "codes")
        discard(spark, before)
        if step == rounds:
            break
        told = table.select("ints", "code").mapInArrow(tally, "part int, entry int, n long, sums array<long>")
        folded = [F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]]
        new = [(np.zeros((k, width), np.int64), np.zeros(k, np.int64)) for _ in range(parts)]
        for r in told.groupBy("part", "entry").agg(*folded).collect():  # parts times entries rows
            new[r["part"]][0][r["entry"]], new[r["part"]][1][r["entry"]] = [r[f"s{i}"] for i in range(width)], r["n"]
        fresh = [_update(book, sums, counts) for book, (sums, counts) in zip(books, new)]
        moved = [np.sqrt(((f - o) ** 2).sum(axis=1)) * (1 + _SLACK) for f, o in zip(fresh, books)]
        books = fresh
        if step:  # as many candidates as the round before looked at, and one more
            used = table.agg(*[F.max(F.col("needs")[p]).alias(f"n{p}") for p in range(parts)]).collect()[0]
            b = [max(2, min(have, used[f"n{p}"] + 1)) if k > 1 else 1 for p, have in enumerate(b)]
    text = ",".join(str(x) for book in books for x in book.reshape(-1).tolist())
    digest = hashlib.sha256(text.encode()).hexdigest()
    totals = table.groupBy("label").agg(F.sum("error").alias("label_error"))
    codes = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.conv(F.substring(F.hex("code"), i * 2 - 1, 2), 16, 10).cast("int"))
    out = _with_totals(table.select("id", "label", "code", "error"), totals)
    return out.select(
        F.col("id").cast(id_type).alias(vec_id),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
        codes.alias("codes"),
    )


def _with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Each row with its label's total; a label may hold most rows, and labels may be many."""
    totals = materialise(totals, "totals")
    totals = totals.withColumnRenamed("label", "_label")
    if totals.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    totals = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(totals, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_s") == F.col("_salt"))).drop("_label", "_salt", "_s")
