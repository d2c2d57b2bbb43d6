"""Removal of word windows seen earlier, found by recompression.

Each document's words are compressed in rounds. A round gives a run of one symbol a
new name, then every pair whose left symbol is on the left side of a coin and whose
right symbol is on the right side. Names and coins are 64-bit hashes of what they
name, so a name is global without a table, and equal passages get equal symbols
except near their ends. With each symbol goes its context: the words that settle
that the symbol stands there. A window of words that holds a symbol's context has
the symbol wherever the window occurs.

Each window is filed under one symbol that it settles, of the highest level that
has one, least name first; every word settles itself, so no window goes without.
Windows that share a symbol are compared by 64 bits of a hash of all their words, which
has nothing to do with the symbol, and by their place around the symbol; the first in (doc_id, position) stays, the others are removed.

What is shuffled: for each symbol in use, a few neighbouring windows at eight bytes
each, packed into one block per task slice and bucket. Windows repeated inside
a slice are settled there, so a passage that a third of the documents share sends
one copy per slice, and no bucket gathers a hot group. Buckets grow in number with
the shuffle partitions and are settled one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.words import U64, mix, slices, span_hashes, split
from parley.session import materialise

FAR = 1 << 40
LEVELS = 3
_WORDS, _CHECK, _RUN, _PAIR = 0xD6E8FEB86659FD93, 0xCA5A826395121157, U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)
NO_KEY = U64(2**64 - 1)


def levels(names: np.ndarray, owner: np.ndarray, rounds: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, names, context start, context end) after 0 .. ``rounds`` rounds. Symbols never span two owners.

    At a text's end a symbol's context is endless, since other texts may go on there.
    """
    left = np.arange(len(names))
    right = left + 1
    yield 0, names, left, right
    for level in range(1, rounds + 1):
        head = np.ones(len(names), bool)
        head[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(head)
        length = np.diff(at, append=len(names))
        last = at + length - 1
        named = names[at]
        many = length > 1
        named[many] = mix(named[many] * _RUN + length[many].astype(U64))
        names, owner = named, owner[at]
        # A run is settled once the symbols right beside it are: the last of the run before, the first of the run after.
        inner = owner[1:] == owner[:-1]
        before, after = np.full(len(at), -FAR), np.full(len(at), FAR)
        before[1:][inner] = left[last[:-1]][inner]
        after[:-1][inner] = right[at[1:]][inner]
        left, right = np.minimum(left[at], before), np.maximum(right[last], after)
        coin = (mix(names ^ mix(np.full(1, level, U64))) & U64(1)).astype(bool)
        same = np.zeros(len(names), bool)  # whether the next symbol has the same owner
        same[:-1] = owner[1:] == owner[:-1]
        pair = np.zeros(len(names), bool)
        pair[:-1] = coin[:-1] & ~coin[1:] & same[:-1]
        taken = np.zeros(len(names), bool)
        taken[1:] = pair[:-1]
        # What tells that a symbol stays alone: the next one if it could have led a pair, else the one before.
        next_right = np.full(len(names), FAR)
        next_right[:-1][same[:-1]] = right[1:][same[:-1]]
        before_left = np.full(len(names), -FAR)
        before_left[1:][same[:-1]] = left[:-1][same[:-1]]
        wide_right = np.where(coin, np.maximum(right, next_right), right)
        wide_left = np.where(coin, left, np.minimum(left, before_left))
        wide_left = np.where(pair, left, wide_left)
        joined = names.copy()
        lead = np.flatnonzero(pair)
        joined[lead] = mix(names[lead] * _PAIR + mix(names[lead + 1] + U64(level)))
        stay = ~taken
        names, owner, left, right = joined[stay], owner[stay], wide_left[stay], wide_right[stay]
        yield level, names, left, right


def file_windows(names: np.ndarray, first: np.ndarray, window: int, rounds: int = LEVELS) -> tuple[np.ndarray, ...]:
    """(start, key, place) of every window: the symbol it is filed under and where that stands in it.

    ``first`` has the first word of each text and the end. Keys of lower levels are larger.
    """
    n = len(names)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low, high = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first)) - window
    position = np.arange(n)
    valid = position <= high
    best, place = np.full(n, NO_KEY), np.zeros(n, np.int64)
    todo = valid.copy()
    for level, name, left, right in reversed(list(levels(names, owner, rounds))):
        if not todo.any():
            break
        settled = np.flatnonzero((right - left <= window) & (left >= 0))
        left, right = left[settled], right[settled]
        start, stop = np.maximum(right - window, low[left]), np.minimum(left, high[left])
        open_before = np.concatenate([[0], np.cumsum(todo)])
        useful = (stop >= start) & (open_before[np.maximum(stop, 0) + 1] > open_before[np.minimum(start, n)])
        left, start, stop = left[useful], start[useful], stop[useful]
        key = (U64(7 - level) << U64(61)) | (name[settled][useful] >> U64(3))
        for d in range(window):
            at = left - d
            ok = (at >= start) & (at <= stop)
            at, own = at[ok], key[ok]
            ok = todo[at]
            np.minimum.at(best, at[ok], own[ok])
        for d in range(window - 1, -1, -1):
            at = left - d
            ok = (at >= start) & (at <= stop)
            at, own = at[ok], key[ok]
            mine = (best[at] == own) & todo[at]
            place[at[mine]] = d
        todo &= best == NO_KEY
    start = np.flatnonzero(valid)
    return start, best[start], place[start]


_HEADER = 4


def _pack(docs: np.ndarray, keys: np.ndarray, doc: np.ndarray, start: np.ndarray, place: np.ndarray, size: np.ndarray, checks: np.ndarray) -> bytes:
    head = np.array([len(docs), len(keys), len(checks), 0], np.int64)
    parts = (head, docs, keys, doc.astype(np.int32), start.astype(np.int32), place.astype(np.uint8), size.astype(np.uint8), checks)
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n_docs, n, m, _ = np.frombuffer(blob, np.int64, _HEADER).tolist()
    out, at = [], 8 * _HEADER
    for kind, count in ((np.int64, 2 * n_docs), (U64, n), (np.int32, n), (np.int32, n), (np.uint8, n), (np.uint8, n), (U64, m)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    return out[0].reshape(-1, 2), *out[1:]


def _ranges(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of neighbouring windows of one text."""
    head = np.ones(len(start), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(head)
    return at, np.diff(at, append=len(start))


def _settled_rows(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> dict:
    none = np.full(len(start), -1)
    blobs = pa.nulls(len(start), pa.binary())
    return {"bucket": none, "blob": blobs, "doc": ids[:, 0], "tie": ids[:, 1], "start": start.astype(np.int64), "windows": count.astype(np.int64)}


FOUND = "bucket long, blob binary, doc long, tie long, start long, windows long"


def _find(window: int, buckets: int):
    """Texts in, blocks for the buckets and ranges settled within the slice out."""

    def run(batches):
        for part in slices(batches, "text"):
            ids = np.stack([part.column("doc").to_numpy(), part.column("tie").to_numpy()], axis=1)
            order = np.lexsort((ids[:, 1], ids[:, 0]))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (ids[order][1:] != ids[order][:-1]).any(axis=1)
            part, ids = part.take(pa.array(order[fresh])), ids[order[fresh]]
            words = split(part.column("text"))
            names, first = words.hashes(), words.first
            start, key, place = file_windows(names, first, window)
            if not len(start):
                continue
            check = span_hashes(names, start, start + window, _WORDS)
            # A window without a symbol of level 2 or more is filed under its own hash.
            alone = key >= (U64(6) << U64(61))
            key[alone], place[alone] = (U64(6) << U64(61)) | (check[alone] >> U64(3)), 0
            _, kept = np.unique(check, return_index=True)  # texts are in order, so the first is the earliest
            again = np.ones(len(start), bool)
            again[kept] = False
            doc = np.searchsorted(first, start, "right") - 1
            at, count = _ranges(doc[again], start[again])
            if len(at):
                own = doc[again][at]
                yield pa.RecordBatch.from_pydict(_settled_rows(ids[own], start[again][at] - first[own], count))
            start, key, place, doc = start[~again], key[~again], place[~again], doc[~again]
            check = span_hashes(names, start, start + window, _CHECK)  # independent of the key, which may be the other hash
            head = np.ones(len(start), bool)  # neighbouring windows under one symbol share a row
            head[1:] = (start[1:] != start[:-1] + 1) | (key[1:] != key[:-1]) | (place[1:] != place[:-1] - 1)
            at = np.flatnonzero(head)
            size = np.diff(at, append=len(start))
            bucket = (mix(key[at]) % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = by[cut[b] : cut[b + 1]]
                used, local = np.unique(doc[at[own]], return_inverse=True)
                spread = np.repeat(at[own], size[own]) + _counting(size[own])
                blob = _pack(ids[used], key[at[own]], local, start[at[own]] - first[doc[at[own]]], place[at[own]], size[own], check[spread])
                nothing = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_pydict({"bucket": [b], "blob": pa.array([blob], pa.binary()), "doc": nothing, "tie": nothing, "start": nothing, "windows": nothing})

    return run


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, in a row."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def settle(blobs: list[bytes]) -> pa.RecordBatch | None:
    """Ranges of windows that have an equal window before them, from all blocks of a bucket."""
    parts, before = [], 0
    for blob in blobs:
        docs, key, doc, start, place, size, check = _unpack(blob)
        parts.append((docs, key, doc.astype(np.int64) + before, start, place, size, check))
        before += len(docs)
    docs, key, doc, start, place, size, check = (np.concatenate(x) for x in zip(*parts))
    step = _counting(size.astype(np.int64))
    full = mix(mix(np.repeat(key, size) + (np.repeat(place, size) - step).astype(U64)) + check * _PAIR)
    order = np.argsort(full)
    same = full[order][1:] == full[order][:-1]
    many = np.zeros(len(full), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    at = np.flatnonzero(many)
    if not len(at):
        return None
    full, check, doc, start = full[at], check[at], np.repeat(doc, size)[at], (np.repeat(start, size) + step)[at]
    order = np.lexsort((start, docs[doc, 1], docs[doc, 0], check, full))
    full, check, doc, start = full[order], check[order], doc[order], start[order]
    head = np.ones(len(full), bool)
    head[1:] = (full[1:] != full[:-1]) | (check[1:] != check[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    # A row that is given twice meets itself.
    again = (docs[doc] != docs[doc[lead]]).any(axis=1) | (start != start[lead])
    doc, start = doc[again], start[again]
    if not len(doc):
        return None
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    at, count = _ranges(doc, start)
    return pa.RecordBatch.from_pydict(_settled_rows(docs[doc[at]], start[at], count))


def _settle_buckets(batches):
    """Rows come with those of a bucket together; settled ranges pass through."""
    waiting, now = [], None
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        done = np.flatnonzero(bucket < 0)
        if len(done):
            yield batch.take(pa.array(done))
        for b, blob in zip(bucket.tolist(), batch.column("blob")):
            if b < 0:
                continue
            if b != now and waiting:
                if (out := settle(waiting)) is not None:
                    yield out
                waiting = []
            now = b
            waiting.append(blob.as_py())
    if waiting and (out := settle(waiting)) is not None:
        yield out


def keyed(docs: DataFrame) -> DataFrame:
    """doc orders the documents (null first); tie tells documents of one id apart."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64(text).alias("tie"),
        text.alias("text"),
    )


def repeated_windows(docs: DataFrame, window: int = 20, buckets: int | None = None) -> DataFrame:
    """(doc, tie, start, windows): runs of windows that occur earlier, by document."""
    conf = docs.sparkSession.conf
    tasks = int(conf.get("spark.sql.shuffle.partitions"))
    found = keyed(docs).select("doc", "tie", "text").mapInArrow(_find(window, buckets or 4 * tasks), FOUND)
    # Settled ranges are dealt by document, blocks by bucket.
    dealt = found.repartition(tasks, F.coalesce(F.nullif("bucket", F.lit(-1)), F.xxhash64("doc", "start"))).sortWithinPartitions("bucket")
    return dealt.mapInArrow(_settle_buckets, FOUND).select("doc", "tie", "start", "windows")


def _rewrite(window: int, with_text: bool):
    def run(batches):
        for part in slices(batches, "text"):
            words = split(part.column("text"))
            first, n = words.first, len(words.starts)
            gone = np.zeros(n + 1, np.int64)
            found = part.column("found")
            at = np.repeat(first[:-1], np.asarray([0 if x is None else x for x in found.value_lengths().to_pylist()], np.int64))
            start = found.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(gone, at + (start >> 32), 1)
            np.add.at(gone, at + (start >> 32) + (start & 0xFFFFFFFF) + window - 1, -1)
            kept = np.cumsum(gone[:-1]) == 0
            inside = np.zeros(len(words.data) + 1, np.int8)
            np.add.at(inside, words.starts[kept], 1)
            np.add.at(inside, words.ends[kept], -1)
            take = np.cumsum(inside[:-1]).astype(bool)
            # Kept words and one blank after each, text by text.
            held = np.concatenate([[0], np.cumsum(kept)])
            letters = np.concatenate([[0], np.cumsum(take)])
            size = letters[-1] + held[-1]
            out = np.full(size, 0x20, np.uint8)
            lengths = (words.ends - words.starts)[kept]
            put = np.ones(size, bool)
            put[np.cumsum(lengths + 1) - 1] = False
            out[put] = words.data[take]
            raw = out.tobytes()
            ends = letters[words.offsets] + held[first]
            texts = [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            counts = np.diff(first)
            cols = {
                "doc_id": part.column("doc_id"),
                "n_words": counts.astype(np.int64),
                "n_removed": counts - np.diff(held[first]),
                "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
            }
            if with_text:
                cols["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return run


def drop_repeats(docs: DataFrame, window: int = 20, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row of ``docs`` (doc_id, text).

    A word goes if a window that covers it also starts earlier: in a smaller doc_id, or
    before in the same document. Null and empty texts have no words. A null doc_id is
    smaller than any other; different texts under one doc_id are ordered by their hash;
    equal rows are one document and get equal results. A document is one record, read
    whole. Other columns are ignored.
    """
    found = materialise(repeated_windows(docs, window), "repeats")
    by_doc = found.groupBy("doc", "tie").agg(F.collect_list(_range_code(F.col("start"), F.col("windows"))).alias("found"))
    rows = keyed(docs).join(by_doc, ["doc", "tie"], "left").select("doc_id", "text", "found")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.mapInArrow(_rewrite(window, with_text), schema)


def _range_code(start: Column, windows: Column) -> Column:
    return F.shiftleft(start, 32) + windows
