"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into cells of a few words; two neighbouring cells are a passage, so
passages overlap. Passages are TF-IDF vectors over the benchmark's words (no other
word can speak for an item). A randomised SVD of all passages of all documents is
worked out in passes: each task multiplies its passages with a thin random matrix and
back, and the small products are added up by a shuffle. Passages whose latent cosine
to a passage of an item is high are candidates. They are checked by the longest
common subsequence of words, and between the two thresholds by the item's answer.

The benchmark is a stated query set: it is taken in blocks of a bounded number of
items, so what goes to the driver and out as a broadcast has a fixed size.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.gather import BLOCKS, ROWS, combined, give_out
from parley.llm.recompress import keyed
from parley.llm.words import slices, span_hashes, split
from parley.llm.words import _BYTE as BYTE_CODES
from parley.session import materialise

CELL = 16
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, first word of each text): lower case in A-Z, without ASCII punctuation at both ends."""
    words = split(column, lower=True)
    starts, ends = words.starts, words.ends.copy()
    while True:
        cut = _PUNCTUATION[words.data[ends - 1]] & (ends - starts > 1)
        if not cut.any():
            break
        ends -= cut
    starts = starts.copy()
    while True:
        cut = _PUNCTUATION[words.data[starts]] & (ends - starts > 1)
        if not cut.any():
            break
        starts += cut
    return span_hashes(BYTE_CODES[words.data], starts, ends), words.first


@dataclass
class Items:
    """A block of the benchmark."""

    ids: list[int]
    words: list[np.ndarray]  # features of each item's words
    answers: list[np.ndarray]  # features of the last sentence
    vocabulary: np.ndarray  # sorted hashes; the feature is the place

    @classmethod
    def of(cls, rows: list) -> Items:
        texts = [r["text"] for r in rows]
        hashes, first = plain_words(pa.array(texts, pa.string()))
        vocabulary = np.unique(hashes)
        features = np.searchsorted(vocabulary, hashes).astype(np.int32)
        words = [features[a:b] for a, b in zip(first, first[1:])]
        return cls([r["item_id"] for r in rows], words, [w[len(w) - last_sentence(t) :] for w, t in zip(words, texts)], vocabulary)


def last_sentence(text: str) -> int:
    """How many words the last sentence has, where there are two or more; five at most else."""
    words = text.split()
    for k in range(len(words) - 2, -1, -1):
        if words[k][-1] in ".?!:":
            return min(len(words) - 1 - k, 12)
    return min(5, len(words))


def _features(vocabulary):
    def run(batches):
        known = vocabulary.value
        for part in slices(batches, "text"):
            hashes, first = plain_words(part.column("text"))
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            found = np.where(known[at] == hashes, at, -1).astype(np.int32 if len(known) > 32_000 else np.int16)
            # A text without a word of the benchmark holds nothing to find.
            rows = [k for k in range(len(first) - 1) if (found[first[k] : first[k + 1]] >= 0).any()]
            blobs = [found[first[k] : first[k + 1]].tobytes() for k in rows]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows, pa.int64())) for c in ("doc", "tie", "doc_id")), pa.array(blobs, pa.binary())], ["doc", "tie", "doc_id", "ids"])

    return run


class Cells:
    """The cells of some documents: features in order of place, with the cell of each."""

    def __init__(self, blobs: list[bytes], kind, used: np.ndarray | None = None):
        parts = [np.frombuffer(b, kind).astype(np.int32) for b in blobs]
        self.ids = np.concatenate(parts)
        n = np.array([len(p) for p in parts])
        count = -(-n // CELL)
        self.first = np.concatenate([[0], np.cumsum(count)])  # cells of each document
        self.begin = np.concatenate([[0], np.cumsum(n)])  # words of each document
        step = np.arange(len(self.ids)) - np.repeat(self.begin[:-1], n)
        cell = np.repeat(self.first[:-1], n) + step // CELL
        some = self.ids >= 0
        if used is not None:
            some &= used[self.ids]
        self.feature, self.cell = self.ids[some], cell[some]
        self.n = int(self.first[-1])
        last = np.zeros(self.n, bool)
        last[self.first[1:] - 1] = True
        self.last = last  # of their document

    def project(self, table: np.ndarray) -> np.ndarray:
        """Rows of ``table`` summed per cell."""
        out = np.zeros((self.n, table.shape[1]), np.float32)
        if len(self.cell):
            head = np.flatnonzero(np.concatenate([[True], self.cell[1:] != self.cell[:-1]]))
            out[self.cell[head]] = np.add.reduceat(table[self.feature], head, axis=0)
        return out

    def passages(self, cells: np.ndarray) -> np.ndarray:
        """Each cell and the next one of its document."""
        out = cells.copy()
        out[:-1][~self.last[:-1]] += cells[1:][~self.last[:-1]]
        return out

    def spread(self, passages: np.ndarray) -> np.ndarray:
        """What each cell gets from the passages it is in."""
        out = passages.copy()
        out[1:][~self.last[:-1]] += passages[:-1][~self.last[:-1]]
        return out


def _cells(batches, kind, used: np.ndarray | None = None, most: int = 300_000):
    """Documents in lots of about ``most`` words; features that are not ``used`` count as no word."""
    for batch in batches:
        blobs = batch.column("ids").to_pylist()
        at = held = 0
        for k, b in enumerate(blobs):
            held += len(b) // np.dtype(kind).itemsize
            if held >= most or k == len(blobs) - 1:
                yield batch.slice(at, k + 1 - at), Cells(blobs[at : k + 1], kind, used)
                at, held = k + 1, 0


def _padded(rows: int) -> int:
    return -(-rows // BLOCKS) * BLOCKS


def document_frequency(table: DataFrame, features: int, kind) -> tuple[np.ndarray, int]:
    """(passages that hold each feature, passages)."""

    def run(batches):
        held = np.zeros(_padded(features + 1), np.int64)
        for _, cells in _cells(batches, kind):
            before = cells.cell - 1
            two = (before >= 0) & ~cells.last[before]  # words of a later cell are in the passage before, too
            both = np.concatenate([cells.cell, before[two]]).astype(np.int64)
            names = np.concatenate([cells.feature, cells.feature[two]])
            held[:features] += np.bincount(np.unique(both * features + names) % features, minlength=features)
            held[features] += cells.n
        yield give_out(held)

    counts = combined(table.select("ids").mapInArrow(run, ROWS), np.int64, np.add, _padded(features + 1))
    return counts[:features], int(counts[features])


def weights(frequency: np.ndarray, passages: int, items: Items, common: float, at_least: int = 8) -> np.ndarray:
    """Inverse document frequency, 1 / sqrt(df + 4): all words that are used bring about the same energy.

    Words in more than a share ``common`` of all passages get 0, but for the ``at_least``
    rarest words of each item, so that no item is without words.
    """
    used = frequency <= common * passages
    for words in items.words:
        own = np.unique(words)
        used[own[np.argsort(frequency[own], kind="stable")[:at_least]]] = True
    return np.where(used, 1 / np.sqrt(frequency + 4.0), 0).astype(np.float32)


def latent_space(table: DataFrame, weight: np.ndarray, rank: int, kind, extra: int = 8, seed: int = 5) -> np.ndarray:
    """Weighted right singular vectors of the passage matrix, one row per feature."""
    features = len(weight)
    width = min(rank + extra, features)
    spark = table.sparkSession
    start = np.random.default_rng(seed).standard_normal((features, width)).astype(np.float32)
    sketch = spark.sparkContext.broadcast(start * weight[:, None])

    def back_and_forth(batches):
        held = np.zeros((_padded(features), width))
        for _, cells in _cells(batches, kind, weight > 0):
            cells_out = cells.spread(cells.passages(cells.project(sketch.value)))
            if len(cells.feature):
                order = np.argsort(cells.feature, kind="stable")
                names = cells.feature[order]
                head = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
                held[names[head]] += np.add.reduceat(cells_out[cells.cell[order]], head, axis=0)
        yield give_out(held)

    product = combined(table.select("ids").mapInArrow(back_and_forth, ROWS), np.float64, np.add, _padded(features) * width).reshape(-1, width)[:features]
    basis, _ = np.linalg.qr(product * weight[:, None])
    basis = basis.astype(np.float32)
    bound = spark.sparkContext.broadcast(basis * weight[:, None])

    def gram(batches):
        held = np.zeros(_padded(basis.shape[1] ** 2))
        for _, cells in _cells(batches, kind, weight > 0):
            rows = cells.passages(cells.project(bound.value))
            held[: basis.shape[1] ** 2] += (rows.T @ rows).astype(np.float64).reshape(-1)
        yield give_out(held)

    small = combined(table.select("ids").mapInArrow(gram, ROWS), np.float64, np.add, _padded(basis.shape[1] ** 2))[: basis.shape[1] ** 2].reshape(basis.shape[1], -1)
    values, turn = np.linalg.eigh(small)
    return (basis @ turn[:, np.argsort(-values)][:, :rank] * weight[:, None]).astype(np.float32)


def item_passages(items: Items, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit latent vectors, item of each): an item's windows of two cells, half overlapping."""
    rows, owner = [], []
    for k, words in enumerate(items.words):
        for at in range(0, max(1, len(words) - CELL), CELL):
            rows.append(space[words[at : at + 2 * CELL]].sum(axis=0) if len(words) else np.zeros(space.shape[1]))
            owner.append(k)
    rows = np.array(rows, np.float32).reshape(-1, space.shape[1])
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9), np.array(owner, np.int64)


def common_subsequence(places: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``places`` has a bit per place of each word of the other sequence."""
    all_ = (1 << length) - 1
    row = all_
    for w in words:
        hit = row & places.get(w, 0)
        if hit:
            row = (row + hit | row - hit) & all_
    return length - row.bit_count()


class Checker:
    """Longest common subsequences with the items."""

    def __init__(self, items: Items, copied: float, reworded: float):
        self.items, self.copied, self.reworded = items, copied, reworded
        self.members: dict[int, np.ndarray] = {}
        self.places = [self._places(w) for w in items.words]
        self.answers = [self._places(w) for w in items.answers]

    def member(self, item: int) -> np.ndarray:
        """Whether each feature is a word of the item; -1, another word, is the last entry."""
        if item not in self.members:
            self.members[item] = np.zeros(len(self.items.vocabulary) + 1, bool)
            self.members[item][self.items.words[item]] = True
        return self.members[item]

    @staticmethod
    def _places(words: np.ndarray) -> dict[int, int]:
        out: dict[int, int] = {}
        for k, w in enumerate(words.tolist()):
            out[w] = out.get(w, 0) | 1 << k
        return out

    def best(self, item: int, words: np.ndarray) -> tuple[int, int, str] | None:
        """(common words, where the window starts, kind) of the best window that counts as the item."""
        n, places = len(self.items.words[item]), self.places[item]
        least = self.reworded * n
        known = self.member(item)[words]
        if np.count_nonzero(known) < least:
            return None
        words = words.tolist()
        if common_subsequence(places, n, words) < least:
            return None
        width, found = int(1.25 * n) + 3, (0, 0)
        held = np.concatenate([[0], np.cumsum(known)])
        for at in range(0, max(1, len(words) - width + 1), max(1, n // 8)):
            if held[min(at + width, len(words))] - held[at] > found[0]:
                found = max(found, (common_subsequence(places, n, words[at : at + width]), -at))
        common, at = found[0], -found[1]
        if common >= self.copied * n:
            return common, at, "copy"
        answer = self.items.answers[item]
        if common >= least and common_subsequence(self.answers[item], len(answer), words[at : at + width]) >= 0.8 * len(answer):
            return common, at, "paraphrase"
        return None


FOUND = "doc long, tie long, doc_id long, item_id long, common long, n_words long, start long, kind string"


def _search(space, items, threshold: float, copied: float, reworded: float, kind):
    def run(batches):
        checker = Checker(items.value, copied, reworded)
        queries, owner = item_passages(items.value, space.value)
        length = np.array([len(w) for w in items.value.words])
        used = np.abs(space.value).sum(axis=1) > 0
        for part, cells in _cells(batches, kind, used):
            rows = cells.passages(cells.project(space.value))
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
            hits = []
            for k in range(0, cells.n, 4096):
                cell, query = np.nonzero(rows[k : k + 4096] @ queries.T >= threshold)
                hits.append(np.stack([cell + k, owner[query]], axis=1))
            hits = np.unique(np.concatenate(hits), axis=0) if hits else np.zeros((0, 2), np.int64)
            if not len(hits):
                continue
            doc = np.searchsorted(cells.first, hits[:, 0], "right") - 1
            begin, end = cells.begin[doc], cells.begin[doc + 1]
            middle = begin + (hits[:, 0] - cells.first[doc]) * CELL
            low = np.maximum(begin, middle - length[hits[:, 1]] - CELL)
            high = np.minimum(end, middle + 2 * CELL + length[hits[:, 1]] + CELL)
            # Overlapping regions of one document and item are one.
            order = np.lexsort((low, hits[:, 1], doc))
            best: dict[tuple[int, int], tuple] = {}
            spans: list[list[int]] = []
            for d, item, a, b in zip(doc[order].tolist(), hits[order, 1].tolist(), low[order].tolist(), high[order].tolist()):
                if spans and spans[-1][:2] == [d, item] and a <= spans[-1][3]:
                    spans[-1][3] = max(b, spans[-1][3])
                else:
                    spans.append([d, item, a, b])
            for d, item, a, b in spans:
                got = checker.best(item, cells.ids[a:b])
                if got and got[0] > best.get((d, item), (0,))[0]:
                    best[d, item] = (got[0], a + got[1] - int(cells.begin[d]), got[2])
            if best:
                at = pa.array([d for d, _ in best], pa.int64())
                own = [items.value.ids[i] for _, i in best]
                n = [int(length[i]) for _, i in best]
                cols = [pa.array(x) for x in zip(*best.values())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in ("doc", "tie", "doc_id")), pa.array(own, pa.int64()), cols[0], pa.array(n, pa.int64()), cols[1], cols[2]],
                    ["doc", "tie", "doc_id", "item_id", "common", "n_words", "start", "kind"],
                )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = 64, threshold: float = 0.6, copied: float = 0.8, reworded: float = 0.6, common: float = 0.003, block: int = 1000) -> DataFrame:
    """(doc_id, item_id, common, n_words, start, kind, doc, tie): items found in documents.

    ``common`` of the item's ``n_words`` words stand in order in a window of the document
    not much longer than the item, from word ``start`` on. A share of ``copied`` is a copy;
    a share of ``reworded`` is a paraphrase if the item's last sentence is there as well.
    ``doc`` and ``tie`` name the document, as ``recompress.keyed`` does. Null and empty
    texts, in documents and benchmark, match nothing. Equal documents are one; equal items
    with different ids are found each. Other columns are ignored.
    """
    spark = docs.sparkSession
    listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    listed = listed.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).distinct()
    blocks = max(1, -(-listed.count() // block))
    out = []
    for k in range(blocks):
        items = Items.of(listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect())
        if not items.ids:
            continue
        kind = np.int32 if len(items.vocabulary) > 32_000 else np.int16
        vocabulary = spark.sparkContext.broadcast(items.vocabulary)
        features = keyed(docs).mapInArrow(_features(vocabulary), "doc long, tie long, doc_id long, ids binary")
        features = materialise(features, "features")
        frequency, passages = document_frequency(features, len(items.vocabulary), kind)
        weight = weights(frequency, passages, items, common)
        space = spark.sparkContext.broadcast(latent_space(features, weight, rank, kind))
        found = features.mapInArrow(_search(space, spark.sparkContext.broadcast(items), threshold, copied, reworded, kind), FOUND)
        out.append(materialise(found.distinct(), "contaminated"))
    return functools.reduce(DataFrame.union, out or [spark.createDataFrame([], FOUND)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay as they are."""
    found = contaminated(docs, benchmark, **options).select(F.col("doc").alias("__doc"), F.col("tie").alias("__tie")).distinct()
    doc, tie = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64(F.col("text").cast("string"))
    return docs.withColumn("__doc", doc).withColumn("__tie", tie).join(found, ["__doc", "__tie"], "left_anti").select(*docs.columns)
