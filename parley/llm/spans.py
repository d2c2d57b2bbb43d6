"""Tokens of two tokenizers side by side: spans, groups between common cuts, links and their counts.

Tokenizer A is byte-level BPE of the tokenizers library, B a sentencepiece model. Their own
spans are the coarse cuts: character offsets of A, and the spans of the pieces in B's
protocol message. Where a span does not end on a border of characters (a character cut
in two by A, the byte pieces of B), the tokens' decoded bytes tell where each one ends.

A text is encoded in chunks: white space and what follows it. Neither tokenizer joins
anything across the start of a chunk, which is checked in their files; if it does not hold,
the chunk is the whole text. Each distinct chunk of a piece of the corpus is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.packed import pieces, squeeze, unsqueeze
from parley.session import materialise

PIECE = 8 << 20
# White space that starts with a space or a line feed begins a chunk; other white space does not.
_CHUNK = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"  # ASCII punctuation that ends a word
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
_B_BITS = 32


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass(frozen=True, slots=True)
class Chunk:
    """What one chunk of text gives; ``links`` are (A id << 32 | B id)."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: tuple[int, ...]


def token_ends(begin: np.ndarray, stop: np.ndarray, decoded: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset where each token ends, and which tokens' spans and bytes disagree.

    ``begin`` and ``stop`` are the tokens' spans, ``decoded`` where their bytes end, ``last``
    marks the last token of each chunk. A span's end is the token's end unless the next
    token's span begins before it, or it is empty: such tokens share a character, and
    their decoded bytes cut it.
    """
    after = np.append(begin[1:], 0)
    coarse = (begin < stop) & (last | (after >= stop))
    return np.where(coarse, stop, decoded), coarse & (stop != decoded)


class Aligner:
    """Both tokenizers, and the chunks met so far; ``room`` bounds how many are kept."""

    def __init__(self, path_a: str, path_b: str, room: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [self._piece_bytes(name, self.b.is_byte(i)) for i, name in enumerate(names)]
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        special = (self.b.is_byte, self.b.is_control, self.b.is_unknown)
        self.chunked = self._cuts_hold(path_a, [n for i, n in enumerate(names) if not any(f(i) for f in special)])
        self.room, self.known = room, {}

    @staticmethod
    def _piece_bytes(name: str, byte: bool) -> bytes:
        if byte:
            return bytes([int(_BYTE.fullmatch(name)[1], 16)])
        return name.replace("▁", " ").encode()

    def _cuts_hold(self, path_a: str, names: list[str]) -> bool:
        """Whether no token of either kind reaches over the start of a chunk, or from a letter to a mark."""
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        cut = spec.get("pre_tokenizer") or {}
        plain_a = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        inner = any("▁" in n.lstrip("▁") or ("\n" in n and n != "\n") or any(x.isalpha() and y in _MARKS for x, y in zip(n, n[1:])) for n in names)
        as_is = [self.b.decode(self.b.encode(x)) == x for x in ("a  b", " a", "a ", "ﬁ Å")]
        return bool(plain_a and not inner and all(as_is))

    def chunks(self, text: str) -> list[str]:
        text = " " + text
        found = _CHUNK.findall(text) if self.chunked else [text]
        if found[-1] == " " and len(found) > 1:  # B makes nothing of an empty text, so a last space goes with what it follows
            found[-2:] = [found[-2] + " "]
        return found

    def encode(self, chunks: list[str]) -> Iterator[Chunk | None]:
        """The tokens of each chunk, in order; None where joined bytes differ from the text."""
        for k in range(0, len(chunks), 5000):
            part = chunks[k : k + 5000]
            parts = [self._parts(c) for c in part]
            new = list({x for p in parts for x in p}.difference(self.known))
            made = dict(zip(new, self._align(new))) if new else {}
            for p in parts:
                got = [made[x] if x in made else self.known[x] for x in p]
                yield got[0] if len(got) == 1 or got[0] is None else None if got[1] is None else _joined(*got)
            if len(self.known) < self.room:
                self.known.update(made)

    def _parts(self, chunk: str) -> tuple[str, ...]:
        """A word and the marks behind it are encoded by themselves, for words share marks."""
        if self.chunked and not chunk[-1].isalnum():
            word = chunk.rstrip(_MARKS)
            if word and len(word) < len(chunk) and word[-1].isalpha():
                return word, chunk[len(word) :]
        return (chunk,)

    def _align(self, chunks: list[str]) -> list[Chunk | None]:
        coded = self.a.encode_batch(chunks, add_special_tokens=False)
        # B puts a space in front by itself. It joins nothing to a line feed, which parts that space from what has none.
        lead = [(c[1:], 0) if c[0] == " " else (c, 1) if c[0] == "\n" else ("\n" + c, 2) for c in chunks]
        protos = self.b.encode([x for x, _ in lead], return_type="proto", num_threads=1)
        n_a = np.array([len(e.ids) for e in coded])
        a_ids = np.array([i for e in coded for i in e.ids], np.int64)
        spans = np.array([o for e in coded for o in e.offsets], np.int64).reshape(-1, 2)
        drop = np.array([d for _, d in lead])
        b_rows = [[(p.id, p.begin, p.end) for p in x.pieces][d:] for x, d in zip(protos, drop.tolist())]
        n_b = np.array([len(r) for r in b_rows])
        b = np.array([x for r in b_rows for x in r], np.int64).reshape(-1, 3)
        data = [c.encode() for c in chunks]
        joined = b"".join(data)
        base = np.cumsum([0, *map(len, data)])  # where each chunk begins, in bytes of them all
        raw = np.frombuffer(joined, np.uint8)
        borders = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where each character begins
        first = np.cumsum([0, *map(len, chunks)])[:-1]  # character of each chunk
        of_a, of_b = np.repeat(np.arange(len(chunks)), n_a), np.repeat(np.arange(len(chunks)), n_b)
        shift = 1 - drop
        found = []
        for ids, of, n, begin, stop, sizes, own in (
            (a_ids, of_a, n_a, borders[first[of_a] + spans[:, 0]], borders[first[of_a] + spans[:, 1]], self.a_sizes, self.a_bytes),
            (b[:, 0], of_b, n_b, base[of_b] + b[:, 1] + shift[of_b], base[of_b] + b[:, 2] + shift[of_b], self.b_sizes, self.b_bytes),
        ):
            length = sizes[ids]
            total = np.bincount(of, length, len(chunks)).astype(np.int64)
            bad = total != np.diff(base)
            tokens = list(map(own.__getitem__, ids.tolist()))
            if bad.any() or b"".join(tokens) != joined:
                at = np.cumsum([0, *n])
                bad |= np.array([b"".join(tokens[x:y]) != d for x, y, d in zip(at, at[1:], data)], bool)
            decoded = np.cumsum(length) - np.repeat(np.cumsum(total) - total, n) + base[of]
            last = np.append(of[1:] != of[:-1], True)[: len(of)]
            ends, apart = token_ends(begin, stop, decoded, last)
            bad[of[apart]] = True
            found.append((ends, bad))
        (a_ends, bad), (b_ends, bad_b) = found
        bad |= bad_b
        a_cut, b_cut = np.isin(a_ends, b_ends), np.isin(b_ends, a_ends)
        return self._groups(chunks, bad, (a_ids, n_a, of_a, a_cut), (b[:, 0], n_b, of_b, b_cut))

    @staticmethod
    def _groups(chunks: list[str], bad: np.ndarray, a: tuple, b: tuple) -> list[Chunk | None]:
        """Tokens between common cuts, as text and as links; no token is empty, so one of each kind ends at a cut."""
        (a_ids, n_a, of_a, a_cut), (b_ids, n_b, of_b, b_cut) = a, b
        out: list[Chunk | None] = [None] * len(chunks)
        if bad.any():  # what does not make up its chunk has no place in the order of the cuts
            keep_a, keep_b = ~bad[of_a], ~bad[of_b]
            a_ids, of_a, a_cut, b_ids, of_b, b_cut = a_ids[keep_a], of_a[keep_a], a_cut[keep_a], b_ids[keep_b], of_b[keep_b], b_cut[keep_b]
        group_a, group_b = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        cut = np.concatenate([a_cut, b_cut])[order]
        mark = np.where(cut, np.where(order < len(a_ids), 1, 2), 0).tolist()
        signs = (",", "|", ";")
        words = [f"{i}{signs[m]}" for i, m in zip(np.concatenate([a_ids, b_ids])[order].tolist(), mark)]
        links = (a_ids[a_cut] << _B_BITS | b_ids[b_cut]).tolist()
        good = np.flatnonzero(~bad)
        groups = np.bincount(of_a[a_cut], minlength=len(chunks))[good].tolist()
        sizes = zip(good.tolist(), n_a[good].tolist(), n_b[good].tolist(), groups)
        at = link = 0
        for k, x, y, g in sizes:
            out[k] = Chunk(x, y, g, "".join(words[at : at + x + y])[:-1], tuple(links[link : link + g]))
            at, link = at + x + y, link + g
        return out


def _joined(word: Chunk, marks: Chunk) -> Chunk:
    return Chunk(word.n_a + marks.n_a, word.n_b + marks.n_b, word.n_groups + marks.n_groups, f"{word.groups};{marks.groups}", word.links + marks.links)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker, kept between its tasks."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


PIECES = (
    "piece long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, n_links array<long>, "
    "places binary, pairs array<long>, counts array<long>"
)


def _encode(path_a: str, path_b: str, most: int):
    def run(batches):
        from pyspark import TaskContext

        both, first = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        for number, part in enumerate(pieces(batches, "text", most)):
            numbers: dict[str, int] = {}  # of each chunk of this piece
            split = []
            for text in part.column("text"):
                found = both.chunks(text.as_py()) if text.is_valid and len(text.as_py()) else []
                split.append(np.array([numbers.setdefault(c, len(numbers)) for c in found], np.int32))
            sizes = np.zeros((len(numbers), 3), np.int64)  # tokens of A and B, groups; all zero where the bytes differ
            groups, links, n_links = [], [], np.zeros(len(numbers) + 1, np.int64)
            for k, f in enumerate(both.encode(list(numbers))):
                groups.append(None if f is None else f.groups)
                if f is not None:
                    sizes[k] = f.n_a, f.n_b, f.n_groups
                    links += f.links
                    n_links[k + 1] = len(f.links)
            start = np.cumsum(n_links)
            pairs, place = np.unique(np.array(links, np.int64), return_inverse=True)
            del numbers, links
            totals, sha, places = np.zeros((len(split), 3), np.int64), [], []
            for k, chunks in enumerate(split):
                if not len(chunks) or not sizes[chunks].all():
                    sha.append("")
                    places.append(chunks[:0])
                    continue
                totals[k] = sizes[chunks].sum(axis=0)
                sha.append(hashlib.sha256(";".join([groups[c] for c in chunks.tolist()]).encode()).hexdigest())
                n = n_links[chunks + 1]
                at = np.repeat(start[chunks] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                places.append(place[at].astype(np.int32))
            every = np.concatenate(places) if places else np.zeros(0, np.int32)
            counts = np.bincount(every, minlength=len(pairs))
            used = np.flatnonzero(counts)  # chunks of texts that were left out have pairs as well
            again = np.zeros(len(counts), np.int64)
            again[used] = np.arange(len(used))
            a, b, g = totals.T
            row = {"piece": [first + number], "doc_id": [part.column("doc_id").to_pylist()], "n_a": [a], "n_b": [b], "n_groups": [g], "groups_sha256": [sha]}
            row |= {"n_links": [[len(p) for p in places]], "places": [squeeze(again[every])], "pairs": [pairs[used]], "counts": [counts[used]]}
            types = {"piece": pa.int64(), "groups_sha256": pa.list_(pa.string()), "places": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.list_(pa.int64()))) for k, v in row.items()], list(row))

    return run


def pair_counts(coded: DataFrame) -> DataFrame:
    """(pair, n, best) of every id pair of the corpus: its links, and whether its B id has none with more."""
    each = coded.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    totals = materialise(each.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    most = totals.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # no more rows than B has ids
    return totals.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of (doc_id, text).

    Byte offsets where tokens of A and B both end cut the tokens into groups; the
    tokens that end there together are linked. A pair of ids counts its links in the
    corpus; ``n_best`` are the links whose count is the highest of their B id, ties
    included, and ``count_sum`` adds the counts of all links. The digest is of
    ``a1,a2|b1;a3|b2,b3``. Strings of special tokens inside texts are plain text.

    Null and empty texts, and those whose tokens of A or B do not make up a space and the
    text, have no tokens: zeros and an empty digest. Repeated rows each count. Other columns
    are not looked at. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = materialise(rows.mapInArrow(_encode(path_a, path_b, piece), PIECES), "aligned")
    asked = coded.select("piece", F.posexplode("pairs").alias("at", "pair"))
    told = asked.join(pair_counts(coded), "pair")
    replies = told.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("told"))

    def score(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                told = row.column("told").flatten()
                n = np.zeros(len(told), np.int64) if not len(told) else told.field("n").to_numpy()
                best = told.field("best").to_numpy(zero_copy_only=False).astype(np.int64) if len(told) else n
                places = unsqueeze(row.column("places")[0].as_py())
                sizes = row.column("n_links").flatten().to_numpy()
                stop = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.concatenate([[0], np.cumsum(x[places])]) for x in (n, best)]
                count_sum, n_best = (s[stop[1:]] - s[stop[:-1]] for s in sums)
                flat = {c: row.column(c).flatten() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
                flat |= {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": row.column("groups_sha256").flatten()}
                yield pa.RecordBatch.from_arrays(list(flat.values()), list(flat))

    kept = coded.select("piece", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places").join(replies, "piece", "left")
    longs = ", ".join(f"{c} long" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return kept.mapInArrow(score, f"{longs}, groups_sha256 string")
