"""Token ids in shard files of compressed byte or bit planes.

A shard holds the ids of consecutive documents. They are cut into blocks of a
fixed number of ids; a block is transposed into planes (plane k has byte k, or bit
k, of every id) and each plane is compressed by itself, so that the nearly constant
high planes cost next to nothing. After the blocks come the document index (number,
id count), the chunk index (first id, ids, length of each plane), both compressed,
and a fixed-size trailer that points to them.

Shards are written by the tasks that encode, through Arrow's file systems, under a
name of their own for each attempt. Only files named by a finished task's manifest
row count, so a task that runs twice leaves an unused file and no wrong data.

Null texts are empty and get the end id alone. Equal ``doc_id`` values keep one
entry each, ordered by the text's hash; a null ``doc_id`` comes first.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.llm.words import slices, text_bytes
from parley.session import materialise, scratch_path

MAGIC = b"PLANES01"
TRAILER = struct.Struct("<QQQQBBHI8s")  # documents at, length, chunks at, length, bits, planes, 0, block, magic
BLOCK = 1 << 16
_MARKS = b".,!*#$%&"  # fixed value: marks that often follow a word


def to_planes(ids: np.ndarray, planes: int, bits: bool) -> list[bytes]:
    """The planes of uint32 ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(planes)]
    return [np.packbits(raw[:, k // 8] >> (k % 8) & 1, bitorder="little").tobytes() for k in range(planes)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        got = np.frombuffer(plane, np.uint8)
        if bits:
            raw[:, k // 8] |= np.unpackbits(got, count=n, bitorder="little") << (k % 8)
        else:
            raw[:, k] = got
    return raw.reshape(-1).view("<u4")


class ShardWriter:
    """Writes one shard as ids come in; holds one block at most."""

    def __init__(self, out, vocab_size: int, block: int = BLOCK, bits: bool = False, level: int = 3):
        self.out, self.block, self.bits = out, block, bits
        width = max(1, (vocab_size - 1).bit_length())
        self.planes = width if bits else -(-width // 8)
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = self.at = 0
        self.docs: list[tuple[int, bool, int]] = []
        self.chunks: list[list[int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (self.planes if self.bits else 8 * self.planes):
            raise ValueError("an id is beyond the vocabulary size")
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._blocks(last=False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % self.block
        for k in range(0, stop, self.block):
            part = ids[k : min(k + self.block, stop)]
            packed = [self.zip.compress(p) for p in to_planes(part, self.planes, self.bits)]
            self.chunks.append([self.written, len(part), self.at, *map(len, packed)])
            for p in packed:
                self.out.write(p)
                self.at += len(p)
            self.written += len(part)
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._blocks(last=True)
        table = np.array(self.docs, np.int64).reshape(-1, 3)
        docs = self.zip.compress(np.ascontiguousarray(table.T).tobytes())
        chunks = self.zip.compress(np.array(self.chunks, np.int64).tobytes())
        self.out.write(docs + chunks)
        self.out.write(TRAILER.pack(self.at, len(docs), self.at + len(docs), len(chunks), self.bits, self.planes, 0, self.block, MAGIC))


class ShardReader:
    def __init__(self, source):
        self.source = source
        source.seek(source.size() - TRAILER.size)
        docs_at, docs_len, chunks_at, chunks_len, bits, self.planes, _, self.block, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        self.bits, self.unzip = bool(bits), zstandard.ZstdDecompressor()
        source.seek(docs_at)
        self.docs = np.frombuffer(self.unzip.decompress(source.read(docs_len)), np.int64).reshape(3, -1).T
        source.seek(chunks_at)
        self.chunks = np.frombuffer(self.unzip.decompress(source.read(chunks_len)), np.int64).reshape(-1, 3 + self.planes)

    def chunk(self, k: int) -> np.ndarray:
        _, n, at, *lengths = self.chunks[k].tolist()
        self.source.seek(at)
        return from_planes([self.unzip.decompress(self.source.read(x)) for x in lengths], n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc_id, first id, ids in pieces) of each document, a chunk in memory at a time."""
        k, have, start = 0, np.zeros(0, np.uint32), 0
        for doc_id, missing, n in self.docs.tolist():
            pieces, need = [], n
            while need:
                if not len(have):
                    have, k = self.chunk(k), k + 1
                pieces.append(have[:need])
                have = have[need:]
                need -= len(pieces[-1])
            yield None if missing else doc_id, start, pieces
            start += n


# Fixed value: the words of a tokenizer that lower-cases and drops white space.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def drops_blanks(path: str) -> bool:
    """Whether a tokenizer's file says that it lower-cases a text and encodes its words one by one, without the blanks."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    changes = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = cuts[0] if cuts else {}
    words = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern") == {"Regex": _WORDS}
    return changes == ["NFC", "Replace", "Lowercase"] and bool(words)


def marker(path: str) -> tuple[str, int] | None:
    """A special token, with its id, that is found in a text as it stands; None if the tokenizer's file has none."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens") or []
    plain = [t for t in added if t["special"] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"])]
    return (plain[-1]["content"], plain[-1]["id"]) if plain else None


class MemoEncoder:
    """Encodes with a tokenizer of the tokenizers library.

    One that drops white space, as its file tells, encodes a text as its blank-separated
    pieces one after another, so each distinct piece is encoded once per worker;
    ``room`` bounds the memory, at some 150 bytes a piece: the pieces of half the room become the
    past, from which those that come again are taken over, and the past before goes. New
    pieces are encoded many at a time, with a special token behind each. Any other tokenizer gets whole texts.
    """

    TOGETHER = 50

    def __init__(self, path: str, room: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.known, self.past = Tokenizer.from_file(path), room, {}, {}
        self.in_pieces, self.marker = drops_blanks(path), marker(path)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.in_pieces:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        # bytes.split cuts at the ASCII blanks alone. ASCII letters are lower-cased here as the tokenizer
        # would do next, so that fewer pieces differ; texts that may name a special token stay as they are.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        new = list(set().union(*split).difference(self.known))
        if len(self.known) + len(new) > self.room // 2:
            self.known, self.past, new = {}, self.known, list(set().union(*split))
        self._learn(self._recalled(new))
        return [b"".join(map(self.known.__getitem__, p)) for p in split]

    def _recalled(self, pieces) -> list[bytes]:
        """Takes over what the past knows; returns the others."""
        if not self.past:
            return list(pieces)
        again = self.past.keys() & pieces
        self.known.update((p, self.past[p]) for p in again)
        return [p for p in pieces if p not in again]

    def _learn(self, pieces: list[bytes]) -> None:
        # The tokenizer cuts between letters or digits and marks, so a word is shared by its forms with marks behind it.
        forms = {}
        for p in pieces:
            word = p.rstrip(_MARKS)
            if len(word) < len(p) and word[-1:].isalnum() and b"<|" not in p:
                forms[p] = (word, p[len(word) :])
        new = {x for p in pieces for x in forms.get(p, (p,))}.difference(self.known)
        new = self._recalled(new)
        for k in range(0, len(new), 10_000):
            self._encode(new[k : k + 10_000])
        for p, (word, marks) in forms.items():
            self.known[p] = self.known[word] + self.known[marks]

    def _encode(self, pieces: list[bytes]) -> None:
        alone = pieces
        if self.marker:
            mark, mark_id = self.marker
            alone = [p for p in pieces if mark.encode() in p]
            groups = [p.decode() for p in pieces if mark.encode() not in p] if alone else [p.decode() for p in pieces]
            groups = [groups[k : k + self.TOGETHER] for k in range(0, len(groups), self.TOGETHER)]
            texts = [f" {mark} ".join([*g, ""]) for g in groups]
            for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(ids == mark_id)
                if len(ends) != len(g):
                    raise ValueError("a special token is lost or made between pieces")
                raw, at = ids.tobytes(), 0
                for piece, end in zip(g, (4 * ends).tolist()):
                    self.known[piece.encode()] = raw[at:end]
                    at = end + 4
        for piece, e in zip(alone, self.tokenizer.encode_batch_fast([p.decode() for p in alone], add_special_tokens=False)):
            self.known[piece] = np.array(e.ids, "<u4").tobytes()


_ENCODERS: dict[str, MemoEncoder] = {}


def memo_encoder(path: str) -> MemoEncoder:
    """One encoder per Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = MemoEncoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, vocab_size: int, end_id: int, block: int = BLOCK, bits: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards under ``folder``; returns the manifest.

    Shards follow ascending doc_id: shard k holds smaller ids than shard k + 1.
    """

    def encode(batches):
        from pyspark import TaskContext

        encoder, shard = memo_encoder(tokenizer), TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.planes"
        out = writer = None
        end = np.array([end_id], np.uint32)
        for part in slices(batches, "text"):
            if writer is None:
                out = system.open_output_stream(f"{root}/{name}")
                writer = ShardWriter(out, vocab_size, block, bits)
            data, offsets = text_bytes(part.column("text"))
            data, cuts = data.tobytes(), offsets.tolist()
            texts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder(texts)):
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_docs": [len(writer.docs)], "n_tokens": [writer.written]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.drop("tie").mapInArrow(encode, "shard long, file string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, read from the shards.

    The manifest has one row per file, so its running sum is the only single-task step.
    """

    def decode(batches):
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                rows = []
                with system.open_input_file(f"{root}/{name}") as source:
                    for doc_id, start, pieces in ShardReader(source).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                        rows.append((doc_id, before + start, sum(map(len, pieces)), crc, name))
                names = ("doc_id", "start", "n_tokens", "ids_crc32")
                cols = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]] if rows else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*cols, pa.array([name] * len(rows), pa.string())], [*names, "file"])

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("file", "before")
    # A number is given, for the few bytes of file names would be read by one task else.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "file").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder as Arrow wants it named; one without a scheme is on Spark's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    return re.sub("^file:/(?!/)", "file:///", whole)


def token_shards(docs: DataFrame, tokenizer: str, vocab_size: int, end_id: int, folder: str | None = None, **options) -> DataFrame:
    """Write the shards, then read them back."""
    folder = folder or scratch_path(docs.sparkSession, "planes")
    folder = qualified(docs.sparkSession, folder)
    manifest = materialise(write_shards(docs, folder, tokenizer, vocab_size, end_id, **options), "manifest")
    return read_shards(manifest, folder)
