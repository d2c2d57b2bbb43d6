"""Language-model scores from a probabilistic suffix tree over words.

A state of the tree is a context of up to ``depth`` words. A context that occurs often
enough is kept if what follows it diverges from what follows its longest kept suffix: the
log-likelihood ratio of its own symbols has to pay for each of them. A kept context's
distribution is its own counts, smoothed with that of its suffix; the root's is the smoothed
word frequency. A word is scored in the state of the longest kept suffix before it.

Documents stay in pieces of bounded size, written once as word numbers. Per level, each
piece asks for its different (context, word) pairs, with its own counts beside them; a
bucket of contexts adds the counts of all pieces, tests the contexts, and answers each
piece. So counts travel once per piece and pair, however often the pair occurs, and no task
holds more than a piece or a bucket. Contexts that a large share of all tokens follows are
spread over all buckets by their words; they are so few by definition that their sums
are handed to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.packed import pieces, squeeze, unsqueeze
from parley.llm.words import U64, mix, split
from parley.session import materialise

PIECE = 8 << 20
END = U64(0x5851F42D4C957F2D)  # stands for the end of a text
_WORD = 6  # bytes of a word's hash that tell it from the others after the same context
_NEXT, _LONGER = U64(0x9FB21C651E98DF25), U64(0xD1B54A32D192ED03)
HOT_SHARE = 100_000  # a context followed by more than one in so many tokens is hot: there are fewer than that many


@dataclass(frozen=True)
class Shape:
    """``depth`` words of context at most; a context occurs ``least_context`` times, a symbol of its own ``least_symbol``
    times; ``gain`` nats per symbol are what a kept context has to win."""

    depth: int = 2
    least_context: int = 256
    least_symbol: int = 2
    gain: float = 2.0


@dataclass(frozen=True)
class Totals:
    tokens: int
    types: int

    @property
    def hot(self) -> int:
        return max(1_000_000, self.tokens // HOT_SHARE)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Natural logarithms of the root's probabilities."""
        return np.log((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


@dataclass
class Nodes:
    """Contexts in order, with the tokens that follow them as own symbols, and how many those are; none if not kept."""

    keys: np.ndarray
    own: np.ndarray
    types: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.own[at], 0), np.where(hit, self.types[at], 0)


NO_NODES = Nodes(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def kept_nodes(count: np.ndarray, own: np.ndarray, types: np.ndarray, ratio: np.ndarray, shape: Shape) -> np.ndarray:
    """The divergence test. ``ratio`` adds c * (ln c - ln p) over own symbols, p as the suffix has it."""
    with np.errstate(divide="ignore", invalid="ignore"):
        won = ratio - own * np.log(np.maximum(count, 1))
    return (count >= shape.least_context) & (types > 0) & (won > shape.gain * types)


PIECES = "piece long, doc_id array<long>, held_out array<boolean>, sizes array<long>, places binary, words binary, counts binary, n_words long, n_tokens long"


def _cut(most: int):
    """Documents in, pieces out: each token as its number among the piece's words, commonest first."""

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        for number, part in enumerate(pieces(batches, "text", most)):
            words = split(part.column("text").combine_chunks(), lower=True)
            sizes = words.counts + 1
            stop = np.cumsum(sizes)
            tokens = np.full(int(stop[-1]), END)
            inner = np.ones(len(tokens), bool)
            inner[stop - 1] = False
            tokens[inner] = words.hashes()
            held = part.column("held_out").to_numpy()
            learned = np.repeat(~held, sizes)
            names, places, n = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            counts = np.bincount(places, learned, len(names)).astype(np.int64)
            row = {
                "piece": pa.array([first + number]),
                "doc_id": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                "held_out": pa.array([held.tolist()]),
                "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "places": pa.array([squeeze(rank[places])], pa.binary()),
                "words": pa.array([names[order].tobytes()], pa.binary()),
                "counts": pa.array([squeeze(counts[order])], pa.binary()),
                "n_words": pa.array([len(names)]),
                "n_tokens": pa.array([len(tokens)]),
            }
            yield pa.RecordBatch.from_arrays(list(row.values()), list(row))

    return run


ASKED = "bucket long, piece long, contexts binary, runs binary, keys binary, counts binary, parents binary"
TOLD = "piece long, bucket long, counts binary, own binary, types binary, tokens long, n_types long, node long, n long, n_own long, n_types_own long, ratio double"


def _blocks(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket that has rows, in rows ordered by bucket."""
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, int(cut[b]), int(cut[b + 1])


def _ask_words(buckets: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                words = np.frombuffer(batch.column("words")[k].as_py(), U64)
                counts = unsqueeze(batch.column("counts")[k].as_py())
                bucket = (mix(words) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for b, at, to in _blocks(bucket[order], buckets):
                    own = order[at:to]
                    yield _row(ASKED, bucket=b, piece=batch.column("piece")[k].as_py(), keys=words[own].tobytes(), counts=squeeze(counts[own]))

    return run


def _row(schema: str, **values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], kinds[k]) for n, k in fields], [n for n, _ in fields])


def _short(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.view(np.uint8).reshape(-1, 8)[:, :_WORD]).tobytes()


def _long(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // _WORD, 8), np.uint8)
    wide[:, :_WORD] = np.frombuffer(data, np.uint8).reshape(-1, _WORD)
    return wide.view(U64).reshape(-1)


def pair_key(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(contexts * _NEXT + (words & U64((1 << 8 * _WORD) - 1)))


def _added(rows: list[dict], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the bucket's different keys, where each first stands among all blocks' keys, and the key of each."""
    every, first, place = np.unique(keys, return_index=True, return_inverse=True)
    counts = np.bincount(place, np.concatenate([unsqueeze(r["counts"]) for r in rows]), len(every))
    return counts.astype(np.int64), first, place


def _settle_words(table: pa.Table) -> pa.Table:
    """One bucket's questions in, answers out, and the tokens and different words learned from."""
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], U64) for r in rows]
    counts, _, place = _added(rows, np.concatenate(keys))
    sums = _row(TOLD, tokens=int(counts.sum()), n_types=int((counts > 0).sum()))
    return pa.Table.from_batches([sums, *_answers(rows, keys, counts[place], [{}] * len(rows))])


def _answers(rows: list[dict], keys: list[np.ndarray], counts: np.ndarray, more: list[dict]) -> Iterator[pa.RecordBatch]:
    stop = np.cumsum([0, *map(len, keys)])
    for r, a, b, extra in zip(rows, stop, stop[1:], more):
        yield _row(TOLD, piece=r["piece"], bucket=r["bucket"], counts=squeeze(counts[a:b]), **extra)


def _settle_pairs(shape: Shape, buckets: int):
    """The same for pairs of a context and a word; buckets from ``buckets`` on hold parts of hot contexts and give their sums."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        contexts = [np.frombuffer(r["contexts"], U64) for r in rows]
        spread = [np.repeat(c, unsqueeze(r["runs"])) for c, r in zip(contexts, rows)]
        keys = [pair_key(c, _long(r["keys"])) for c, r in zip(spread, rows)]
        counts, first, place = _added(rows, np.concatenate(keys))
        spread = np.concatenate(spread)[first]
        parents = np.concatenate([unsqueeze(r["parents"]) for r in rows])[first].astype(np.uint32).view(np.float32).astype(np.float64)
        nodes, node = np.unique(spread, return_inverse=True)
        mine = counts >= shape.least_symbol
        terms = (counts, counts * mine, mine, np.where(mine, counts * (np.log(np.maximum(counts, 1)) - parents), 0.0))
        n, own, types, ratio = (np.bincount(node, x, len(nodes)) for x in terms)
        if rows[0]["bucket"] >= buckets:
            sums = [_row(TOLD, node=int(k), n=int(a), n_own=int(b), n_types_own=int(c), ratio=float(d)) for k, a, b, c, d in zip(nodes.view(np.int64), n, own, types, ratio)]
            return pa.Table.from_batches([*sums, *_answers(rows, keys, counts[place], [{}] * len(rows))])
        kept = kept_nodes(n, own, types, ratio, shape)
        own, types = np.where(kept, own, 0), np.where(kept, types, 0)
        at = [np.searchsorted(nodes, c) for c in contexts]
        return pa.Table.from_batches(list(_answers(rows, keys, counts[place], [{"own": squeeze(own[a]), "types": squeeze(types[a])} for a in at])))

    return run


class Replay:
    """A piece with the answers it has so far: the state of every token, level by level."""

    def __init__(self, row: dict, shape: Shape, totals: Totals, buckets: list[int], hot: list[Nodes]):
        self.shape, self.totals, self.buckets, self.hot, self.piece = shape, totals, buckets, hot, row["piece"]
        self.names = np.frombuffer(row["words"], U64)
        self.places = unsqueeze(row["places"]).astype(np.int32)
        self.sizes = np.array(row["sizes"], np.int64)
        self.learned = np.repeat(~np.array(row["held_out"], bool), self.sizes)
        self.at = (np.arange(len(self.places)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)).astype(np.int32)  # place in the text
        self.context = np.zeros(len(self.places), U64)  # of the words before, as many as the level has

    def words_told(self, told: list[dict]) -> None:
        bucket = (mix(self.names) % U64(self.buckets[0])).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.empty(len(order), np.int64)
        counts[order] = np.concatenate([unsqueeze(r["counts"]) for r in sorted(told, key=lambda r: r["bucket"])])
        self.counts = counts[self.places]
        self.base = self.totals.base(counts)[self.places]
        self.score = self.base.copy()
        self.grams = self.counts  # how often the level's words ending here occur

    def pairs(self, level: int):
        """The tokens whose context of ``level`` words is frequent, their different pairs, and the order of the questions."""
        frequent = self.at >= level
        frequent[1:] &= self.grams[:-1] >= self.shape.least_context
        spot = np.flatnonzero(frequent)
        # The context grows by the word before it: a hash of the words, oldest last.
        longer = mix(self.context[spot] * _LONGER + self.names[self.places[spot - level]] + U64(level))
        self.context[spot] = longer
        words = self.names[self.places[spot]]
        keys, first, place = np.unique(pair_key(longer, words), return_index=True, return_inverse=True)
        contexts, words = longer[first], words[first]
        hot = self.grams[spot - 1][first] > self.totals.hot
        by = np.where(hot, keys, contexts)
        # Hot pairs go to buckets of their own, behind the others.
        bucket = (mix(by) % U64(self.buckets[level])).astype(np.int64) + np.where(hot, self.buckets[level], 0)
        return spot, words, contexts, hot, first, place, bucket, np.lexsort((contexts, bucket))

    def ask(self, level: int) -> Iterator[pa.RecordBatch]:
        spot, words, contexts, _, first, place, bucket, order = self.pairs(level)
        counts = np.bincount(place, self.learned[spot], len(words)).astype(np.int64)
        parents = self.score[spot][first].astype(np.float32)
        for b, at, to in _blocks(bucket[order], 2 * self.buckets[level]):
            own = order[at:to]
            head = np.flatnonzero(np.concatenate([[True], contexts[own][1:] != contexts[own][:-1]]))
            yield _row(
                ASKED,
                bucket=b,
                piece=self.piece,
                contexts=contexts[own][head].tobytes(),
                runs=squeeze(np.diff(head, append=len(own))),
                keys=_short(words[own]),
                counts=squeeze(counts[own]),
                parents=squeeze(parents[own].view(np.uint32)),
            )

    def told(self, level: int, rows: list[dict]) -> None:
        spot, words, contexts, hot, _, place, bucket, order = self.pairs(level)
        grams = np.zeros(len(self.places), np.int64)
        if len(words):
            rows = sorted(rows, key=lambda r: r["bucket"])
            counts, own, types = (np.empty(len(words), np.int64) for _ in range(3))
            counts[order] = np.concatenate([unsqueeze(r["counts"]) for r in rows])
            cold = order[~hot[order]]
            head = np.ones(len(cold), bool)
            head[1:] = (contexts[cold][1:] != contexts[cold][:-1]) | (bucket[cold][1:] != bucket[cold][:-1])
            run = np.cumsum(head) - 1
            for target, name in ((own, "own"), (types, "types")):
                given = [unsqueeze(r[name]) for r in rows if r[name] is not None]
                if given:
                    target[cold] = np.concatenate(given)[run]
            own[hot], types[hot] = self.hot[level].find(contexts[hot])
            kept = (types > 0)[place]
            c = counts[place]
            mine = np.where(c >= self.shape.least_symbol, c, 0)[kept]
            n, t = own[place][kept], types[place][kept]
            with np.errstate(divide="ignore"):
                self.score[spot[kept]] = np.log((mine + t * np.exp(self.score[spot[kept]])) / (n + t))
            grams[spot] = c
        # A longer context needs this one to be frequent before it can be.
        self.grams = grams

    def result(self, row: dict) -> pa.RecordBatch:
        stop = np.cumsum(self.sizes)

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, stop - self.sizes) if len(stop) else np.zeros(0)

        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(row["doc_id"], pa.int64()),
                "held_out": pa.array(row["held_out"], pa.bool_()),
                "n_tokens": self.sizes,
                "n_known": per_text((self.counts > 0).astype(np.int64)),
                "base_score": per_text(self.base) / np.log(10),
                "score": per_text(self.score) / np.log(10),
            }
        )


def _replay(level: int | None, shape: Shape, totals: Totals, buckets: list[int], hot: list[Nodes]):
    """Pieces with their answers in; the questions of ``level`` out, or the scores if it is None."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row, told = left.to_pylist()[0], right.to_pylist()
        piece = Replay(row, shape, totals, buckets, hot)
        piece.words_told([r for r in told if r["level"] == 0])
        for past in range(1, shape.depth + 1 if level is None else level):
            piece.told(past, [r for r in told if r["level"] == past])
        if level is None:
            return pa.Table.from_batches([piece.result(row)])
        return pa.Table.from_batches(list(piece.ask(level)), schema=_row(ASKED).schema)

    return run


def suffix_tree_scores(docs: DataFrame, shape: Shape = Shape(), folds: int = 5, fold: int = 1, piece: int = PIECE, bucket_keys: int = 1_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of (doc_id, text).

    Tokens are the words between ASCII blanks, A-Z lower-cased, and an end. Texts whose
    crc32(doc_id) mod ``folds`` is ``fold`` are scored but not learned from. Scores
    are base-10 logarithms of the whole text's probability, ``base_score`` by the
    root alone.

    A null or empty text is an end and nothing else. A null id counts as an empty one, so it
    is learned from. Repeated rows each count and are each scored. Other columns are not
    looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.crc32(name) % folds == fold).alias("held_out"))
    cut = materialise(rows.mapInArrow(_cut(piece), PIECES), "pieces")
    sizes = cut.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).collect()[0]
    buckets = [max(parts, -(-sizes["words"] // bucket_keys)), *[max(parts, -(-sizes["tokens"] // (2 * bucket_keys)))] * shape.depth]
    asked = cut.select("piece", "words", "counts").mapInArrow(_ask_words(buckets[0]), ASKED)
    told = materialise(asked.groupBy("bucket").applyInArrow(_settle_words, TOLD), "told")
    sums = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_types"), F.lit(0)).alias("v")).collect()[0]
    totals = Totals(sums["n"], sums["v"])
    answers = told.where("piece IS NOT NULL").withColumn("level", F.lit(0))
    hot = [NO_NODES]
    by_piece = cut.drop("n_words", "n_tokens", "counts").groupBy("piece")
    for level in range(1, shape.depth + 1):
        asked = by_piece.cogroup(answers.groupBy("piece")).applyInArrow(_replay(level, shape, totals, buckets, hot), ASKED)
        told = materialise(asked.groupBy("bucket").applyInArrow(_settle_pairs(shape, buckets[level]), TOLD), "told")
        answers = answers.unionByName(told.where("piece IS NOT NULL").withColumn("level", F.lit(level)))
        hot.append(_hot_nodes(told, shape))
    out = by_piece.cogroup(answers.groupBy("piece")).applyInArrow(
        _replay(None, shape, totals, buckets, hot), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _hot_nodes(told: DataFrame, shape: Shape) -> Nodes:
    """The hot contexts, fewer than HOT_SHARE."""
    sums = told.where("node IS NOT NULL").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n", "n_own", "n_types_own", "ratio")])
    rows = sums.toArrow().to_pydict()
    if not rows["node"]:
        return NO_NODES
    keys = np.array(rows["node"], np.int64).view(U64)
    n, own, types, ratio = (np.array(rows[c]) for c in ("n", "n_own", "n_types_own", "ratio"))
    kept = kept_nodes(n, own, types, ratio, shape)
    order = np.argsort(keys)
    return Nodes(keys[order], np.where(kept, own, 0)[order], np.where(kept, types, 0)[order])
