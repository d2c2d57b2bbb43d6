"""Exact join of documents by the Jaccard similarity of their shingles.

1 - J is a metric. Its pivots here are single shingles: a document is at distance
1 - 1/n from each of its n shingles and at 1 from others, so its Voronoi region is
that of a shingle it holds, the first in an order that puts common shingles last. A
document within the threshold of another can miss only a bounded number of its
shingles; so each document is replicated to the regions of its first shingles up to
that bound, its window, and any two linked documents meet in some region. (Documents as
first pivots would not separate anything: unrelated texts are all at distance 1.)

Regions join recursively. Around the empty set the triangle inequality bounds the
sizes of linked sets, and around the region's shingle what can still be shared after
it. What a small region leaves are pairs; counts of shingles per class of hashes bound
the overlap of each. Pairs that stay, and the members of large regions, form areas by
connected components. An area is cut into blocks by size, blocks within each other's
size window face each other, and members that may have a link there by their counts are
compared exactly, whole block against whole block, and give a spanning forest.

Equal sets are one node, so exact copies cost nothing. No candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.components import connected_components
from parley.llm.gather import ROWS, HashSet, combined, distinct_by_owner, give_out, within_groups
from parley.llm.recompress import keyed
from parley.llm.words import U64, mix, slices, span_hashes, split
from parley.session import discard, materialise

SMALL = 32  # documents of a region that are compared pair by pair
SIDE = 256  # documents of a block
FEW = 6  # documents of facing blocks that are compared set by set
COUNTERS = 1 << 24
AT_ONCE = 2 << 20  # bytes of text whose sets are made at once
CLASSES = 256


def shingle_sets(column: pa.Array, length: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(first, values): the distinct shingles of text i are values[first[i]:first[i + 1]], in order of hash."""
    words = split(column, lower)
    names, n = words.hashes(), words.counts
    size = np.where(n >= length, n - length + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), size)
    start = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + words.first[owner]
    values = span_hashes(names, start, np.minimum(start + length, words.first[owner + 1]))
    owner, values = distinct_by_owner(owner, values)
    return np.searchsorted(owner, np.arange(len(n) + 1)), values


def node_ids(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([[U64(0)], np.cumsum(mix(values))])
    return mix((total[first[1:]] - total[first[:-1]]) ^ mix(np.diff(first).astype(U64))).view(np.int64)


def need(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of this size that any linked set shares at least."""
    return (percent * size + 99) // 100


def overlap_needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 i >= p (a + b - i) for these and more shared shingles."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _once(node: np.ndarray, first: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different sets that aren't empty."""
    filled = np.flatnonzero(np.diff(first))
    node, at = np.unique(node[filled], return_index=True)
    at = filled[at]
    sizes = np.diff(first)[at]
    take = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[at], sizes)
    return node, np.concatenate([[0], np.cumsum(sizes)]), values[take]


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> U64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def common_shingles(texts: DataFrame, length: int) -> np.ndarray:
    """The ranks of the counters, from what they count in all texts; equal sets count once per slice."""

    def run(batches):
        held = np.zeros(COUNTERS, np.uint32)
        for part in slices(batches, "text"):
            first, values = shingle_sets(part.column("text"), length)
            _, _, values = _once(node_ids(first, values), first, values)
            np.add.at(held, _counter(values), np.uint32(1))
        yield give_out(held)

    return ranks(combined(texts.mapInArrow(run, ROWS), np.uint32, np.add, COUNTERS))


def ranks(counts: np.ndarray) -> np.ndarray:
    """By how much each counter is above the mean, in steps of a quarter of a power of two.

    A counter holds many rare shingles, whose number varies by the root of the mean; what a shingle
    brings to it beyond that counts. A rank that is wrong by chance only makes an order a little worse.
    Were it the count itself that is compared, a shingle of as many texts as the mean would pass for a rare one, and in
    a large corpus rare ones would make regions that link all documents to one area.
    """
    mean = counts.sum(dtype=np.int64) / len(counts)
    chance = 2.5 * np.sqrt(mean) + 2
    out = np.empty(len(counts), np.uint8)
    for k in range(0, len(counts), 1 << 16):  # bounded temporary arrays: this runs on the driver
        out[k : k + (1 << 16)] = np.rint(4 * np.log2(np.maximum((counts[k : k + (1 << 16)] - mean) / chance, 1)))
    return out


def _windows(length: int, percent: int, buckets: int, rank):
    """The regions that each set goes to, in a block per slice and bucket."""

    def run(batches):
        weight = rank.value
        for part in slices(batches, "text"):
            first, values = shingle_sets(part.column("text"), length)
            node, first, values = _once(node_ids(first, values), first, values)
            size = np.diff(first)
            owner = np.repeat(np.arange(len(node)), size)
            order = np.lexsort((values, weight[_counter(values)], owner))
            place = np.arange(len(values)) - first[owner]
            keep = place < (size - need(size, percent) + 1)[owner]
            owner, place, values = owner[keep], place[keep], values[order][keep]
            bucket = (mix(values) % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = by[cut[b] : cut[b + 1]]
                cols = {"bucket": [b], "region": values[own].tobytes(), "node": node[owner[own]].tobytes(), "size": size[owner[own]].astype(np.int32).tobytes(), "place": place[own].astype(np.int32).tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array(cols["bucket"]), *(pa.array([cols[c]], pa.binary()) for c in ("region", "node", "size", "place"))], list(cols))

    return run


PAIRS = "a long, b long, region long"


def _join_regions(percent: int, small: int):
    """Pairs of small regions, and for large ones (region, node, null): the region's members."""

    def settle(blobs):
        region, node, size, place = (np.concatenate([np.frombuffer(x[k], t) for x in blobs]) for k, t in enumerate((U64, np.int64, np.int32, np.int32)))
        order = np.lexsort((node, region))
        region, node, size, place = region[order], node[order], size[order].astype(np.int64), place[order].astype(np.int64)
        new = np.ones(len(region), bool)
        new[1:] = (region[1:] != region[:-1]) | (node[1:] != node[:-1])
        region, node, size, place = region[new], node[new], size[new], place[new]
        head = np.ones(len(region), bool)
        head[1:] = region[1:] != region[:-1]
        group = np.diff(np.flatnonzero(head), append=len(region))
        own = np.repeat(group, group)
        large = own > small
        if large.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(int(large.sum()), pa.int64()), pa.array(node[large]), pa.array(region[large].view(np.int64))], ["a", "b", "region"])
        some = (own > 1) & ~large
        node, size, place = node[some], size[some], place[some]
        left, right = [], []
        for i, j in within_groups(group[(group > 1) & (group <= small)], small):
            shared = np.minimum(size[i] - place[i], size[j] - place[j])  # at most, if this is the first shingle they share
            ok = shared >= overlap_needed(size[i], size[j], percent)
            left.append(node[i[ok]])
            right.append(node[j[ok]])
        if left and sum(map(len, left)):
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], ["a", "b", "region"])

    def run(batches):
        waiting, now = [], None
        for batch in batches:
            for b, *cols in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in range(1, 5))):
                if b != now and waiting:
                    yield from settle(waiting)
                    waiting = []
                now = b
                waiting.append([c.as_py() for c in cols])
        if waiting:
            yield from settle(waiting)

    return run


TEXTS = "node long, text binary"
COUNTED = "node long, size long, classes binary"
FACING = "node long, facing long, side long"


def class_rows(node: np.ndarray, first: np.ndarray, values: np.ndarray, classes: int) -> pa.RecordBatch:
    """Counts per class of hashes, in a byte each where they fit."""
    size, packed = np.diff(first), []
    kind = (mix(values) & U64(classes - 1)).astype(np.int64)
    for k in range(0, len(node), 4096):
        to = min(k + 4096, len(node))
        owner = np.repeat(np.arange(to - k), size[k:to])
        counts = np.bincount(owner * classes + kind[first[k] : first[to]], minlength=(to - k) * classes).reshape(-1, classes).astype(np.uint32)
        packed += [b"\1" + c.astype(np.uint8).tobytes() if c.max() < 256 else b"\4" + c.tobytes() for c in counts]
    return pa.RecordBatch.from_pydict({"node": node, "size": size, "classes": pa.array(packed, pa.binary())})


def _wanted_sets(length: int, wanted, then):
    """``then`` over the sets that may be wanted."""

    def run(batches):
        for part in slices(batches, "text"):
            first, values = shingle_sets(part.column("text"), length)
            node, first, values = _once(node_ids(first, values), first, values)
            hit = np.flatnonzero(wanted.value.may_hold(node))
            if len(hit):
                size = np.diff(first)[hit]
                begin = np.concatenate([[0], np.cumsum(size)])
                yield then(node[hit], begin, values[np.arange(begin[-1]) + np.repeat(first[hit] - begin[:-1], size)])

    return run


def _wanted_texts(length: int, wanted):
    """A text of each set that may be wanted."""

    def run(batches):
        for part in slices(batches, "text"):
            first, values = shingle_sets(part.column("text"), length)
            node = node_ids(first, values)
            hit = np.flatnonzero((np.diff(first) > 0) & wanted.value.may_hold(node))
            node, at = np.unique(node[hit], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), part.column("text").take(pa.array(hit[at])).cast(pa.binary())], ["node", "text"])

    return run


def _class_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8 if blob[0] == 1 else np.uint32, offset=1).astype(np.int32)


def _may_link(percent: int):
    """Pairs whose counts per class leave room for the overlap needed: what two sets share is at most the smaller count of each class."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                a, b = (np.stack([_class_counts(x) for x in part.column(c).to_pylist()]) for c in ("classes_a", "classes_b"))
                ok = np.minimum(a, b).sum(axis=1) >= overlap_needed(a.sum(axis=1), b.sum(axis=1), percent)
                yield part.filter(pa.array(ok)).select(["a", "b"])

    return run


def combined_rows(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: np.concatenate([x[c] for x in found]) for c in found[0]})


def _as_sets(sets_in: Callable):
    """Batches with a column text: the set of each text, made for many texts at once."""

    def read(batches):
        for part in slices(batches, "text", AT_ONCE):
            first, values = sets_in(part.column("text"))
            yield part, [values[a:b] for a, b in zip(first.tolist(), first[1:].tolist())]

    return read


def _as_counts(batches):
    for batch in batches:
        yield batch, batch.column("classes").to_pylist()


def _by_facing(then, read):
    """The columns of ``then`` (node, side, value) for each pair of facing blocks; their rows come together. ``read`` gives the values of a batch."""

    def run(batches):
        now, rows, found = None, [], []
        for batch, values in read(batches):
            for facing, side, node, value in zip(*(batch.column(c).to_pylist() for c in ("facing", "side", "node")), values):
                if facing != now:
                    if len(rows) > 1 and (out := then(now, rows)) is not None:
                        found.append(out)
                    now, rows = facing, []
                    if len(found) >= 1000:
                        yield combined_rows(found)
                        found = []
                rows.append((node, side, value))
        if len(rows) > 1 and (out := then(now, rows)) is not None:
            found.append(out)
        if found:
            yield combined_rows(found)

    return run


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows to compare with the columns; a block that faces itself is both."""
    if side.any():
        return np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.arange(len(side)), np.arange(len(side))


def _may_meet(percent: int):
    """The members that may have a link to a member of the facing block; where there are few, all."""

    def then(facing, rows):
        side = np.array([r[1] for r in rows])
        if len(rows) <= FEW:
            return {"node": np.array([r[0] for r in rows]), "facing": np.full(len(rows), facing), "side": side}
        counts = np.stack([_class_counts(r[2]) for r in rows])
        size = counts.sum(axis=1)
        left, right = _sides(side)
        found = np.zeros(len(rows), bool)
        for i in left.tolist():
            some = right[right > i] if not side.any() else right
            ok = np.minimum(counts[i], counts[some]).sum(axis=1) >= overlap_needed(size[i], size[some], percent)
            found[i] |= ok.any()
            found[some[ok]] = True
        at = np.flatnonzero(found)
        if not len(at):
            return None
        return {"node": np.array([rows[k][0] for k in at]), "facing": np.full(len(at), facing), "side": side[at]}

    return then


def _compare(percent: int):
    """Exact links between two facing blocks, as a spanning forest."""

    def then(facing, rows):
        node, side = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        sets = [r[2] for r in rows]
        size = np.array([len(s) for s in sets])
        if len(rows) == 2:
            shared = _shared(*sets)
            return {"a": node[:1], "b": node[1:]} if 100 * shared >= percent * (size.sum() - shared) else None
        left, right = _sides(side)
        if not len(left) or not len(right):
            return None
        if len(rows) <= FEW:
            shared = np.zeros((len(rows), len(rows)), np.int64)
            for i in left.tolist():
                for j in right.tolist():
                    if i != j and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                        shared[i, j] = _shared(sets[i], sets[j])
        else:
            shared = _shared_counts(sets, size, left, right)
        i, j = np.nonzero(100 * shared >= percent * (size[:, None] + size - shared))
        i, j = i[i != j], j[i != j]
        label = node.copy()
        while len(i):
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            if (new == label).all():
                break
            label = new
        moved = label != node
        return {"a": node[moved], "b": label[moved]} if moved.any() else None

    return then


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _shared_counts(sets: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common shingles of each left and each right set, a strip of shingles at a time."""
    owner, value = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    head = np.ones(len(value), bool)
    head[1:] = value[1:] != value[:-1]
    code = np.cumsum(head) - 1
    often = np.bincount(code) > 1
    number = np.cumsum(often) - 1
    kept = often[code]
    owner, code = owner[kept], number[code[kept]]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(often.sum()), 8192):
        a, b = np.searchsorted(code, [k, k + 8192])
        strip = np.zeros((len(sets), 8192), np.float32)
        strip[owner[a:b], code[a:b] - k] = 1
        shared[np.ix_(left, right)] += strip[left] @ strip[right].T
    return np.rint(shared).astype(np.int64)


def links(docs: DataFrame, length: int, percent: int, small: int = SMALL, side: int = SIDE) -> DataFrame:
    """(a, b): edges between nodes that connect exactly the linked ones."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("text").cast("string").alias("text"))
    rank = spark.sparkContext.broadcast(common_shingles(texts, length))
    dealt = texts.mapInArrow(_windows(length, percent, 4 * tasks, rank), "bucket long, region binary, node binary, size binary, place binary")
    met = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_join_regions(percent, small), PAIRS)
    counts = lambda wanted: texts.mapInArrow(_wanted_sets(length, wanted, lambda n, f, v: class_rows(n, f, v, CLASSES)), COUNTED)
    whole = lambda wanted: texts.mapInArrow(_wanted_texts(length, wanted), TEXTS)
    return verified(materialise(met, "regions"), counts, whole, lambda column: shingle_sets(column, length), percent, side, spare=True)


def verified(met: DataFrame, classes_of: Callable, texts_of: Callable, sets_in: Callable, percent: int, side: int = SIDE, spare: bool = False) -> DataFrame:
    """(a, b): edges that connect exactly the linked ones among the candidates in ``met``, a stored table, removed once read if ``spare``.

    ``classes_of`` and ``texts_of`` get a broadcast ``HashSet`` of nodes and give rows
    (node, size, classes) and (node, text) of them; other nodes may come along. ``sets_in`` gives
    (first, values) of the sets of a column of texts. Whole texts are read only where counts per class leave room
    for a link, and each is sent once to every pair of blocks that it may have a link in. Texts
    are what travels: their shingles' hashes take several times the room.
    """
    spark = met.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = materialise(met.where("region IS NULL").select("a", "b").distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(met.where("region IS NOT NULL").select("b"))
    wanted = spark.sparkContext.broadcast(HashSet.of(nodes, "node"))
    classes = materialise(classes_of(wanted).dropDuplicates(["node"]), "classes")
    # Pairs of small regions that may be links, and members of large regions, form areas.
    of = lambda x: classes.select(F.col("node").alias(x), F.col("classes").alias(f"classes_{x}"))
    maybe = pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_may_link(percent), "a long, b long")
    large = met.where("region IS NOT NULL").select(F.col("region").alias("a"), "b")
    areas = connected_components(large.union(maybe)).select(F.col("id").alias("node"), F.col("component").alias("area"))
    discard(pairs, *([met] if spare else []))  # areas are stored
    # Regions have no classes and go in the join; one with the hash of a node would only make an area larger. Blocks of areas, in order of size; two blocks face each other if their sizes allow a link.
    placed = materialise(_blocks(areas.join(classes.select("node", "size"), "node"), side), "blocks")
    extent = placed.groupBy("area", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    other = extent.select("area", F.col("block").alias("j"), F.col("low").alias("low_j"))
    facing = extent.withColumnRenamed("block", "i").join(other, "area").where(f"i <= j AND {percent} * low_j <= 100 * high")
    ends = facing.select("area", "i", "j", F.col("i").alias("block"), F.lit(0).cast("long").alias("side"))
    ends = ends.union(facing.where("i < j").select("area", "i", "j", "j", F.lit(1).cast("long")))
    faced = placed.join(ends, ["area", "block"]).select("node", F.xxhash64("area", "i", "j").alias("facing"), "side")
    counted = faced.join(classes.select("node", "classes"), "node")
    met_ = counted.repartition(tasks, "facing").sortWithinPartitions("facing", "side").mapInArrow(_by_facing(_may_meet(percent), _as_counts), FACING)
    met_ = materialise(met_, "facing")
    discard(placed, classes)
    wanted = spark.sparkContext.broadcast(HashSet.of(met_, "node"))
    whole = texts_of(wanted).dropDuplicates(["node"]).join(met_, "node")
    dealt = whole.repartition(tasks, "facing").sortWithinPartitions("facing", "side")
    out = materialise(dealt.mapInArrow(_by_facing(_compare(percent), _as_sets(sets_in)), "a long, b long"), "links")
    discard(met_)
    return out


def _blocks(members: DataFrame, side: int) -> DataFrame:
    """(area, block, node, size): blocks of about ``side`` members, in order of size.

    Documents of one size are counted per area; the running count says where a size
    begins, and a size that fills several blocks is dealt over them by hash.
    """
    counts = members.groupBy("area", "size").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("area").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("at", before)
    spread = F.pmod(F.xxhash64("node"), F.floor((F.col("n") + side - 1) / side).cast("long"))
    block = F.when(F.col("n") > side, F.floor(F.col("at") / side) * 2 + 1 + spread * 2).otherwise(F.floor(F.col("at") / side) * 2)
    return members.join(counts, ["area", "size"]).select("area", block.cast("long").alias("block"), "node", "size")


def join(docs: DataFrame, length: int = 5, percent: int = 80, small: int = SMALL, side: int = SIDE) -> DataFrame:
    """(doc_id, n_shingles, component_id, doc, tie, component) of every row of ``docs`` (doc_id, text).

    Words are lower-cased in A-Z. Two documents link when 100 * shared >= percent * all
    shingles of both. A text with fewer words than ``length`` has them as its one
    shingle; null, empty and blank texts have none, link with nothing and have their own id
    as component. ``component_id`` is the smallest id reachable, ``component`` a hash that
    the documents of a component share, null without shingles; ``doc`` and ``tie`` name the
    document, as ``recompress.keyed`` does. Repeated rows keep one result each; null ids
    are reachable but never the smallest unless all are null. A document is one record,
    read whole. Other columns are ignored.
    """
    rows = keyed(docs)

    def sizes(batches):
        for part in slices(batches, "text"):
            first, values = shingle_sets(part.column("text"), length)
            cols = [*(part.column(c) for c in ("doc_id", "doc", "tie")), pa.array(np.diff(first)), pa.array(node_ids(first, values))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "doc", "tie", "n_shingles", "node"])

    known = materialise(rows.mapInArrow(sizes, "doc_id long, doc long, tie long, n_shingles long, node long"), "documents")
    groups = connected_components(links(rows, length, percent, small, side))
    nodes = known.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(groups.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(least, "component").select("node", "component", F.col("component_id").alias("shared_id"))
    own = F.when(F.col("n_shingles") > 0, F.col("shared_id")).otherwise(F.col("doc_id"))
    return known.join(named.where("node IS NOT NULL"), "node", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), "doc", "tie", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component")
    )


def keep_one(docs: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """The first document of each component, with all its columns; documents without shingles stay."""
    found = materialise(join(docs, length, percent), "components")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc", "tie")).alias("first")).select("first.*")
    stay = first.union(found.where("component IS NULL").select("doc", "tie").distinct()).select(F.col("doc").alias("__doc"), F.col("tie").alias("__tie"))
    doc, tie = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64(F.col("text").cast("string"))
    rows = docs.withColumn("__doc", doc).withColumn("__tie", tie).join(stay, ["__doc", "__tie"], "left_semi")
    return rows.dropDuplicates(["__doc", "__tie"]).select(*docs.columns)
