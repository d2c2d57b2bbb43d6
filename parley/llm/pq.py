"""Near-duplicate vectors by product quantisation.

Vectors go to the inverted list of their nearest coarse centroid; what is left of
them is cut into subspaces and each part becomes the number of its nearest code. A
query visits every list whose centroid is almost as near as its own list's, looks up
its distance to each member's codes in tables made for the query, and computes the
exact cosine of those that come near enough.

Equal vectors are one vector with a weight. Lists are cut into blocks of members and
shares of queries, by counts taken over all rows, so no task gathers a crowded list. A
block gives counts per vector and one edge per vector of a spanning forest, never all
its pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.components import connected_components
from parley.session import materialise

BLOCK, SHARE = 1024, 20_000


def k_means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        sizes = np.bincount(own, minlength=k)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[k : k + 4096] @ centres.T - half, axis=1) for k in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, np.int64)


@dataclass
class Index:
    coarse: np.ndarray  # unit centroids of the lists
    books: list[np.ndarray]  # codes of each subspace
    cuts: np.ndarray  # where the subspaces begin, and the end

    @classmethod
    def train(cls, sample: np.ndarray, lists: int, parts: int = 8, codes: int = 256, seed: int = 11) -> Index:
        rng = np.random.default_rng(seed)
        coarse = k_means(sample, min(lists, len(sample)), 8, rng, unit=True)
        left = sample - coarse[np.argmax(sample @ coarse.T, axis=1)]
        cuts = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        books = [k_means(left[:, a:b], min(codes, len(sample)), 6, rng) for a, b in zip(cuts, cuts[1:])]
        return cls(coarse, books, cuts)

    def encode(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the squared length of what they miss."""
        codes = np.stack([nearest(left[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1)
        missed = sum(((left[:, a:b] - book[codes[:, s]]) ** 2).sum(axis=1) for s, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)))
        return codes, missed

    def distances(self, left: np.ndarray, codes: np.ndarray, missed: np.ndarray) -> np.ndarray:
        """Squared distances of queries to coded members of one list, by table look-up, less what the codes miss."""
        out = np.zeros((len(left), len(codes)))
        for s, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            part = left[:, a:b]
            table = (part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)
            out += table[:, codes[:, s]]
        return out - missed


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _probes(rows: np.ndarray, index: Index, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row visits each list, and its own list."""
    near = rows @ index.coarse.T
    own = np.argmax(near, axis=1)
    return near >= near[np.arange(len(rows)), own][:, None] - margin, own


def _forest(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id each node reaches."""
    label = ids.copy()
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == label).all():
            return label
        label = new


def _block(index: Index, margin: float, least: float, slack: float, dim: int):
    reach = 2 - 2 * least

    def links(members, queries):
        """(id, links, label) of the vectors with a link between a query and a member."""
        m_id, m_weight, m, home = members
        q_id, q_weight, q = queries
        centre = index.coarse[home]
        codes, missed = index.encode(m - centre)
        near = index.distances(q - centre, codes, missed) <= reach + slack
        a, b = np.nonzero(near & (q_id[:, None] != m_id))
        exact = np.concatenate([np.einsum("ij,ij->i", q[a[k : k + 65536]], m[b[k : k + 65536]]) for k in range(0, max(1, len(a)), 65536)])
        a, b = a[exact >= least], b[exact >= least]
        if not len(a):
            return None
        # The member finds the query by itself if it visits the query's list; else the link is counted for it here.
        lists = np.argmax(q @ index.coarse.T, axis=1)
        back = _probes(m, index, margin)[0][b, lists[a]]
        ids = np.concatenate([q_id, m_id])
        ids, place = np.unique(ids, return_inverse=True)
        a_, b_ = place[a], place[len(q_id) + b]
        count = np.bincount(a_, m_weight[b], len(ids)) + np.bincount(b_[~back], q_weight[a[~back]], len(ids))
        used = np.unique(np.concatenate([a_, b_]))
        label = _forest(len(ids), a_, b_, ids)
        return pa.RecordBatch.from_pydict({"id": ids[used], "links": count[used].astype(np.int64), "label": label[used]})

    def run(batches):
        now, members, waiting = None, None, []
        for batch in batches:
            keys, roles = batch.column("key").to_numpy(), batch.column("role").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])])) if len(keys) else []
            for at, to in zip(edge, [*edge[1:], len(keys)]):
                part = batch.slice(at, to - at)
                ids, weights, rows = part.column("id").to_numpy(), part.column("weight").to_numpy(), unit_rows(part.column("vector"), dim)
                if keys[at] != now:
                    now, members, waiting = keys[at], None, []
                if roles[at] == 0:  # members come first, and are as many as a block holds
                    waiting.append((ids, weights, rows))
                    members = None
                    continue
                if members is None:
                    if not waiting:
                        continue
                    members = (*(np.concatenate(x) for x in zip(*waiting)), int(now) >> 40)
                for k in range(0, len(ids), 512):
                    out = links(members, (ids[k : k + 512], weights[k : k + 512], rows[k : k + 512]))
                    if out is not None:
                        yield out

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, margin: float = 0.16, slack: float = 0.25, lists: int | None = None, sample: int = 16_384, most_lists: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    The quantisers are trained on at most ``sample`` different vectors, those with the
    smallest hashes; every vector is indexed and is a query. A query visits the lists whose
    centroid's cosine is within ``margin`` of its best, and ranks members exactly whose
    looked-up squared distance is within ``slack`` of the threshold. A link found from
    either end counts at both. Vectors that are null, zero, hold null or non-finite parts,
    have a null id, or another length than the commonest link with nothing; a null id has
    a null component. Rows equal in id and vector are one vector; each gets the result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    sizes = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    result = lambda c: c.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    if not sizes or not sizes[0]["n"]:
        return result(rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    dim = sizes[0]["n"]
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fine = F.col("id").isNotNull() & (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)) & (length > 0) & (length < float("inf"))
    good = rows.where(fine).dropDuplicates(["id", "vector"])
    merged = materialise(good.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "vectors")
    n = merged.count()
    if not n:
        return result(rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    picked = merged.orderBy(F.xxhash64("id")).limit(sample).select("vector").toArrow()
    index = Index.train(unit_rows(picked.column("vector").combine_chunks(), dim), lists or max(8, min(most_lists, 2 * math.isqrt(n))))
    n_lists = len(index.coarse)

    def tally(batches):
        members, queries = np.zeros(n_lists, np.int64), np.zeros(n_lists, np.int64)
        for batch in batches:
            visits, own = _probes(unit_rows(batch.column("vector"), dim), index, margin)
            members += np.bincount(own, minlength=n_lists)
            queries += visits.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"list": np.arange(n_lists), "members": members, "queries": queries})

    counted = merged.select("vector").mapInArrow(tally, "list long, members long, queries long")
    counted = counted.groupBy("list").agg(F.sum("members").alias("members"), F.sum("queries").alias("queries")).collect()  # one row per list
    blocks, shares = np.ones(n_lists, np.int64), np.ones(n_lists, np.int64)
    for row in counted:
        blocks[row["list"]], shares[row["list"]] = max(1, -(-row["members"] // BLOCK)), max(1, -(-row["queries"] // SHARE))

    def deal(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = part.column("id").to_numpy()
                visits, own = _probes(unit_rows(part.column("vector"), dim), index, margin)
                q, to = np.nonzero(visits)
                salt = ids * 2654435761 >> 7
                q, to, block = _spread(q, to, blocks[to])
                share = salt[q] % shares[to]
                m, share_m = _spread(np.arange(len(ids)), own, shares[own])[::2]
                home = own[m]
                take = np.concatenate([m, q])
                key = np.concatenate([_key(home, salt[m] % blocks[home], share_m), _key(to, block, share)])
                role = np.repeat([0, 1], [len(m), len(q)])
                got = part.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), got.column("id"), got.column("weight"), got.column("vector")], ["key", "role", "id", "weight", "vector"])

    kind = merged.schema["vector"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = merged.mapInArrow(deal, f"key long, role long, id long, weight long, vector {kind}").repartition(parts, "key").sortWithinPartitions("key", "role")
    found = materialise(dealt.mapInArrow(_block(index, margin, least, slack, dim), "id long, links long, label long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("id", "label"), "id", "label")
    own = merged.join(links, "id", "left").join(groups, "id", "left")
    own = own.select("vector", F.coalesce("links", F.lit(0)).alias("links"), "weight", F.coalesce("component", "id").alias("component_id"))
    settled = good.join(own, "vector").select("id", "vector", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    joined = rows.alias("r").join(settled.alias("s"), (F.col("r.id") == F.col("s.id")) & (F.col("r.vector") == F.col("s.vector")), "left")
    return result(joined.select("r.id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "r.id").alias("component_id")))


def _spread(rows: np.ndarray, to: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row ``times`` over, with a running number."""
    at = np.repeat(np.arange(len(rows)), times)
    return rows[at], to[at], np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


def _key(lists: np.ndarray, block: np.ndarray, share: np.ndarray) -> np.ndarray:
    return (lists << 40) | (block << 20) | share
