"""k most similar vectors by hash-prefix forests (cosine distance).

Points lie in shards of a bounded number of rows. A shard holds a forest: per tree a sorted array of long hash strings,
a bit per hyperplane. A query first descends in each tree to the longest prefix that all trees together share with enough points, which gives
neighbours near by; the best k of all shards bound the distance of the k-th. Then the trees of all shards ascend together, to
the longest prefix that a point at that distance shares in some tree with the wanted probability. So queries in dense places open short
ranges and only lonely ones long ranges; where these hold a good part of a shard, the ascent goes on to the root, whose empty prefix all
points share. Candidates are ranked by their exact distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import kernels
from nearfield.operators.knn import FOUND, query_blocks, top_k
from nearfield.session import materialize, release

BITS = 64
#: Trees of a forest, and candidates per query and shard with which the descent is content.
TREES, FIRST = 24, 64
#: Probability with which a neighbour is to be among the candidates.
RECALL = 0.9999
#: Share of a shard from which on a query reads all of it: gathering so many single rows would take longer.
ROOT_SHARE = 1 / 16
#: Rows of a shard: bounds the memory of a task. A task with more rows builds several forests.
SHARD_ROWS = 25_000
#: Rows of a shard by which its hyperplanes are laid through the data.
FIT_ROWS = 1024
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Forest:
    """Sorted hash strings of one shard. x holds unit vectors; rows are in ascending order of id, so equal strings are too."""

    def __init__(self, x: np.ndarray, trees: int, seed: int):
        rng = np.random.default_rng(seed)
        sample = x[rng.permutation(len(x))[:FIT_ROWS]]
        n = trees * BITS
        planes = sample[rng.integers(0, len(sample), n)] - sample[rng.integers(0, len(sample), n)]
        flat = np.einsum("ij,ij->i", planes, planes) < 1e-12
        planes[flat] = rng.standard_normal((int(flat.sum()), x.shape[1]))
        self.planes, self.cuts = planes.astype(np.float32), np.median(sample @ planes.T, axis=0).astype(np.float32)
        strings = self.strings(x)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """One number per tree and row; its bits from the highest are the hash string."""
        out = np.empty((len(self.cuts) // BITS, len(x)), np.uint64)
        for s in range(0, len(x), 4096):
            bits = np.packbits((x[s : s + 4096] @ self.planes.T) > self.cuts, axis=1)
            out[:, s : s + 4096] = bits.view(">u8").astype(np.uint64).T
        return out

    def prefix_ranges(self, q: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query the range of rows that share the first level bits."""
        low = np.where(level >= BITS, np.uint64(0), _FULL >> np.minimum(level, BITS - 1).astype(np.uint64))
        lo, hi = np.empty(q.shape, np.int64), np.empty(q.shape, np.int64)
        for t in range(len(q)):
            lo[t] = np.searchsorted(self.sorted[t], q[t] & ~low, "left")
            hi[t] = np.searchsorted(self.sorted[t], q[t] | low, "right")
        return lo, hi

    def longest(self, strings: np.ndarray, least: int) -> np.ndarray:
        """Per query the longest prefix (for all trees at once) that holds at least `least` rows over all trees; 0 if none does."""
        a, b = np.zeros(strings.shape[1], np.int64), np.full(strings.shape[1], BITS, np.int64)
        while (a < b).any():
            m = (a + b + 1) >> 1
            lo, hi = self.prefix_ranges(strings, m)
            enough = (hi - lo).sum(axis=0) >= least
            a, b = np.where(enough, m, a), np.where(enough, b, m - 1)
        return a

    def pairs(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows in the ranges (tree x query) of the queries, each pair once, by query."""
        n = (hi - lo).ravel()
        tree, query = (np.repeat(g.ravel(), n) for g in np.indices(lo.shape))
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo.ravel(), n)
        both = np.unique(query * self.order.shape[1] + self.order[tree, at])
        return both // self.order.shape[1], both % self.order.shape[1]


def needed_prefix(distance: np.ndarray, trees: int, recall: float) -> np.ndarray:
    """The longest prefix that a point at this cosine distance shares with the query in some tree with probability recall; 0 where distance is NaN."""
    if recall >= 1.0:
        return np.zeros(len(distance), np.int64)
    same = 1.0 - np.arccos(np.clip(1.0 - distance, -1.0, 1.0)) / np.pi
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.log(1.0 - (1.0 - recall) ** (1.0 / trees)) / np.log(same)
    return np.clip(np.where(same >= 1.0, BITS, np.nan_to_num(bits)), 0, BITS).astype(np.int64)


def _best(pair_q: np.ndarray, pair_x: np.ndarray, rough: np.ndarray, qid, q, ids, x, k: int, drop_self: bool, bound: np.ndarray):
    """(query id, id, distance) of the best k pairs of each query, none farther than its bound."""
    keep = rough <= np.nan_to_num(bound[pair_q], nan=9.0) + 2e-6
    if drop_self:
        keep &= ids[pair_x] != qid[pair_q]
    pair_q, pair_x, rough = pair_q[keep], pair_x[keep], rough[keep]
    order = np.lexsort((rough, pair_q))
    pair_q, pair_x, rough = pair_q[order], pair_x[order], rough[order]
    first = np.searchsorted(pair_q, np.arange(len(qid) + 1))
    kth = np.minimum(first[:-1] + k, first[1:]) - 1
    edge = np.full(len(qid), -1.0)
    edge[kth >= first[:-1]] = rough[kth[kth >= first[:-1]]]
    near = rough <= edge[pair_q] + 2e-6
    pair_q, pair_x = pair_q[near], pair_x[near]
    exact = kernels.rowwise("cosine", q[pair_q], x[pair_x])
    order = np.lexsort((ids[pair_x], exact, pair_q))
    pair_q, pair_x, exact = pair_q[order], pair_x[order], exact[order]
    rank = np.arange(len(pair_q)) - np.searchsorted(pair_q, pair_q)
    top = rank < k
    return qid[pair_q[top]], ids[pair_x[top]], exact[top]


def _copies_before(x: np.ndarray) -> np.ndarray:
    """How many equal rows come before each row."""
    same = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)[1] if len(x) else np.zeros(0, np.int64)
    order = np.argsort(same, kind="stable")
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.searchsorted(same[order], same[order])
    return out


def search_shard(ids, x, qid, q, bound, k: int, trees: int, recall: float, seed: int, drop_self: bool, opened: list | None = None):
    """(query id, id, distance) of the best k candidates of each query in one shard. x and q in double precision; bound is None for the descent,
    else the distance of the k-th neighbour known, NaN if there are fewer. opened gets the number of candidates of each query."""
    order = np.argsort(ids, kind="stable")
    order = order[_copies_before(x[order]) <= k]  # of equal vectors only the k + 1 least ids can be among the best k of any query
    ids, x = ids[order], x[order]
    u, v = kernels.unit(x).astype(np.float32), kernels.unit(q).astype(np.float32)
    forest = Forest(u, trees, seed)
    out = []
    limit = np.full(len(q), np.nan) if bound is None else bound
    for s in range(0, len(q), 2048):
        at = np.arange(s, min(len(q), s + 2048))
        strings = forest.strings(v[at])
        level = forest.longest(strings, FIRST) if bound is None else needed_prefix(bound[at], trees, recall)
        lo, hi = forest.prefix_ranges(strings, level)
        size = (hi - lo).sum(axis=0)
        root = (size > max(FIRST * trees, len(ids) * ROOT_SHARE)) | (level == 0)
        if opened is not None:
            opened.append(np.where(root, len(ids), size))
        far = np.nonzero(~root & (size > 0))[0]
        cuts = np.searchsorted(np.cumsum(size[far]), np.arange(0, size[far].sum() + 200_000, 200_000))
        for a, b in zip(cuts[:-1], cuts[1:]):
            f = far[a:b]
            if len(f):
                pq, px = forest.pairs(lo[:, f], hi[:, f])
                pq = f[pq]
                rough = 1.0 - np.einsum("ij,ij->i", v[at][pq], u[px])
                out.append(_best(pq, px, rough, qid[at], q[at], ids, x, k, drop_self, limit[at]))
        f = np.nonzero(root)[0]
        step = max(1, 4_000_000 // max(1, len(ids)))
        for a in range(0, len(f), step):
            g = f[a : a + step]
            rough = 1.0 - v[at[g]] @ u.T
            kk = min(k + 1, rough.shape[1])  # one more, which may be the query itself
            edge = np.minimum(np.partition(rough, kk - 1, axis=1)[:, kk - 1], np.nan_to_num(limit[at[g]], nan=9.0)) + 2e-6
            i, j = np.nonzero(rough <= edge[:, None])
            out.append(_best(g[i], j, rough[i, j], qid[at], q[at], ids, x, k, drop_self, limit[at]))
    cat = lambda c, t: np.concatenate([o[c] for o in out]) if out else np.zeros(0, t)
    return cat(0, np.int64), cat(1, np.int64), cat(2, np.float64)


def similar_vectors(points: DataFrame, queries: DataFrame, k: int, dim: int, trees: int = TREES, recall: float = RECALL, seed: int = 7, drop_self: bool = True) -> DataFrame:
    """query_id, id, distance, rank: about the k points most similar to each query, by (cosine distance, id).

    points and queries have id and data, all vectors usable (see points.current_usable): dim elements, finite, not all zero; points may have v instead of data (see points.current_packed). Every point
    is indexed. recall is the probability with which a neighbour is among the candidates, by the theory of random hyperplanes; what comes out is measured in the tests and the README. recall=1 reads every shard from the root, which is exact. A point is no neighbour of the query
    with its own id if drop_self. With k or fewer points in all, all are returned. Empty tables give no rows, rows with a null id take no part, extra columns don't matter.
    Queries go out in blocks (knn.QUERY_BLOCK), each finished before the next; points are written once and read where they lie, twice per block, and only ids and distances are shuffled.
    """
    spark, ready = points.sparkSession, "v" in points.columns
    m, blocks = query_blocks(queries, dim) if k > 0 else (0, iter(()))
    src = points.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("v") if ready else F.col("data").cast("array<float>").alias("data"))

    def scan(sent: Broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q, bound = sent.value

            def shard(parts):
                ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                got = search_shard(ids, x.astype(np.float64), qid, q, bound, k, trees, recall, seed, drop_self)
                return pa.RecordBatch.from_arrays([pa.array(a) for a in got], ["query_id", "id", "distance"])

            held, n = [], 0
            for b in batches:
                if b.num_rows:
                    held.append((b.column(0).to_numpy(zero_copy_only=False), kernels.unpack(b.column(1).to_pylist(), dim, np.float32) if ready else kernels.matrix(b.column(1), dim)))
                    n += b.num_rows
                if n >= SHARD_ROWS:
                    yield shard(held)
                    held, n = [], 0
            if held:
                yield shard(held)

        return run

    src = materialize(src, "searched") if m else src
    out = None
    for qid, q in blocks:
        sent = spark.sparkContext.broadcast((qid, q, None))
        near = materialize(top_k(src.mapInArrow(scan(sent), FOUND), k), "near")
        sent.destroy()
        kth = near.where(F.col("rank") == k).select("query_id", "distance").toArrow()  # one row per query of the block
        place = dict(zip(kth["query_id"].to_pylist(), kth["distance"].to_pylist()))
        sent = spark.sparkContext.broadcast((qid, q, np.array([place.get(i, np.nan) for i in qid.tolist()])))
        more = near.select("query_id", "id", "distance").unionAll(src.mapInArrow(scan(sent), FOUND)).groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
        found = materialize(top_k(more, k), "found")
        sent.destroy()
        release(near)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, id long, distance double, rank int")
