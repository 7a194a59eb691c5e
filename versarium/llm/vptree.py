"""Nearest neighbours by inner product: vantage-point trees per shard, pruned by the triangle inequality."""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versarium.llm.common import pick, staged

SHARD = 16384  # vectors of a shard
BLOCK = 4096  # queries that visit a shard together
LEAF = 1024  # points that are compared as one matrix product
BAND = 1.25  # ratio of the greatest to the least norm of the vectors that share a tree
FACTOR = 5.0  # how much the pruning is relaxed; 1 gives exact results
ROUNDING = 1e-12  # of a matrix product, for each unit of the product of both norms


class Tree:
    """A vantage-point tree over points (rows).

    A node keeps a point, its halves by distance from that point, and each half's least and
    greatest distance. A leaf holds up to `leaf` points, vantage points are in the leaves too.
    """

    def __init__(self, points, leaf=LEAF, seed=5):
        self.points, self.leaf = points, leaf
        self.random = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(points)))

    def _grow(self, rows):
        if len(rows) <= self.leaf:
            return rows
        top = rows[self.random.integers(len(rows))]
        far = np.sqrt(((self.points[rows] - self.points[top]) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        rows, far = rows[order], far[order]
        half = len(rows) // 2
        return (top, [(far[s][0], far[s][-1], self._grow(rows[s])) for s in (slice(None, half), slice(half, None))])

    def search(self, queries, best, factor=FACTOR):
        """Offer to `best` all leaves that may hold one of the k nearest of some queries.

        All queries walk the tree together, each with its own bound: a half is left out for a query
        whose distance from it, times `factor`, is above that of the k-th nearest so far.
        `best.limits(rows of queries)` are these distances, `best.offer(rows, points)` takes a leaf.
        """
        self.queries, self.best, self.factor = queries, best, factor
        if len(self.points):
            self._visit(self.root, np.arange(len(queries)))

    def _visit(self, node, active):
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self.best.offer(active, node)
            return
        top, halves = node
        q, p = self.queries[active], self.points[top]
        far = np.sqrt(np.maximum((q ** 2).sum(axis=1) - 2 * q @ p + p @ p, 0))
        bounds = [np.maximum(np.maximum(low - far, far - high), 0) for low, high, _ in halves]
        first = bounds[0] <= bounds[1]
        for nearer in (True, False):  # every query sees its nearer half first
            for i, (_, _, child) in enumerate(halves):
                mine = (first if i == 0 else ~first) == nearer
                open_ = mine & (bounds[i] * self.factor <= self.best.limits(active) + 1e-6)
                self._visit(child, active[open_])


class Best:
    """The k best (score, id) of each query, ties to the smaller id, among what was offered.

    A matrix product, with room for its rounding, only chooses whom to score: the score itself is
    one sum of products per pair, which depends on the two vectors alone.
    """

    def __init__(self, queries, query_norms, points, point_norms, ids, k):
        self.queries, self.points, self.ids, self.k = queries, points, ids, k
        self.query_norms, self.room = query_norms, 4 * ROUNDING * query_norms * (point_norms.max() if len(point_norms) else 1)
        self.score = np.full((len(queries), k), -np.inf)
        self.rows = np.full((len(queries), k), -1)
        self.compared = 0

    def enter(self, members, edge):
        """From now on rows are those of a band: members[row], with greatest norm `edge`."""
        self.members, self.edge = members, edge

    def reachable(self):
        """Queries whose k-th score a vector of the norm of the band may still reach."""
        return np.flatnonzero(self.query_norms * self.edge + self.room >= self.score[:, -1])

    def limits(self, active):
        """Distance of the k-th nearest, between the query and the point both lifted to norm 1."""
        cosine = (self.score[active, -1] - self.room[active]) / (self.query_norms[active] * self.edge)
        return np.sqrt(np.maximum(2 - 2 * cosine, 0))

    def offer(self, active, rows):
        rows = self.members[rows]
        self.compared += len(active) * len(rows)
        about = self.queries[active] @ self.points[rows].T
        bound = self.score[active, -1]
        if len(rows) > self.k:
            bound = np.maximum(bound, np.partition(about, len(rows) - self.k, axis=1)[:, len(rows) - self.k] - self.room[active])
        at, col = np.nonzero(~(about < (bound - self.room[active])[:, None]))  # also what is no number
        if not len(at):
            return
        score = np.einsum("ij,ij->i", self.queries[active[at]], self.points[rows[col]])
        hit = np.unique(at)
        old = np.repeat(hit, self.k)
        at = np.concatenate([old, at])
        score = np.concatenate([self.score[active[hit]].ravel(), score])
        found = np.concatenate([self.rows[active[hit]].ravel(), rows[col]])
        order = np.lexsort((np.where(found >= 0, self.ids[found], 0), -score, at))
        at, score, found = at[order], score[order], found[order]
        first = np.searchsorted(at, hit)
        pick = first[:, None] + np.arange(self.k)
        self.score[active[hit]], self.rows[active[hit]] = score[pick], found[pick]


def usable(vectors, id_col="vec_id", vector_col="embedding"):
    """(vec_id, v) of the vectors that take part: not null, not zero, all components finite."""
    v = F.col("v")
    rows = pick(vectors, vec_id=id_col, v=vector_col).select("vec_id", v.cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _norms(x):
    most = np.abs(x).max(axis=1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


def _searched(shard, block, k, factor):
    """The k best of one shard for each query of one block."""
    names = ["query_id", "vec_id", "score"]
    if not len(shard) or not len(block):
        return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
    x, q = np.stack(shard["v"].to_numpy()), np.stack(block["v"].to_numpy())
    # a vector that repeats is one point; its least id stands for it among ties
    points, where = np.unique(x, axis=0, return_inverse=True)
    ids, where = shard["vec_id"].to_numpy(), where.ravel()
    order = np.lexsort((ids, where))
    start = np.searchsorted(where[order], np.arange(len(points) + 1))
    norms, lengths = _norms(points), _norms(q)
    best = Best(q, lengths, points, norms, ids[order][start[:-1]], k + 1)
    # Inner products become distances: one more component fills every point up to the greatest norm
    # of its band, and queries take that norm as well, which does not change their order. Bands and
    # query norms apart, distances from queries and among points would not compare.
    band = np.floor(np.log(norms) / np.log(BAND) + 0.5)
    for b in np.unique(band)[::-1]:
        members = np.flatnonzero(band == b)
        best.enter(members, norms[members].max())
        own = points[members] / best.edge
        lift = np.sqrt(np.maximum(1 - (own ** 2).sum(axis=1), 0))
        active = best.reachable()
        seen = _Part(best, active)
        Tree(np.column_stack([own, lift])).search(
            np.column_stack([q[active] / lengths[active, None], np.zeros(len(active))]), seen, factor)
    out = []
    for one, scores, found in zip(block["query_id"].to_numpy(), best.score.tolist(), best.rows.tolist()):
        mine = [(-s, i) for s, r in zip(scores, found) if r >= 0
                for i in ids[order[start[r]:start[r + 1]][:k + 1]].tolist() if i != one]
        out += [(one, i, -s) for s, i in sorted(mine)[:k]]
    return pd.DataFrame(out, columns=names).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


class _Part:
    """`best` for some of its queries, numbered from 0."""

    def __init__(self, best, active):
        self.best, self.active = best, active

    def limits(self, rows):
        return self.best.limits(self.active[rows])

    def offer(self, rows, points):
        self.best.offer(self.active[rows], points)


def nearest(vectors, queries, k=20, factor=FACTOR, id_col="vec_id", vector_col="embedding", shard=SHARD, block=BLOCK):
    """query_id, rank (from 1), vec_id, score: the k vectors of the largest inner product for each query.

    `queries` has the same columns. A query's own id is no candidate. Every vector is in one shard, by a
    hash of its id, so that no vector and no neighbourhood fills a shard; every block of queries
    visits every shard. Ties go to the smaller id. Null, zero and non-finite vectors, null ids and
    vectors of another length than the query's take no part; a repeated id is as many candidates;
    with fewer candidates than k all are returned, with none no row; empty tables give no rows. Ids are integers.
    `factor` 1 is exact; larger ones search less and may miss some. Within a shard, vectors of about
    the same norm share a tree, so that a few long vectors do not change what is found among the rest.
    """
    if vectors.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids have to be integers")
    base = staged(usable(vectors, id_col, vector_col), "vectors")
    asked = staged(usable(queries, id_col, vector_col).dropDuplicates(["vec_id"]), "queries")
    rows = base.count()
    blocks = max(1, -(-asked.count() // block))
    shards = max(1, -(-rows // shard))

    def dealt(ids, n):
        return F.pmod(F.xxhash64(ids, F.lit(n)), F.lit(n)).cast("int")

    def numbers(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select(F.size("v").alias("dim"), dealt(F.col("vec_id"), shards).alias("shard"), "vec_id", "v").select(
        "*", numbers(blocks).alias("block"))
    right = asked.select(F.size("v").alias("dim"), dealt(F.col("vec_id"), blocks).alias("block"),
                         F.col("vec_id").alias("query_id"), "v").select("*", numbers(shards).alias("shard"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _searched(a, b, k, factor)
    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
