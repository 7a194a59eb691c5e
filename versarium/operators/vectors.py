"""Vector retrieval (VEC1-VEC3): exact, by inverted lists, and the backlog."""

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from versarium.functions import text as T
from versarium.operators.joins import backlog
from versarium.operators.ordered import top_per_key
from versarium.session import staged


def _matrix(values, dims):
    return np.asarray([v for v in values], dtype=np.float64).reshape(-1, dims)


BLOCKS = 48  # of queries, where each has 50,000 at most
# Rows and queries of one matrix product, and pairs whose differences are held at once.
TILE_ROWS, TILE_QUERIES, TILE_PAIRS = 4096, 512, 1 << 16


def _exact(vectors, queries, rows, asked):
    """Cosine and distance of pairs of places, the same for equal vectors wherever they stand."""
    cosine, l2 = np.empty(len(rows)), np.empty(len(rows))
    for i in range(0, len(rows), TILE_PAIRS):
        v, q = vectors[rows[i:i + TILE_PAIRS]], queries[asked[i:i + TILE_PAIRS]]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine[i:i + TILE_PAIRS] = (v * q).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
        l2[i:i + TILE_PAIRS] = np.sqrt(((v - q) ** 2).sum(axis=1))
    return cosine, l2


def _batch_hits(ids, vectors, query_ids, queries, k, min_similarity, order_by="l2"):
    """Per query the best k rows of one block, by distance (or similarity), then id.

    The product is made tile by tile, and of a tile only the pairs that may be among the best k so far
    are kept, so that memory depends on the sizes of the tiles and not on those of the block.
    """
    for start in range(0, len(queries), TILE_QUERIES):
        some = queries[start:start + TILE_QUERIES]
        q_squares = (some ** 2).sum(axis=1)
        kth, kept = np.full(len(some), np.inf), None  # kth: squared distance, or similarity with a minus
        for at in range(0, len(vectors), TILE_ROWS):
            part = vectors[at:at + TILE_ROWS]
            squares = (part ** 2).sum(axis=1)
            dots = part @ some.T
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = dots / np.outer(np.sqrt(squares), np.sqrt(q_squares))
            if order_by == "l2":
                value = squares[:, None] + q_squares[None, :] - 2 * dots
                slack = 1e-11 * (np.nanmax(squares, initial=0) + q_squares)
            else:
                value, slack = -cosine, np.full(len(some), 1e-11)
            if len(part) >= k and np.isinf(kth).any():
                sure = np.where(cosine >= min_similarity + 1e-11, value, np.inf)
                kth = np.minimum(kth, np.partition(sure, k - 1, axis=0)[k - 1])
            asked, rows = np.nonzero(((cosine >= min_similarity - 1e-11) & (value <= kth + slack)).T)
            if len(rows) == 0:
                continue
            found = (asked, rows + at, *_exact(part, some, rows, asked))
            found = [x[found[2] >= min_similarity] for x in found]
            if kept is not None:
                found = [np.concatenate(x) for x in zip(kept, found)]
            best = found[3] if order_by == "l2" else -found[2]
            order = np.lexsort((ids[found[1]], best, found[0]))
            asked, best = found[0][order], best[order]
            rank = np.arange(len(asked)) - np.searchsorted(asked, asked)
            kept = [x[order[rank < k]] for x in found]
            last = rank == k - 1
            kth[asked[last]] = np.minimum(kth[asked[last]], best[last] ** 2 if order_by == "l2" else best[last])
        if kept is not None:
            for j, i, similarity, distance in zip(*kept):
                yield query_ids[start + j], ids[i], float(similarity), float(distance)


def match_passages(vectors, queries, k=12, min_similarity=0.20, key="vec_id", vector="embedding",
                   query_key="query_id", order_by="l2"):
    """For each query the k nearest vectors with enough cosine similarity.

    Rows are filtered by cosine and ordered by L2, as for unit vectors the two
    agree; order_by='cosine' ranks by similarity. See match_all for the plan.
    """
    return match_all(vectors, queries, k, min_similarity, key, vector, query_key, order_by=order_by)


def match_all(vectors, queries, k=12, min_similarity=0.20, key="vec_id", vector="embedding", query_key="query_id",
              vector_bucket=50_000, query_bucket=None, order_by="l2"):
    """Both sides are cut into buckets by key hash and each pair of buckets gives at most k
    rows per query, by matrix products over tiles; the final ranking sees only those. Neither
    side passes through the driver, at any size. Each side is shuffled once per bucket of the other, so
    the buckets of many queries grow from 2,000 to 50,000 before there are more than `BLOCKS` of them."""
    n_v = max(1, -(-vectors.count() // vector_bucket))
    count = queries.count()
    n_q = max(1, -(-count // (query_bucket or min(max(2_000, -(-count // BLOCKS)), 50_000))))
    left = (vectors.select(key, vector).withColumn("vb", F.pmod(F.xxhash64(key), F.lit(n_v)))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))))
    right = (queries.select(query_key, F.col(vector).alias("q_")).withColumn("qb", F.pmod(F.xxhash64(query_key), F.lit(n_q)).cast("int"))
             .withColumn("vb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_v - 1).cast("bigint")))))
    hits = _met(left, right, ["vb", "qb"], vectors, queries, k, min_similarity, key, vector, query_key, order_by)
    rank = [F.col("distance"), F.col(key)] if order_by == "l2" else [F.desc("similarity"), F.col(key)]
    return top_per_key(hits, [query_key], k, *rank).withColumnRenamed("rank_", "rank")


def _met(left, right, buckets, vectors, queries, k, min_similarity, key, vector, query_key, order_by="l2"):
    """The k best rows per query of every bucket that vectors (``vector``) and queries (``q_``) share."""
    key_type = vectors.schema[key].dataType.simpleString()
    query_type = queries.schema[query_key].dataType.simpleString()

    def block(vec, qry):
        columns = [query_key, key, "similarity", "distance"]
        if vec.empty or qry.empty:
            return pd.DataFrame({c: [] for c in columns})
        matrix = np.asarray(qry["q_"].tolist(), dtype=np.float64)
        rows = _batch_hits(vec[key].to_numpy(), _matrix(vec[vector].tolist(), matrix.shape[1]), qry[query_key].tolist(),
                           matrix, k, min_similarity, order_by)
        return pd.DataFrame(rows, columns=columns)

    return left.groupBy(*buckets).cogroup(right.groupBy(*buckets)).applyInPandas(
        block, f"{query_key} {query_type}, {key} {key_type}, similarity double, distance double")


def assign_cells(vectors, lists=100, seed=7, vector="embedding"):
    """Add the inverted list of each vector. The centres are trained on all of them."""
    lists = max(1, min(lists, vectors.count()))
    base = vectors.withColumn("f_", array_to_vector(vector))
    model = KMeans(k=lists, seed=seed, featuresCol="f_", predictionCol="cell", maxIter=10).fit(base)
    centres = [c.tolist() for c in model.clusterCenters()]
    return model.transform(base).drop("f_"), centres


def knn_ivf(vectors, queries, k=12, min_similarity=0.20, lists=100, probes=4, key="vec_id", vector="embedding",
            query_key="query_id", cell_rows=20_000):
    """The k nearest vectors by inverted lists; the same rows as match_passages.

    First the ``probes`` lists nearest to a query are read. By the triangle inequality a list holds
    nothing nearer than the distance of its centre less its radius, so then exactly those lists are read
    that may hold something nearer than the k-th found so far, all of them where fewer were found.
    Lists of more than about ``cell_rows`` vectors are split, so none is one task.
    """
    celled, centres = assign_cells(vectors.select(key, vector), lists, vector=vector)
    celled = staged(celled, "cells")
    matrix = np.asarray(centres)
    width = matrix.shape[1]

    @F.pandas_udf("double")
    def from_centre(vecs: pd.Series, cells: pd.Series) -> pd.Series:
        return pd.Series(np.linalg.norm(_matrix(vecs.tolist(), width) - matrix[cells.to_numpy()], axis=1))
    sizes = {r.cell: r for r in celled.groupBy("cell").agg(
        F.max(from_centre(vector, "cell")).alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # one row per list
    radius = np.array([sizes[c].radius if c in sizes else -np.inf for c in range(len(matrix))])
    parts = [-(-sizes[c].n // cell_rows) if c in sizes else 1 for c in range(len(matrix))]

    @F.pandas_udf("array<struct<cell:int,least:double,turn:int>>")
    def bounds(vecs: pd.Series) -> pd.Series:
        gaps = np.linalg.norm(_matrix(vecs.tolist(), width)[:, None, :] - matrix[None, :, :], axis=2)
        turn = np.argsort(np.argsort(gaps, axis=1, kind="stable"), axis=1)
        least = gaps - radius - 1e-9 * (1 + gaps)  # what rounding may add
        return pd.Series([[{"cell": c, "least": x, "turn": t} for c, (x, t) in enumerate(zip(*row))]
                          for row in zip(least.tolist(), turn.tolist())])

    split = F.element_at(F.array(*[F.lit(p) for p in parts]), F.col("cell") + 1)
    left = celled.withColumn("part", F.pmod(F.xxhash64(key), split).cast("int"))
    asked = staged(queries.select(query_key, F.col(vector).alias("q_"), F.explode(bounds(vector)).alias("c"))
                   .select(query_key, "q_", "c.*"), "bounds")

    def hits(rows):
        right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), split - 1)))
        return _met(left, right, ["cell", "part"], vectors, queries, k, min_similarity, key, vector, query_key)
    first = staged(top_per_key(hits(asked.where(F.col("turn") < probes)), [query_key], k, "distance", key), "first")
    kth = first.where(F.col("rank_") == k).select(F.col(query_key).alias("kth_query"), F.col("distance").alias("kth"))
    open_ = asked.where(F.col("turn") >= probes).join(kth, F.col(query_key) == F.col("kth_query"), "left").where(
        F.col("kth").isNull() | (F.col("least") <= F.col("kth"))).select(query_key, "q_", "cell")
    every = first.drop("rank_").unionByName(hits(open_))
    return top_per_key(every, [query_key], k, "distance", key).withColumnRenamed("rank_", "rank")


def hashed_encoder(df, text, dims=64, out="embedding"):
    """Deterministic bag-of-words vector of length 1; a stand-in for a model."""
    split = Tokenizer(inputCol=text, outputCol="tok_").transform(df)
    counted = HashingTF(inputCol="tok_", outputCol="tf_", numFeatures=dims).transform(split)
    raw = vector_to_array("tf_")
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(raw, lambda x: (x / F.when(norm > 0, norm).otherwise(1.0)).cast("float"))
    return counted.withColumn(out, unit).drop("tok_", "tf_")


def pieces(c, limit):
    """A text cut into pieces of at most ``limit`` characters; an empty text is one."""
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(c) - 1) / limit), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.substring(c, i * limit + 1, F.lit(limit)))


def encode_whole(items, key, text, limit=6000, encoder=hashed_encoder, out="embedding"):
    """One vector per item for an encoder that takes ``limit`` characters: longer
    texts are encoded piece by piece and averaged by length."""
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = items.select(key, F.posexplode(T.let(whole, lambda t: pieces(t, limit))).alias("part_", "input_"))
    coded = encoder(parts, "input_").select(key, F.greatest(F.length("input_"), F.lit(1)).cast("double").alias("weight_"),
                                            array_to_vector(F.col(out).cast("array<double>")).alias("vector_"))
    # one vector per item and task is summed up before the shuffle
    mean = Summarizer.mean(F.col("vector_"), F.col("weight_"))
    return coded.groupBy(key).agg(vector_to_array(mean).cast("array<float>").alias(out))


def embed_backlog(items, done, key, text, limit=6000, encoder=hashed_encoder):
    """Vectors for the items that have none, of their whole texts."""
    return encode_whole(backlog(items.select(key, text), done, key), key, text, limit, encoder)
