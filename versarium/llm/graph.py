"""Connected components by alternating large and small stars."""

from pyspark.sql import functions as F

from versarium.llm.common import staged


def _both(edges):
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _hooked(edges, pairs, keep):
    """Every neighbour of `u` that `keep` accepts, linked to the least node around `u`.

    The least neighbour is a partial aggregate, written and joined back on `u`: a node with very
    many neighbours is summed up before the shuffle, and its links can be split by the skew join.
    """
    least = staged(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return pairs.join(least, "u").filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges):
    """(node, component) for every node of `edges` (u, v: integers); component = least node.

    Self-loops, repeated and reversed links are harmless; no edges give no rows. Rounds are
    about the logarithm of the longest chain; each writes its edges to the shared folder.
    """
    edges = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .distinct(), "edges")
    mark = None
    while True:
        pairs = _both(edges)
        large = _hooked(edges, pairs, F.col("v") > F.col("u")).filter("u <> v").distinct()
        # now every edge goes from the greater to the lesser node
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v")))).filter("u <> v").distinct()
        edges = staged(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
