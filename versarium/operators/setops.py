"""Set operations over frames (SET1-SET6)."""

from functools import reduce

from pyspark.sql import functions as F

from versarium.operators.ordered import first_per_key


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def ordered_union(frames, key):
    """Union in which an earlier frame wins for an id."""
    ranked = [f.withColumn("src_", F.lit(i)) for i, f in enumerate(frames)]
    return first_per_key(union_all(ranked), [key], "src_").drop("src_")


def difference(wanted, present, key):
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def changes(before, after, key):
    """Values that only one side has, with the side."""
    gone = difference(before, after, key).withColumn("side", F.lit("before"))
    new = difference(after, before, key).withColumn("side", F.lit("after"))
    return gone.unionByName(new)


def header_detail_rows(df, group, order, label):
    """One header row per group, then its detail rows."""
    heads = df.select(group).distinct().select(
        group, F.lit(0).alias("level"), F.lit(None).cast(df.schema[order].dataType).alias(order),
        F.col(group).cast("string").alias("label"))
    rows = df.select(group, F.lit(1).alias("level"), order, F.col(label).cast("string").alias("label"))
    return heads.unionByName(rows).orderBy(group, "level", order)


def fallback_source(first, second):
    """The second frame only if the first has no row. The test reads one row."""
    found = first.select(F.lit(1).alias("some_")).limit(1).agg(F.count("some_")).scalar()
    return first.unionByName(second.where(found == 0))
