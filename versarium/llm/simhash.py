"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from versarium.llm.common import pick, staged
from versarium.llm.graph import components

BLOCKS = 4  # of 16 bits; two fingerprints that differ in 2 bits agree in 2 of them
GROUP = 64  # members of a block group up to which its pairs are compared one by one


def fingerprint_of(text, size=3):
    """64-bit SimHash over the shingles of `size` words, repeats included; 0 without words."""
    import xxhash
    if text is None:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)])) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 32768):
        part = hashes[start:start + 32768]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(documents, id_col="doc_id", text_col="text", size=3):
    """(doc_id, fp) for every row; `fp` is the fingerprint as a signed 64-bit integer."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, size) for t in texts], dtype="int64")

    return pick(documents, doc_id=id_col, text=text_col).select("doc_id", simhash("text").alias("fp"))


def _mask(blocks):
    value = sum(0xFFFF << (16 * b) for b in blocks)
    return value - (1 << 64) if value >= 1 << 63 else value


def close_pairs(fps, distance=2, group=GROUP):
    """Links (u, v) between the distinct values of `fp`, enough to connect all within `distance` <= 2.

    Each fingerprint is keyed by every choice of 2 of its 4 blocks. Groups of up to `group`
    members are joined with themselves and verified. In larger ones all pairs would grow with
    the square, so each member is keyed by itself and by each value one bit away in the free
    blocks instead: two members within 2 bits share such a midpoint, and all that share one are
    within 2 bits of each other, so one link to the least of them connects exactly them.
    """
    if not 0 <= distance <= 2:
        raise ValueError("two of four blocks prove links up to 2 bits")
    choices = list(combinations(range(BLOCKS), 2))
    fp = F.col("fp")
    keyed = fps.select("fp").distinct().select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(_mask(c))).alias("block"))
        for i, c in enumerate(choices)])).alias("k")).select("fp", "k.choice", "k.block")
    keyed = staged(keyed.join(keyed.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("members"))
                              .filter("members > 1"), ["choice", "block"]), "blocks")
    few = keyed.filter(F.col("members") <= group)
    pairs = few.select("choice", "block", F.col("fp").alias("u")).join(
        few.select("choice", "block", F.col("fp").alias("v")), ["choice", "block"]).filter("u < v").select("u", "v")
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[
        F.lit((1 << bit) - (1 << 64) if bit == 63 else 1 << bit).cast("long")
        for b in range(BLOCKS) if b not in c for bit in range(16 * b, 16 * b + 16)]) for c in choices]), F.col("choice") + 1)
    near = keyed.filter(F.col("members") > group).select(
        "choice", "fp", F.explode(flips).alias("flip")).select("choice", "fp", fp.bitwiseXOR(F.col("flip")).alias("middle"))
    hubs = near.groupBy("choice", "middle").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = near.join(hubs.drop("n"), ["choice", "middle"]).filter("u < fp").select("u", F.col("fp").alias("v"))
    return pairs.union(stars).filter(
        F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).distinct()


def near_duplicates(documents, id_col="doc_id", text_col="text", size=3, distance=2):
    """One row per input row: doc_id, fp, component_id (least doc_id that links reach), copies.

    `copies` counts the rows of the component. Null and empty texts have fingerprint 0 and are
    linked like any other. Rows without id are returned with their component, whose id is the
    least id that is not null (null if there is none). Repeated rows are returned as often as
    they come. An empty table gives no rows. Identical texts share a fingerprint and are one
    node, so thousands of copies cost no pairs.
    """
    fps = staged(fingerprints(documents, id_col, text_col, size), "fingerprints")
    nodes = components(close_pairs(fps, distance))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    joined = least.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "least", "rows")
    totals = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("rows").alias("copies"))
    by_fp = joined.select("fp", "component").join(totals, "component").select("fp", "component_id", "copies")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id", "copies")


def one_of_each(documents, id_col="doc_id", text_col="text", size=3, distance=2):
    """The rows of `documents` that are the first of their component, all columns kept.

    Rows without id cannot be told apart and stay; so do all rows that repeat the first one's id.
    """
    found = near_duplicates(documents, id_col, text_col, size, distance)
    later = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__later")).distinct()
    return documents.join(later, F.col(f"`{id_col}`") == F.col("__later"), "left_anti")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
