"""Importance resampling towards a target distribution: hashed features, array scores, a bisected cutoff."""

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from versarium.llm.common import pick, staged
from versarium.operators.ordered import global_numbers

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SECTIONS = 16  # parts of the open interval that one count job tells apart: four bisections at a time

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text, buckets=BUCKETS):
    """(number of words, buckets of all words and of all pairs of following words)."""
    if text is None:
        return 0, np.zeros(0, np.uint32)
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only
    ones = list(map(crc32, words))
    twos = list(map(crc32, [b" " + w for w in words[1:]], ones))
    return len(words), np.array(ones + twos, dtype=np.uint32) % buckets


def features(rows, buckets=BUCKETS):
    """(id, n_words, buckets) of every row (id, text); the buckets as packed 32-bit integers."""
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [buckets_of(t, buckets) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n_words": [n for n, _ in found],
                                "buckets": [b.astype("<u4").tobytes() for _, b in found]})
    return rows.mapInPandas(cut, f"id {kind}, n_words long, buckets binary")


def bucket_counts(found, buckets=BUCKETS):
    """Occurrences of each bucket over all rows, summed per batch and then by Spark."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total = np.zeros(buckets, dtype=np.int64)
            for packed in batch["buckets"]:
                total += np.bincount(np.frombuffer(packed, "<u4"), minlength=buckets)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"bucket": at, "n": total[at]})
    sums = found.select("buckets").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for bucket, n in sums.collect():  # at most `buckets` rows
        counts[bucket] = n
    return counts


def gains(source, target):
    """floor(1000 ln) of how much likelier each bucket is in the target, one count added to each."""
    add, s_all, t_all = float(len(source)), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log(((t + 1.0) * (s_all + add)) / ((s + 1.0) * (t_all + add))))
            for s, t in zip(source, target)]


def noise(id_column, seed=SEED):
    """Gumbel noise of an id, in thousandths; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _greatest(count_from, low, high, wanted, sections=SECTIONS):
    """The greatest t in low..high of which `count_from([t, ...])` gives `wanted` or more; `low` does."""
    while low < high:
        marks = sorted({low + -(-(high - low) * i // sections) for i in range(1, sections + 1)})
        counts = count_from(marks)
        low, high = (max([low, *[m for m, n in zip(marks, counts) if n >= wanted]]),
                     min([high, *[m - 1 for m, n in zip(marks, counts) if n < wanted]]))
    return low


def cutoff(rows, wanted):
    """(score, id) of the last of the `wanted` highest scores, ties by smaller id, or None.

    Both are found by count jobs over the stored rows (score, place: the id, nulls as the greatest):
    no sort, and nothing but counts reaches the driver.
    """
    least, most, n = rows.agg(F.min("score"), F.max("score"), F.count(F.lit(1))).first()
    wanted = min(wanted, n)
    if wanted < 1:
        return None

    def counter(frame, column, sign):
        def count_from(marks):
            sums = [F.sum((sign * column >= m).cast("long")) for m in marks]
            return [x or 0 for x in frame.agg(*sums).first()]
        return count_from
    score = _greatest(counter(rows, F.col("score"), 1), least, most, wanted)
    above = rows.filter(F.col("score") > score).count()
    tied = rows.filter(F.col("score") == score)
    first, last = tied.agg(F.min("place"), F.max("place")).first()
    return score, -_greatest(counter(tied, F.col("place"), -1), -last, -first, wanted - above)


def resampled(documents, target, id_col="doc_id", text_col="text", target_text_col="text", percent=PERCENT,
              min_words=MIN_WORDS, seed=SEED, buckets=BUCKETS):
    """One row per document: doc_id, n_features, weight, score, rank.

    Features are words and pairs of following words, hashed into `buckets`. A document's weight is
    the floored mean of its features' gains, 0 without any; its score adds Gumbel noise of its id, so
    that the highest scores are a sample without replacement in proportion to the weights. Of the N
    documents with `min_words` words or more, floor(percent N / 100) are drawn and ranked from 1;
    `rank` is null for all others.

    Null and empty texts have no feature and are never drawn (with `min_words` 0 they may be). Null
    ids have the noise of an empty id and come last among ties; ids are integers. Repeated rows are
    rows of their own; rows that tie in score and id are ranked in any order. An empty target
    counts nothing; an empty table gives no rows.
    """
    docs = pick(documents, id=id_col, text=text_col)
    if docs.schema["id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids have to be integers")
    found = staged(features(docs.withColumn("id", F.col("id").cast("long")), buckets), "features")
    asked = features(pick(target, text=target_text_col).select(F.lit(0).cast("long").alias("id"), "text"), buckets)
    gain = np.array(gains(bucket_counts(found, buckets), bucket_counts(asked, buckets)), dtype=np.int64)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [np.frombuffer(b, "<u4") for b in batch["buckets"]]
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "n_words": batch["n_words"], "n_features": [len(b) for b in lists],
                                "weight": [int(gain[b].sum()) // len(b) if len(b) else 0 for b in lists]})
    weighed = found.mapInPandas(weigh, "id long, n_words long, n_features long, weight long")
    rows = staged(weighed.select("*", (F.col("weight") + noise(F.col("id"), seed)).alias("score"),
                                 F.coalesce("id", F.lit(2**63 - 1)).alias("place")), "scored")
    fit = rows.filter(F.col("n_words") >= min_words)
    wanted = percent * fit.count() // 100
    last = cutoff(fit, wanted)
    names = [F.col("id").alias("doc_id"), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select(*names, none)
    drawn = (F.col("n_words") >= min_words) & ((F.col("score") > last[0]) | (F.col("score") == last[0]) & (F.col("place") <= last[1]))
    # rows that repeat the last one's score and id may be one too many
    ranked = global_numbers(rows.filter(drawn), F.desc("score"), "place", out="number")
    rank = F.when(F.col("number") < wanted, F.col("number") + 1).alias("rank")
    return rows.filter(~drawn).select(*names, none).union(ranked.select(*names, rank))


def drawn_documents(documents, target, id_col="doc_id", **options):
    """The documents drawn, all columns kept, best first by `rank` order of their ids; see `resampled`."""
    ids = resampled(documents, target, id_col, **options).filter("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return documents.join(ids, F.col(f"`{id_col}`") == F.col("__drawn"), "left_semi")


ORACLE = r"""
WITH tbl AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
                         ORDER BY i) t FROM (SELECT unnest(range(256)) i)),
texts AS (SELECT 0 side, row_number() OVER () r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') w FROM texts),
runs AS (SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) f FROM words),
kinds AS (SELECT f, hex(encode(f)) h FROM (SELECT DISTINCT f FROM runs)),
hashed AS (SELECT f, xor(4294967295, list_reduce(list_transform(range(0, len(h) // 2 + 1), lambda i: CASE WHEN i = 0 THEN 4294967295
             ELSE ('0x' || h[2 * i - 1:2 * i])::BIGINT END), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 b
           FROM kinds, tbl),
feats AS (SELECT side, r, b FROM runs JOIN hashed USING (f)),
totals AS (SELECT count(*) FILTER (side = 0) s_all, count(*) FILTER (side = 1) t_all FROM feats),
gains AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT gain
          FROM (SELECT b, count(*) FILTER (side = 0) s, count(*) FILTER (side = 1) t FROM feats GROUP BY b), totals),
weights AS (SELECT r, count(*) n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT weight FROM feats JOIN gains USING (b) WHERE side = 0 GROUP BY r),
scored AS (SELECT doc_id, len(w) n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0)
             + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT score
           FROM words LEFT JOIN weights USING (r) WHERE side = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) n, count(*) OVER () total FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= 25 * total // 100 THEN n END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
