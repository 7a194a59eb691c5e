"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from pyspark.sql import functions as F

from versarium.llm.common import let, pick, staged


def word_list(text):
    """Lower-case runs of letters and digits; null and empty texts have none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _windows(words, size, made):
    """`made(w1..w_size)` for every run of `size` words in a row."""
    def runs(ws):
        made_at = F.transform(ws, lambda w, i: made(w, *[F.get(ws, i + k) for k in range(1, size)]))
        return F.slice(made_at, F.lit(1), F.greatest(F.size(ws) - (size - 1), F.lit(0)))
    return let(words, runs)


def hashed(words, size):
    return _windows(words, size, F.xxhash64)


def spelled(words, size):
    return _windows(words, size, lambda *w: F.concat_ws(" ", *w))


def sized_items(items, size=5):
    """(item_id, width, shingle): the distinct shingles of each item.

    Items with fewer than `size` words are one shingle, their whole word sequence, and are
    looked for at that width. Items without a word have no shingle and are never found.
    """
    words = items.select("item_id", word_list(F.col("text")).alias("w")).withColumn(
        "width", F.least(F.size("w"), F.lit(size)))
    by_width = [words.filter(F.col("width") == n).select("item_id", "width", F.explode(spelled(F.col("w"), n)).alias("shingle"))
                for n in range(1, size + 1)]
    out = by_width[0]
    for part in by_width[1:]:
        out = out.union(part)
    return out.filter("item_id is not null").distinct()


def sketches(shingles, threshold):
    """(width, h, item_id): the least hashes of each item, as many as its size class needs.

    Items are partitioned by size into classes up to 2, 4, 8, ... shingles. An item of a class
    up to U keeps its k = floor((1 - threshold) U) + 1 least hashes. A document that contains
    `threshold` of the item lacks at most k - 1 of its shingles, so one of the k is in it: the
    search misses nothing. The k hashes are a MinHash sample of the item, the smaller set, so
    the length of the document does not matter.
    """
    hashes = shingles.select("item_id", "width", _hash_of(F.col("shingle"), F.col("width")).alias("h"))
    lists = hashes.groupBy("item_id", "width").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size("hs"), F.lit(2)))))
    kept = F.floor(upper * (1 - threshold) + 1e-9).cast("int") + 1
    return lists.select("item_id", "width", F.explode(F.slice("hs", F.lit(1), kept)).alias("h"))


def _hash_of(shingle, width, most=5):
    """The hash that `hashed` gives for the same words."""
    words = F.split(shingle, " ")
    out = F.lit(None).cast("long")
    for n in range(1, most + 1):
        out = F.when(width == n, F.xxhash64(*[F.get(words, F.lit(i)) for i in range(n)])).otherwise(out)
    return out


def contained_items(documents, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
                    size=5, threshold=0.8):
    """One row per document and benchmark item whose shingles it holds to `threshold` or more.

    doc_id, item_id, shared and total (distinct shingles of the item) and containment. Shingles are
    `size` words in lower case; a shorter item counts as one shingle, its whole sequence. Null or
    empty documents and items match nothing; rows without id are left out; rows that repeat an id
    are taken together; empty tables give no rows.

    Search: the hashes of all document shingles meet the sketches of the items in one join (Spark
    broadcasts the sketches only while they are below its size limit). Check: the documents found,
    and only they, are cut into spelled-out shingles and compared exactly.
    """
    if not 1 <= size <= 5:
        raise ValueError("shingles take one to five words")
    docs = pick(documents, doc_id=id_col, text=text_col).filter("doc_id is not null and text is not null")
    items = pick(benchmark, item_id=item_col, text=item_text_col)
    shingles = staged(sized_items(items, size), "items")
    sketch = staged(sketches(shingles, threshold), "sketches")
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect())  # at most `size` integers
    found = None
    for n in widths:
        hashes = docs.select("doc_id", F.explode(hashed(word_list(F.col("text")), n)).alias("h"))
        hits = hashes.join(sketch.filter(F.col("width") == n).select("h", "item_id"), "h").select("doc_id", "item_id")
        found = hits if found is None else found.union(hits)
    if found is None:
        found = docs.select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")).limit(0)
    found = staged(found.distinct(), "candidates")
    near = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    held = None
    for n in widths:
        part = near.select("doc_id", F.explode(F.array_distinct(spelled(word_list(F.col("text")), n))).alias("shingle"))
        part = part.join(shingles.filter(F.col("width") == n).select("shingle", "item_id"), "shingle").select("doc_id", "item_id", "shingle")
        held = part if held is None else held.union(part)
    if held is None:
        held = found.withColumn("shingle", F.lit(""))
    shared = (held.join(found, ["doc_id", "item_id"], "left_semi").distinct()
              .groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared")))
    totals = shingles.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    return (shared.join(totals, "item_id").withColumn("containment", F.col("shared") / F.col("total"))
            .filter(F.col("containment") >= threshold)
            .select("doc_id", "item_id", "shared", "total", "containment"))


def without_leaks(documents, benchmark, **options):
    """The rows of `documents` that hold no item; rows without id cannot be judged and stay."""
    found = contained_items(documents, benchmark, **options).select("doc_id").distinct()
    key = options.get("id_col", "doc_id")
    return documents.join(found.withColumnRenamed("doc_id", "__leak"), F.col(f"`{key}`") == F.col("__leak"), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) s FROM d),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM benchmark),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) s FROM b WHERE len(w) >= 5),
t AS (SELECT item_id, count(*) total FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, total, shared::DOUBLE / total AS containment
FROM m JOIN t USING (item_id) WHERE shared::DOUBLE / total >= 0.8
"""
