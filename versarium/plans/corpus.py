"""Whole jobs: corpus build, quality report, daily readings, passage search."""

from pyspark.sql import functions as F

from versarium.functions import text as T
from versarium.operators import html as H
from versarium.operators import ordered as O
from versarium.operators import quality as K
from versarium.operators import refs as R
from versarium.operators import search as X
from versarium.operators import segment as G
from versarium.sources import readers


def corpus_quality(docs, min_words=15):
    """Per source and in total: texts before and after the quality gate."""
    kept = K.quality_gate(docs, "text", "doc_id", ["source"], min_words)
    out = K.before_after(docs, kept, "source")
    return out.withColumn("source", F.coalesce("source", F.lit("(all)")))


def corpus_build(pages, language="de", min_words=15):
    """Stored pages (page_id, url, html) to the corpus table: main content,
    segments, cleaning, chunks, quality gate, duplicates, numbers, ids."""
    content = H.with_main_content(H.with_nodes(pages, ["page_id", "url"]))
    meta = H.page_metadata(content, ["page_id"])
    parts = H.content_blocks(content).select("page_id", F.posexplode("blocks").alias("pos", "b"))
    texts = parts.where(F.col("b.kind").isin("paragraph", "list")).select("page_id", "pos", F.col("b.text").alias("text"))
    chunks = texts.select("page_id", "pos", F.posexplode(G.chunk_400(F.col("text"))).alias("sub", "text"))
    placed = chunks.withColumn("ord", F.struct("pos", "sub"))
    named = placed.join(meta, "page_id")
    clean = K.computed_once(named, "text", T.deep_clean(F.col("text")))
    valid = clean.where(T.word_count(F.col("text")) >= min_words)
    unique = K.keep_first_duplicate(valid.withColumn("seq", F.struct("page_id", "ord")), "text", "seq", ["author"]).drop("seq")
    titled = unique.withColumn("work_title", T.clean_title(F.col("title")))
    # numbered after all filters, per work, so ids have no gaps and no repeats
    numbered = O.number_rows(titled, ["author", "work_title", "page_id"], "ord", "section", window=True)
    return numbered.select(
        F.concat_ws("_", T.make_id(F.col("author"), F.col("work_title"), F.col("page_id")), "section").alias("id"),
        "author", "work_title", "section", "text", T.word_count(F.col("text")).alias("word_count"),
        F.lit(language).alias("language"))


def daily_readings(days, keys, verses, json="json"):
    """Day documents to the verses of each reading, with the psalm fallback.
    All days and readings share one range join."""
    main = readers.main_celebration(readers.celebration_flatten(days, keys, json), keys)
    slots = main.select(*keys, F.inline(G.reading_slots(F.col("L1"), F.col("AP"), F.col("L2"), F.col("EV"))))
    asked = slots.where(T.trim_space(F.col("reference")) != "")
    refs = R.parse_lectionary_ref(asked, [*keys, "id"], "reference")
    found = R.psalm_fallback(refs, verses, [*keys, "id"], by_item=False)
    return found.select(*keys, "id", "display", "translation", "chapter", "verse", "text")


def passage_search(requests, key, passages, passage_key, text, limit=8):
    """Verses to the passages that name them, ignoring case: variants, match,
    best rank per passage, first ``limit`` passages per request."""
    variants = requests.select(key, F.posexplode(R.abbrev_variants(F.col("book"), F.col("chapter"), F.col("verse")))
                               .alias("variant_rank", "variant"))
    lowered = passages.select(passage_key, F.lower(text).alias("low_"))
    hits = X.substring_join(lowered, passage_key, "low_", variants, "variant").join(variants, "variant")
    best = hits.groupBy(key, passage_key).agg(F.min("variant_rank").alias("best"))
    return O.top_per_key(best, [key], max(limit, 1), "best", passage_key).withColumnRenamed("rank_", "pos")
