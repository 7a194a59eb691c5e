"""Substring, term and combined search (FLT7-8, JN10, TXS1-TXS3, DUP2)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from versarium import dims
from versarium import patterns as P
from versarium.functions import predicates as Q
from versarium.functions import text as T
from versarium.operators import joins as J
from versarium.operators import refs as R
from versarium.operators import segment as G
from versarium.operators.ordered import top_per_key
from versarium.session import staged

# Patterns of one automaton, and their characters.
PATTERN_BLOCK = 50_000
PATTERN_CHARS = 8_000_000
# Pairs of gram and key that a task sorts at once, and the base of the hash of a gram.
POSTING_PAIRS = 1_000_000
GRAM_BASE = 0x9E3779B97F4A7C15


def ilike_search(df, text, term, order, limit=10):
    """Rows that contain the term, ignoring case; first by ``order``."""
    if len(term) < 2:
        return df.where(F.lit(False))
    return df.where(Q.ilike_term(F.col(text), term)).orderBy(*order).limit(limit)


def multi_pattern_or(df, text, terms, order, limit=10):
    return df.where(Q.multi_pattern_or(F.col(text), terms)).orderBy(*order).limit(limit)


def qgrams(c, q):
    """All substrings of q characters, by a look-ahead at each position."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(.{%d}))" % q), F.lit(1)))


def substring_join(df, key, text, patterns, pattern, block=PATTERN_BLOCK):
    """The distinct (key, pattern) pairs where a text of the key contains the pattern.

    Texts stay in the task that reads them: the patterns come to them, in blocks of at most about
    ``block`` patterns and PATTERN_CHARS characters, counted before they are sent. Each block is one
    automaton and one pass over the texts, whose cost does not depend on the number of patterns.
    """
    wanted = patterns.select(F.col(pattern).alias("pattern_")).where(F.length("pattern_") > 0).distinct()
    wanted = staged(wanted, "patterns")
    count, chars = wanted.agg(F.count(F.lit(1)), F.sum(F.length("pattern_"))).first()
    blocks = max(1, -(-count // block), -(-(chars or 0) // PATTERN_CHARS))
    texts = df.select(F.col(key).alias("key_"), F.col(text).alias("text_")).where(F.col("text_").isNotNull())
    kind = df.schema[key].dataType.simpleString()
    found = None
    for number in range(blocks):
        of_block = F.pmod(F.xxhash64("pattern_"), F.lit(blocks)) == number
        words = df.sparkSession.sparkContext.broadcast([r[0] for r in wanted.where(of_block).collect()])
        hits = texts.mapInArrow(_contained(words, key, pattern), f"`{key}` {kind}, `{pattern}` string")
        found = hits if found is None else found.union(hits)
    return found.distinct()


def _contained(words, key, pattern):
    """Batches of (key_, text_) to the (key, pattern) pairs found."""
    def match(batches):
        import ahocorasick
        sought, automaton = words.value, ahocorasick.Automaton()
        for i, word in enumerate(sought):
            automaton.add_word(word, i)
        if not sought:
            return
        automaton.make_automaton()
        sought = pa.array(sought)
        for batch in batches:
            rows, which = [], []
            for n, value in enumerate(batch.column("text_").to_pylist()):
                found = {i for _, i in automaton.iter(value)}
                rows += [n] * len(found)
                which += found
            yield pa.RecordBatch.from_arrays([batch.column("key_").take(pa.array(rows, pa.int64())),
                                              sought.take(pa.array(which, pa.int64()))], names=[key, pattern])
    return match


def _gram_ids(text, q):
    """The distinct substrings of q characters of a text as 64-bit hashes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < q:
        return np.zeros(0, np.int64)
    ids = np.zeros(len(codes) - q + 1, np.uint64)
    for i in range(q):
        ids = ids * np.uint64(GRAM_BASE) + codes[i:i + len(ids)]
    return np.unique(ids.view(np.int64))


def _posting_lists(q, limit):
    """Batches of (key_, text_) to (gram_, n_, keys_), in order of gram for each part of about ``limit`` pairs."""
    def lists(keys, grams):
        counts = [len(g) for g in grams]
        ids = np.concatenate(grams)
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.diff(ids[order], prepend=0) != 0) if len(ids) else np.zeros(0, np.int64)
        if len(ids) and (not len(starts) or starts[0] != 0):
            starts = np.append(0, starts)
        held = pa.concat_arrays(keys).take(pa.array(np.repeat(np.arange(len(grams)), counts)[order]))
        edges = np.append(starts, len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[order][starts]), pa.array(np.diff(edges)), pa.ListArray.from_arrays(
            pa.array(edges.astype(np.int32)), held)], names=["gram_", "n_", "keys_"])

    def post(batches):
        keys, grams, pairs = [], [], 0
        for batch in batches:
            for n, text in enumerate(batch.column("text_")):
                ids = _gram_ids(text.as_py(), q)
                keys.append(batch.column("key_").slice(n, 1))
                grams.append(ids)
                pairs += len(ids)
                if pairs >= limit:
                    yield lists(keys, grams)
                    keys, grams, pairs = [], [], 0
        if pairs:
            yield lists(keys, grams)
    return post


def gram_index(df, key, text, path, q=3, pairs=POSTING_PAIRS):
    """Posting lists of the q-character substrings of the texts, for many searches over one corpus.

    Written to ``path``: (gram, number, keys), one list per gram and part of the texts, made and sorted by the
    task that reads them, so that no pair of gram and key is shuffled; and the number of keys of each gram. A
    gram is a 64-bit hash: two that meet cost a search in more texts. A key may have several texts.
    """
    texts = df.select(F.col(key).alias("key_"), F.col(text).alias("text_")).where("key_ IS NOT NULL AND text_ IS NOT NULL")
    kind = df.schema[key].dataType.simpleString()
    lists = texts.mapInArrow(_posting_lists(q, pairs), f"gram_ long, n_ long, keys_ array<{kind}>")
    lists.write.mode("overwrite").parquet(f"{path}/postings")
    postings = df.sparkSession.read.parquet(f"{path}/postings")
    postings.groupBy("gram_").agg(F.sum("n_").alias("keys_")).write.mode("overwrite").parquet(f"{path}/counts")


def _pattern_grams(q):
    def cut(batches):
        for batch in batches:
            column = batch.column("pattern_")
            grams = [_gram_ids(p, q) for p in column.to_pylist()]
            rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            yield pa.RecordBatch.from_arrays([column.take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0, np.int64), *grams]))],
                                             names=["pattern_", "gram_"])
    return cut


def indexed_join(df, key, text, patterns, pattern, path, q=3):
    """The pairs of substring_join by the index at ``path``.

    Each pattern asks for the postings of its rarest gram alone, and the texts of those keys are
    searched; a pattern with a gram that no text has is dropped at once. Patterns of fewer than q
    characters have no gram and go through substring_join.
    """
    spark = df.sparkSession
    postings, counts = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts")
    wanted = staged(patterns.select(F.col(pattern).alias("pattern_")).where(F.length("pattern_") > 0).distinct(), "patterns")
    grams = wanted.where(F.length("pattern_") >= q).mapInArrow(_pattern_grams(q), "pattern_ string, gram_ long")
    rarest = (grams.join(counts, "gram_", "left").groupBy("pattern_")
              .agg(F.min_by("gram_", "keys_").alias("gram_"), F.count_if(F.col("keys_").isNull()).alias("unknown_"))
              .where("unknown_ = 0"))
    near = (postings.join(rarest.select("pattern_", "gram_"), "gram_")
            .select(F.explode("keys_").alias("key_"), "pattern_").distinct())
    texts = df.select(F.col(key).alias("key_"), F.col(text).alias("text_"))
    found = texts.join(near, "key_").where(F.contains("text_", "pattern_")).select(
        F.col("key_").alias(key), F.col("pattern_").alias(pattern))
    short = wanted.where(F.length("pattern_") < q)
    return found.union(substring_join(df.where(F.col(key).isNotNull()), key, text, short, "pattern_")).distinct()


def seeded_join(df, key, text, patterns, pattern, q=None):
    """The same pairs without Python: join on the first q characters of the pattern,
    which stand somewhere in every text that contains it, then verify each candidate.
    Only keys and seeds are exploded; the texts are joined back once. Meant for
    patterns of some length: q is at most that of the shortest."""
    wanted = patterns.select(pattern).where(F.length(pattern) > 0).distinct()
    if q is None:
        q = max(1, min(8, wanted.agg(F.min(F.length(pattern))).first()[0] or 1))
    keyed = df.select(key, F.explode(qgrams(F.col(text), q)).alias("seed_"))
    sought = wanted.withColumn("seed_", F.substring(pattern, 1, q))
    pairs = keyed.join(sought, "seed_").select(key, pattern).distinct()
    found = pairs.join(df.select(key, text), key).where(F.contains(F.col(text), F.col(pattern)))
    return found.select(key, pattern).distinct()


def variant_match(passages, key, text, variants, variant, rank, limit=8, index=None):
    """First ``limit`` passages by the rank of the first variant they contain.
    The answer equals the original walk over the variants, which stops after
    twice the limit: later variants only add rows of a higher rank. ``index`` is
    the path of a gram_index of the passages, if there is one."""
    hits = (indexed_join(passages, key, text, variants, variant, index) if index
            else substring_join(passages, key, text, variants, variant))
    ranked = hits.join(variants.select(variant, rank), variant)
    best = ranked.groupBy(key).agg(F.min(rank).alias("rank"))
    return best.orderBy("rank", key).limit(max(limit, 1))


def term_postings(df, key, text):
    """term -> (document, frequency), lower-cased, not stemmed. All tokens of a
    document are in one task, so the partial count leaves one row per pair."""
    tokens = df.select(key, F.explode(P.SEARCH_TOKEN.all(F.lower(text))).alias("term"))
    return tokens.groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def term_search(postings, key, query, limit=None):
    """Documents with all query terms, most hits first."""
    terms = sorted(set(query.lower().split()))
    hits = (postings.where(F.col("term").isin(terms)).groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("hits"))
            .where(F.col("n_terms") == len(terms)).drop("n_terms"))
    ranked = hits.orderBy(F.desc("hits"), key)
    return ranked if limit is None else ranked.limit(limit)


def combined_search(verses, passages, term, verse_key, passage_key, limit=50):
    """Hits in lines and in passages, each first ``limit``, with their type.
    Both inputs bring author, work, section, ord, text."""
    def hits(df, key, kind):
        found = ilike_search(df, "text", term, [key], limit)
        return found.select(F.concat(F.lit(kind + "-"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"),
                            "text", "author", "work", "section", "ord")
    return hits(verses, verse_key, "verse").unionByName(hits(passages, passage_key, "passage")) \
        .orderBy("author", "work", "ord", "id")


def smart_search(queries, key, query, verses, translation="schoeningh", limit=10):
    """Batch form of the search box. A query that reads as a reference gives its
    verses or its chapter; any query gives the books it names; other queries
    give the first ``limit`` verses that contain them."""
    asked = queries.select(key, F.col(query).alias("q")).where(F.length("q") >= 2)
    # queries and verses are worked out once for all branches
    parsed = staged(asked.withColumn("r", R.parse_query_ref(F.col("q"))), "parsed")
    asked = parsed.drop("r")
    one = staged(verses.where(F.col("translation") == translation), "verses")
    refs = parsed.where(F.col("r").isNotNull()).select(key, "r", F.col("r.book").alias("named"))
    # many queries name the same book: look each name up once
    looked_up = refs.select("named").distinct().select("named", F.explode(J.book_lookup(F.col("named"))).alias("display"))
    looked_up = staged(looked_up, "books")
    rows = refs.join(looked_up, "named")
    chapters = rows.where(F.col("r.start").isNull()).select(
        key, F.lit("chapter").alias("type"), F.concat("display", F.lit(" "), F.col("r.chapter").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("subtitle"))
    ranges = rows.where(F.col("r.start").isNotNull()).select(
        key, "display", F.col("r.chapter").alias("chapter"), F.col("r.start").alias("start"), F.col("r.end").alias("end"))
    def shown(df):
        return df.select(key, F.lit("verse").alias("type"), F.concat(
            "display", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("verse").cast("string")).alias("title"),
            T.snippet(F.col("text"), 80).alias("subtitle"))
    verse_hits = shown(R.resolve_refs(ranges, one, [key]))
    names = F.array(*[F.struct(F.lit(b[2]).alias("t"), F.lit(b[2].lower()).alias("low")) for b in dims.books()])
    named = T.let(F.lower("q"), lambda q: F.transform(F.filter(names, lambda b: F.contains(b["low"], q)), lambda b: b["t"]))
    books = asked.select(key, F.explode(named).alias("title")) \
        .select(key, F.lit("book").alias("type"), "title", F.lit(None).cast("string").alias("subtitle"))
    free = parsed.where(F.col("r").isNull()).select(key, F.lower("q").alias("needle"))
    # rank once per distinct needle and verse text, then give the hits to the queries
    texts = one.select(F.lower("text").alias("low_")).distinct().withColumn("low_key_", F.col("low_"))
    found = substring_join(texts, "low_key_", "low_", free.select("needle").distinct(), "needle")
    hits = one.withColumn("low_key_", F.lower("text")).join(found, "low_key_")
    first = staged(top_per_key(hits, ["needle"], limit, "book", "chapter", "verse"), "first").join(free, "needle")
    first = R.display_books(first, "book", "translation").withColumn("display", F.col("book_display"))
    return chapters.unionByName(verse_hits).unionByName(books).unionByName(shown(first))


def fuzzy_name(names, name, threshold=0.65):
    """Closest other name of each distinct name, if similar enough.

    Similarity is 1 - edits / greater length, so a pair whose longer name has n characters may differ by
    t = floor((1 - threshold) n) edits. The shorter name is cut into t + 1 segments, one of which the
    edits leave whole; the longer one has it at most so many places away as edits can shift it. The join is
    on both lengths, the number of the segment and its characters, and every candidate is measured.
    """
    word = staged(names.select(F.col(name).alias("a")).where(F.length("a") > 0).distinct(), "names")
    share = 1 - threshold + 1e-9
    edits = F.floor(F.lit(share) * F.col("long_")).cast("int")
    lengths = staged(word.select(F.length("a").alias("n_")).distinct(), "lengths")
    both = lengths.select(F.col("n_").alias("short_")).join(
        lengths.select(F.col("n_").alias("long_")), (F.col("long_") >= F.col("short_")) & (F.col("long_") - F.col("short_") <= edits))
    both = both.withColumn("t_", edits)
    # segment i of t + 1 begins at floor(i n / (t + 1))
    cut = both.withColumn("i_", F.explode(F.sequence(F.lit(0), F.col("t_"))))
    start = F.floor(F.col("i_") * F.col("short_") / (F.col("t_") + 1)).cast("int")
    stop = F.floor((F.col("i_") + 1) * F.col("short_") / (F.col("t_") + 1)).cast("int")
    cut = staged(cut.withColumns({"start_": start, "size_": stop - start}), "segments")
    keys = ["short_", "long_", "i_", "segment_"]
    left = word.withColumn("short_", F.length("a")).join(F.broadcast(cut), "short_").select(
        "a", "short_", "long_", "i_", F.substring("a", F.col("start_") + 1, F.col("size_")).alias("segment_"))
    # before the segment at most i edits shift it, behind it at most t - i do
    gap = F.col("long_") - F.col("short_")
    low = F.greatest(F.lit(0), F.col("start_") - F.col("i_"), F.col("start_") + gap - (F.col("t_") - F.col("i_")))
    high = F.least(F.col("long_") - F.col("size_"), F.col("start_") + F.col("i_"), F.col("start_") + gap + F.col("t_") - F.col("i_"))
    places = cut.withColumns({"low_": low, "high_": high}).where("low_ <= high_")
    right = word.select(F.col("a").alias("b"), F.length("a").alias("long_")).join(F.broadcast(places), "long_").select(
        "b", "short_", "long_", "i_", F.explode(F.array_distinct(F.transform(F.sequence("low_", "high_"), lambda p: F.substring(
            F.col("b"), p + 1, F.col("size_"))))).alias("segment_"))
    pairs = left.join(right, keys).where(F.col("a") != F.col("b")).select("a", "b").distinct()
    scored = pairs.withColumn("score", G.similarity(F.col("a"), F.col("b"))).where(F.col("score") >= threshold)
    both_ways = scored.union(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    best = both_ways.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("closest"), F.max("score").alias("score"))
    return best.select(F.col("a").alias(name), "closest", F.round("score", 6).alias("score"))
