"""Scripture references (REF1-REF6, JN4-JN6, JN16): find, parse, resolve."""

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versarium import dims
from versarium.functions import classify as C
from versarium.functions import text as T
from versarium.operators.ordered import first_per_key
from versarium.session import staged


def _token_pattern():
    """All book tokens, ordinals as ``1``, ``1.`` or ``1. `` before the name."""
    plain, ordinal = set(), {}
    for alias in dims.book_aliases():
        head = re.match(r"([123])[. ]*(.+)", alias)
        if head:
            ordinal.setdefault(head[2], set()).add(head[1])
        else:
            plain.add(alias)
    forms = [(len(name), re.escape(name).replace(r"\ ", r"\s+")) for name in plain]
    forms += [(len(name) + 1, f"[{''.join(sorted(nums))}]\\.?\\s*{name}") for name, nums in ordinal.items()]
    return "|".join(form for _, form in sorted(forms, key=lambda f: (-f[0], f[1])))


TOKEN = _token_pattern()
NUMBERS = r"\s*([0-9]{1,3})\s*[,.:]\s*([0-9]{1,3})(?:\s*[–-]\s*([0-9]{1,3}))?"
# A token does not start inside a word or number. Tokens are matched as they
# are written: a lower-case one would name no book and drop out later.
CITATION = r"(?<![\p{L}\p{N}])(?=[1-3A-ZÖvV])(?:(?i:vgl\.)\s*)?(?:" + TOKEN + ")" + NUMBERS
CUT = "\ue001"
LABEL = r"^(?:(?i:vgl\.)\s*)?(.+?)" + NUMBERS + "$"


def alias_df(spark):
    """Normalised token -> display name (REF6)."""
    rows = {}
    for alias, display in dims.book_aliases().items():
        key = dims.plain(re.sub(r"[.\s]", "", alias))
        if rows.setdefault(key, display) != display:
            raise ValueError(f"token {key} names two books")
    return dims.constant(spark, sorted(rows.items()), "token string, display string")


def find_refs(df, keys, text):
    """Every citation in free text with its offset and label."""
    # one pass of the pattern fences every label; after the split, labels stand
    # at the odd places and the lengths before them add up to their offset
    fenced = F.regexp_replace(F.translate(F.col(text), CUT, " "), "(" + CITATION + ")", CUT + "$1" + CUT)
    parts = df.select(*keys, fenced.alias("f_")).where(F.contains("f_", F.lit(CUT)))
    hit = "struct<at:int,label:string>"
    start = F.struct(F.array().cast(f"array<{hit}>").alias("hits"), F.lit(0).alias("end"), F.lit(False).alias("odd"))
    placed = F.aggregate(F.split("f_", CUT), start, lambda acc, x: F.struct(
        F.when(acc["odd"], F.concat(acc["hits"], F.array(F.struct(acc["end"].alias("at"), x.alias("label")))))
        .otherwise(acc["hits"]).alias("hits"), (acc["end"] + F.length(x)).alias("end"), (~acc["odd"]).alias("odd")),
        lambda acc: acc["hits"])
    rows = parts.select(*keys, F.inline(placed))
    def group(i):
        return F.regexp_extract("label", LABEL, i)
    rows = rows.withColumns({
        "token": T.ref_norm(group(1)), "chapter": group(2).cast("int"), "start": group(3).cast("int"),
        "end": F.coalesce(T.nonempty(group(4)).cast("int"), group(3).cast("int"))})
    named = rows.join(F.broadcast(alias_df(df.sparkSession)), "token")
    return named.select(*keys, "at", F.length("label").alias("length"), "label", "display", "chapter",
                        "start", "end")


def _clean_lectionary(c):
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)^vgl\.\s*", ""),
                                r"(?i)^(Lesung aus|Evangelium nach|Psalm)\s+", ""))
    c = F.translate(c, "–—−", "---")
    c = F.regexp_replace(c, r"\s*\(R:[^)]*\)", "")
    c = F.regexp_replace(c, r"^(Ps\s+\d+)\s*\([^)]*\)", "$1")
    return F.regexp_replace(c, r"\su\.\s*", ".")


def parse_lectionary_ref(df, keys, ref, compat=False):
    """Verse ranges of a lectionary reference; ``end`` is null for an open one.

    compat=True keeps the original reading of verse lists: only ``.`` separates
    and ``12f`` is 12; of a range over chapters only the first chapter's rest and
    the last verse count. By default ``,`` separates too, ``f`` adds a verse, and
    a range over chapters has all of its verses.
    """
    parts = F.transform(F.split(_clean_lectionary(F.col(ref)), ";"), lambda p: F.trim(p))
    full, more = r"^(.+?)\s+(\d+)[,:]\s*(.+)$", r"^(\d+)[,:]\s*(.+)$"

    def read(p):
        named = F.rlike(p, F.lit(full))
        def pick(i, j):
            return F.when(named, F.regexp_extract(p, full, i)).otherwise(F.regexp_extract(p, more, j))
        book = F.when(named, F.trim(F.regexp_replace(F.regexp_extract(p, full, 1), r"\.$", "")))
        return F.struct(book.alias("book"), pick(2, 1).alias("chapter"), pick(3, 2).alias("verses"))

    read_parts = F.filter(F.transform(parts, read), lambda r: r["chapter"] != "")
    rows = df.select(*keys, F.explode(F.array(read_parts)).alias("r_"))
    # the book of a part is the last one named up to it
    carried = F.transform(F.col("r_"), lambda r, i: F.struct(
        F.element_at(F.filter(F.slice(F.col("r_.book"), 1, i + 1), lambda b: b.isNotNull()), -1).alias("book"),
        r["chapter"].alias("chapter"), r["verses"].alias("verses")))
    # a reference whose first part names no book has none to carry
    carried = F.when(F.size(F.filter(F.col("r_.book"), lambda b: b.isNotNull())) > 0, carried)
    rows = rows.select(*keys, F.posexplode(carried).alias("part", "p")).select(*keys, "part", "p.*")

    cross = r"^(\d+)\s+-\s+(\d+)\s*,\s*(\d+)$"
    crossing = F.rlike("verses", F.lit(cross))
    def piece(chapter, verses):
        return F.struct(chapter.cast("int").alias("chapter"), verses.alias("verses"))
    begun, ended = F.col("chapter").cast("int"), C.to_int(T.nonempty(F.regexp_extract("verses", cross, 2)))
    last = F.regexp_extract("verses", cross, 3)
    # the chapters in between are whole, and the last one begins with its first verse
    between = F.when(ended - begun > 1, F.transform(
        F.sequence(begun + 1, F.greatest(ended - 1, begun + 1)), lambda c: piece(c, F.lit("1-"))))
    none = F.filter(F.array(piece(begun, F.lit(""))), lambda p: F.lit(False))
    pieces = F.when(crossing, F.concat(
        F.array(piece(F.col("chapter"), F.concat(F.regexp_extract("verses", cross, 1), F.lit("-")))),
        none if compat else F.coalesce(between, none),
        F.array(piece(ended, last if compat else F.concat(F.lit("1-"), last))))
    ).otherwise(F.array(piece(F.col("chapter"), F.col("verses"))))
    rows = rows.select(*keys, "part", "book", F.posexplode(pieces).alias("piece", "q"))

    tidy = F.regexp_replace("q.verses", r"\s*-\s*", "-")
    items = F.split(tidy, r"\." if compat else r"[.,]")
    rows = rows.select(*keys, "part", "piece", "book", F.col("q.chapter").alias("chapter"),
                       F.posexplode(items).alias("item", "v"))
    follow = F.lit(0) if compat else F.rlike("v", F.lit(r"\df\b")).cast("int")
    bare = F.trim(F.regexp_replace("v", "[a-zA-Z]", ""))
    left = C.to_int(T.nonempty(F.trim(F.substring_index(bare, "-", 1))))
    right = C.to_int(T.nonempty(F.trim(F.substring_index(bare, "-", -1))))
    rows = rows.withColumns({"start": left, "follow_": follow,
                             "end": F.when(F.contains(bare, F.lit("-")), right).otherwise(left)})
    rows = rows.where(F.col("start") > 0).withColumn("end", F.col("end") + F.col("follow_"))
    named = rows.withColumn("token", T.ref_norm(F.col("book"))).join(
        F.broadcast(alias_df(df.sparkSession)), "token")
    return named.select(*keys, "part", "piece", "item", "display", "chapter", "start", "end")


def parse_query_ref(c):
    """``Book c:v(-v)`` or ``Book c``; null when the query is no reference."""
    q = F.trim(c)
    full, short = r"(?i)^(.+?)\s+(\d+):(\d+)(?:-(\d+))?$", r"(?i)^(.+?)\s+(\d+)$"
    def num(rx, i):
        return C.to_int(T.nonempty(F.regexp_extract(q, rx, i)))
    verse = F.struct(F.trim(F.regexp_extract(q, full, 1)).alias("book"), num(full, 2).alias("chapter"),
                     num(full, 3).alias("start"), F.coalesce(num(full, 4), num(full, 3)).alias("end"))
    none = F.lit(None).cast("int")
    chapter = F.struct(F.trim(F.regexp_extract(q, short, 1)).alias("book"), num(short, 2).alias("chapter"),
                       none.alias("start"), none.alias("end"))
    return F.when(F.rlike(q, F.lit(full)), verse).when(F.rlike(q, F.lit(short)), chapter)


def abbrev_variants(book, chapter, verse):
    """Search strings for a verse, in order of trust, without repeats."""
    ch, v = chapter.cast("string"), verse.cast("string")
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n.lower()).alias("n")) for a, n in dims.SEARCH_NAMES])
    low = F.lower(book)
    hits = T.let(low, lambda t: F.filter(table, lambda e: F.contains(e["n"], t)))
    def forms(name):
        return F.array(F.concat(name, F.lit(" "), ch, F.lit(":"), v), F.concat(name, F.lit(" "), ch, F.lit(" "), v))
    bare = F.array(F.concat(ch, F.lit(":"), v), F.concat(ch, F.lit(" "), v))
    own = low
    for umlaut, base in dims.UMLAUTS[:3]:
        own = F.replace(own, F.lit(umlaut), F.lit(base))
    short = F.when(F.length(own) <= 4, forms(own)).otherwise(F.array().cast("array<string>"))
    named = F.flatten(F.transform(hits, lambda e: forms(e["a"])))
    # bare numbers fit any book, so they come last
    return F.array_distinct(F.concat(named, short, F.when(F.size(hits) > 0, bare)
                                     .otherwise(F.array().cast("array<string>"))))


def map_books(df, display, translation=None):
    """Display name -> table name of a translation; unmapped books drop out."""
    names = dims.book_names_df(df.sparkSession).withColumnRenamed("display", "display_")
    if translation is not None:
        names = names.where(F.col("translation") == translation)
    return df.join(F.broadcast(names), F.col(display) == F.col("display_")).drop("display_")


def display_books(df, db_name, translation):
    """Table name -> display name; unknown names stay as they are."""
    names = dims.book_names_df(df.sparkSession).select(
        F.col("display").alias("display_"), F.col("translation").alias("tr_"), F.col("db_name").alias("db_"))
    same = (F.col(db_name) == F.col("db_")) & (F.col(translation) == F.col("tr_"))
    return (df.join(F.broadcast(names), same, "left")
            .withColumn("book_display", F.coalesce("display_", F.col(db_name))).drop("display_", "tr_", "db_"))


def _merged(refs, keys):
    """The ranges of one key, book and chapter side by side in one row, without repeats."""
    return refs.where(F.col("start").isNotNull()).groupBy(*keys, "display", "chapter").agg(
        F.collect_set(F.struct("start", "end")).alias("ranges_"))


def _numbers():
    """The numbers from lo_ to hi_ in any of ranges_, each once; an open range reaches to hi_."""
    def inside(r):
        low, high = F.greatest(r["start"], F.col("lo_")), F.least(F.coalesce(r["end"], F.col("hi_")), F.col("hi_"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform("ranges_", inside)))


def _chapters(verses):
    """One row per display name and chapter: its translations, each with its verses as an array by number.

    Written once, so that Spark knows its size: a small table is sent to the references, which then stay where they are.
    """
    number = F.col("verse").cast("int")
    chapters = verses.where(number.isNotNull()).groupBy("translation", "book", "chapter").agg(
        F.min(number).alias("lo_"), F.max(number).alias("hi_"),
        F.array_sort(F.collect_list(F.struct(number.alias("verse"), "text"))).alias("sorted_"))
    by_number = F.transform(F.sequence("lo_", "hi_"), lambda n: F.get(F.filter("sorted_", lambda v: v["verse"] == n), F.lit(0)))
    names = dims.book_names_df(verses.sparkSession).select("translation", F.col("db_name").alias("book"), "display")
    named = chapters.join(F.broadcast(names), ["translation", "book"])
    return staged(named.groupBy("display", "chapter").agg(
        F.collect_list(F.struct("translation", "lo_", "hi_", by_number.alias("verses_"))).alias("books_")), "chapters")


def _resolved(refs, chapters, keys):
    hits = _merged(refs, keys).join(chapters, ["display", "chapter"]).select(
        *keys, "display", "chapter", "ranges_", F.inline("books_"))
    found = F.filter(F.transform(_numbers(), lambda n: F.get("verses_", n - F.col("lo_"))), lambda v: v.isNotNull())
    return hits.select(*keys, "display", "translation", "chapter", F.explode(found).alias("v_")).select(
        *keys, "display", "translation", "chapter", "v_.verse", "v_.text")


def resolve_refs(refs, verses, keys):
    """Verses of each reference range, once per verse; ``verses`` has one row per
    translation, book, chapter and verse.

    A chapter is one row with its verses as an array by number, so the join is an equality and a range
    is read by place. Overlapping ranges of a key are merged as numbers in their row, before any text comes in."""
    return _resolved(refs, _chapters(verses), keys)


def psalm_fallback(refs, verses, keys, min_verse=16, by_item=True):
    """References that find nothing in the old psalm numbering are looked up in
    the psalm before, from verse 16 on.

    Whether a reference finds something is told by verse numbers, before any text comes in. A verse
    comes once per part and item of a key, or with ``by_item=False`` once per key: what is found in the psalm
    before has no number that a reference of the key finds in the psalm itself."""
    ids = [*keys, "part", "item"]
    chapters = _chapters(verses)
    old = ((F.col("display") == "Psalmen")
           & ((F.col("start") >= min_verse) | (F.col("end") >= min_verse)))
    def holds(book):
        inside = F.exists(book["verses_"], lambda v: v.isNotNull() & (v["verse"] >= F.col("start"))
                          & (v["verse"] <= F.coalesce("end", v["verse"])))
        return (book["translation"] == "allioli") & inside
    direct = F.when(F.exists("books_", holds), 1)
    known = refs.join(chapters, ["display", "chapter"], "left").select(*[F.col(c) for c in refs.columns], direct.alias("direct_"))
    known = known.withColumn("found_", F.max("direct_").over(W.partitionBy(*ids)))
    shifts = F.when(old & F.col("found_").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    asked = known.withColumn("shift_", F.explode(shifts)).withColumn("chapter", F.col("chapter") - F.col("shift_"))
    hits = _resolved(asked, chapters, [*(ids if by_item else keys), "shift_"])
    kept = hits.where((F.col("shift_") == 0) | (F.col("translation") == "allioli"))
    return kept.withColumn("chapter", F.col("chapter") + F.col("shift_")).drop("shift_")


def parallel_translations(verses):
    """All translations of a verse side by side under the display name."""
    shown = display_books(verses, "book", "translation")
    return (shown.groupBy("book_display", "chapter", "verse")
            .pivot("translation", list(dims.TRANSLATIONS)).agg(F.min("text")))


def citation_graph(citations, verses, work):
    """Cited verse -> number of citing works and citations. ``at`` tells the
    citations of one work apart. Counting per work first leaves one row per work and verse."""
    # a verse counts once, whichever translations have it
    names = dims.book_names_df(verses.sparkSession).select("translation", F.col("db_name").alias("book"), "display")
    number = F.col("verse").cast("int")
    known = verses.select("translation", "book", "chapter", "verse").join(F.broadcast(names), ["translation", "book"]).groupBy(
        "display", "chapter").agg(F.min(number).alias("lo_"), F.max(number).alias("hi_"), F.collect_set(number).alias("known_"))
    hits = _merged(citations, [work, "at"]).join(known, ["display", "chapter"]).select(
        work, "display", "chapter", F.explode(F.array_intersect(_numbers(), "known_")).alias("verse"))
    per_work = hits.groupBy("display", "chapter", "verse", work).agg(F.count(F.lit(1)).alias("n"))
    return per_work.groupBy("display", "chapter", "verse").agg(
        F.count(F.lit(1)).alias("n_works"), F.sum("n").alias("n_citations"))


def fallback_latest(df, fallback, key, needed, *order):
    """Newest item per key; needed keys that are missing come from a second
    source (WIN3)."""
    main = first_per_key(df, [key], *order)
    rest = first_per_key(fallback.where(F.col(key).isin(list(needed))), [key], *order)
    return main.unionByName(rest.join(main.select(key), key, "left_anti"))
