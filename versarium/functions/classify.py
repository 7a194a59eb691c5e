"""Dates, math and classification as column functions (CLS1-CLS21)."""

from pyspark.sql import functions as F

from versarium import dims
from versarium import patterns as P
from versarium.functions.text import (blank_null, collapse_ws, fold_diacritics, let, nonempty,
                                      trim_space)


def to_int(c):
    return c.try_cast("int")


def parse_years(c):
    """Birth and death year of a life span."""
    return F.struct(to_int(nonempty(P.YEARS.group(c, 1))).alias("birth"),
                    to_int(nonempty(P.YEARS.group(c, 2))).alias("death"))


def timeframe(start, end):
    """``a - b``, one year, or null; 0 counts as missing."""
    return nonempty(F.concat_ws(" - ", F.nullif(start, F.lit(0)).cast("string"),
                                F.nullif(end, F.lit(0)).cast("string")))


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def german_date(c):
    """``01. Mai 2024``; text that is no date comes back unchanged."""
    day = F.try_to_date(c, "yyyy-MM-dd")
    shown = F.concat(F.date_format(day, "dd"), F.lit(". "), _pick(F.month(day), dims.MONTHS),
                     F.lit(" "), F.year(day).cast("string"))
    return F.coalesce(shown, c)


def weekday_label(ts):
    return _pick(F.dayofweek(ts), dims.WEEKDAYS)


def weekday_category(ts):
    return _pick(F.dayofweek(ts), dims.WEEKDAY_CATEGORY)


def day_title(ts):
    return F.concat(weekday_label(ts), F.lit(", "), F.dayofmonth(ts).cast("string"), F.lit(". "),
                    _pick(F.month(ts), dims.MONTHS))


def hour_band(ts):
    h = F.hour(ts)
    return (F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 17), "day")
            .when((h >= 17) & (h < 22), "evening").otherwise("night"))


def _first_stem(c, stems):
    """Value of the first stem, in list order, that the text contains."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in stems])
    return let(c, lambda t: F.get(F.filter(table, lambda s: F.contains(t, s["k"])), 0))["v"]


def author_by_substring(url, title):
    """First stem in the URL, else in the title, else the corpus number."""
    number = nonempty(F.regexp_extract(url, r"/([^/]*cp[gl]-[^/]*)", 1))
    return F.coalesce(_first_stem(F.lower(url), dims.AUTHOR_STEMS),
                      _first_stem(F.lower(title), dims.AUTHOR_STEMS),
                      F.concat(F.lit("Corpus_"), number), F.lit("Unbekannt"))


def contains_any(c, values):
    return let(c, lambda t: F.exists(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(t, v)))


def section_role(heading):
    def role_of(folded):
        out = None
        for role, keywords in P.SECTION_ROLES:
            hit = contains_any(folded, keywords)
            out = F.when(hit, role) if out is None else out.when(hit, role)
        return out.otherwise("main")
    return let(fold_diacritics(blank_null(heading)), role_of)


def looks_like_intro(c):
    return F.rlike(F.substring(fold_diacritics(blank_null(c)), 1, 80),
                   F.lit("^(" + "|".join(P.INTRO_PREFIXES) + ")"))


def segment_type(tag, text, cls):
    """Kind of one page element; the first rule that fits."""
    heading = F.rlike(tag, F.lit("^h[1-6]$"))
    return (F.when(contains_any(F.lower(text), P.INTRO_WORDS), "introduction")
            .when(heading & P.BOOK_HEADING.found(text), "book")
            .when(heading & P.CHAPTER_HEADING.found(text), "chapter")
            .when(heading, "heading")
            .when(P.VERSE_START.found(text), "verse")
            .when(P.NUMBER_START.found(text), "paragraph")
            .when(F.contains(F.lower(blank_null(cls)), F.lit("note")), "footnote")
            .otherwise("paragraph"))


def section_number(kind, text):
    """Number as written; a roman one stays text."""
    return (F.when(kind == "book", nonempty(P.BOOK_NUMBER.group(text, 0)))
            .when(kind == "chapter", nonempty(P.FIRST_NUMBER.group(text, 0)))
            .when(kind == "verse", nonempty(P.VERSE_START.group(text, 1)))
            .when(kind == "paragraph", nonempty(P.NUMBER_START.group(text, 1))))


def section_start(c):
    return P.SECTION_START.found(c)


def chapter_header(c):
    """Chapter number of a header line, else null. Every header has a digit, so other lines are looked through once."""
    return let(trim_space(c), lambda t: F.when(P.DIGIT.found(t), F.coalesce(*[nonempty(rx.group(t, 1)) for rx in P.CHAPTER_HEADER])))


def _distinct(rx, c):
    return F.size(F.array_distinct(rx.all(c, 0)))


def structure_profile(text, html):
    """Counts of structure marks and the content type drawn from them."""
    book, chapter, verse = (_distinct(P.STRUCTURE[k], text) for k in ("book", "chapter", "verse"))
    paragraphs = F.regexp_count(html, F.lit(P.PARAGRAPH_TAG.java))
    return {
        "book_count": book, "chapter_count": chapter, "verse_count": verse,
        "footnote_count": F.regexp_count(html, F.lit(P.STRUCTURE["footnote"].java)),
        "paragraph_count": paragraphs,
        "has_introduction": P.STRUCTURE["intro"].found(text),
        "hierarchy_levels": F.when(verse > 0, 3).when(chapter > 0, 2).when(book > 0, 1)
                             .otherwise(0),
        "content_type": (F.when((book > 0) & (chapter > 0), "multi_book_work")
                         .when(chapter > 0, "chaptered_work").when(verse > 0, "versed_work")
                         .when(paragraphs > 0, "paragraph_work").otherwise("simple_text")),
    }


def detect_hour(title, categories):
    """Canonical hour: a keyword in the title or equal to a category."""
    low = F.lower(blank_null(title))
    cats = F.transform(F.coalesce(categories, F.array().cast("array<string>")), F.lower)
    out = None
    for key, keywords in dims.HOUR_KEYWORDS:
        named = F.array(*[F.lit(k) for k in keywords])
        hit = contains_any(low, keywords) | F.arrays_overlap(cats, named)
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out


def detect_language(c):
    return F.when(contains_any(c, P.LATIN_WORDS), "Latin").otherwise("English")


def is_german(c):
    return contains_any(F.lower(c), P.GERMAN_PAGE)


def is_german_link(c):
    return contains_any(F.lower(c), P.GERMAN_LINK)


def success_rate(good, total):
    return F.coalesce(F.round(100 * good / F.nullif(total, F.lit(0)), 1), F.lit(0.0))


def author_description(original, lifespan):
    joined = F.concat_ws(" · ", nonempty(original), nonempty(lifespan))
    return F.coalesce(nonempty(joined), F.lit(dims.DEFAULT_DESCRIPTION))


def heading_label(heading, index):
    """``n. heading`` unless it starts with a digit; index counts from 1."""
    clean = trim_space(blank_null(heading))
    return (F.when(clean == "", F.concat(F.lit("Abschnitt "), index.cast("string")))
            .when(F.rlike(clean, F.lit("^[0-9]")), clean)
            .otherwise(F.concat(index.cast("string"), F.lit(". "), clean)))


def reading_seconds(c, rate=22, low=12, high=180):
    seconds = F.ceil(F.length(collapse_ws(blank_null(c))) / F.lit(rate)).cast("int")
    return F.greatest(F.lit(low), F.least(F.lit(high), seconds))


def clamp(c, low=1, high=15):
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def positive_int(c):
    n = to_int(c)
    return F.when(n > 0, n)
