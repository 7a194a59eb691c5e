"""Row predicates (FLT1-FLT14). Null input is false throughout."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from versarium import patterns as P
from versarium.functions.classify import contains_any
from versarium.functions.text import blank_null, let, trim_space, word_count, words


def valid_text(c, min_chars=50, min_words=15):
    """Substantial running text: long enough, not digits, not a label line,
    not a list of short tokens."""
    def check(m):
        t, pieces = m["t"], m["w"]
        n_words = F.size(pieces)
        n_short = F.size(F.filter(pieces, lambda w: F.length(w) <= 3))
        n_digits = F.regexp_count(t, F.lit(r"\p{Nd}"))
        shouting = (n_words < 20) & (F.upper(t) == t) & (F.lower(t) != t)
        return ((F.length(t) >= min_chars) & (n_words >= min_words) & P.HAS_WORD.found(t) & ~shouting
                & ~P.METADATA_START.found(t) & (n_digits <= 0.3 * F.length(t)) & (n_short <= 0.7 * n_words))
    trimmed = trim_space(blank_null(c))
    return let(let(trimmed, lambda t: F.struct(t.alias("t"), words(t).alias("w"))), check)


def min_words(c, n=15):
    return word_count(c) >= n


def substantive(c, min_chars=50):
    return F.length(trim_space(blank_null(c))) > min_chars


def unwanted_content(c):
    return P.UNWANTED.found(F.lower(blank_null(c)))


def unwanted_words(c):
    return contains_any(F.lower(blank_null(c)), P.UNWANTED_WORDS)


def contains_text(c, needle):
    return F.coalesce(F.contains(c, F.lit(needle)), F.lit(False))


def ci_contains_any(columns, term):
    """Any column contains the term, ignoring case; an empty term keeps all."""
    if not term.strip():
        return F.lit(True)
    hits = [F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns]
    return reduce(or_, hits)


def like_escaped(term):
    """A term as literal text inside a LIKE pattern."""
    return "%" + "".join("\\" + ch if ch in "%_\\" else ch for ch in term) + "%"


def ilike_term(c, term):
    return F.coalesce(F.ilike(c, F.lit(like_escaped(term))), F.lit(False))


def multi_pattern_or(c, terms):
    """OR of substring tests; ``%`` and ``_`` of the input become blanks."""
    blanked = [t.replace("%", " ").replace("_", " ") for t in terms]
    return reduce(or_, [ilike_term(c, t) for t in blanked])


def point_range(book, chapter, verse, wanted, chapter_no, start, end=None):
    hit = (book == wanted) & (chapter == chapter_no) & (verse >= start)
    return hit if end is None else hit & (verse <= end)


def ordinary_category(c, special=("alle", "rosenkranz")):
    """Not one of the catch-all names."""
    return ~F.coalesce(F.lower(c).isin(list(special)), F.lit(False))


def nonempty_ref(c):
    return trim_space(blank_null(c)) != ""


def error_page(c):
    return F.contains(blank_null(c), F.lit(P.ERROR_PAGE))


def number_rest(c, min_rest=30):
    """Leading number and rest of a numbered line, if the rest is long enough."""
    rest = P.LEADING_NUMBER.group(c, 2)
    return F.when(F.length(rest) > min_rest, F.struct(
        P.LEADING_NUMBER.group(c, 1).alias("verse"), rest.alias("text")))
