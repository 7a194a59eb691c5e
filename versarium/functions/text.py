"""Text normalisation as column functions (TXT1-TXT37). JVM-side throughout;
only normalize_unicode is an Arrow UDF."""

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import functions as F

from versarium import dims
from versarium import patterns as P
from versarium.rx import chain


def blank_null(c):
    return F.coalesce(c, F.lit(""))


def let(c, body):
    """body(value) with the value computed once. A column used twice in an
    expression is otherwise computed twice where Spark does not share it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def trim_space(c):
    """Trim every Unicode space, not only U+0020. What is left is taken from the
    text, which is faster than a search for spaces that end it."""
    return P.UP_TO_SPACE.group(c)


def nonempty(c):
    """'' counts as missing in coalesce chains."""
    return F.nullif(c, F.lit(""))


def strip_tags(c):
    return P.TAGS.sub(c)


def decode_entities(c):
    """Basic entities; ``&amp;`` last, so ``&amp;lt;`` decodes once."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                         ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def br_to_newline(c):
    c = strip_tags(P.BREAKS.sub(c))
    return trim_space(F.replace(c, F.lit("&nbsp;"), F.lit(" ")))


def collapse_ws(c):
    return F.trim(P.SPACES.sub(c))


def clean_markup(c):
    """Tags out, entities decoded, space collapsed."""
    return collapse_ws(decode_entities(strip_tags(c)))


def strip_footnote_refs(c):
    return chain(c, P.FOOTNOTE_REFS)


def strip_page_numbers(c):
    return chain(c, P.PAGE_NUMBERS)


def where_found(c, needed, rules):
    """Apply rules that change no text without ``needed``: a literal, one of several, or a pattern."""
    def found(t):
        if isinstance(needed, tuple):
            return reduce(or_, [F.contains(t, F.lit(x)) for x in needed])
        return F.contains(t, F.lit(needed)) if isinstance(needed, str) else needed.found(t)
    return let(c, lambda t: F.when(found(t), chain(t, rules)).otherwise(t))


def where_edge(c, edge, allowed, rules):
    """Apply rules that change no text whose first (1) or last (-1) character is not of the class ``allowed``."""
    at = (lambda t: F.left(t, F.lit(1))) if edge == 1 else (lambda t: F.right(t, F.lit(1)))
    return let(c, lambda t: F.when(allowed.found(at(t)), chain(t, rules)).otherwise(t))


def strip_biblio_refs(c):
    rules, needs = P.BIBLIO_REFS, P.BIBLIO_NEEDS
    for i in (*range(6), slice(6, 8), *range(8, 13)):
        some = rules[i] if isinstance(i, slice) else [rules[i]]
        c = where_found(c, needs[i][0] if isinstance(i, slice) else needs[i], some)

    def numbered(t):
        for need, rule in zip(needs[13:], rules[13:]):
            t = where_found(t, need, [rule])
        return t
    return let(c, lambda t: F.when(P.DIGIT.found(t), numbered(t)).otherwise(t))


def _keep_lines(c, keep):
    return F.array_join(F.filter(F.split(c, "\n", -1), keep), "\n")


def strip_metadata_lines(c, variant="formatter"):
    rx = P.METADATA_LINES[variant]
    return _keep_lines(c, lambda line: ~rx.found(line))


def strip_nav_lines(c, variant="base", min_length=10):
    """Trim lines; drop empty, boilerplate and short ones."""
    rx = P.NAV_LINES[variant]
    lines = F.transform(F.split(c, "\n", -1), trim_space)
    kept = F.filter(lines, lambda x: (F.length(x) > min_length) & ~rx.found(x))
    return F.array_join(kept, "\n")


def keep_substantive_lines(c, min_length=20, drop_caps=True):
    def keep(line):
        bare = trim_space(line)
        good = (F.length(bare) > min_length) & ~P.ALL_DIGITS.found(bare)
        return good & ~P.CAPS_ONLY.found(bare) if drop_caps else good
    return trim_space(_keep_lines(c, keep))


def drop_repeated_line(c):
    """A line equal to the line before it is dropped."""
    lines = F.split(c, "\n", -1)
    kept = F.filter(lines, lambda x, i: (i == 0) | (F.get(lines, i - 1) != x))
    return F.array_join(kept, "\n")


def words(c):
    """Python ``split()``: pieces between runs of Unicode space."""
    return F.filter(F.split(P.SPACES.sub(c), " "), lambda x: x != "")


def word_count(c):
    return F.size(words(blank_null(c)))


def drop_name_lists(c, variant="titles"):
    """Lines of names and offices out of texts that carry such lists."""
    if variant == "titles":
        def keep(line):
            titled = P.NAME_TITLES.found(line) & P.AT_MOST_THREE_WORDS.found(line)
            return ~(titled | P.TWO_NAMES_LINE.found(line))
        return let(c, lambda t: F.when(P.PRIEST_OR_DEACON.found(t), _keep_lines(t, keep)).otherwise(t))

    def short(line):
        return ~(P.PRIEST_OR_DEACON.found(line) & (word_count(line) < 10))

    def named(t):
        return F.contains(t, F.lit("Priester")) & F.contains(t, F.lit("Diakon"))
    return let(c, lambda t: F.when(named(t), _keep_lines(t, short)).otherwise(t))


def trim_artifacts(c):
    return chain(c, P.TRIM_ARTIFACTS)


def strip_web_artifacts(c):
    return chain(c, P.WEB_ARTIFACTS)


def tidy_punctuation(c):
    return trim_space(chain(c, P.TIDY))


def charset_whitelist(c):
    return P.NOT_ALLOWED.sub(c)


def deep_clean(c):
    """The full corpus cleaning: trim artifacts, page numbers, footnote marks,
    numbering, web artifacts, references, name lists, punctuation, in this
    order. A rule runs only on texts that hold what it looks for."""
    c = where_edge(blank_null(c), -1, P.E_OR_SPACE, P.TRIM_ARTIFACTS[:1])
    for rule in P.TRIM_ARTIFACTS[1:3]:
        c = where_edge(c, -1, P.DIGIT_OR_SPACE, [rule])
    c = where_edge(c, 1, P.DIGIT, P.TRIM_ARTIFACTS[3:])
    c = where_found(c, "S.", P.PAGE_NUMBERS[:1])
    c = where_found(c, P.DIGIT, P.PAGE_NUMBERS[1:])
    c = where_found(c, "\u21a9", P.FOOTNOTE_REFS[:1])
    for needed, rule in zip("[(.", P.FOOTNOTE_REFS[1:] + P.NUMBERING):
        c = where_found(c, needed, [rule])
    c = where_found(c, "://", P.WEB_ARTIFACTS[:1])
    c = where_found(c, "www.", P.WEB_ARTIFACTS[1:2])
    c = where_found(c, P.DIGIT, P.WEB_ARTIFACTS[2:])
    c = drop_name_lists(strip_biblio_refs(c))
    for needed, rule in zip(("(", "[", P.TWO_COMMAS, P.TWO_STOPS), P.TIDY):
        c = where_found(c, needed, [rule])
    c = where_edge(P.SPACES.sub(c), 1, P.NO_START, P.TIDY[5:6])
    # the last rule of P.TIDY: what is left ends in one of the characters that it stops at
    return trim_space(P.UP_TO_WORD.group(c, 0))


def clean_segment(c):
    """Cleaning of one page element: tags, arrows, charset, references."""
    c = F.replace(strip_tags(blank_null(c)), F.lit("↩"), F.lit(""))
    return trim_space(chain(P.SPACES.sub(charset_whitelist(c)), P.PAGE_REFS))


def clean_work_text(c):
    """clean_segment plus the bibliographic references of printed works."""
    c = F.replace(strip_tags(blank_null(c)), F.lit("↩"), F.lit(""))
    return trim_space(chain(P.SPACES.sub(charset_whitelist(c)), P.WORK_REFS))


def normalize_unicode(c, form="NFKC"):
    """Exact Unicode normalisation. Spark has no built-in for it."""
    @F.pandas_udf("string")
    def to_form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))
    return to_form(c)


def _fold_tables():
    """From Unicode data: characters whose NFKD without marks is one other
    character, and the few Latin ones that become several."""
    single, several = {}, {}
    for code in list(range(0xA0, 0x600)) + list(range(0x1E00, 0x2000)) + list(range(0xFB00, 0xFB07)):
        char = chr(code)
        base = "".join(ch for ch in unicodedata.normalize("NFKD", char)
                       if not unicodedata.combining(ch))
        if base != char and len(base) == 1:
            single[char] = base
        elif base != char and len(base) > 1 and base.isalpha():
            several[char] = base
    return single, several


_SINGLE, _SEVERAL = _fold_tables()
_SEVERAL_CLASS = "[" + "".join(_SEVERAL) + "]"


def fold_diacritics(c, lower=True):
    """Diacritics off by table (Latin, Greek, Cyrillic), JVM-side."""
    c = F.translate(c, "".join(_SINGLE), "".join(_SINGLE.values()))
    c = F.regexp_replace(c, r"\p{Mn}", "")

    def spell(t):
        for char, base in _SEVERAL.items():
            t = F.replace(t, F.lit(char), F.lit(base))
        return t
    c = let(c, lambda t: F.when(F.rlike(t, F.lit(_SEVERAL_CLASS)), spell(t)).otherwise(t))
    return F.lower(c) if lower else c


# ---- fixed values: mis-decoded umlauts, longest key first ----------------------
MOJIBAKE = [("Ã¤", "ae"), ("Ã¶", "oe"), ("Ã¼", "ue"), ("Ã„", "Ae"), ("Ã–", "Oe"), ("Ãœ", "Ue"),
            ("÷", "oe"), ("õ", "oe")]


def fold_umlauts(c):
    for bad, good in MOJIBAKE + dims.UMLAUTS:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def strip_markers(c):
    return trim_space(chain(c, P.MARKERS))


def clean_verse(c):
    """Marker removal and spacing of one imported verse."""
    return trim_space(chain(strip_markers(c), P.VERSE_TIDY))


def replace_all_columns(df, char="#"):
    return df.select(*[
        F.replace(F.col(f"`{name}`"), F.lit(char), F.lit("")).alias(name)
        if dtype == "string" else F.col(f"`{name}`") for name, dtype in df.dtypes])


def normalize_quotes(c):
    return F.translate(c, "“”„–—−", '"""---')


def clean_title(c, drop_number=False):
    c = chain(c, P.TITLE_CLEAN)
    return trim_space(P.TITLE_TRAILING_NUMBER.sub(c) if drop_number else c)


def make_id(author, work, section, spaces_only=False):
    if spaces_only:
        return F.concat_ws("_", F.replace(author, F.lit(" "), F.lit("_")),
                           F.replace(work, F.lit(" "), F.lit("_")), section.cast("string"))
    return F.concat_ws("_", P.NON_ID.sub(author), F.substring(P.NON_ID.sub(work), 1, 30),
                       section.cast("string"))


def slugify(c):
    """Umlauts spelled out, other diacritics folded, the rest to ``-``."""
    c = F.lower(blank_null(c))
    for umlaut, base in dims.UMLAUTS:
        c = F.replace(c, F.lit(umlaut), F.lit(base))
    return chain(fold_diacritics(c, lower=False), P.NON_SLUG)


def safe_filename(c, limit=100):
    c = F.lower(F.replace(P.SPACES.sub(P.UNSAFE_FILE.sub(c)), F.lit(" "), F.lit("_")))
    return F.substring(c, 1, limit)


def name_from_filename(c):
    stem = trim_space(chain(c, P.FILE_STEM))
    return F.coalesce(F.try_element_at(dims.literal_map(dims.NAME_CORRECTIONS.items()), stem),
                      F.initcap(stem))


def describe_name(c):
    return F.coalesce(F.try_element_at(dims.literal_map(dims.NAME_DESCRIPTIONS.items()), c),
                      F.lit(dims.DEFAULT_DESCRIPTION))


def snippet(c, limit=80):
    return let(c, lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t))


def ref_norm(c):
    """Dots and spaces out, umlauts spelled: the key of book tokens."""
    c = F.regexp_replace(blank_null(c), r"[.\s]", "")
    for umlaut, base in dims.UMLAUTS:
        c = F.replace(c, F.lit(umlaut), F.lit(base))
    return c


def cache_key(book, translation, chapter, verse, default_translation="allioli"):
    def part(c):
        return F.lower(trim_space(blank_null(c)))
    def number(c):
        return F.coalesce(c, F.lit(0)).cast("string")
    named = F.coalesce(nonempty(translation), F.lit(default_translation))
    return F.concat_ws(":", part(book), part(named), number(chapter), number(verse))


def format_ref(name, chapter, verse):
    return F.concat(name, F.lit(" "), chapter.cast("string"), F.lit(","), verse.cast("string"))


def display_ref(c):
    """Display form of a psalm reference."""
    c = F.regexp_replace(c, r"\s*\(R:[^)]*\)", "")
    c = F.regexp_replace(c, r"^(Ps\s+\d+)\s*\([^)]*\)", "$1")
    c = F.translate(c, "–—−", "---")
    c = F.regexp_replace(c, r"\su\.\s*", ".")

    def cleaned(t):
        head = F.regexp_extract(t, r"^([^,]*,\s*)", 1)
        verses = F.regexp_extract(t, r"^[^,]*,\s*([^,]+)", 1)
        tail = F.substring(t, F.length(head) + F.length(verses) + 1, F.length(t))
        return F.when(F.contains(t, F.lit(",")), F.concat(head, F.regexp_replace(verses, "[a-zA-Z]", ""), tail)).otherwise(t)
    return F.trim(F.regexp_replace(let(c, cleaned), r"\.{2,}", "."))


def truncate_text(c, limit=6000):
    """Encoder input limit; the stored text stays whole."""
    return F.substring(c, 1, limit)


def strip_footnote_anchor(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)^\{?FN", ""), r"\}?$", ""))


def note_label(anchor, key):
    """``12.`` from the anchor, else from the last part of the key."""
    clean = nonempty(strip_footnote_anchor(blank_null(anchor)))
    last = nonempty(F.element_at(F.split(blank_null(key), ":"), -1))
    return F.concat(F.coalesce(clean, last), F.lit("."))


def rtf_to_text(c):
    return trim_space(chain(c, P.RTF_CODES))


def url_work_id(c):
    return F.coalesce(nonempty(P.WORK_ID_CPG.group(c, 0)), P.LAST_PATH_PART.group(c, 1))


def url_format(c):
    low = F.lower(c)
    out = F.when(F.contains(low, F.lit(".epub")), "epub")
    for kind in ("pdf", "docx", "rtf"):
        out = out.when(F.contains(low, F.lit("." + kind)), kind)
    return out.otherwise("unknown")


def is_image_file(c):
    return F.rlike(F.lower(c), F.lit(r"\.(jpg|jpeg|png|gif|webp|svg)$"))


def sentence_per_line(c):
    return trim_space(chain(c, P.SENTENCE_LINES))


def normalize_word(c):
    """The comparison form of one word."""
    return chain(fold_diacritics(F.lower(blank_null(c)), lower=False), P.WORD_FORM)


def dup_key(c, prefix=100):
    """Key of near-exact copies. ``prefix`` is part of the rule: texts with the
    same opening count as copies; prefix=None compares the whole text."""
    key = F.trim(chain(F.lower(blank_null(c)), P.DUP_NOISE_JAVA))
    return key if prefix is None else F.substring(key, 1, prefix)


def content_hash(c):
    return F.sha2(c, 256)


def vector_literal(c):
    shown = F.transform(c, lambda x: F.format_string("%.8f", x.cast("double")))
    return F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))
