"""Small SQL spellings shared by the oracle statements."""

from versarium import dims
from versarium import patterns as P
from versarium.rx import quote, sql_chain


def trim(x):
    return P.EDGE_SPACE.sql_sub(x)


def collapse(x):
    return f"trim({P.SPACES.sql_sub(x)})"


def words(x):
    return f"list_filter(string_split({P.SPACES.sql_sub(x)}, ' '), lambda w: w <> '')"


def n_words(x):
    return f"len({words(x)})::INTEGER"


def replaces(x, pairs):
    for old, new in pairs:
        x = f"replace({x}, {quote(old)}, {quote(new)})"
    return x


def umlauts(x):
    return replaces(x, dims.UMLAUTS)


def entities(x):
    return replaces(x, [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
                        ("&#39;", "'"), ("&amp;", "&")])


def lines(x, keep):
    """Lines of x for which keep(line) holds."""
    return (f"array_to_string(list_filter(string_split({x}, chr(10)), lambda ln: {keep('ln')}), "
            "chr(10))")


def name_lists(x):
    """The drop_name_lists rule in SQL."""
    def keep(ln):
        n = n_words(ln)
        return (f"NOT (({n} <= 3 AND {P.NAME_TITLES.sql_found(ln)}) OR "
                f"({n} = 2 AND {P.TWO_NAMES.sql_found(trim(ln))}))")
    return f"CASE WHEN {P.PRIEST_OR_DEACON.sql_found(x)} THEN {lines(x, keep)} ELSE {x} END"


def staged(source, steps):
    """Nested SELECTs that rewrite column t step by step, so that long rule
    chains stay flat. Every step maps the name t to an SQL expression."""
    sql = source
    for step in steps:
        sql = f"SELECT * REPLACE ({step('t')} AS t) FROM ({sql})"
    return sql


def deep_clean_steps():
    def rules(*groups):
        flat = [r for g in groups for r in g]
        return lambda t: sql_chain(t, flat)
    return [
        rules(P.TRIM_ARTIFACTS, P.PAGE_NUMBERS), rules(P.FOOTNOTE_REFS, P.NUMBERING),
        rules(P.WEB_ARTIFACTS), rules(P.BIBLIO_REFS), name_lists, rules(P.TIDY), trim,
    ]


def valid(t):
    """The valid_text rule over an already trimmed expression."""
    w = words(t)
    return (f"(length({t}) >= 50 AND len({w}) >= 15 AND {P.HAS_WORD.sql_found(t)} "
            f"AND NOT (upper({t}) = {t} AND lower({t}) <> {t} AND len({w}) < 20) "
            f"AND NOT {P.METADATA_START.sql_found(t)} "
            f"AND len(regexp_extract_all({t}, '\\p{{Nd}}')) <= 0.3 * length({t}) "
            f"AND len(list_filter({w}, lambda s: length(s) <= 3)) <= 0.7 * len({w}))")


def copy_key(x, row):
    """The whole-text key; a text with an empty one has a key of its own."""
    return f"(SELECT CASE WHEN k = '' THEN 'row ' || {row} ELSE 'key ' || k END FROM (SELECT {dup_key(x, None)} AS k))"


def dup_key(x, prefix=100):
    key = f"trim({sql_chain(f'lower({x})', P.DUP_NOISE)})"
    return key if prefix is None else f"substring({key}, 1, {prefix})"


# Documents carry no footnote marks, page numbers or labels. This adds them at
# every sentence and line end, from the row's own values, in both engines.
MARKED = """(SELECT doc_id, source, lang, n_chars,
  doc_id || ', ' || replace(replace(text, '. ', ' (3). S. 12 '), chr(10),
    ' [' || doc_id || ']' || chr(10) || 'Autor: ' || source || chr(10) || 'Priester ' || lang || chr(10))
  || ' vgl. https://x.example/' || source || ' lib. IV n. 7 ' || n_chars AS t FROM documents)"""
