"""The text functions for SQL users, as temporary SQL functions. They expand to
built-in expressions, so Catalyst sees through them."""

from versarium import dims
from versarium import patterns as P
from versarium.functions import text as T


def _raw(text):
    if "'" in text and '"' in text:
        return _quoted(text)
    mark = '"' if "'" in text else "'"
    return f"r{mark}{text}{mark}"


def _quoted(text):
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _chain(expr, rules):
    for rule in rules:
        expr = f"regexp_replace({expr}, {_raw(rule.java)}, {_quoted(rule.to)})"
    return expr


def _replaces(expr, pairs):
    for old, new in pairs:
        expr = f"replace({expr}, {_quoted(old)}, {_quoted(new)})"
    return expr


def _group(expr, rx, group):
    return f"regexp_extract({expr}, {_raw(rx.java)}, {group})"


def _found(expr, rx):
    return f"regexp_like({expr}, {_raw(rx.java)})"


def _folded(expr):
    single = f"translate({expr}, {_quoted(''.join(T._SINGLE))}, {_quoted(''.join(T._SINGLE.values()))})"
    return _replaces(f"regexp_replace({single}, {_raw(chr(92) + 'p{Mn}')}, '')", T._SEVERAL.items())


def _words(expr):
    return f"filter(split({_chain(expr, [P.SPACES])}, ' '), w -> w <> '')"


def definitions():
    """name -> (argument list, return type, body)."""
    words = _words("coalesce(t, '')")
    return {
        "strip_tags": ("t STRING", "STRING", _chain("t", [P.TAGS])),
        "collapse_ws": ("t STRING", "STRING", f"trim({_chain('t', [P.SPACES])})"),
        "trim_space": ("t STRING", "STRING", _chain("t", [P.EDGE_SPACE])),
        "strip_footnote_refs": ("t STRING", "STRING", _chain("t", P.FOOTNOTE_REFS)),
        "strip_page_numbers": ("t STRING", "STRING", _chain("t", P.PAGE_NUMBERS)),
        "strip_biblio_refs": ("t STRING", "STRING", _chain("t", P.BIBLIO_REFS)),
        "clean_title": ("t STRING", "STRING", _chain("t", [*P.TITLE_CLEAN, P.EDGE_SPACE])),
        "word_count": ("t STRING", "INT", f"size({words})"),
        "dup_key": ("t STRING", "STRING", f"substring(trim({_chain("lower(coalesce(t, ''))", P.DUP_NOISE)}), 1, 100)"),
        "snippet": ("t STRING, n INT", "STRING",
                    "CASE WHEN length(t) > n THEN concat(substring(t, 1, n), '...') ELSE t END"),
        "content_hash": ("t STRING", "STRING", "sha2(t, 256)"),
        "name_similarity": ("a STRING, b STRING", "DOUBLE",
                            "CASE WHEN length(a) = 0 AND length(b) = 0 THEN 1.0D WHEN length(a) = 0 OR length(b) = 0 THEN 0.0D "
                            "ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END"),
    } | _markup() | _names() | _structure() | _checks()


def _markup():
    entities = _replaces("t", [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")])
    verse = f"trim_space({_chain('t', P.MARKERS)})"
    return {
        "decode_entities": ("t STRING", "STRING", entities),
        "br_to_newline": ("t STRING", "STRING", f"trim_space(replace(strip_tags({_chain('t', [P.BREAKS])}), '&nbsp;', ' '))"),
        "clean_markup": ("t STRING", "STRING", "collapse_ws(decode_entities(strip_tags(t)))"),
        "strip_web_artifacts": ("t STRING", "STRING", _chain("t", P.WEB_ARTIFACTS)),
        "trim_artifacts": ("t STRING", "STRING", _chain("t", P.TRIM_ARTIFACTS)),
        "tidy_punctuation": ("t STRING", "STRING", f"trim_space({_chain('t', P.TIDY)})"),
        "charset_whitelist": ("t STRING", "STRING", _chain("t", [P.NOT_ALLOWED])),
        "strip_markers": ("t STRING", "STRING", verse),
        "clean_verse": ("t STRING", "STRING", f"trim_space({_chain(verse, P.VERSE_TIDY)})"),
        "rtf_to_text": ("t STRING", "STRING", f"trim_space({_chain('t', P.RTF_CODES)})"),
        "sentence_per_line": ("t STRING", "STRING", f"trim_space({_chain('t', P.SENTENCE_LINES)})"),
        "drop_repeated_line": ("t STRING", "STRING",
                               "array_join(filter(split(t, '\\n', -1), (x, i) -> i = 0 OR get(split(t, '\\n', -1), i - 1) <> x), '\\n')"),
        "normalize_quotes": ("t STRING", "STRING", "translate(t, '“”„–—−', '\"\"\"---')"),
    }


def _names():
    umlauts = _replaces("lower(coalesce(t, ''))", dims.UMLAUTS)
    file = _chain(_chain("t", [P.UNSAFE_FILE]), [P.SPACES])
    return {
        "fold_diacritics": ("t STRING", "STRING", f"lower({_folded('t')})"),
        "fold_umlauts": ("t STRING", "STRING", _replaces("t", T.MOJIBAKE + dims.UMLAUTS)),
        "slugify": ("t STRING", "STRING", _chain(_folded(umlauts), P.NON_SLUG)),
        "safe_filename": ("t STRING", "STRING", f"substring(lower(replace({file}, ' ', '_')), 1, 100)"),
        "normalize_word": ("t STRING", "STRING", _chain(_folded("lower(coalesce(t, ''))"), P.WORD_FORM)),
        "make_id": ("author STRING, work STRING, section STRING", "STRING",
                    f"concat_ws('_', {_chain('author', [P.NON_ID])}, substring({_chain('work', [P.NON_ID])}, 1, 30), section)"),
        "ref_norm": ("t STRING", "STRING", _replaces("regexp_replace(coalesce(t, ''), r'[.\\s]', '')", dims.UMLAUTS)),
        "format_ref": ("name STRING, chapter INT, verse INT", "STRING", "concat(name, ' ', chapter, ',', verse)"),
        "vector_literal": ("v ARRAY<DOUBLE>", "STRING", "concat('[', array_join(transform(v, x -> format_string('%.8f', x)), ','), ']')"),
        "url_work_id": ("t STRING", "STRING", f"coalesce(nullif({_group('t', P.WORK_ID_CPG, 0)}, ''), {_group('t', P.LAST_PATH_PART, 1)})"),
        "url_format": ("t STRING", "STRING", "CASE " + " ".join(
            f"WHEN contains(lower(t), '.{kind}') THEN '{kind}'" for kind in ("epub", "pdf", "docx", "rtf")) + " ELSE 'unknown' END"),
    }


def _structure():
    headers = ", ".join(f"nullif({_group('trim_space(t)', rx, 1)}, '')" for rx in P.CHAPTER_HEADER)
    return {
        "section_start": ("t STRING", "BOOLEAN", _found("t", P.SECTION_START)),
        "chapter_header": ("t STRING", "STRING", f"coalesce({headers})"),
        "reading_seconds": ("t STRING", "INT", "greatest(12, least(180, CAST(ceil(length(collapse_ws(coalesce(t, ''))) / 22) AS INT)))"),
        "search_tokens": ("t STRING", "ARRAY<STRING>", f"regexp_extract_all(lower(t), {_raw(P.SEARCH_TOKEN.java)}, 0)"),
    }


def _checks():
    trimmed = "trim_space(coalesce(t, ''))"
    pieces = _words(trimmed)
    short = f"size(filter({pieces}, w -> length(w) <= 3))"
    return {
        "valid_text": ("t STRING", "BOOLEAN", f"""length({trimmed}) >= 50 AND size({pieces}) >= 15 AND {_found(trimmed, P.HAS_WORD)}
            AND NOT (size({pieces}) < 20 AND upper({trimmed}) = {trimmed} AND lower({trimmed}) <> {trimmed}) AND NOT {_found(trimmed, P.METADATA_START)}
            AND regexp_count({trimmed}, r'\\p{{Nd}}') <= 0.3 * length({trimmed}) AND {short} <= 0.7 * size({pieces})"""),
        "substantive": ("t STRING", "BOOLEAN", f"length({trimmed}) > 50"),
        "unwanted_content": ("t STRING", "BOOLEAN", _found("lower(coalesce(t, ''))", P.UNWANTED)),
    }


def register(spark):
    for name, (args, kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


def register_matches(spark, vectors, k=12, name="match_passages", key="vec_id", vector="embedding"):
    """The nearest `k` rows of a view as an SQL table function: `name(query, min_similarity)`.

    Rows with enough cosine similarity, nearest first, as `vectors.match_passages` gives them for one
    query. One scan whose tasks keep `k` rows each; for many queries use the operator.
    """
    def dot(a, b):
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)"
    far = f"sqrt(aggregate(zip_with({vector}, query, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"
    similar = f"{dot(vector, 'query')} / sqrt({dot(vector, vector)}) / sqrt({dot('query', 'query')})"
    kind = spark.table(vectors).schema[key].dataType.simpleString()
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, min_similarity DOUBLE)
      RETURNS TABLE({key} {kind}, similarity DOUBLE, rank INT)
      RETURN SELECT hit.{key}, hit.similarity, pos + 1 AS rank FROM (SELECT posexplode(array_sort(collect_list(
        struct(distance, {key}, similarity)))) AS (pos, hit) FROM (SELECT * FROM (SELECT {key}, {similar} AS similarity, {far} AS distance
        FROM {vectors}) WHERE similarity >= min_similarity ORDER BY distance, {key} LIMIT {int(k)}))""")
