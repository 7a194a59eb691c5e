"""Queries over the text functions."""

from pyspark.sql import functions as F

from versarium import dims
from versarium import patterns as P
from versarium.functions import text as T
from versarium.queries import inputs, sqlkit as S
from versarium.queries.registry import projected, query
from versarium.rx import sql_chain
from versarium.session import load


def marked(name, fn, steps, out="clean"):
    """A cleaning rule over the marked documents."""
    sql = f"SELECT doc_id, t AS {out} FROM ({S.staged(f'SELECT doc_id, t FROM {S.MARKED}', steps)})"

    @query(name, sql)
    def run(spark, sf_dir):
        return inputs.marked_documents(spark, sf_dir).select("doc_id", fn(F.col("t")).alias(out))


marked("clean_text", T.deep_clean, S.deep_clean_steps())
marked("strip_footnote_refs", T.strip_footnote_refs, [lambda t: sql_chain(t, P.FOOTNOTE_REFS)])
marked("strip_page_numbers", T.strip_page_numbers, [lambda t: sql_chain(t, P.PAGE_NUMBERS)])
marked("strip_biblio_refs", T.strip_biblio_refs, [lambda t: sql_chain(t, P.BIBLIO_REFS)])
marked("strip_metadata_lines", T.strip_metadata_lines,
       [lambda t: S.lines(t, lambda ln: f"NOT {P.METADATA_LINES['formatter'].sql_found(ln)}")])
for _variant in ("archive", "download"):
    marked(f"strip_metadata_lines_{_variant}", lambda c, v=_variant: T.strip_metadata_lines(c, v),
           [lambda t, v=_variant: S.lines(t, lambda ln: f"NOT {P.METADATA_LINES[v].sql_found(ln)}")])
marked("drop_name_lists", T.drop_name_lists, [S.name_lists])
marked("trim_artifacts", T.trim_artifacts, [lambda t: sql_chain(t, P.TRIM_ARTIFACTS)])
marked("strip_web_artifacts", T.strip_web_artifacts, [lambda t: sql_chain(t, P.WEB_ARTIFACTS)])
marked("tidy_punctuation", T.tidy_punctuation, [lambda t: sql_chain(t, P.TIDY), S.trim])
marked("charset_whitelist", T.charset_whitelist, [P.NOT_ALLOWED.sql_sub])
marked("clean_segment", T.clean_segment, [
    lambda t: P.SPACES.sql_sub(P.NOT_ALLOWED.sql_sub(f"replace({P.TAGS.sql_sub(t)}, '↩', '')")),
    lambda t: S.trim(sql_chain(t, P.PAGE_REFS))])
marked("clean_work_text", T.clean_work_text, [
    lambda t: P.SPACES.sql_sub(P.NOT_ALLOWED.sql_sub(f"replace({P.TAGS.sql_sub(t)}, '↩', '')")),
    lambda t: S.trim(sql_chain(t, P.WORK_REFS))])
marked("keep_substantive_lines", T.keep_substantive_lines, [
    lambda t: S.trim(S.lines(t, lambda ln: f"length({S.trim(ln)}) > 20 AND NOT "
                             f"{P.ALL_DIGITS.sql_found(S.trim(ln))} AND NOT "
                             f"{P.CAPS_ONLY.sql_found(S.trim(ln))}"))])
marked("sentence_per_line", T.sentence_per_line,
       [lambda t: S.trim(sql_chain(t, P.SENTENCE_LINES))])
marked("strip_nav_lines", T.strip_nav_lines, [
    lambda t: ("array_to_string(list_filter(list_transform(string_split(" + t + ", chr(10)), "
               f"lambda a: {S.trim('a')}), lambda b: length(b) > 10 AND NOT "
               f"{P.NAV_LINES['base'].sql_found('b')}), chr(10))")])

marked("strip_nav_lines_strict", lambda c: T.strip_nav_lines(c, "strict"), [
    lambda t: ("array_to_string(list_filter(list_transform(string_split(" + t + ", chr(10)), "
               f"lambda a: {S.trim('a')}), lambda b: length(b) > 10 AND NOT "
               f"{P.NAV_LINES['strict'].sql_found('b')}), chr(10))")])

projected("collapse_ws", "documents", ["doc_id"],
          f"SELECT doc_id, {S.collapse('text')} AS clean FROM documents",
          clean=lambda: T.collapse_ws(F.col("text")))
projected("word_count", "documents", ["doc_id"],
          f"SELECT doc_id, {S.n_words('text')} AS n_words FROM documents",
          n_words=lambda: T.word_count(F.col("text")))
projected("snippet", "documents", ["doc_id"], """
  SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END
  AS snippet FROM documents""", snippet=lambda: T.snippet(F.col("text")))
projected("make_id", "documents", ["doc_id"], f"""
  SELECT doc_id, {P.NON_ID.sql_sub('source')} || '_' ||
    substring({P.NON_ID.sql_sub('text')}, 1, 30) || '_' || n_chars AS id FROM documents""",
          id=lambda: T.make_id(F.col("source"), F.col("text"), F.col("n_chars")))
projected("slugify", "documents", ["doc_id"], f"""
  SELECT doc_id, {sql_chain('strip_accents(' + S.umlauts('lower(text)') + ')', P.NON_SLUG)} AS slug
  FROM documents""", slug=lambda: T.slugify(F.col("text")))
projected("fold_diacritics", "documents", ["doc_id"],
          "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents",
          folded=lambda: T.fold_diacritics(F.col("text")))
projected("normalize_unicode", "documents", ["doc_id"],
          "SELECT doc_id, nfc_normalize(text) AS nfc FROM documents",
          nfc=lambda: T.normalize_unicode(F.col("text"), "NFC"))
projected("fold_umlauts", "documents", ["doc_id"], f"""
  SELECT doc_id, {S.replaces('text', T.MOJIBAKE + dims.UMLAUTS)} AS folded FROM documents""",
          folded=lambda: T.fold_umlauts(F.col("text")))
projected("normalize_quotes", "documents", ["doc_id"], '''
  SELECT doc_id, translate('„' || text || '“ – —', '“”„–—−', '"""---') AS quoted FROM documents''',
          quoted=lambda: T.normalize_quotes(F.concat(F.lit("„"), F.col("text"), F.lit("“ – —"))))
projected("clean_title", "documents", ["doc_id"], f"""
  SELECT doc_id, {S.trim(sql_chain("'Übersetzung (' || lang || '): ' || substring(text, 1, 60) || ' (BKV) (' || source || ')'", P.TITLE_CLEAN))}
  AS title FROM documents""", title=lambda: T.clean_title(F.concat(
      F.lit("Übersetzung ("), F.col("lang"), F.lit("): "), F.substring("text", 1, 60),
      F.lit(" (BKV) ("), F.col("source"), F.lit(")"))))
projected("safe_filename", "documents", ["doc_id"], f"""
  SELECT doc_id, substring(lower(replace({P.SPACES.sql_sub(P.UNSAFE_FILE.sql_sub("source || ': ' || text"))}, ' ', '_')), 1, 100)
  AS file FROM documents""",
          file=lambda: T.safe_filename(F.concat(F.col("source"), F.lit(": "), F.col("text"))))
projected("truncate_text", "documents", ["doc_id"],
          "SELECT doc_id, substring(text, 1, 6000) AS head FROM documents",
          head=lambda: T.truncate_text(F.col("text")))
projected("drop_repeated_line", "documents", ["doc_id"], """
  SELECT doc_id, array_to_string(list_filter(ls, lambda x, i: i = 1 OR ls[i - 1] <> x), chr(10)) AS clean
  FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10)), chr(10)) AS ls FROM documents)""",
          clean=lambda: T.drop_repeated_line(F.replace("text", F.lit(". "), F.lit("\n"))))
projected("content_hash", "documents", ["doc_id"],
          "SELECT doc_id, sha256(text) AS content_hash FROM documents",
          content_hash=lambda: T.content_hash(F.col("text")))
projected("dup_key", "documents", ["doc_id"],
          f"SELECT doc_id, {S.dup_key('text')} AS dup_key FROM documents",
          dup_key=lambda: T.dup_key(F.col("text")))
projected("normalize_word", "documents", ["doc_id"], f"""
  SELECT doc_id, {sql_chain('strip_accents(lower(text))', P.WORD_FORM)} AS word FROM documents""",
          word=lambda: T.normalize_word(F.col("text")))

projected("strip_tags", "pages", ["page_id"],
          f"SELECT page_id, {P.TAGS.sql_sub('html')} AS clean FROM pages",
          clean=lambda: T.strip_tags(F.col("html")))
projected("decode_entities", "pages", ["page_id"],
          f"SELECT page_id, {S.entities('html')} AS clean FROM pages",
          clean=lambda: T.decode_entities(F.col("html")))
projected("br_to_newline", "pages", ["page_id"], f"""
  SELECT page_id, {S.trim("replace(" + P.TAGS.sql_sub(P.BREAKS.sql_sub('html')) + ", '&nbsp;', ' ')")}
  AS clean FROM pages""", clean=lambda: T.br_to_newline(F.col("html")))
projected("clean_markup", "pages", ["page_id"],
          f"SELECT page_id, {S.collapse(S.entities(P.TAGS.sql_sub('html')))} AS clean FROM pages",
          clean=lambda: T.clean_markup(F.col("html")))
projected("url_work_id", "pages", ["page_id"], f"""
  SELECT page_id, coalesce(nullif({P.WORK_ID_CPG.sql_group('url', 0)}, ''),
    {P.LAST_PATH_PART.sql_group('url', 1)}) AS work_id FROM pages""",
          work_id=lambda: T.url_work_id(F.col("url")))
projected("url_format", "pages", ["page_id"], """
  SELECT page_id, CASE WHEN contains(u, '.epub') THEN 'epub' WHEN contains(u, '.pdf') THEN 'pdf'
    WHEN contains(u, '.docx') THEN 'docx' WHEN contains(u, '.rtf') THEN 'rtf' ELSE 'unknown' END AS format
  FROM (SELECT page_id, lower(url || '/x.pdf') AS u FROM pages)""",
          format=lambda: T.url_format(F.concat("url", F.lit("/x.PDF"))))
projected("rtf_to_text", "documents", ["doc_id"], f"""
  SELECT doc_id, {S.trim(sql_chain("'{\\rtf1 ' || replace(text, '. ', '\\par ') || '}'", P.RTF_CODES))} AS clean
  FROM documents""", clean=lambda: T.rtf_to_text(F.concat(
      F.lit("{\\rtf1 "), F.replace("text", F.lit(". "), F.lit("\\par ")), F.lit("}"))))
projected("strip_markers", "documents", ["doc_id"], f"""
  SELECT doc_id, {S.trim(sql_chain("replace(text, '. ', '$ŽG://ESyn0812/') || '[] //ESyn0812/x, ;'", P.MARKERS))} AS clean
  FROM documents""", clean=lambda: T.strip_markers(F.concat(
      F.replace("text", F.lit(". "), F.lit("$ŽG://ESyn0812/")), F.lit("[] //ESyn0812/x, ;"))))
projected("clean_verse", "documents", ["doc_id"], f"""
  SELECT doc_id, {S.trim(sql_chain(S.trim(sql_chain("text || ' [x]//ESyn0812/y, ;'", P.MARKERS)), P.VERSE_TIDY))} AS clean
  FROM documents""",
          clean=lambda: T.clean_verse(F.concat("text", F.lit(" [x]//ESyn0812/y, ;"))))
projected("name_from_filename", "part", ["p_partkey"], f"""
  SELECT p_partkey, array_to_string(list_transform(string_split(stem, ' '),
      lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ') AS name
  FROM (SELECT p_partkey, {S.trim(sql_chain("'Ikone_300px-' || replace(p_name, ' ', '_') || '-62b05f-200.jpg'", P.FILE_STEM))} AS stem FROM part)""",
          name=lambda: T.name_from_filename(F.concat(
              F.lit("Ikone_300px-"), F.replace("p_name", F.lit(" "), F.lit("_")),
              F.lit("-62b05f-200.jpg"))))
projected("cache_key", "lineitem", ["l_orderkey", "l_linenumber"], """
  SELECT l_orderkey, l_linenumber, lower(trim(l_returnflag)) || ':allioli:' || l_partkey || ':0' AS cache_key
  FROM lineitem""", cache_key=lambda: T.cache_key(F.col("l_returnflag"), F.lit(""),
                                                  F.col("l_partkey"), F.lit(None).cast("int")))
projected("format_ref", "lineitem", ["l_orderkey", "l_linenumber"], """
  SELECT l_orderkey, l_linenumber, l_returnflag || ' ' || l_suppkey || ',' || l_linenumber AS ref
  FROM lineitem""",
          ref=lambda: T.format_ref(F.col("l_returnflag"), F.col("l_suppkey"), F.col("l_linenumber")))
projected("display_ref", "lineitem", ["l_orderkey", "l_linenumber"], """
  SELECT l_orderkey, l_linenumber,
    'Ps ' || l_suppkey || ', ' || l_linenumber || '-' || l_partkey || '.7' AS ref FROM lineitem""",
          ref=lambda: T.display_ref(F.concat(
              F.lit("Ps "), "l_suppkey", F.lit(" (134), "), "l_linenumber", F.lit("a–"),
              "l_partkey", F.lit("b u. 7 (R: 3a)"))))
projected("vector_literal", "embeddings", ["vec_id"], """
  SELECT vec_id, '[' || array_to_string(list_transform(embedding,
    lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings""",
          literal=lambda: T.vector_literal(F.col("embedding")))
projected("note_label", "lineitem", ["l_orderkey", "l_linenumber"], """
  SELECT l_orderkey, l_linenumber, l_partkey || '.' AS from_anchor, l_suppkey || '.' AS from_key
  FROM lineitem""",
          from_anchor=lambda: T.note_label(F.concat(F.lit("{FN"), "l_partkey", F.lit("}")), F.lit("")),
          from_key=lambda: T.note_label(F.lit(None).cast("string"),
                                        F.concat(F.lit("a:b:"), "l_suppkey")))


@query("replace_all_columns", """SELECT replace(c_name, '#', '') AS c_name,
  replace(c_mktsegment, '#', '') AS c_mktsegment, c_custkey FROM customer""")
def replace_all_columns(spark, sf_dir):
    return T.replace_all_columns(
        load(spark, sf_dir, "customer").select("c_name", "c_mktsegment", "c_custkey"))


@query("describe_name", f"""SELECT s_suppkey, coalesce(d.txt, 'Kirchenvater') AS description
  FROM (SELECT s_suppkey, 'Justin der Märtyrer' AS nm FROM supplier) LEFT JOIN
  {dims.sql_values(list(dims.NAME_DESCRIPTIONS.items()), 'd', ['nm', 'txt'])} USING (nm)""")
def describe_name(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select(
        "s_suppkey", T.describe_name(F.lit("Justin der Märtyrer")).alias("description"))


_REF_NORM = "replace(replace(l_returnflag || '. Kön ' || l_suppkey, '.', ''), ' ', '')"
projected("ref_norm", "lineitem", ["l_orderkey", "l_linenumber"],
          f"SELECT l_orderkey, l_linenumber, {S.umlauts(_REF_NORM)} AS token FROM lineitem",
          token=lambda: T.ref_norm(F.concat("l_returnflag", F.lit(". Kön "), "l_suppkey")))
