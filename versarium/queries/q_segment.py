"""Queries: segmentation, chunking, alignment, office pages."""

from pyspark.sql import functions as F

from versarium import patterns as P
from versarium.functions import text as T
from versarium.operators import segment as G
from versarium.queries import sqlkit as S
from versarium.queries.registry import query
from versarium.rx import Rx, quote
from versarium.session import load, load_text

NL = Rx(r"\n")


def parts_query(name, parts, sql_list, table="documents", key="doc_id", text=None, sql_text="text"):
    """Register a splitter: one row per part with its position."""
    sql = f"""SELECT {key}, unnest(p) AS part, (generate_subscripts(p, 1) - 1)::INTEGER AS pos
      FROM (SELECT {key}, {sql_list('t')} AS p FROM (SELECT {key}, {sql_text} AS t FROM {table}))"""

    @query(name, sql)
    def run(spark, sf_dir):
        df = load_text(spark, sf_dir, table)
        body = F.col("text") if text is None else text()
        return df.select(key, body.alias("t")).select(key, F.posexplode(parts(F.col("t"))).alias("pos", "part"))


def pieces(t, rx_re2):
    split = f"string_split_regex({t}, {quote(rx_re2)})"
    return f"list_filter(list_transform({split}, lambda a: {S.trim('a')}), lambda b: b <> '')"


def pack(items, sep, before="false", after="false", keep="true", tail="true"):
    """The greedy fold in SQL; before/after/keep/tail use h (have) and n (new)."""
    def cond(text, h, n="0"):
        return "(" + text.replace("{h}", h).replace("{n}", n) + ")"
    sized = f"list_transform({items}, lambda c: {{'t': c, 'n': {S.n_words('c')}}})"
    cut = f"(a.n > 0 AND {cond(before, 'a.n', 'x.n')})"
    cur = f"(CASE WHEN {cut} OR a.n = 0 THEN x.t ELSE a.cur || {quote(sep)} || x.t END)"
    n = f"(CASE WHEN {cut} OR a.n = 0 THEN x.n ELSE a.n + x.n END)"
    done = f"(CASE WHEN {cut} AND {cond(keep, 'a.n')} THEN list_append(a.done, a.cur) ELSE a.done END)"
    full = cond(after, n)
    folded = f"""list_reduce({sized}, lambda a, x: {{
      'done': CASE WHEN {full} THEN list_append({done}, {cur}) ELSE {done} END,
      'cur': CASE WHEN {full} THEN '' ELSE {cur} END, 'n': CASE WHEN {full} THEN 0 ELSE {n} END}},
      {{'done': []::VARCHAR[], 'cur': ''::VARCHAR, 'n': 0::INTEGER}})"""
    return folded, cond(tail, "r.n")


def chunk_query(name, chunks, items, add="", gate=None, **fold):
    """Register a chunker over whole documents."""
    folded, tail = pack(items("text"), **fold)
    out = f"CASE WHEN r.n > 0 AND {tail} THEN list_append(r.done, r.cur) ELSE r.done END"
    if add:
        out = f"list_transform({out}, lambda z: z || {quote(add)})"
    if gate:
        out = gate(out)
    sql = f"""SELECT doc_id, unnest(p) AS part, (generate_subscripts(p, 1) - 1)::INTEGER AS pos FROM (
      SELECT doc_id, {out} AS p FROM (SELECT doc_id, text, {folded} AS r FROM documents))"""

    @query(name, sql)
    def run(spark, sf_dir):
        docs = load_text(spark, sf_dir, "documents", "doc_id", "text")
        return docs.select("doc_id", F.posexplode(chunks(F.col("text"))).alias("pos", "part"))


parts_query("split_paragraphs", lambda c: G.split_paragraphs(c, NL), lambda t: pieces(t, r"\n"))
parts_query("split_blank_lines", G.split_paragraphs, lambda t: pieces(t, P.BLANK_LINES.re2),
            text=lambda: F.replace("text", F.lit("\n"), F.lit("\r\n \r\n")),
            sql_text="replace(text, chr(10), chr(10) || ' ' || chr(10))")
parts_query("split_sentences", G.split_sentences, lambda t: pieces(
    f"regexp_replace({t}, {quote(P.SENTENCE_GAP.re2)}, '\\1' || chr(1) || '\\2', 'g')", "\x01"))
parts_query("split_sentences_simple", G.split_sentences_simple,
            lambda t: f"list_filter({pieces(t, P.SENTENCE_END.re2)}, lambda s: length(s) > 20)")
parts_query("split_by_markers", G.split_by_markers,
            lambda t: f"list_filter(string_split_regex({t}, {quote(P.CHAPTER_MARKERS.re2)}), "
                      f"lambda s: {S.trim('s')} <> '')",
            text=lambda: F.replace("text", F.lit("\n"), F.lit("\n Kapitel 12")),
            sql_text="replace(text, chr(10), chr(10) || ' Kapitel 12')")

_SENT = P.SENTENCE_END.re2
chunk_query("chunk_400", G.chunk_400, lambda t: pieces(t, _SENT), add=".", sep=". ",
            before="{h} + {n} > 400", keep="{h} >= 20", tail="{h} >= 20",
            gate=lambda out: f"""CASE WHEN {S.n_words('text')} > 500 THEN {out}
              WHEN {S.n_words('text')} >= 20 AND length({S.trim('text')}) > 100 THEN [{S.trim('text')}]
              ELSE []::VARCHAR[] END""")
chunk_query("chunk_40", G.chunk_40, lambda t: pieces(
    f"regexp_replace({t}, {quote(P.SENTENCE_GAP.re2)}, '\\1' || chr(1) || '\\2', 'g')", "\x01"),
            sep=" ", before="{h} > 40 AND {n} > 5")
chunk_query("chunk_min200", G.chunk_min200,
            lambda t: f"list_filter({pieces(t, chr(10))}, lambda s: length(s) >= 20)",
            sep=" ", after="{h} >= 200", tail="{h} >= 50")
chunk_query("chunk_flush_before", G.chunk_flush_before,
            lambda t: f"list_filter({pieces(t, chr(10))}, lambda s: length(s) >= 20)",
            sep=" ", before="{h} >= 200", keep="{h} >= 20", tail="{h} >= 20")
chunk_query("chunk_min150", G.chunk_min150,
            lambda t: f"list_filter({pieces(t, _SENT)}, lambda s: length(s) >= 20)",
            sep=". ", after="{h} >= 150", tail="{h} >= 30")

_MERGE = """WITH RECURSIVE line AS (
  SELECT conv_id, turn, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
    length(text) AS len, regexp_matches(text, {start}) AS starts, text LIKE '%.' AS ends
  FROM conversations WHERE text <> ''),
walk AS (
  SELECT conv_id, rn, turn, turn AS paragraph, CASE WHEN ends AND len > 200 THEN 0 ELSE len END AS state
  FROM line WHERE rn = 1
  UNION ALL
  SELECT l.conv_id, l.rn, l.turn, CASE WHEN w.state = 0 OR l.starts THEN l.turn ELSE w.paragraph END,
    CASE WHEN l.ends AND (CASE WHEN w.state = 0 OR l.starts THEN l.len ELSE w.state + 1 + l.len END) > 200 THEN 0
      WHEN w.state = 0 OR l.starts THEN l.len ELSE w.state + 1 + l.len END
  FROM walk w JOIN line l ON l.conv_id = w.conv_id AND l.rn = w.rn + 1)
SELECT conv_id, paragraph, string_agg(t, ' ' ORDER BY turn) AS text, count(*)::INTEGER AS n_rows
FROM walk JOIN line USING (conv_id, turn) GROUP BY conv_id, paragraph"""


@query("merge_rows", _MERGE.replace("{start}", quote(P.SECTION_START.re2)))
def merge_rows(spark, sf_dir):
    return G.merge_rows(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")


@query("merge_rows_split", _MERGE.replace("{start}", quote(P.SECTION_START.re2)))
def merge_rows_split(spark, sf_dir):
    # so many ranges that works go on from one into the next
    return G.merge_rows(load(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", ranges=40)


@query("verse_number", f"""WITH block AS (SELECT source, doc_id, unnest(p) AS block, generate_subscripts(p, 1) AS pos
    FROM (SELECT source, doc_id, {pieces("replace(text, chr(10), chr(10) || 'Kapitel ' || doc_id || chr(10))", chr(10))} AS p
      FROM documents)),
  head AS (SELECT *, {' '.join(f"coalesce(nullif({rx.sql_group('block')}, ''),{' NULL' if i == len(P.CHAPTER_HEADER) - 1 else ''}" for i, rx in enumerate(P.CHAPTER_HEADER)) + ')' * len(P.CHAPTER_HEADER)} AS header FROM block),
  chap AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id, pos), '1') AS chapter FROM head),
  verse AS (SELECT source, doc_id, pos, chapter, unnest(s) AS text, generate_subscripts(s, 1) AS sub FROM (
    SELECT *, list_filter({pieces('block', _SENT)}, lambda q: length(q) > 20) AS s FROM chap WHERE header IS NULL))
  SELECT source, doc_id, chapter, text, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos, sub) AS verse FROM verse""")
def verse_number(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "source", "text")
    head = F.concat(F.lit("\nKapitel "), F.col("doc_id").cast("string"), F.lit("\n"))
    docs = docs.withColumn("text", F.replace("text", F.lit("\n"), head))
    out = G.verse_number(docs, ["source"], "doc_id", "text", NL)
    return out.select("source", "doc_id", "chapter", "text", F.col("verse").cast("bigint").alias("verse"))


_FRAG = "replace(replace(text, '. ', ' 2) '), chr(10), chr(10) || doc_id || chr(10))"
_FRAGS = f"""flatten(list_transform(string_split({_FRAG}, chr(10)), lambda ln: list_filter(list_transform(string_split(
  regexp_replace(ln, {quote(P.NUMBERED_FRAGMENT.re2)}, chr(1) || '\\2', 'g'), chr(1)), lambda a: {S.trim('a')}), lambda b: b <> '')))"""


@query("numbered_fragments", f"""WITH frag AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM
    (SELECT doc_id, {_FRAGS} AS p FROM documents)),
  grp AS (SELECT *, sum(regexp_matches(line, '^[0-9]+$')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS note FROM frag)
  SELECT doc_id, 'line' AS kind, regexp_extract(line, '^([0-9]+\\))', 1) AS label,
    trim(regexp_replace(line, '^[0-9]+\\)', '')) AS text FROM grp WHERE note = 0
  UNION ALL SELECT doc_id, 'footnote', first(line ORDER BY pos),
    coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (NOT regexp_matches(line, '^[0-9]+$')), '')
  FROM grp WHERE note > 0 GROUP BY doc_id, note""")
def numbered_fragments(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "text")
    note = F.concat(F.lit("\n"), F.col("doc_id").cast("string"), F.lit("\n"))
    body = F.replace(F.replace("text", F.lit(". "), F.lit(" 2) ")), F.lit("\n"), note)
    return docs.select("doc_id", F.inline(G.numbered_fragments(body)))


_QUOTED = "replace(replace(text, '. ', '. „a b“ '), ', ', ', «c» ')"


@query("quote_segments", f"""SELECT conv_id, turn, (generate_subscripts(p, 1) - 1)::INTEGER AS pos, unnest(
    list_transform(p, lambda s: CASE WHEN s LIKE chr(2) || '%' THEN substring(s, 3, length(s) - 3) ELSE s END)) AS part,
    unnest(list_transform(p, lambda s: s LIKE chr(2) || '%')) AS is_quote FROM (SELECT conv_id, turn, list_filter(string_split(
    regexp_replace({_QUOTED}, {quote('(' + P.QUOTES.re2 + ')')}, chr(1) || chr(2) || '\\1' || chr(1), 'g'), chr(1)),
    lambda x: x <> '') AS p FROM conversations)""")
def quote_segments(spark, sf_dir):
    turns = load_text(spark, sf_dir, "conversations")
    body = F.replace(F.replace("text", F.lit(". "), F.lit(". „a b“ ")), F.lit(", "), F.lit(", «c» "))
    return (turns.select("conv_id", "turn", F.posexplode(G.quote_segments(body)).alias("pos", "s"))
            .select("conv_id", "turn", "pos", F.col("s.text").alias("part"), F.col("s.is_quote").alias("is_quote")))


@query("placeholder_segments", """SELECT conv_id, turn, (generate_subscripts(p, 1) - 1)::INTEGER AS pos,
    unnest(list_transform(p, lambda s: CASE WHEN s LIKE chr(2) || '%' THEN trim(substring(s, 2)) ELSE s END)) AS part,
    unnest(list_transform(p, lambda s: s LIKE chr(2) || '%')) AS is_note FROM (SELECT conv_id, turn, list_filter(string_split(
    replace(text, '. ', '. ' || chr(1) || chr(2) || turn || chr(1)), chr(1)), lambda x: x <> '') AS p FROM conversations)""")
def placeholder_segments(spark, sf_dir):
    turns = load_text(spark, sf_dir, "conversations")
    body = F.replace("text", F.lit(". "), F.concat(F.lit(". {FN"), F.col("turn").cast("string"), F.lit("}")))
    return (turns.select("conv_id", "turn", F.posexplode(G.placeholder_segments(body)).alias("pos", "s"))
            .select("conv_id", "turn", "pos", F.col("s.text").alias("part"), F.col("s.is_note").alias("is_note")))


@query("tokenize", f"""WITH tok AS (SELECT conv_id, turn, unnest(p) AS token, generate_subscripts(p, 1) AS i FROM (
    SELECT conv_id, turn, {P.TOKENS.sql_all('text')} AS p FROM conversations)),
  w AS (SELECT *, {P.WORD_TOKEN.sql_found('token')} AS is_word FROM tok),
  n AS (SELECT *, coalesce(sum(is_word::INT) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS seg FROM w)
  SELECT conv_id, turn, seg, token, is_word, CASE WHEN is_word THEN seg END AS word_index,
    (row_number() OVER (PARTITION BY conv_id, turn, seg ORDER BY i) - 1)::INTEGER AS sub FROM n""")
def tokenize(spark, sf_dir):
    return G.tokenize(load_text(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


_EXPECTED = f"list_filter(string_split({P.SPACES.sql_sub(f'''regexp_replace(strip_accents(lower(text)), {quote(P.WORD_FORM[0].re2)}, ' ', 'g')''')}, ' '), lambda w: w <> '')"
_SPOKEN = f"list_filter(string_split({P.SPACES.sql_sub(P.WORD_FORM[0].sql_sub('''replace(strip_accents(lower(text)), 'tion', 'sion')'''))}, ' '), lambda w: w <> '')"


def _near(at):
    word = f"coalesce(e[{at}], '')"
    return (f"(CASE WHEN length(x) = 0 AND length({word}) = 0 THEN 1 WHEN length(x) = 0 OR length({word}) = 0 THEN 0 "
            f"ELSE 1 - levenshtein(x, {word}) / greatest(length(x), length({word})) END >= 0.65)")


@query("greedy_align", f"""SELECT conv_id, turn, len(e)::INTEGER AS n_expected, list_reduce(s, lambda a, x:
    CASE WHEN a >= len(e) THEN a WHEN {_near('a + 1')} THEN a + 1 WHEN {_near('a + 2')} THEN a + 2
      WHEN {_near('a + 3')} THEN a + 3 ELSE a END, 0::INTEGER)::INTEGER AS pointer
  FROM (SELECT conv_id, turn, {_EXPECTED} AS e, {_SPOKEN} AS s FROM conversations)""")
def greedy_align(spark, sf_dir):
    turns = load_text(spark, sf_dir, "conversations")
    expected = G.expected_words(F.col("text"))
    heard = F.replace(T.fold_diacritics(F.col("text")), F.lit("tion"), F.lit("sion"))
    spoken = F.filter(F.split(P.SPACES.sub(P.WORD_FORM[0].sub(heard)), " "), lambda w: w != "")
    lists = turns.select("conv_id", "turn", F.explode(F.array(F.struct(expected.alias("e"), spoken.alias("s")))).alias("l"))
    return lists.select("conv_id", "turn", F.size("l.e").alias("n_expected"),
                        G.greedy_align(F.col("l.e"), F.col("l.s")).alias("pointer"))


@query("prefix_align", f"""SELECT conv_id, turn, list_reduce(e, lambda a, x: {{
    'k': a.k + (a.open AND contains(s, CASE WHEN a.k = 0 THEN x ELSE a.p || ' ' || x END))::INT,
    'p': CASE WHEN a.open AND contains(s, CASE WHEN a.k = 0 THEN x ELSE a.p || ' ' || x END) THEN CASE WHEN a.k = 0 THEN x ELSE a.p || ' ' || x END ELSE a.p END,
    'open': a.open AND contains(s, CASE WHEN a.k = 0 THEN x ELSE a.p || ' ' || x END)}},
    {{'k': 0::INTEGER, 'p': ''::VARCHAR, 'open': true}}).k AS k
  FROM (SELECT conv_id, turn, {_EXPECTED} AS e, array_to_string({_SPOKEN}, ' ') AS s FROM conversations)""")
def prefix_align(spark, sf_dir):
    turns = load_text(spark, sf_dir, "conversations")
    heard = F.replace(T.fold_diacritics(F.col("text")), F.lit("tion"), F.lit("sion"))
    said = F.array_join(F.filter(F.split(P.SPACES.sub(P.WORD_FORM[0].sub(heard)), " "), lambda w: w != ""), " ")
    lists = turns.select("conv_id", "turn", F.explode(F.array(
        F.struct(G.expected_words(F.col("text")).alias("e"), said.alias("s")))).alias("l"))
    return lists.select("conv_id", "turn", G.prefix_align(F.col("l.e"), F.col("l.s")).alias("k"))


_SLOT = "SELECT o_orderkey, '{0}' AS id, {1} AS reference, '{2}' AS type FROM orders"


@query("reading_slots", " UNION ALL ".join([
    _SLOT.format("L1", "o_orderstatus", "reading"), _SLOT.format("AP", "o_orderpriority", "psalm"),
    _SLOT.format("L2", "o_orderpriority", "reading") + " WHERE o_orderstatus = 'P'", _SLOT.format("EV", "''", "gospel")]))
def reading_slots(spark, sf_dir):
    second = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(" ")
    slots = G.reading_slots(F.col("o_orderstatus"), F.col("o_orderpriority"), second, F.lit(None).cast("string"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.inline(slots)).drop("title")


def _office(spark, sf_dir):
    """Office markup around the sentences of each page."""
    pages = load_text(spark, sf_dir, "pages")
    title = T.clean_markup(F.regexp_extract("html", "<title>([^<]*)", 1))
    n = F.col("page_id").cast("string")
    one = F.concat(F.lit("<FONT><I>Ant.</I></FONT> "), title, F.lit("<br/><FONT COLOR='red'><I>Psalmus "), n,
                   F.lit("</I></FONT><br/>"), n, F.lit(":1 "), title, F.lit("<br/>"), n, F.lit(":2 Amen<br/>"),
                   F.lit("<FONT><I>Oratio</I></FONT> "), title, F.lit("<br/>℣. Deus "), n, F.lit(" ℟. "), title)
    return pages.select("page_id", F.concat(one, F.lit("\n"), one).alias("o"))


_TITLE = "SELECT page_id, " + S.collapse(S.entities("regexp_extract(html, '<title>([^<]*)', 1)")) + " AS t FROM pages"


@query("office_psalms", f"""SELECT page_id, pos, page_id::VARCHAR AS number, t AS antiphon,
  page_id || ':1 ' || t || '|' || page_id || ':2 Amen' AS verses
  FROM ({_TITLE}), (VALUES (0), (1)) AS v(pos)""")
def office_psalms(spark, sf_dir):
    out = G.office_psalms(_office(spark, sf_dir), "page_id", "o")
    shown = F.transform("verses", lambda v: F.concat(v["chapter"], F.lit(":"), v["verse"], F.lit(" "), v["text"]))
    return out.withColumn("verses", F.array_join(shown, "|"))


@query("office_blocks", f"""SELECT page_id, 'antiphon' AS kind, t AS body, 2::BIGINT AS n FROM ({_TITLE}) WHERE length(t) > 5
  UNION ALL SELECT page_id, 'prayer', 'Oratio ' || t, 2 FROM ({_TITLE}) WHERE length('Oratio ' || t) > 10
  UNION ALL SELECT page_id, 'versicle', 'Deus ' || page_id || ' / Latin', 2 FROM ({_TITLE})""")
def office_blocks(spark, sf_dir):
    pages = _office(spark, sf_dir)
    def rows(kind, parts):
        return pages.select("page_id", F.lit(kind).alias("kind"), F.explode(parts).alias("body"))
    versicles = F.transform(G.office_versicles(F.col("o")),
                            lambda v: F.concat(v["versicle"], F.lit(" / "), v["language"]))
    return (rows("antiphon", G.office_antiphons(F.col("o")))
            .unionByName(rows("prayer", G.office_prayers(F.col("o"))))
            .unionByName(rows("versicle", versicles))
            .groupBy("page_id", "kind", "body").agg(F.count(F.lit(1)).alias("n")))
