"""Queries: classification functions."""

from pyspark.sql import functions as F

from versarium import dims
from versarium import patterns as P
from versarium.functions import arrays as R
from versarium.functions import classify as C

from versarium.operators import segment as G
from versarium.queries import sqlkit as S
from versarium.queries.registry import projected, query
from versarium.rx import quote
from versarium.session import load, load_text


def _any(x, values):
    return "(" + " OR ".join(f"contains({x}, {quote(v)})" for v in values) + ")"


projected("parse_years", "lineitem", ["l_orderkey", "l_linenumber"], """SELECT l_orderkey, l_linenumber,
  l_suppkey::INTEGER AS birth, left(l_partkey::VARCHAR, 4)::INTEGER AS death FROM lineitem""",
          birth=lambda: C.parse_years(_span())["birth"], death=lambda: C.parse_years(_span())["death"])


def _span():
    return F.concat(F.lit("um "), "l_suppkey", F.lit(" – "), "l_partkey", F.lit(" n. Chr."))


projected("timeframe", "part", ["p_partkey"], """SELECT p_partkey, CASE WHEN p_size = 0 THEN NULL WHEN p_size > 25
  THEN p_size || ' - ' || (p_size - 25) ELSE p_size::VARCHAR END AS frame FROM part""",
          frame=lambda: C.timeframe(F.col("p_size"), F.greatest(F.col("p_size") - 25, F.lit(0))))

_STEMS = dims.AUTHOR_STEMS


def _first(x):
    return "CASE " + " ".join(f"WHEN contains({x}, {quote(k)}) THEN {quote(v)}" for k, v in _STEMS) + " END"


projected("author_by_substring", "pages", ["page_id"], f"""SELECT page_id, coalesce({_first('lower(url)')},
    {_first("lower(regexp_extract(html, '<title>([^<]*)', 1))")}, CASE WHEN page_id > 100 THEN 'Corpus_cpg-' || page_id END, 'Unbekannt') AS author
  FROM pages""", author=lambda: C.author_by_substring(
      F.when(F.col("page_id") > 100, F.concat("url", F.lit("/cpg-"), "page_id", F.lit("/x"))).otherwise(F.col("url")),
      F.regexp_extract("html", "<title>([^<]*)", 1)))

_HEADS = ["Einleitung", "Nachtrag zu", "Ergänzung", "Anmerkungen", "Erklärung der", "Kapitel"]


def _heading():
    words = F.array(*[F.lit(h) for h in _HEADS])
    return F.concat(F.element_at(words, (F.col("turn") % 6 + 1).cast("int")), F.lit(" "), F.col("text"))


_HEADING = f"[{', '.join(quote(h) for h in _HEADS)}][turn % 6 + 1] || ' ' || text"
_FOLDED = f"lower(strip_accents({_HEADING}))"
projected("section_role", "conversations", ["conv_id", "turn"], f"""SELECT conv_id, turn, CASE
  {' '.join(f"WHEN {_any(_FOLDED, ws)} THEN '{r}'" for r, ws in P.SECTION_ROLES)} ELSE 'main' END AS section_role
  FROM conversations""", section_role=lambda: C.section_role(_heading()))
projected("looks_like_intro", "conversations", ["conv_id", "turn"], f"""SELECT conv_id, turn,
  {' OR '.join(f"starts_with(substring({_FOLDED}, 1, 80), '{p}')" for p in P.INTRO_PREFIXES)} AS intro
  FROM conversations""", intro=lambda: C.looks_like_intro(_heading()))

_LINES = ["Vorwort ", "Buch IV ", "Kapitel 7 ", "12. 3 ", "12. ", "Brief 9 "]
_LINE = f"[{', '.join(quote(h) for h in _LINES)}][turn % 6 + 1] || text"
_TAG = "['p', 'h2', 'h3', 'p', 'p', 'div'][turn % 6 + 1]"
_CLS = "CASE WHEN role = 'user' THEN 'Footnote' ELSE '' END"
_KIND = f"""CASE WHEN {_any(f'lower({_LINE})', P.INTRO_WORDS)} THEN 'introduction'
  WHEN regexp_matches({_TAG}, '^h[1-6]$') AND {P.BOOK_HEADING.sql_found(_LINE)} THEN 'book'
  WHEN regexp_matches({_TAG}, '^h[1-6]$') AND {P.CHAPTER_HEADING.sql_found(_LINE)} THEN 'chapter'
  WHEN regexp_matches({_TAG}, '^h[1-6]$') THEN 'heading' WHEN {P.VERSE_START.sql_found(_LINE)} THEN 'verse'
  WHEN {P.NUMBER_START.sql_found(_LINE)} THEN 'paragraph' WHEN contains(lower({_CLS}), 'note') THEN 'footnote'
  ELSE 'paragraph' END"""


def _line():
    at = (F.col("turn") % 6 + 1).cast("int")
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in _LINES]), at), F.col("text"))


@query("segment_type", f"""SELECT *, CASE kind WHEN 'book' THEN nullif({P.BOOK_NUMBER.sql_group('ln', 0)}, '')
  WHEN 'chapter' THEN nullif({P.FIRST_NUMBER.sql_group('ln', 0)}, '') WHEN 'verse' THEN nullif({P.VERSE_START.sql_group('ln', 1)}, '')
  WHEN 'paragraph' THEN nullif({P.NUMBER_START.sql_group('ln', 1)}, '') END AS number
  FROM (SELECT conv_id, turn, {_KIND} AS kind, {_LINE} AS ln FROM conversations)""")
def segment_type(spark, sf_dir):
    tags = F.array(*[F.lit(t) for t in ("p", "h2", "h3", "p", "p", "div")])
    tag = F.element_at(tags, (F.col("turn") % 6 + 1).cast("int"))
    cls = F.when(F.col("role") == "user", "Footnote").otherwise("")
    rows = load_text(spark, sf_dir, "conversations").select("conv_id", "turn", _line().alias("ln"),
                                                            C.segment_type(tag, _line(), cls).alias("kind"))
    return rows.withColumn("number", C.section_number(F.col("kind"), F.col("ln")))


projected("section_start", "conversations", ["conv_id", "turn"], f"""SELECT conv_id, turn,
  {P.SECTION_START.sql_found(_LINE)} AS starts FROM conversations""", starts=lambda: C.section_start(_line()))
projected("chapter_header", "conversations", ["conv_id", "turn"], f"""SELECT conv_id, turn, coalesce(
  {', '.join(f"nullif({rx.sql_group(S.trim(_LINE))}, '')" for rx in P.CHAPTER_HEADER)}) AS chapter FROM conversations""",
          chapter=lambda: C.chapter_header(_line()))

_MARKS = "replace(text, '. ', ' Kapitel ' || doc_id || ' Buch IV (3) ')"


@query("structure_profile", f"""WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN text WHEN lang = 'de' THEN
    replace(text, '. ', '. Nr. ' || doc_id || ' ') ELSE {_MARKS} END AS t FROM documents),
  c AS (SELECT doc_id, t, len(list_distinct({P.STRUCTURE['book'].sql_all('t')}))::INTEGER AS book_count,
    len(list_distinct({P.STRUCTURE['chapter'].sql_all('t')}))::INTEGER AS chapter_count,
    len(list_distinct({P.STRUCTURE['verse'].sql_all('t')}))::INTEGER AS verse_count,
    len({P.STRUCTURE['footnote'].sql_all('t')})::INTEGER AS footnote_count, 1 AS paragraph_count,
    {P.STRUCTURE['intro'].sql_found('t')} AS has_introduction FROM d)
  SELECT * EXCLUDE (t), CASE WHEN verse_count > 0 THEN 3 WHEN chapter_count > 0 THEN 2 WHEN book_count > 0 THEN 1 ELSE 0 END AS hierarchy_levels,
    CASE WHEN book_count > 0 AND chapter_count > 0 THEN 'multi_book_work' WHEN chapter_count > 0 THEN 'chaptered_work'
    WHEN verse_count > 0 THEN 'versed_work' ELSE 'paragraph_work' END AS content_type FROM c""")
def structure_profile(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    marks = F.replace("text", F.lit(". "), F.concat(F.lit(" Kapitel "), number, F.lit(" Buch IV (3) ")))
    t = (F.when(F.col("lang") == "en", F.col("text")).when(F.col("lang") == "de", F.replace(
        "text", F.lit(". "), F.concat(F.lit(". Nr. "), number, F.lit(" ")))).otherwise(marks))
    docs = load_text(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(t)).alias("t"))
    profile = C.structure_profile(F.col("t"), F.concat(F.lit("<p class='x'>"), "t"))
    counted = docs.select("doc_id", *[c.alias(n) for n, c in profile.items()])
    return counted


_TITLES = ["Evening Prayer II for", "Office of Readings", "Night Prayer", "Morning Prayer", "Feast day"]
_HOURS = {"Evening Prayer II for": "Vespers", "Office of Readings": "OfficeOfReadings", "Night Prayer": "Compline",
          "Morning Prayer": "Lauds"}
projected("detect_hour", "events", ["event_id"], f"""SELECT event_id, CASE (event_id % 5)::INT
  {' '.join(f"WHEN {i} THEN '{_HOURS[t]}'" for i, t in enumerate(_TITLES) if t in _HOURS)}
  ELSE CASE WHEN event_type = 'click' THEN 'Terce' END END AS hour_key FROM events""",
          hour_key=lambda: C.detect_hour(
              F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (F.col("event_id") % 5 + 1).cast("int")),
              F.array(F.lit("Daily"), F.when(F.col("event_type") == "click", "Midmorning Prayer").otherwise("x"))))


@query("hours_in_order", f"""SELECT key, pos, label, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS rn
  FROM (SELECT event_id, ts, CASE (event_id % 5)::INT {' '.join(f"WHEN {i} THEN '{_HOURS[t]}'" for i, t in enumerate(_TITLES) if t in _HOURS)} END AS key FROM events))
  JOIN {dims.sql_values([(k, i, dims.HOUR_LABELS['de'][i]) for i, k in enumerate(dims.HOUR_ORDER)], 'h', ['key', 'pos', 'label'])} USING (key) WHERE rn = 1""")
def hours_in_order(spark, sf_dir):
    from versarium.operators.ordered import first_per_key
    titles = F.array(*[F.lit(t) for t in _TITLES])
    key = C.detect_hour(F.element_at(titles, (F.col("event_id") % 5 + 1).cast("int")), F.lit(None).cast("array<string>"))
    items = load(spark, sf_dir, "events").select("event_id", "ts", key.alias("key")).where(F.col("key").isNotNull())
    order = dims.constant(spark, [(k, i, dims.HOUR_LABELS["de"][i]) for i, k in enumerate(dims.HOUR_ORDER)],
                          "key string, pos int, label string")
    latest = first_per_key(items, ["key"], F.desc("ts"), F.desc("event_id"))
    return latest.join(F.broadcast(order), "key").orderBy("pos").select("key", "pos", "label", "event_id")


projected("detect_language", "documents", ["doc_id"], f"""SELECT doc_id, CASE WHEN {_any("text || CASE WHEN lang = 'es' THEN ' Amen' ELSE '' END", P.LATIN_WORDS)}
  THEN 'Latin' ELSE 'English' END AS spoken FROM documents""", spoken=lambda: C.detect_language(
      F.concat("text", F.when(F.col("lang") == "es", " Amen").otherwise(""))))
projected("is_german", "pages", ["page_id"], f"""SELECT page_id, {_any('lower(html || url)', P.GERMAN_PAGE)} AS german,
  {_any("lower(url || CASE WHEN contains(url, '/de/') THEN 'Deutsch' ELSE '' END)", P.GERMAN_LINK)} AS german_link FROM pages""",
          german=lambda: C.is_german(F.concat("html", "url")), german_link=lambda: C.is_german_link(
              F.concat("url", F.when(F.contains("url", F.lit("/de/")), "Deutsch").otherwise(""))))


@query("success_rate", """SELECT event_type, round(100 * count(*) FILTER (value > 10) / count(*), 1) AS rate
  FROM events GROUP BY event_type""")
def success_rate(spark, sf_dir):
    rates = C.success_rate(F.count_if(F.col("value") > 10), F.count(F.lit(1)))
    return load(spark, sf_dir, "events").groupBy("event_type").agg(rates.alias("rate"))


projected("author_description", "part", ["p_partkey"], """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' · ' || p_brand
  WHEN p_size > 10 THEN p_brand ELSE 'Kirchenvater' END AS description FROM part""",
          description=lambda: C.author_description(F.when(F.col("p_size") > 25, F.col("p_name")),
                                                   F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("")))
projected("heading_label", "part", ["p_partkey"], """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size || '. ' || p_name
  WHEN p_size > 10 THEN p_size || p_name ELSE 'Abschnitt ' || p_size END AS label FROM part""",
          label=lambda: C.heading_label(F.when(F.col("p_size") > 25, F.col("p_name")).when(
              F.col("p_size") > 10, F.concat("p_size", "p_name")), F.col("p_size")))
projected("reading_seconds", "documents", ["doc_id"], f"""SELECT doc_id, greatest(12, least(180,
  ceil(length({S.collapse('text')}) / 22)))::INTEGER AS seconds FROM documents""",
          seconds=lambda: C.reading_seconds(F.col("text")))
projected("clamp_limits", "part", ["p_partkey"], """SELECT p_partkey, greatest(1, least(15, p_size)) AS capped,
  CASE WHEN p_size > 0 THEN p_size END AS positive FROM part""", capped=lambda: C.clamp(F.col("p_size")),
          positive=lambda: C.positive_int(F.col("p_size").cast("string")))
projected("safe_json", "events", ["event_id"], """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (props::JSON ->> 'k')::INTEGER END AS k FROM events""",
          k=lambda: R.safe_json(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), "props")).otherwise(
              F.col("props")), "struct<k:int>")["k"])
projected("json_nested_flatten", "events", ["event_id"], """SELECT event_id, event_id::VARCHAR AS id, event_type AS title,
  (props::JSON ->> 'k') AS body FROM events""", id=lambda: _item()["id"], title=lambda: _item()["title"],
          body=lambda: _item()["text"])


def _item():
    from versarium.sources.readers import map_item
    doc = F.concat(F.lit('{"id": '), "event_id", F.lit(', "attributes": {"name": "'), "event_type",
                   F.lit('", "content": "'), F.get_json_object("props", "$.k"), F.lit('"}}'))
    return map_item(doc)


@query("json_array_from_text", """SELECT conv_id, turn, unnest([role, turn::VARCHAR]) AS item FROM conversations""")
def json_array_from_text(spark, sf_dir):
    prose = F.concat("text", F.lit(' Hier: ["'), "role", F.lit('", "'), "turn", F.lit('"] Ende.'))
    return load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.explode(R.json_array_from_text(prose)).alias("item"))


@query("similarity_score", """SELECT p_partkey, round(1 - levenshtein(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) /
  greatest(length(split_part(p_name, ' ', 1)), length(split_part(p_name, ' ', 2))), 6) AS score FROM part""")
def similarity_score(spark, sf_dir):
    pair = F.split("p_name", " ")
    return load(spark, sf_dir, "part").select("p_partkey", F.round(G.similarity(pair[0], pair[1]), 6).alias("score"))



