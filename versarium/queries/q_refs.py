"""Queries: references, verse ranges, translations."""

from pyspark.sql import functions as F

from versarium import dims
from versarium.operators import refs as R
from versarium.queries import inputs
from versarium.queries.registry import query
from versarium.session import load

_BOOKS = dims.sql_values([b[:4] for b in dims.books()], "b", ["book_ix", "abbr", "display", "nt"])
_NAMES = dims.sql_values([(b[0], b[2], t, b[4][t], b[3]) for b in dims.books() for t in dims.TRANSLATIONS], "nm",
                         ["book_ix", "display", "translation", "db_name", "nt"])
_CITING = f"""citing AS (SELECT o_orderkey, b.*, (o_orderkey % 29 + 1)::INTEGER AS c, (o_custkey % 20 + 1)::INTEGER AS s,
  (o_custkey % 20 + 1 + o_orderkey % 6)::INTEGER AS e FROM orders JOIN {_BOOKS} ON b.book_ix = o_custkey % 73)"""
_VERSES = f"""verses AS (SELECT nm.translation, nm.display, nm.db_name AS book, chapter, verse, min(t) AS text FROM (
  SELECT l_suppkey % 73 AS book_ix, CASE l_returnflag WHEN 'A' THEN 'allioli' WHEN 'N' THEN 'schoeningh' ELSE 'einheit' END AS tr,
    (l_orderkey % 30 + 1)::INTEGER AS chapter, (l_partkey % 40 + 1)::INTEGER AS verse, l_linestatus || l_linenumber AS t FROM lineitem) x
  JOIN {_NAMES} ON nm.book_ix = x.book_ix AND nm.translation = x.tr GROUP BY ALL)"""
_LABELS = f"""{_CITING}, lab AS (SELECT *, abbr || ' ' || c || ',' || s || '–' || e AS l1,
  'vgl. ' || display || ' ' || (c + 1) || ':' || s AS l2 FROM citing)"""
_FOUND = f"""{_LABELS}, found AS (
  SELECT o_orderkey, 6 AS "at", l1 AS label, display, c AS chapter, s AS start, e AS "end" FROM lab UNION ALL
  SELECT o_orderkey, 6 + length(l1) + 5, l2, display, c + 1, s, s FROM lab)"""
_RANGES = f"""{_CITING}, ranges AS (
  SELECT o_orderkey, 0 AS part, 0 AS item, display, c AS chapter, s AS start, e AS "end" FROM citing UNION ALL
  SELECT o_orderkey, 0, 1, display, c, e + 3, e + 4 FROM citing UNION ALL
  SELECT o_orderkey, 1, 0, display, c + 1, s, s FROM citing UNION ALL
  SELECT o_orderkey, 1, 1, display, c + 1, s + 2, s + 2 FROM citing)"""


@query("find_refs", f"""WITH {_FOUND} SELECT o_orderkey, "at"::INTEGER AS "at", length(label)::INTEGER AS length, label,
  display, chapter, start, "end" FROM found""")
def find_refs(spark, sf_dir):
    return R.find_refs(inputs.citing_texts(spark, sf_dir), ["o_orderkey"], "text")


@query("parse_lectionary_ref", f"WITH {_RANGES} SELECT o_orderkey, part, item, display, chapter, start, \"end\" FROM ranges")
def parse_lectionary_ref(spark, sf_dir):
    return R.parse_lectionary_ref(inputs.lectionary_refs(spark, sf_dir), ["o_orderkey"], "ref").drop("piece")


@query("cross_chapter_refs", f"""WITH {_CITING} SELECT o_orderkey, display, c + unnest([0, 1, 2]) AS chapter, unnest([s, 1, 1]) AS start,
  unnest([NULL, NULL, e]) AS "end" FROM citing""")
def cross_chapter_refs(spark, sf_dir):
    spaced = F.regexp_replace("abbr", r"^([123])", "$1 ")
    asked = inputs.citing(spark, sf_dir).select("o_orderkey", F.format_string(
        "%s %d, %d - %d, %d", spaced, "c", "s", F.col("c") + 2, "e").alias("ref"))
    return R.parse_lectionary_ref(asked, ["o_orderkey"], "ref").drop("part", "piece", "item")


@query("resolve_refs", f"""WITH {_RANGES}, {_VERSES} SELECT DISTINCT o_orderkey, r.display, translation, r.chapter, verse, text
  FROM ranges r JOIN verses v ON r.display = v.display AND r.chapter = v.chapter AND verse BETWEEN start AND "end" """)
def resolve_refs(spark, sf_dir):
    refs = R.parse_lectionary_ref(inputs.lectionary_refs(spark, sf_dir), ["o_orderkey"], "ref")
    return R.resolve_refs(refs, inputs.verses(spark, sf_dir), ["o_orderkey"])


_PSALMS = """psalms AS (SELECT o_orderkey, 0 AS part, 0 AS item, 'Psalmen' AS display, (o_orderkey % 31 + 1)::INTEGER AS chapter,
  (15 + o_custkey % 10)::INTEGER AS start, (17 + o_custkey % 10)::INTEGER AS "end" FROM orders)"""


@query("psalm_fallback", f"""WITH {_PSALMS}, {_VERSES}, direct AS (SELECT p.o_orderkey, translation, p.chapter, verse, text
    FROM psalms p JOIN verses v ON p.display = v.display AND p.chapter = v.chapter AND verse BETWEEN start AND "end"),
  missing AS (SELECT * FROM psalms WHERE (start >= 16 OR "end" >= 16) AND o_orderkey NOT IN
    (SELECT o_orderkey FROM direct WHERE translation = 'allioli'))
  SELECT * FROM direct UNION ALL SELECT m.o_orderkey, translation, m.chapter, verse, text FROM missing m JOIN verses v
    ON v.display = 'Psalmen' AND v.translation = 'allioli' AND v.chapter = m.chapter - 1 AND verse BETWEEN start AND "end" """)
def psalm_fallback(spark, sf_dir):
    refs = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit(0).alias("part"), F.lit(0).alias("item"),
        F.when(F.col("o_orderkey") >= 0, "Psalmen").alias("display"),
        (F.pmod("o_orderkey", F.lit(31)) + 1).cast("int").alias("chapter"),
        (15 + F.pmod("o_custkey", F.lit(10))).cast("int").alias("start"),
        (17 + F.pmod("o_custkey", F.lit(10))).cast("int").alias("end"))
    out = R.psalm_fallback(refs, inputs.verses(spark, sf_dir), ["o_orderkey"])
    return out.select("o_orderkey", "translation", "chapter", "verse", "text")


@query("parallel_translations", f"""WITH {_VERSES} SELECT display AS book_display, chapter, verse,
  min(text) FILTER (translation = 'allioli') AS allioli, min(text) FILTER (translation = 'schoeningh') AS schoeningh,
  min(text) FILTER (translation = 'einheit') AS einheit FROM verses GROUP BY ALL""")
def parallel_translations(spark, sf_dir):
    return R.parallel_translations(inputs.verses(spark, sf_dir))


@query("citation_graph", f"""WITH {_FOUND}, {_VERSES} SELECT f.display, f.chapter, verse, count(DISTINCT o_orderkey) AS n_works,
  count(*) AS n_citations FROM found f JOIN (SELECT DISTINCT display, chapter, verse FROM verses) v ON f.display = v.display
  AND f.chapter = v.chapter AND verse BETWEEN start AND "end" GROUP BY ALL""")
def citation_graph(spark, sf_dir):
    found = R.find_refs(inputs.citing_texts(spark, sf_dir), ["o_orderkey"], "text")
    return R.citation_graph(found, inputs.verses(spark, sf_dir), "o_orderkey")


@query("book_name_map", f"""WITH {_CITING} SELECT o_orderkey, nm.translation, nm.db_name, nm.nt
  FROM citing c JOIN {_NAMES} ON c.display = nm.display""")
def book_name_map(spark, sf_dir):
    books = inputs.citing(spark, sf_dir).select("o_orderkey", "display")
    return R.map_books(books, "display").select("o_orderkey", "translation", "db_name", "nt")


@query("display_book_name", f"WITH {_VERSES} SELECT display AS book_display, translation, chapter, verse FROM verses")
def display_book_name(spark, sf_dir):
    return R.display_books(inputs.verses(spark, sf_dir), "book", "translation").select(
        "book_display", "translation", "chapter", "verse")


@query("testament_of", f"""WITH {_VERSES} SELECT translation, nm.nt, count(*) AS n FROM verses v
  JOIN {_NAMES} USING (display, translation) GROUP BY ALL""")
def testament_of(spark, sf_dir):
    names = dims.book_names_df(spark).withColumnRenamed("db_name", "book")
    joined = inputs.verses(spark, sf_dir).join(F.broadcast(names), ["translation", "book"])
    return joined.groupBy("translation", "nt").agg(F.count(F.lit(1)).alias("n"))


@query("parse_query_ref", f"""WITH {_CITING} SELECT o_orderkey, display AS book, c AS chapter, CASE WHEN o_orderkey % 2 = 0 THEN s END AS start,
  CASE WHEN o_orderkey % 2 = 0 THEN e END AS "end" FROM citing""")
def parse_query_ref(spark, sf_dir):
    long = F.format_string(" %s %d:%d-%d", "display", "c", "s", "e")
    asked = inputs.citing(spark, sf_dir).select("o_orderkey", R.parse_query_ref(
        F.when(F.col("o_orderkey") % 2 == 0, long).otherwise(F.format_string("%s %d", "display", "c"))).alias("q"))
    return asked.select("o_orderkey", "q.book", "q.chapter", "q.start", "q.end")


_SEARCH = dims.sql_values([(i, a, d) for i, (a, d) in enumerate(dims.SEARCH_NAMES)], "sn", ["i", "a", "d"])


@query("abbrev_variants", f"""WITH {_CITING}, named AS (
    SELECT o_orderkey, a || ' ' || c || ':' || s AS variant FROM citing JOIN {_SEARCH} ON contains(lower(d), lower(display))
    UNION ALL SELECT o_orderkey, a || ' ' || c || ' ' || s FROM citing JOIN {_SEARCH} ON contains(lower(d), lower(display))
    UNION ALL SELECT o_orderkey, c || ':' || s FROM citing JOIN {_SEARCH} ON contains(lower(d), lower(display))
    UNION ALL SELECT o_orderkey, c || ' ' || s FROM citing JOIN {_SEARCH} ON contains(lower(d), lower(display))
    UNION ALL SELECT o_orderkey, p || ' ' || c || ':' || s FROM (SELECT *, replace(replace(replace(lower(display), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue') AS p FROM citing) WHERE length(p) <= 4
    UNION ALL SELECT o_orderkey, p || ' ' || c || ' ' || s FROM (SELECT *, replace(replace(replace(lower(display), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue') AS p FROM citing) WHERE length(p) <= 4)
  SELECT DISTINCT o_orderkey, variant FROM named""")
def abbrev_variants(spark, sf_dir):
    return inputs.citing(spark, sf_dir).select("o_orderkey", F.explode(
        R.abbrev_variants(F.col("display"), F.col("c"), F.col("s"))).alias("variant"))


_ALIASES = sorted({(dims.plain("".join(ch for ch in a if ch not in ". ")), d) for a, d in dims.book_aliases().items()})


@query("alias_expansion", f"""WITH {_CITING} SELECT o_orderkey, token FROM citing JOIN
  {dims.sql_values(_ALIASES, 'al', ['token', 'd'])} ON display = d""")
def alias_expansion(spark, sf_dir):
    aliases = R.alias_df(spark)
    return (inputs.citing(spark, sf_dir).select("o_orderkey", "display")
            .join(F.broadcast(aliases), "display").select("o_orderkey", "token"))
