"""Queries: joins and set operations."""

from pyspark.sql import functions as F

from versarium import dims
from versarium.operators import joins as J
from versarium.operators import setops as U
from versarium.queries import inputs
from versarium.queries.registry import projected, query
from versarium.rx import quote
from versarium.session import load

_STAR = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus, c_name, n_name FROM lineitem
  {0} JOIN {1} ON l_orderkey = o_orderkey {0} JOIN customer ON o_custkey = c_custkey
  {0} JOIN nation ON c_nationkey = n_nationkey"""
_KEYS = [("l_orderkey", "o_orderkey"), ("o_custkey", "c_custkey"), ("c_nationkey", "n_nationkey")]
_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus", "c_name", "n_name"]


@query("passage_hierarchy", _STAR.format("INNER", "orders"))
def passage_hierarchy(spark, sf_dir):
    return J.passage_hierarchy(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders"),
                               load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"), _KEYS).select(*_COLS)


@query("passage_hierarchy_left", _STAR.format("LEFT", "(SELECT * FROM orders WHERE o_orderstatus = 'F')"))
def passage_hierarchy_left(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return J.passage_hierarchy(load(spark, sf_dir, "lineitem"), orders, load(spark, sf_dir, "customer"),
                               load(spark, sf_dir, "nation"), _KEYS, "left").select(*_COLS)


@query("council_docs", """SELECT o_orderkey, coalesce(c_custkey, o_custkey)::VARCHAR AS council,
  coalesce(c_name, o_custkey::VARCHAR) AS council_title FROM orders LEFT JOIN
  (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def council_docs(spark, sf_dir):
    rich = load(spark, sf_dir, "customer").where("c_acctbal > 0")
    out = J.council_docs(load(spark, sf_dir, "orders"), rich, "o_custkey", "c_custkey", "c_name")
    return out.select("o_orderkey", "council", "council_title")


@query("sections_with_content", """WITH filled AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45))
  SELECT o_orderkey, o_custkey FROM filled UNION ALL
  SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM filled)""")
def sections_with_content(spark, sf_dir):
    sections = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    big = load(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.sections_with_content(sections, big, "o_custkey", "o_orderkey")


@query("embedding_backlog", """SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def embedding_backlog(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return J.backlog(docs, load(spark, sf_dir, "labels"), "doc_id")


@query("note_links", """SELECT l_suppkey, l_partkey, l_orderkey AS first_link, p_name FROM (SELECT *, row_number() OVER
  (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey) AS rn FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE rn = 1""")
def note_links(spark, sf_dir):
    links = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey")
    notes = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    out = J.note_links(links, notes, "l_suppkey", "l_partkey", "l_orderkey")
    return out.select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("first_link"), "p_name")


@query("cache_lookup", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def cache_lookup(spark, sf_dir):
    return J.cache_lookup(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), "doc_id")


@query("cache_miss", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def cache_miss(spark, sf_dir):
    asked = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    return J.backlog(asked, load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "conv_id"), "conv_id")


@query("key_lookup", """SELECT asked, p_partkey, p_brand FROM (SELECT asked, p_partkey, p_brand, row_number() OVER (PARTITION BY asked
    ORDER BY CASE WHEN p_partkey::VARCHAR = asked THEN 0 WHEN p_brand = asked THEN 1 END NULLS LAST, p_partkey, p_brand) AS rn FROM (
    SELECT DISTINCT l_partkey::VARCHAR AS asked FROM lineitem UNION ALL SELECT DISTINCT p_brand FROM part UNION ALL SELECT 'none')
  LEFT JOIN part ON p_partkey::VARCHAR = asked OR p_brand = asked) WHERE rn = 1""")
def key_lookup(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ids = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("asked")).distinct()
    names = parts.select(F.col("p_brand").alias("asked")).distinct()
    none = dims.constant(spark, [("none",)], "asked string")
    return J.key_lookup(ids.unionByName(names).unionByName(none), parts, "asked", "p_partkey", "p_brand").select("asked", "p_partkey", "p_brand")


@query("favorites", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def favorites(spark, sf_dir):
    chosen = load(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return J.favorites(load(spark, sf_dir, "part").select("p_partkey", "p_name"), chosen, "p_partkey")


@query("name_corrections", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Sparsam' WHEN 'SMALL' THEN 'Klein' ELSE p_type END AS kind FROM part""")
def name_corrections(spark, sf_dir):
    fixes = [("ECONOMY", "Sparsam"), ("SMALL", "Klein")]
    return J.corrected(load(spark, sf_dir, "part"), "p_type", fixes, "kind").select("p_partkey", "kind")


projected("available_hours", "events", ["event_id"], f"""SELECT event_id, CASE (event_id % 8)::INT
  {' '.join(f"WHEN {i} THEN {quote(h[2])}" for i, h in enumerate(dims.OFFICE_HOURS))} END AS hour_name FROM events""",
          hour_name=lambda: F.try_element_at(dims.literal_map([(h[0], h[2]) for h in dims.OFFICE_HOURS]), F.element_at(
              F.array(*[F.lit(h[0]) for h in dims.OFFICE_HOURS]), (F.col("event_id") % 8 + 1).cast("int"))))

_BOOKS = dims.sql_values([(b[2], b[2].lower()) for b in dims.books()], "b", ["book", "low"])
_PARTS = dims.sql_values(sorted(J._name_parts().items()), "pt", ["a", "n"])


@query("book_lookup_fuzzy", f"""WITH q AS (SELECT p_partkey, lower(p_name) AS low FROM part)
  SELECT p_partkey, book FROM q JOIN {_BOOKS} ON contains(b.low, q.low) OR contains(q.low, b.low) OR EXISTS
    (SELECT 1 FROM {_PARTS} WHERE contains(q.low, pt.a) AND contains(b.low, pt.n))""")
def book_lookup_fuzzy(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    return parts.select("p_partkey", F.explode(J.book_lookup(F.col("p_name"))).alias("book"))


_NAV = [(b[1], [b[1], b[2], b[4]["allioli"]], 20 + b[0]) for b in dims.books()]
_NAV_SQL = dims.sql_values([(i, b[0], label.lower(), b[2]) for i, b in enumerate(_NAV) for label in b[1]], "nv",
                           ["i", "abbr", "label", "chapters"])


@query("longest_prefix", f"""WITH q AS (SELECT o_orderkey, lower(display || ' ' || (o_orderkey % 60)) AS t FROM orders JOIN
    {dims.sql_values([(b[0], b[2]) for b in dims.books()], 'bk', ['ix', 'display'])} ON ix = o_custkey % 73),
  best AS (SELECT q.*, nv.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(label) DESC, i) AS rn FROM q JOIN {_NAV_SQL} ON starts_with(t, label))
  SELECT o_orderkey, abbr, CASE WHEN regexp_matches(rest, '^[0-9]+$') AND TRY_CAST(rest AS INTEGER) BETWEEN 1 AND chapters THEN TRY_CAST(rest AS INTEGER) END AS chapter
  FROM (SELECT *, trim(substring(t, length(label) + 1)) AS rest FROM best WHERE rn = 1)""")
def longest_prefix(spark, sf_dir):
    asked = inputs.citing(spark, sf_dir).select("o_orderkey", F.concat(
        F.lit(" "), "display", F.lit(" "), (F.col("o_orderkey") % 60).cast("string")).alias("t"))
    return J.longest_prefix(asked, ["o_orderkey"], "t", _NAV)


projected("label_match", "supplier", ["s_suppkey"], """SELECT s_suppkey, true AS near, false AS far FROM supplier""",
          near=lambda: J.label_match(F.lit("SUPPLIER#"), F.col("s_name")),
          far=lambda: J.label_match(F.lit("supplier#"), F.concat("s_name", F.repeat(F.lit("x"), F.lit(30)))))
projected("work_title", "part", ["p_partkey"], """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name WHEN p_size > 10 THEN p_brand
  ELSE 'Unbekanntes Werk' END AS title FROM part""", title=lambda: J.work_title(
      F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(""), F.when(F.col("p_size") > 10, F.col("p_brand"))))


@query("union_all", """SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def union_all(spark, sf_dir):
    return U.union_all([load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
                        load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))])


@query("ordered_union", """SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL
  SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def ordered_union(spark, sf_dir):
    first = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    second = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return U.ordered_union([first, second], "id")


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def distinct_rows(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()


@query("difference", """SELECT c_custkey AS k, 'before' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + 5 FROM orders)
  UNION ALL SELECT DISTINCT o_custkey + 5, 'after' FROM orders WHERE o_custkey + 5 NOT IN (SELECT c_custkey FROM customer)""")
def difference(spark, sf_dir):
    before = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    after = load(spark, sf_dir, "orders").select((F.col("o_custkey") + 5).alias("k"))
    return U.changes(before, after, "k")


@query("header_detail_rows", """SELECT DISTINCT o_custkey, 0 AS level, NULL::BIGINT AS o_orderkey, o_custkey::VARCHAR AS label FROM orders
  UNION ALL SELECT o_custkey, 1, o_orderkey, o_orderpriority FROM orders""")
def header_detail_rows(spark, sf_dir):
    return U.header_detail_rows(load(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("fallback_source", """SELECT doc_id, 'a' AS src FROM labels WHERE quality = 1 UNION ALL
  SELECT conv_id, 'd' FROM conversations""")
def fallback_source(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    good = labels.where("quality = 1").select("doc_id", F.lit("a").alias("src"))
    unused = labels.select("doc_id", F.lit("b").alias("src"))
    none = labels.where("quality > 9").select("doc_id", F.lit("c").alias("src"))
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("d").alias("src"))
    return U.fallback_source(good, unused).unionByName(U.fallback_source(none, turns))


