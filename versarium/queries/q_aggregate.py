"""Queries: corpus statistics, windows, order and limits."""

from pyspark.sql import functions as F

from versarium import dims
from versarium.functions import classify as C
from versarium.functions import text as T
from versarium.operators import aggregate as A
from versarium.operators import ordered as O
from versarium.queries import sqlkit as S
from versarium.queries.registry import projected, query
from versarium.session import load, load_text


@query("rows_per_source_top", """SELECT source, count(*) AS n_rows FROM documents GROUP BY source
  ORDER BY n_rows DESC, source LIMIT 10""")
def rows_per_source_top(spark, sf_dir):
    return A.rows_per_key(load(spark, sf_dir, "documents"), "source", 10)


@query("corpus_totals", f"""SELECT count(*) AS n_rows, count(DISTINCT source) AS n_authors,
  count(DISTINCT lang) AS n_works, sum(w)::BIGINT AS n_words, round(sum(w) / count(*), 4) AS mean_words
  FROM (SELECT source, lang, {S.n_words('text')} AS w FROM documents)""")
def corpus_totals(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents").withColumn("w", T.word_count(F.col("text")))
    return A.corpus_totals(docs, "source", "lang", "w")


@query("works_per_author", """SELECT l_suppkey, count(DISTINCT l_partkey) AS n_works, count(*) AS n_entries,
  round(count(*) / count(DISTINCT l_partkey), 4) AS mean_entries FROM lineitem GROUP BY l_suppkey""")
def works_per_author(spark, sf_dir):
    return A.works_per_author(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("distinct_values", "SELECT DISTINCT source FROM documents")
def distinct_values(spark, sf_dir):
    return A.distinct_values(load(spark, sf_dir, "documents"), "source")


_ROLES = ["user", "assistant", "system"]


@query("qa_rollup", """SELECT conv_id, count(*) AS n_rows, count(*) FILTER (role = 'user') AS n_user,
  count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system,
  CASE WHEN n_user >= n_assistant AND n_user >= n_system THEN 'user'
    WHEN n_assistant >= n_system THEN 'assistant' ELSE 'system' END AS dominant_role,
  (n_user > 0)::INT AS has_user, (n_assistant > 0)::INT AS has_assistant, (n_system > 0)::INT AS has_system
  FROM conversations GROUP BY conv_id""")
def qa_rollup(spark, sf_dir):
    return A.qa_rollup(load(spark, sf_dir, "conversations"), ["conv_id"], "role", _ROLES)


@query("structure_summary", """SELECT conv_id, string_agg(role || '=' || n, ',' ORDER BY role) AS summary FROM (
  SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""")
def structure_summary(spark, sf_dir):
    out = A.structure_summary(load(spark, sf_dir, "conversations"), ["conv_id"], "role")
    shown = F.transform(F.map_entries("summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("conv_id", F.array_join(shown, ",").alias("summary"))


@query("max_chapter", "SELECT l_orderkey, max(l_linenumber) AS max_chapter FROM lineitem GROUP BY l_orderkey")
def max_chapter(spark, sf_dir):
    return A.max_per_key(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "max_chapter")


@query("group_collect", """SELECT o_custkey, page, count(*) AS n_items,
    string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY rn) AS items FROM (
    SELECT *, ((rn - 1) // 4 + 1)::INTEGER AS page FROM (SELECT *, row_number() OVER
      (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)) GROUP BY o_custkey, page""")
def group_collect(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    out = A.group_collect(orders, ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderstatus"], 4)
    shown = F.transform("items", lambda i: F.concat(i["o_orderkey"].cast("string"), F.lit(":"), i["o_orderstatus"]))
    return out.withColumn("items", F.array_join(shown, ","))


@query("extraction_stats", """SELECT count(*) AS n_works, sum(n)::BIGINT AS n_segments,
  sum(f)::BIGINT AS n_footnotes, sum(i)::BIGINT AS n_introductions,
  round(100 * count(*) FILTER (n > 1) / count(*), 1) AS rate FROM (SELECT conv_id, count(*) AS n,
    count(*) FILTER (role = 'assistant') AS f, count(*) FILTER (role = 'system') AS i
    FROM conversations GROUP BY conv_id)""")
def extraction_stats(spark, sf_dir):
    kinds = load(spark, sf_dir, "conversations").select("conv_id", F.when(
        F.col("role") == "assistant", "footnote").when(F.col("role") == "system", "introduction").alias("kind"))
    return A.extraction_stats(kinds, "conv_id", "kind")


@query("works_counts_file", """SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem
  GROUP BY l_suppkey, l_partkey""")
def works_counts_file(spark, sf_dir):
    return A.role_counts(load(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey")


@query("distinct_books_like", "SELECT DISTINCT p_name FROM part WHERE regexp_matches(p_name, '(?i)ring|bolt|gear|nut')")
def distinct_books_like(spark, sf_dir):
    return A.distinct_like(load(spark, sf_dir, "part"), "p_name", ["ring", "bolt", "gear", "nut"])


@query("first_last_sample", """SELECT source, min_by(text, doc_id) AS first_text, max_by(text, doc_id) AS last_text
  FROM documents GROUP BY source""")
def first_last_sample(spark, sf_dir):
    return A.first_last(load(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("section_no", """SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS section
  FROM documents""")
def section_no(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return O.number_rows(docs, ["source"], "doc_id", "section").withColumn("section", F.col("section").cast("bigint"))


@query("row_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders")
def row_id(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    out = O.number_rows(orders, (), "o_orderkey", "row_id", ranges=16)
    return out.withColumn("row_id", F.col("row_id").cast("bigint"))


@query("batch_no", """SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::INTEGER + 1
  AS batch_no FROM orders""")
def batch_no(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    return O.batch_no(orders, "o_orderkey", 1000, ranges=16)


@query("carry_forward", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn) AS last_user FROM conversations""")
def carry_forward(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("said"))
    return O.carry_forward(turns, ["conv_id"], "turn", "said", "last_user").select("conv_id", "turn", "last_user")


@query("carry_forward_split", """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END
  IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS last_error FROM events""")
def carry_forward_split(spark, sf_dir):
    events = load(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") == "error", F.col("event_id")).alias("err"))
    # so many ranges that users go on from one into the next
    return O.carry_forward(events, ["user_id"], "event_id", "err", "last_error", ranges=24) \
        .select("event_id", "user_id", "last_error")


@query("latest_per_key", """SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER
  (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(spark, sf_dir):
    return O.first_per_key(load(spark, sf_dir, "events").select("event_type", "event_id", "ts"),
                           ["event_type"], F.desc("ts"), F.desc("event_id"))


@query("first_n_unique", """SELECT user_id, event_type, first_id FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY first_id) AS rn FROM (SELECT user_id, event_type, min(event_id) AS first_id
  FROM events GROUP BY user_id, event_type)) WHERE rn <= 3""")
def first_n_unique(spark, sf_dir):
    firsts = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    return O.top_per_key(firsts, ["user_id"], 3, "first_id").drop("rank_")


@query("format_preference", """SELECT l_orderkey, l_shipmode, l_linenumber FROM (SELECT l_orderkey, l_linenumber, m AS l_shipmode,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY p, l_linenumber, l_partkey, l_suppkey) AS rn FROM (
    SELECT *, CASE l_returnflag WHEN 'A' THEN 'epub' WHEN 'N' THEN 'pdf' ELSE 'txt' END AS m,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 9 END AS p FROM lineitem)) WHERE rn = 1""")
def format_preference(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "epub").when(F.col("l_returnflag") == "N", "pdf").otherwise("txt")
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                   kind.alias("l_shipmode"))
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in ("epub", "docx", "pdf", "rtf")]),
                                                 F.col("l_shipmode")), F.lit(0).cast("bigint")), F.lit(99))
    return (O.first_per_key(items, ["l_orderkey"], order, "l_linenumber", "l_partkey", "l_suppkey")
            .select("l_orderkey", "l_shipmode", "l_linenumber"))


@query("main_celebration", """SELECT user_id, coalesce(min(event_id) FILTER (event_type = 'error'), max(event_id)) AS main_id
  FROM events GROUP BY user_id""")
def main_celebration(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(
        F.min(F.when(F.col("event_type") == "error", F.col("event_id"))), F.max("event_id")).alias("main_id"))


@query("hour_band", """SELECT band, count(*) AS n FROM (SELECT CASE WHEN h BETWEEN 5 AND 11 THEN 'morning'
  WHEN h BETWEEN 12 AND 16 THEN 'day' WHEN h BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS band
  FROM (SELECT hour(ts) AS h FROM events)) GROUP BY band""")
def hour_band(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(C.hour_band(F.col("ts")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _case(expr, values, start=0):
    return f"CASE {expr} " + " ".join(f"WHEN {i + start} THEN '{v}'" for i, v in enumerate(values)) + " END"


projected("weekday_label", "events", ["event_id"], f"""SELECT event_id, {_case('dayofweek(ts)', dims.WEEKDAYS)} AS weekday,
  {_case('dayofweek(ts)', dims.WEEKDAY_CATEGORY)} AS category,
  {_case('dayofweek(ts)', dims.WEEKDAYS)} || ', ' || day(ts) || '. ' || {_case('month(ts)', dims.MONTHS, 1)} AS title
  FROM events""", weekday=lambda: C.weekday_label(F.col("ts")), category=lambda: C.weekday_category(F.col("ts")),
          title=lambda: C.day_title(F.col("ts")))
projected("german_date", "orders", ["o_orderkey"], f"""SELECT o_orderkey, strftime(o_orderdate, '%d') || '. ' ||
  {_case('month(o_orderdate)', dims.MONTHS, 1)} || ' ' || year(o_orderdate) AS shown, o_orderpriority AS kept FROM orders""",
          shown=lambda: C.german_date(F.date_format("o_orderdate", "yyyy-MM-dd")),
          kept=lambda: C.german_date(F.col("o_orderpriority")))


@query("sort_nulls_last", """SELECT c_custkey, year FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal::INTEGER END AS year FROM customer)
  ORDER BY year DESC NULLS LAST, c_custkey""")
def sort_nulls_last(spark, sf_dir):
    year = F.when(F.col("c_acctbal") > 0, F.bround("c_acctbal").cast("int"))
    return O.sort_by_year(load(spark, sf_dir, "customer").select("c_custkey", year.alias("year")), "year", "c_custkey", descending=True)


@query("sort_by_name", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey")
def sort_by_name(spark, sf_dir):
    return O.sort_by_name(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("sort_author_work", "SELECT l_suppkey, l_partkey, l_linenumber, l_orderkey FROM lineitem ORDER BY ALL")
def sort_author_work(spark, sf_dir):
    keys = ["l_suppkey", "l_partkey", "l_linenumber", "l_orderkey"]
    return load(spark, sf_dir, "lineitem").select(*keys).orderBy(*keys)


@query("sort_ordinal_title", "SELECT p_partkey, p_size, p_name FROM part ORDER BY nullif(p_size, 1) ASC NULLS LAST, p_name, p_partkey")
def sort_ordinal_title(spark, sf_dir):
    return (load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
            .orderBy(F.nullif(F.col("p_size"), F.lit(1)).asc_nulls_last(), "p_name", "p_partkey"))


@query("sort_numeric_verse", """SELECT o_orderkey, v FROM (SELECT o_orderkey, replace(o_orderpriority, '-LOW', '') AS v FROM orders)
  ORDER BY TRY_CAST(v AS INTEGER) ASC NULLS LAST, o_orderkey""")
def sort_numeric_verse(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.replace("o_orderpriority", F.lit("-LOW"), F.lit("")).alias("v"))
    return orders.orderBy(F.col("v").try_cast("int").asc_nulls_last(), "o_orderkey")


@query("limit_n", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20")
def limit_n(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(20)


_ORDER = ["view", "click", "purchase", "signup", "error"]


@query("fixed_display_order", f"""SELECT event_type, pos, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
  JOIN {dims.sql_values([(k, i) for i, k in enumerate(_ORDER)], 'o', ['event_type', 'pos'])} USING (event_type)""")
def fixed_display_order(spark, sf_dir):
    rank = dims.constant(spark, list(enumerate(_ORDER)), "pos int, event_type string")
    counts = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(rank), "event_type").orderBy("pos").select("event_type", "pos", "n")
