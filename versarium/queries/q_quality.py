"""Queries: predicates, quality gate, duplicates, audit reports."""

from pyspark.sql import functions as F

from versarium import patterns as P
from versarium.functions import predicates as Q
from versarium.functions import text as T
from versarium.operators import quality as K
from versarium.plans import corpus
from versarium.queries import inputs, sqlkit as S
from versarium.queries.registry import projected, query
from versarium.rx import quote
from versarium.session import load, load_text

_CLEAN = S.staged("SELECT doc_id, source, text AS t FROM documents", S.deep_clean_steps())
_KEPT = f"""SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY doc_id) AS rn FROM (
      SELECT *, {S.copy_key('t', 'doc_id')} AS k FROM ({_CLEAN}) WHERE {S.valid('t')}))
  WHERE rn = 1 AND {S.n_words('t')} >= 15"""


@query("corpus_quality", f"""
  SELECT coalesce(source, '(all)') AS source, original, cleaned, original - cleaned AS removed FROM (
    SELECT source, sum(n)::BIGINT AS original, sum(m)::BIGINT AS cleaned FROM (
      SELECT source, count(*) AS n, 0 AS m FROM documents GROUP BY source UNION ALL
      SELECT source, 0, count(*) FROM ({_KEPT}) GROUP BY source) GROUP BY ROLLUP (source))""")
def corpus_quality(spark, sf_dir):
    return corpus.corpus_quality(load_text(spark, sf_dir, "documents", "doc_id", "source", "text"))


@query("quality_gate", f"SELECT doc_id, source, t AS text, {S.n_words('t')} AS n_words FROM ({_KEPT})")
def quality_gate(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "source", "text")
    return K.quality_gate(docs, "text", "doc_id", ["source"])


_T = S.trim("text")
projected("valid_text", "documents", ["doc_id"],
          f"SELECT doc_id, {S.valid('t')} AS valid FROM (SELECT doc_id, {_T} AS t FROM documents)",
          valid=lambda: Q.valid_text(F.col("text")))
projected("min_words", "documents", ["doc_id"],
          f"SELECT doc_id, {S.n_words('text')} >= 15 AS enough FROM documents",
          enough=lambda: Q.min_words(F.col("text")))
projected("substantive", "documents", ["doc_id"],
          f"SELECT doc_id, length({_T}) > 100 AS long_enough FROM documents",
          long_enough=lambda: Q.substantive(F.col("text"), 100))
projected("unwanted_content", "documents", ["doc_id"], f"""
  SELECT doc_id, {P.UNWANTED.sql_found("lower(text || ' Datenschutz')")} AS marked,
    {P.UNWANTED.sql_found('lower(text)')} AS unwanted FROM documents""",
          marked=lambda: Q.unwanted_content(F.concat("text", F.lit(" Datenschutz"))),
          unwanted=lambda: Q.unwanted_content(F.col("text")))
projected("unwanted_words", "documents", ["doc_id"],
          "SELECT doc_id, " + " OR ".join(f"contains(lower(text), {quote(w)})" for w in P.UNWANTED_WORDS)
          + " AS unwanted FROM documents", unwanted=lambda: Q.unwanted_words(F.col("text")))


@query("contains_filter", "SELECT doc_id, n_chars FROM documents WHERE contains(text, 'tion')")
def contains_filter(spark, sf_dir):
    return (load(spark, sf_dir, "documents").where(Q.contains_text(F.col("text"), "tion"))
            .select("doc_id", "n_chars"))


@query("ci_contains_any", """SELECT p_partkey, p_name, p_type FROM part
  WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')""")
def ci_contains_any(spark, sf_dir):
    return (load(spark, sf_dir, "part")
            .where(Q.ci_contains_any([F.col("p_name"), F.col("p_type")], "Ring"))
            .select("p_partkey", "p_name", "p_type"))


@query("point_range", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
  WHERE l_returnflag = 'A' AND l_suppkey = 7 AND l_partkey BETWEEN 100 AND 900""")
def point_range(spark, sf_dir):
    return (load(spark, sf_dir, "lineitem")
            .where(Q.point_range(F.col("l_returnflag"), F.col("l_suppkey"), F.col("l_partkey"),
                                 "A", 7, 100, 900)).select("l_orderkey", "l_linenumber", "l_quantity"))


@query("exclude_special", """SELECT c_custkey, c_mktsegment FROM customer
  WHERE lower(c_mktsegment) NOT IN ('machinery', 'rosenkranz')""")
def exclude_special(spark, sf_dir):
    return (load(spark, sf_dir, "customer")
            .where(Q.ordinary_category(F.col("c_mktsegment"), ("machinery", "rosenkranz")))
            .select("c_custkey", "c_mktsegment"))


@query("nonempty_ref", f"SELECT conv_id, turn FROM conversations WHERE {S.trim('text')} <> ''")
def nonempty_ref(spark, sf_dir):
    return (load(spark, sf_dir, "conversations").where(Q.nonempty_ref(F.col("text")))
            .select("conv_id", "turn"))


@query("error_page", f"SELECT page_id, contains(html, {quote(P.ERROR_PAGE)}) AS missing FROM pages")
def error_page(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", Q.error_page(F.col("html")).alias("missing"))


@query("size_window", """SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey
  HAVING count(*) BETWEEN 5 AND 50""")
def size_window(spark, sf_dir):
    return K.size_window(load(spark, sf_dir, "orders"), "o_custkey")


projected("leading_number", "documents", ["doc_id"], """
  SELECT doc_id, CASE WHEN length(rest) > 30 THEN doc_id::VARCHAR END AS verse,
    CASE WHEN length(rest) > 30 THEN rest END AS body
  FROM (SELECT doc_id, regexp_extract(doc_id || '. ' || replace(text, chr(10), ' '),
    '^(\\p{Nd}+)\\.?[\\s]*(.*)$', 2) AS rest FROM documents)""",
          verse=lambda: Q.number_rest(_numbered())["verse"], body=lambda: Q.number_rest(_numbered())["text"])


def _numbered():
    return F.concat(F.col("doc_id").cast("string"), F.lit(". "), F.replace("text", F.lit("\n"), F.lit(" ")))


@query("dup_key_first", f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER
  (PARTITION BY source, {S.copy_key('text', 'doc_id')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dup_key_first(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "source", "text")
    return K.keep_first_duplicate(docs, "text", "doc_id", ["source"]).select("doc_id", "source")


@query("dup_whole_text_first", f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER
  (PARTITION BY {S.copy_key('text', 'doc_id')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dup_whole_text_first(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "text")
    return K.keep_first_duplicate(docs, "text", "doc_id").select("doc_id")


@query("dedup_in_page", f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER
  (PARTITION BY source, {S.collapse('text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedup_in_page(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "source", "text")
    docs = docs.withColumn("text", T.collapse_ws(F.col("text")))
    return K.dedup_exact(docs, "text", "doc_id", ["source"]).select("doc_id", "source")


@query("duplicate_ids", "SELECT (count(*) - count(DISTINCT l_orderkey))::BIGINT AS duplicates FROM lineitem")
def duplicate_ids(spark, sf_dir):
    return K.duplicate_ids(load(spark, sf_dir, "lineitem"), "l_orderkey")


_PROFILE = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
            ("n_chars", "bigint")]


@query("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS type, count(*) - count({c}) AS n_null FROM documents"
    for c, t in _PROFILE))
def column_profile(spark, sf_dir):
    return K.column_profile(load(spark, sf_dir, "documents"))


@query("length_profile", """SELECT max(length(text))::BIGINT AS max_length,
  round(avg(length(text)), 4) AS mean_length FROM documents""")
def length_profile(spark, sf_dir):
    return K.length_profile(load(spark, sf_dir, "documents"), "text")


@query("astral_count", """SELECT count(*) FILTER (regexp_matches(text || CASE WHEN lang = 'de' THEN chr(128512)
  ELSE '' END, '[\\x{10000}-\\x{10FFFF}]')) AS n_astral FROM documents""")
def astral_count(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.concat(
        "text", F.when(F.col("lang") == "de", "\U0001F600").otherwise("")).alias("text"))
    return K.astral_count(docs, "text")


_ISSUE = "CASE " + " ".join(f"WHEN {rx.sql_found('t')} THEN '{n}'" for n, rx in P.SUSPICIOUS) + " END"
_ISSUES = f"""list_filter([{_ISSUE}, CASE WHEN length({S.trim('t')}) < 50 THEN 'short_text' END,
  CASE WHEN {S.n_words('t')} < 15 THEN 'few_words' END], lambda x: x IS NOT NULL)"""


@query("artifact_report", f"""SELECT source, issue, count(*) AS n FROM (
  SELECT source, unnest({_ISSUES}) AS issue FROM {S.MARKED}) GROUP BY ALL""")
def artifact_report(spark, sf_dir):
    return K.artifact_report(inputs.marked_documents(spark, sf_dir), "source", "t")


@query("artifact_examples", f"""SELECT source, doc_id, issue, tail, rank_ FROM (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id, pos))::INTEGER AS rank_ FROM (
    SELECT source, doc_id, tail, unnest(i) AS issue, generate_subscripts(i, 1) AS pos FROM (
      SELECT source, doc_id, right(t, 100) AS tail, {_ISSUES} AS i FROM {S.MARKED}))) WHERE rank_ <= 3""")
def artifact_examples(spark, sf_dir):
    return K.artifact_examples(inputs.marked_documents(spark, sf_dir), "source", "t", "doc_id")


@query("before_after_rollup", """SELECT coalesce(lang, '(all)') AS lang, sum(n)::BIGINT AS original,
  sum(m)::BIGINT AS cleaned, (sum(n) - sum(m))::BIGINT AS removed FROM (
  SELECT d.lang, 1 AS n, (l.doc_id IS NOT NULL)::INT AS m FROM documents d LEFT JOIN labels l
  ON d.doc_id = l.doc_id AND l.quality = 1) GROUP BY ROLLUP (lang)""")
def before_after_rollup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    good = load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = K.before_after(docs, docs.join(good, "doc_id", "left_semi"), "lang")
    return out.withColumn("lang", F.coalesce("lang", F.lit("(all)")))


_RULES = """CASE WHEN NOT coalesce(o_totalprice > 1000, false) THEN 'price'
  WHEN NOT coalesce(o_orderstatus <> 'P', false) THEN 'status' END"""


@query("accepted_rows", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_RULES} IS NULL")
def accepted_rows(spark, sf_dir):
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") != "P"}
    good, _ = K.split_good_reject(load(spark, sf_dir, "orders"), rules)
    return good.select("o_orderkey", "o_orderstatus")


@query("reject_sink", f"SELECT o_orderkey, {_RULES} AS reject_reason FROM orders WHERE {_RULES} IS NOT NULL")
def reject_sink(spark, sf_dir):
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") != "P"}
    _, rejected = K.split_good_reject(load(spark, sf_dir, "orders"), rules)
    return rejected.select("o_orderkey", "reject_reason")
