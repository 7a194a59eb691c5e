"""Queries: sinks, streams and whole jobs."""

import uuid

from pyspark.sql import functions as F

from versarium import dims
from versarium.operators import refs as R
from versarium.operators import segment as G
from versarium.functions import sqlreg
from versarium.functions import text as T
from versarium import patterns as P
from versarium.patterns import SPACES, WORD_FORM
from versarium.plans import corpus
from versarium.queries import inputs, sqlkit as S
from versarium.queries.q_refs import _CITING, _VERSES
from versarium.queries.q_search import _NEAREST, centroids
from versarium.queries.q_segment import _EXPECTED, _SPOKEN, _near
from versarium.queries.registry import query
from versarium.rx import sql_chain
from versarium.session import ensure_checkpoint_dir, load, load_text
from versarium.sources import writers
from versarium.streaming import jobs


def scratch(spark):
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/flow-{uuid.uuid4().hex}"


@query("upsert_by_key", """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def upsert_by_key(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    old, new = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'")
    return writers.merge_latest(old, new, ["o_custkey"], "o_orderkey")


@query("upsert_versions", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderstatus = 'P' DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def upsert_versions(spark, sf_dir):
    path = scratch(spark)
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    writers.upsert(orders.where("o_orderstatus <> 'P'"), path, ["o_custkey"], 1, F.desc("o_orderkey"))
    writers.upsert(orders.where("o_orderstatus = 'P'"), path, ["o_custkey"], 2, F.desc("o_orderkey"))
    return writers.read_latest(spark, path, ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("write_partitioned", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def write_partitioned(spark, sf_dir):
    path = scratch(spark)
    writers.write_partitioned(load(spark, sf_dir, "documents"), path, "lang")
    stored = spark.read.parquet(path)
    return stored.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("latest_per_key_stream", """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type
  ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key_stream(spark, sf_dir):
    path = scratch(spark)
    stream = jobs.table_stream(spark, sf_dir, "events", load(spark, sf_dir, "events").schema)
    jobs.latest_stream(stream, "event_type", ["ts", "event_id"], ["event_id"], f"{path}/t", f"{path}/c")
    return writers.read_latest(spark, f"{path}/t", ["event_type"])


@query("upsert_stream", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_stream(spark, sf_dir):
    path = scratch(spark)
    stream = jobs.table_stream(spark, sf_dir, "events", load(spark, sf_dir, "events").schema).select("user_id", "event_id")
    jobs.upsert_stream(stream, f"{path}/t", ["user_id"], f"{path}/c", F.desc("event_id"))
    return writers.read_latest(spark, f"{path}/t", ["user_id"], order=[F.desc("event_id")])


@query("ingest_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def ingest_stream(spark, sf_dir):
    path = scratch(spark)
    jobs.ingest(jobs.table_stream(spark, sf_dir, "events", load(spark, sf_dir, "events").schema), f"{path}/t", f"{path}/c")
    return spark.read.parquet(f"{path}/t").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("backlog_stream", "SELECT doc_id, 64 AS n_dims FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def backlog_stream(spark, sf_dir):
    path = scratch(spark)
    stream = jobs.table_stream(spark, sf_dir, "documents", load(spark, sf_dir, "documents").schema)
    jobs.backlog_stream(stream, load(spark, sf_dir, "labels"), "doc_id", "text", f"{path}/t", f"{path}/c")
    return writers.read_latest(spark, f"{path}/t", ["doc_id"]).select("doc_id", F.size("embedding").alias("n_dims"))


@query("align_stream", f"""WITH w AS (SELECT conv_id, turn, {_EXPECTED} AS e, {_SPOKEN} AS s FROM conversations),
  said AS (SELECT conv_id, flatten(list(s ORDER BY turn)) AS s FROM w GROUP BY conv_id),
  goal AS (SELECT conv_id, flatten(list(e ORDER BY turn)) AS e FROM w GROUP BY conv_id)
  SELECT conv_id, list_reduce(s, lambda a, x: CASE WHEN a >= len(e) THEN a WHEN {_near('a + 1')} THEN a + 1 WHEN {_near('a + 2')} THEN a + 2
    WHEN {_near('a + 3')} THEN a + 3 ELSE a END, 0::INTEGER)::INTEGER AS pointer FROM said JOIN goal USING (conv_id)""")
def align_stream(spark, sf_dir):
    path = scratch(spark)
    turns = load(spark, sf_dir, "conversations")
    # the text to be read in a session: its turns in order
    goal = turns.select("conv_id", "turn", G.expected_words(F.col("text")).alias("e")).groupBy("conv_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", "e"))), lambda r: r["e"])).alias("expected"))
    stream = jobs.table_stream(spark, sf_dir, "conversations", turns.schema)
    heard = F.replace(T.fold_diacritics(F.col("text")), F.lit("tion"), F.lit("sion"))
    spoken = F.filter(F.split(SPACES.sub(WORD_FORM[0].sub(heard)), " "), lambda w: w != "")
    chunks = stream.select("conv_id", "turn", spoken.alias("spoken")).join(goal, "conv_id")
    jobs.align_stream(chunks, "conv_id", "turn", "spoken", "expected", f"{path}/t", f"{path}/c")
    return jobs.pointers(spark, f"{path}/t", "conv_id")


@query("cache_fill_stream", """SELECT user_id, sha256(user_id::VARCHAR) AS answer, 1::BIGINT AS times FROM (SELECT DISTINCT user_id FROM events)""")
def cache_fill_stream(spark, sf_dir):
    path = scratch(spark)
    events = load(spark, sf_dir, "events").select("event_id", "user_id")
    # the table as four files, one batch each
    for part in range(4):
        events.where(F.pmod("event_id", F.lit(4)) == part).coalesce(1).write.mode("append").parquet(f"{path}/in")

    def answer(misses):
        return misses.select("user_id", F.sha2(F.col("user_id").cast("string"), 256).alias("answer"))
    stream = jobs.file_stream(spark, f"{path}/in", events.schema, files_per_batch=1)
    jobs.cache_fill(stream, "user_id", answer, f"{path}/t", f"{path}/c")
    # all stored versions: a key that was computed again would show
    return spark.read.parquet(f"{path}/t").groupBy("user_id", "answer").agg(F.count(F.lit(1)).alias("times"))


@query("sql_functions", f"""SELECT doc_id, {S.n_words('text')} AS n_words, {S.dup_key('text')} AS dup_key,
  CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '...' ELSE text END AS head FROM documents""")
def sql_functions(spark, sf_dir):
    sqlreg.register(spark)
    load_text(spark, sf_dir, "documents").createOrReplaceTempView("documents_view")
    return spark.sql("SELECT doc_id, word_count(text) AS n_words, dup_key(text) AS dup_key, snippet(text, 40) AS head FROM documents_view")


@query("sql_markup", f"""SELECT page_id, {S.collapse(S.entities(P.TAGS.sql_sub('html')))} AS clean,
  coalesce(nullif({P.WORK_ID_CPG.sql_group('url', 0)}, ''), {P.LAST_PATH_PART.sql_group('url', 1)}) AS work_id FROM pages""")
def sql_markup(spark, sf_dir):
    sqlreg.register(spark)
    load_text(spark, sf_dir, "pages").createOrReplaceTempView("pages_view")
    return spark.sql("SELECT page_id, clean_markup(html) AS clean, url_work_id(url) AS work_id FROM pages_view")


@query("sql_names", f"""SELECT doc_id, {sql_chain('strip_accents(' + S.umlauts('lower(text)') + ')', P.NON_SLUG)} AS slug,
  {sql_chain('strip_accents(lower(text))', P.WORD_FORM)} AS word, {P.NON_ID.sql_sub('source')} || '_' ||
    substring({P.NON_ID.sql_sub('text')}, 1, 30) || '_' || n_chars AS id FROM documents""")
def sql_names(spark, sf_dir):
    sqlreg.register(spark)
    load_text(spark, sf_dir, "documents").createOrReplaceTempView("documents_view")
    return spark.sql("SELECT doc_id, slugify(text) AS slug, normalize_word(text) AS word, make_id(source, text, n_chars) AS id FROM documents_view")


@query("sql_match_passages", f"SELECT vec_id, similarity, rank FROM ({_NEAREST}) WHERE query_id = (SELECT min(label) FROM embeddings)")
def sql_match_passages(spark, sf_dir):
    load(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings_view")
    centroids(spark, sf_dir).createOrReplaceTempView("centroids_view")
    sqlreg.register_matches(spark, "embeddings_view")
    return spark.sql("""SELECT vec_id, round(similarity, 6) AS similarity, rank
      FROM match_passages((SELECT min_by(embedding, query_id) FROM centroids_view), 0.2D)""")


@query("corpus_build")
def corpus_build(spark, sf_dir):
    return corpus.corpus_build(load_text(spark, sf_dir, "pages"))


@query("daily_readings", f"""WITH {_CITING}, {_VERSES}, r AS (
    SELECT o_orderkey, 'L1' AS id, display, c AS chapter, s AS start, e AS "end" FROM citing UNION ALL
    SELECT o_orderkey, 'EV', 'Johannes', c, e, e + 2 FROM citing)
  SELECT o_orderkey, id, r.display, translation, r.chapter, verse, text FROM r JOIN verses v ON r.display = v.display
    AND r.chapter = v.chapter AND verse BETWEEN start AND "end"
  UNION ALL SELECT o_orderkey, 'L1', 'Psalmen', 'allioli', r.chapter, verse, text FROM r JOIN verses v ON r.display = 'Psalmen' AND id = 'L1'
    AND v.display = 'Psalmen' AND v.translation = 'allioli' AND v.chapter = r.chapter - 1 AND verse BETWEEN start AND "end"
    WHERE (start >= 16 OR "end" >= 16) AND NOT EXISTS (SELECT 1 FROM verses d WHERE d.display = 'Psalmen' AND d.translation = 'allioli'
      AND d.chapter = r.chapter AND d.verse BETWEEN r.start AND r."end")""")
def daily_readings(spark, sf_dir):
    spaced = F.regexp_replace("abbr", r"^([123])", "$1 ")
    day = F.format_string('﻿{"Zelebrationen": {"a": {"Tl": "Montag der 3. Woche im Jahreskreis", "L1": "%s %d, %d-%d", "EV": "Joh %d, %d-%d"}, '
                          '"b": {"Tl": "Anderes", "L1": "Mt 1, 1"}}}', spaced, "c", "s", "e", "c", "e", F.col("e") + 2)
    days = inputs.citing(spark, sf_dir).select("o_orderkey", day.alias("json"))
    return corpus.daily_readings(days, ["o_orderkey"], inputs.verses(spark, sf_dir))




_HITS = dims.sql_values([(i, a, d.lower()) for i, (a, d) in enumerate(dims.SEARCH_NAMES)], "sn", ["i", "a", "low"])


@query("passage_search", f"""WITH {_CITING}, asked AS (SELECT book_ix, lower(display) AS low, (book_ix % 29 + 1) || ':' || (book_ix % 20 + 1) AS cv,
    (book_ix % 29 + 1) || ' ' || (book_ix % 20 + 1) AS sp FROM (SELECT DISTINCT book_ix, display FROM citing)),
  named AS (SELECT book_ix, list(a ORDER BY i) AS names FROM asked JOIN {_HITS} ON contains(sn.low, asked.low) GROUP BY book_ix),
  variant AS (SELECT book_ix, list_distinct(v) AS u, v FROM (SELECT asked.book_ix, list_concat(
      flatten(list_transform(coalesce(names, []), lambda n: [n || ' ' || cv, n || ' ' || sp])),
      CASE WHEN length(own) <= 4 THEN [own || ' ' || cv, own || ' ' || sp] ELSE [] END,
      CASE WHEN names IS NOT NULL THEN [cv, sp] ELSE [] END) AS v FROM (SELECT *, replace(replace(replace(low, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue') AS own FROM asked) asked
      LEFT JOIN named USING (book_ix))),
  ranked AS (SELECT book_ix, variant, min(i) AS r0 FROM (SELECT book_ix, unnest(v) AS variant, generate_subscripts(v, 1) AS i FROM variant) GROUP BY ALL),
  numbered AS (SELECT book_ix, variant, row_number() OVER (PARTITION BY book_ix ORDER BY r0) - 1 AS r FROM ranked),
  texts AS (SELECT o_orderkey, lower('Siehe ' || abbr || ' ' || c || ',' || s || '–' || e || ' und vgl. ' || display || ' ' || (c + 1) || ':' || s || '; mt 5,3.') AS t FROM citing),
  hit AS (SELECT book_ix, o_orderkey, min(r)::INTEGER AS best FROM numbered JOIN texts ON contains(t, variant) GROUP BY ALL)
  SELECT book_ix, o_orderkey, best, pos::INTEGER AS pos FROM (SELECT *, row_number() OVER (PARTITION BY book_ix ORDER BY best, o_orderkey) AS pos FROM hit) WHERE pos <= 8""")
def passage_search(spark, sf_dir):
    asked = inputs.citing(spark, sf_dir).select("book_ix", F.col("display").alias("book")).distinct().withColumns({
        "chapter": F.col("book_ix") % 29 + 1, "verse": F.col("book_ix") % 20 + 1})
    return corpus.passage_search(asked, "book_ix", inputs.citing_texts(spark, sf_dir), "o_orderkey", "text")


@query("fallback_latest", """WITH main AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
  SELECT * FROM main UNION ALL SELECT o_custkey, max(o_orderkey) FROM orders WHERE o_orderstatus <> 'F' AND o_custkey <= 100
    AND o_custkey NOT IN (SELECT o_custkey FROM main) GROUP BY o_custkey""")
def fallback_latest(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    main, other = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'")
    return R.fallback_latest(main, other, "o_custkey", range(1, 101), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")
