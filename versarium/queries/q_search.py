"""Queries: substring, term, combined and vector search."""

import uuid

from pyspark.sql import functions as F

from versarium import dims
from versarium import patterns as P
from versarium.functions import stems
from versarium.operators import search as X
from versarium.operators import terms as I
from versarium.operators import vectors as V
from versarium.queries import inputs
from versarium.queries.q_refs import _CITING, _VERSES
from versarium.queries.registry import query
from versarium.session import ensure_checkpoint_dir, load, load_text



@query("ilike_search", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'tion than') ORDER BY doc_id LIMIT 10")
def ilike_search(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "source", "text")
    return X.ilike_search(docs, "text", "TION than", ["doc_id"]).select("doc_id", "source")


@query("multi_pattern_or", """SELECT doc_id FROM documents WHERE contains(lower(text), 'tion than') OR contains(lower(text), 'nicht der')
  OR contains(lower(text), 'el la') ORDER BY doc_id LIMIT 10""")
def multi_pattern_or(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "text")
    return X.multi_pattern_or(docs, "text", ["tion than", "nicht_der", "el%la"], ["doc_id"]).select("doc_id")


@query("substring_join", """SELECT doc_id, item_id FROM documents d JOIN (SELECT item_id,
  regexp_extract(text, '^[^.]*', 0) AS needle FROM benchmark) ON contains(text, needle)""")
def substring_join(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "text")
    needles = load(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", r"^[^.]*", 0).alias("needle"))
    return X.substring_join(docs, "doc_id", "text", needles, "needle").join(needles, "needle").select("doc_id", "item_id")


@query("substring_join_whole", """SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def substring_join_whole(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "text")
    needles = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return X.substring_join(docs, "doc_id", "text", needles, "needle").join(needles, "needle").select("doc_id", "item_id")


@query("substring_join_seeded", """SELECT doc_id, item_id FROM documents d JOIN (SELECT item_id,
  regexp_extract(text, '^[^.]*', 0) AS needle FROM benchmark) ON contains(text, needle)""")
def substring_join_seeded(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "text")
    needles = load(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", r"^[^.]*", 0).alias("needle"))
    return X.seeded_join(docs, "doc_id", "text", needles, "needle").join(needles, "needle").select("doc_id", "item_id")


@query("variant_match", """SELECT doc_id, min(item_id) AS rank FROM documents JOIN (SELECT item_id, regexp_extract(text, '^[^.]*', 0) AS needle
  FROM benchmark) ON contains(text, needle) GROUP BY doc_id ORDER BY rank, doc_id LIMIT 8""")
def variant_match(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "text")
    variants = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rank_no"),
                                                       F.regexp_extract("text", r"^[^.]*", 0).alias("variant"))
    return X.variant_match(docs, "doc_id", "text", variants, "variant", "rank_no")


@query("variant_match_indexed", """SELECT doc_id, min(item_id) AS rank FROM documents JOIN (SELECT item_id, unnest([text, regexp_extract(text, '^[^.]*', 0)]) AS needle
  FROM benchmark) ON contains(text, needle) GROUP BY doc_id ORDER BY rank, doc_id LIMIT 50""")
def variant_match_indexed(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "text")
    path = f"{ensure_checkpoint_dir(spark)}/gram-index-{uuid.uuid4().hex}"
    X.gram_index(docs, "doc_id", "text", path)
    variants = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rank_no"), F.explode(F.array(
        "text", F.regexp_extract("text", r"^[^.]*", 0))).alias("variant"))
    return X.variant_match(docs, "doc_id", "text", variants, "variant", "rank_no", 50, index=path)


_TOKENS = f"SELECT doc_id, unnest({P.SEARCH_TOKEN.sql_all('lower(text)')}) AS term FROM documents"


@query("term_postings", f"SELECT term, doc_id, count(*) AS tf FROM ({_TOKENS}) GROUP BY term, doc_id")
def term_postings(spark, sf_dir):
    return X.term_postings(load_text(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


@query("term_search", f"""SELECT doc_id, count(*) AS hits FROM ({_TOKENS}) WHERE term IN ('the', 'tion') GROUP BY doc_id
  HAVING count(DISTINCT term) = 2""")
def term_search(spark, sf_dir):
    postings = X.term_postings(load_text(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return X.term_search(postings, "doc_id", "Tion the")


def indexed(spark, sf_dir, stemmed=False):
    path = f"{ensure_checkpoint_dir(spark)}/term-index-{uuid.uuid4().hex}"
    I.write_term_index(load_text(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", path, stemmed=stemmed)
    return spark.read.parquet(path)


@query("term_search_top", f"""SELECT doc_id, count(*) AS hits FROM ({_TOKENS}) WHERE term IN ('the', 'tion') GROUP BY doc_id
  HAVING count(DISTINCT term) = 2 ORDER BY hits DESC, doc_id LIMIT 20""")
def term_search_top(spark, sf_dir):
    return I.index_search(indexed(spark, sf_dir), "doc_id", "Tion the", 20)


@query("term_index", f"""SELECT term, sum(docs)::BIGINT AS docs, sum(tfs)::BIGINT AS tfs, max(most)::INTEGER AS most, count(*) AS blocks FROM (
  SELECT term, part, count(*) AS docs, sum(tf) AS tfs, max(tf) AS most FROM (SELECT term, doc_id // {I.SPAN} AS part, doc_id, count(*) AS tf
    FROM ({_TOKENS}) GROUP BY ALL) GROUP BY ALL) GROUP BY term""")
def term_index(spark, sf_dir):
    return indexed(spark, sf_dir).groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tfs"),
        F.max("most").alias("most"), F.count(F.lit(1)).alias("blocks"))


def _stem_sql(words):
    """The rules of `stems.german` step by step over the column w of a subquery."""
    def region(pattern):
        found = f"length(regexp_extract(w, '{pattern}', 0))"
        return f"CASE WHEN length(w) < 3 OR {found} = 0 THEN length(w) ELSE {found} END"

    def cut(ending, mark, unless="false"):
        return f"CASE WHEN {ending} <> '' AND length(w) - length({ending}) >= {mark} AND NOT ({unless}) THEN left(w, length(w) - length({ending})) ELSE w END"
    v = f"[{stems.VOWELS}]"
    sql = f"SELECT term, replace(term, 'ß', 'ss') AS w FROM ({words})"
    for letter in "uy":
        sql = f"SELECT term, regexp_replace(w, '({v}){letter}({v})', '\\1{letter.upper()}\\2', 'g') AS w FROM ({sql})"
    sql = f"""SELECT term, w, CASE WHEN length(w) < 3 THEN length(w) ELSE greatest(3, {region(stems.FIRST_REGION)}) END AS r1,
      {region(stems.SECOND_REGION)} AS r2, regexp_extract(w, '(ern|em|er|en|es|e|s)$', 1) AS e FROM ({sql})"""
    sql = f"""SELECT term, r1, r2, w AS old, e AS gone, {cut('e', 'r1', f"e = 's' AND NOT regexp_matches(w, '[{stems.BEFORE_S}]s$')")} AS w FROM ({sql})"""
    sql = f"""SELECT term, r1, r2, CASE WHEN w <> old AND gone IN ('e', 'en', 'es') AND w LIKE '%niss' THEN left(w, length(w) - 1) ELSE w END AS w FROM ({sql})"""
    sql = f"SELECT *, regexp_extract(w, '(est|en|er|st)$', 1) AS e FROM ({sql})"
    sql = f"""SELECT term, r1, r2, {cut('e', 'r1', f"e = 'st' AND NOT regexp_matches(w, '.{{3}}[{stems.BEFORE_ST}]st$')")} AS w FROM ({sql})"""
    sql = f"SELECT *, regexp_extract(w, '(lich|heit|keit|isch|end|ung|ig|ik)$', 1) AS e FROM ({sql})"
    sql = f"""SELECT term, r1, r2, w AS old, e AS gone, {cut('e', 'r2', "regexp_matches(w, 'e(ig|ik|isch)$')")} AS w FROM ({sql})"""
    sql = f"""SELECT term, r1, r2, w, gone, CASE WHEN w = old THEN '' WHEN gone IN ('end', 'ung') THEN regexp_extract(w, '(ig)$', 1)
      WHEN gone IN ('lich', 'heit') THEN regexp_extract(w, '(er|en)$', 1) WHEN gone = 'keit' THEN regexp_extract(w, '(lich|ig)$', 1) ELSE '' END AS e FROM ({sql})"""
    sql = f"""SELECT term, CASE WHEN gone IN ('lich', 'heit') THEN {cut('e', 'r1')} ELSE {cut('e', 'r2', "gone IN ('end', 'ung') AND w LIKE '%eig'")} END AS w FROM ({sql})"""
    return f"SELECT term, translate(w, 'UYäöü', 'uyaou') AS stem FROM ({sql})"


_STEMMED = f"SELECT doc_id, stem FROM ({_TOKENS}) JOIN ({_stem_sql(f'SELECT DISTINCT term FROM ({_TOKENS})')}) USING (term)"


@query("term_stems", f"SELECT stem, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_STEMMED}) GROUP BY stem")
def term_stems(spark, sf_dir):
    words = load_text(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(I.search_tokens(F.col("text"))).alias("term"))
    # few words make up most of a text: count them first; the stem of each word is worked out once
    counted = words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    per_word = counted.join(I.stem_table(words), "term").groupBy("stem", "doc_id").agg(F.sum("n").alias("n"))
    return per_word.groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("term_search_stemmed", f"""SELECT doc_id, count(*) AS hits FROM ({_STEMMED}) WHERE stem IN ('der', 'nicht') GROUP BY doc_id
  HAVING count(DISTINCT stem) = 2 ORDER BY hits DESC, doc_id LIMIT 20""")
def term_search_stemmed(spark, sf_dir):
    return I.index_search(indexed(spark, sf_dir, stemmed=True), "doc_id", "nichts der", 20, stemmed=True)


@query("combined_search", """SELECT id, type, text, author, work, section, ord FROM (
  SELECT 'verse-' || (conv_id * 1000 + turn) AS id, 'verse' AS type, text, role AS author, role AS work, role AS section, turn AS ord,
    row_number() OVER (ORDER BY conv_id * 1000 + turn) AS rn FROM conversations WHERE contains(lower(text), 'ion') UNION ALL
  SELECT 'passage-' || doc_id, 'passage', text, source, lang, lang, n_chars, row_number() OVER (ORDER BY doc_id) FROM documents
    WHERE contains(lower(text), 'ion')) WHERE rn <= 50""")
def combined_search(spark, sf_dir):
    turns = load_text(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("vid"), "text", F.col("role").alias("author"),
        F.col("role").alias("work"), F.col("role").alias("section"), F.col("turn").alias("ord"))
    docs = load_text(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("author"), F.col("lang").alias("work"), F.col("lang").alias("section"),
        F.col("n_chars").alias("ord"))
    return X.combined_search(turns, docs, "ion", "vid", "doc_id")


_SMART = f"""WITH {_CITING}, {_VERSES}, q AS (SELECT o_orderkey, display, c, s, e, (o_orderkey % 3)::INT AS form FROM citing),
  asked AS (SELECT *, display || ' ' || c || CASE form WHEN 0 THEN ':' || s || '-' || e ELSE '' END AS t FROM q WHERE form < 2
    UNION ALL SELECT *, 'o' || (o_orderkey % 7 + 1) FROM q WHERE form = 2),
  named AS (SELECT o_orderkey, form, c, s, e, b.book FROM q JOIN {dims.sql_values([(b[2], b[2].lower()) for b in dims.books()], 'b', ['book', 'low'])}
    ON form < 2 AND (contains(b.low, lower(display)) OR contains(lower(display), b.low) OR EXISTS (SELECT 1 FROM
      {dims.sql_values(sorted(X.J._name_parts().items()), 'pt', ['a', 'n'])} WHERE contains(lower(display), pt.a) AND contains(b.low, pt.n))))
  SELECT o_orderkey, 'chapter' AS type, book || ' ' || c AS title, NULL::VARCHAR AS subtitle FROM named WHERE form = 1
  UNION ALL SELECT o_orderkey, 'verse', display || ' ' || chapter || ':' || verse, text FROM named JOIN verses v ON form = 0 AND
    v.translation = 'schoeningh' AND v.display = named.book AND v.chapter = c AND verse BETWEEN s AND e
  UNION ALL SELECT o_orderkey, 'book', book, NULL FROM asked JOIN {dims.sql_values([(b[2], b[2].lower()) for b in dims.books()], 'b', ['book', 'low'])} ON contains(b.low, lower(t))
  UNION ALL SELECT o_orderkey, 'verse', display || ' ' || chapter || ':' || verse, text FROM (SELECT o_orderkey, v.*, row_number() OVER
    (PARTITION BY o_orderkey ORDER BY v.book, v.chapter, v.verse) AS rn FROM asked JOIN verses v ON form = 2 AND v.translation = 'schoeningh' AND contains(lower(v.text), t)) WHERE rn <= 10"""


@query("smart_search", _SMART)
def smart_search(spark, sf_dir):
    asked = inputs.citing(spark, sf_dir)
    form = F.col("o_orderkey") % 3
    text = (F.when(form == 0, F.format_string("%s %d:%d-%d", "display", "c", "s", "e"))
            .when(form == 1, F.format_string("%s %d", "display", "c"))
            .otherwise(F.concat(F.lit("o"), (F.col("o_orderkey") % 7 + 1).cast("string"))))
    return X.smart_search(asked.select("o_orderkey", text.alias("query")), "o_orderkey", "query", inputs.verses(spark, sf_dir))


_NAMES = "SELECT DISTINCT p_name AS a FROM part"


@query("fuzzy_name", f"""SELECT a AS p_name, b AS closest, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b DESC) AS rn
  FROM (SELECT x.a, y.a AS b, 1 - levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a)) AS score FROM ({_NAMES}) x, ({_NAMES}) y WHERE x.a <> y.a)
  WHERE score >= 0.65) WHERE rn = 1""")
def fuzzy_name(spark, sf_dir):
    return X.fuzzy_name(load(spark, sf_dir, "part"), "p_name")


_CENTROID = """SELECT label AS query_id, list(round(m, 6) ORDER BY i) AS q FROM (SELECT label, i, avg(v::DOUBLE) AS m FROM (
  SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label"""
_SCORED = f"""SELECT query_id, vec_id, list_cosine_similarity(e, q) AS sim, list_distance(e, q) AS d
  FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), ({_CENTROID})"""


def centroids(spark, sf_dir):
    """One query vector per label: the rounded mean of its vectors."""
    parts = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("m"))
    # one entry per dimension, whatever the number of vectors
    return means.groupBy(F.col("label").alias("query_id")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


_NEAREST = f"""SELECT query_id, vec_id, round(sim, 6) AS similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM ({_SCORED}) WHERE sim >= 0.2) WHERE rank <= 12"""


@query("knn_exact", _NEAREST)
def knn_exact(spark, sf_dir):
    hits = V.match_passages(load(spark, sf_dir, "embeddings"), centroids(spark, sf_dir))
    return hits.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("knn_cosine_order", f"""SELECT query_id, vec_id, round(sim, 6) AS similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM ({_SCORED}) WHERE sim >= 0.2) WHERE rank <= 12""")
def knn_cosine_order(spark, sf_dir):
    hits = V.match_passages(load(spark, sf_dir, "embeddings"), centroids(spark, sf_dir), order_by="cosine")
    return hits.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("knn_all", """SELECT query_id, vec_id, round(sim, 6) AS similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS sim,
    list_distance(a.e, b.e) AS d FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) a,
    (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) b) WHERE sim >= 0.2) WHERE rank <= 3""")
def knn_all(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    hits = V.match_all(vectors, queries, k=3)
    return hits.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("knn_ivf", _NEAREST)
def knn_ivf(spark, sf_dir):
    hits = V.knn_ivf(load(spark, sf_dir, "embeddings"), centroids(spark, sf_dir))
    return hits.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("embed_backlog")
def embed_backlog(spark, sf_dir):
    docs = load_text(spark, sf_dir, "documents", "doc_id", "text")
    out = V.embed_backlog(docs, load(spark, sf_dir, "labels"), "doc_id", "text")
    return out.select("doc_id", F.size("embedding").alias("n_dims"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"))
