"""Queries over stored pages."""

from pyspark.sql import functions as F

from versarium import patterns as P
from versarium.operators import aggregate as A
from versarium.operators import html as H
from versarium.queries import sqlkit as S
from versarium.queries.registry import query
from versarium.rx import sql_chain
from versarium.session import load, load_text
from versarium.sources import readers as R


def parsed(spark, sf_dir, *keys):
    return H.with_nodes(load_text(spark, sf_dir, "pages"), ["page_id", *keys])


def main(spark, sf_dir, *keys):
    return H.with_main_content(parsed(spark, sf_dir, *keys))


@query("manifest_scan", "SELECT trim(url) AS url FROM pages WHERE trim(url) <> ''")
def manifest_scan(spark, sf_dir):
    return R.manifest_scan(load_text(spark, sf_dir, "pages"))


_PAGE = "coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INTEGER), 1)"
_WORK = "regexp_extract(url, '^([^?#]*)', 1)"


@query("page_group", f"""SELECT work, page_no, url FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY page_no) AS rank FROM (
  SELECT work, page_no, min(url) AS url FROM (SELECT {_WORK} AS work, {_PAGE} AS page_no, url, html FROM pages)
  WHERE NOT contains(html, '{P.ERROR_PAGE}') GROUP BY work, page_no)) WHERE rank = page_no""")
def page_group(spark, sf_dir):
    pages = load_text(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^([^?#]*)", 1).alias("work"), R.page_number(F.col("url")).alias("page_no"), "url", "html")
    return R.page_group(pages).select("work", "page_no", "url")


_LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>"""
_ROOT = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query("extract_links", f"""SELECT page_id, pos, link, {S.collapse(S.entities(P.TAGS.sql_sub('label')))} AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY pos) AS rn FROM (
    SELECT page_id, pos, label, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN {_ROOT} || href
      ELSE {_ROOT} || '/' || href END AS link FROM (SELECT page_id, url, unnest(h) AS href, unnest(b) AS label,
      (generate_subscripts(h, 1) - 1)::INTEGER AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '{_LINK}', 1) AS h,
      regexp_extract_all(html, '{_LINK}', 2) AS b FROM pages)))) WHERE rn = 1""")
def extract_links(spark, sf_dir):
    return H.extract_links(load_text(spark, sf_dir, "pages"), ["page_id"])


@query("page_metadata", f"""SELECT page_id, CASE WHEN length(h1) > 3 THEN h1 ELSE 'Unbekannter Autor' END AS author,
  coalesce(list_filter(h2, lambda x: length(x) > 3 AND x <> h1)[1], 'Unbekannter Titel') AS title,
  coalesce(nullif({P.WORK_ID_CPG.sql_group('url', 0)}, ''), {P.LAST_PATH_PART.sql_group('url', 1)}) AS work_id FROM (
  SELECT page_id, url, {S.collapse(S.entities(P.TAGS.sql_sub("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")))} AS h1,
    list_transform(regexp_extract_all(html, '(?s)<h2[^>]*>(.*?)</h2>', 1), lambda x: {S.collapse(S.entities(P.TAGS.sql_sub('x')))}) AS h2 FROM pages)""")
def page_metadata(spark, sf_dir):
    return H.page_metadata(parsed(spark, sf_dir, "url"), ["page_id"])


# The pages of the test tables hold one article of one h1 and flat paragraphs,
# so plain string splitting gives the same blocks there.
_CLEAN = "list_transform(string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>'), lambda x: " + \
    S.collapse(S.entities(P.TAGS.sql_sub("x"))) + ")"
_ARTICLE = f"SELECT page_id, url, {_CLEAN} AS b FROM pages"
_BLOCK = f"SELECT page_id, url, unnest(b) AS text, (generate_subscripts(b, 1) - 1)::INTEGER AS pos FROM ({_ARTICLE})"
_ROLE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(strip_accents(title)), '{w}')" for w in ws) + f" THEN '{r}'"
    for r, ws in P.SECTION_ROLES) + " ELSE 'main' END"


@query("extract_main_content", f"""SELECT page_id, 'article' AS tag, round(6.0 * len(list_filter(b[2:], lambda x: x <> '')) + 3
  + length(array_to_string(list_filter(b, lambda x: x <> ''), ' ')) / 400, 4)::DOUBLE AS score FROM ({_ARTICLE})""")
def extract_main_content(spark, sf_dir):
    best = F.get(F.filter("nodes", lambda n: n["node"] == F.col("best.node")), 0)["tag"]
    return main(spark, sf_dir).select("page_id", best.alias("tag"), F.round("best.score", 4).alias("score"))


@query("html_blocks", f"""SELECT page_id, pos, CASE pos WHEN 0 THEN 'heading' ELSE 'paragraph' END AS kind,
  CASE pos WHEN 0 THEN 'h1' ELSE 'p' END AS tag, text FROM ({_BLOCK})""")
def html_blocks(spark, sf_dir):
    blocks = H.content_blocks(main(spark, sf_dir))
    return blocks.select("page_id", F.posexplode("blocks").alias("pos", "b")).select(
        "page_id", "pos", F.col("b.kind").alias("kind"), F.col("b.tag").alias("tag"), F.col("b.text").alias("text"))


_SECTION = f"""SELECT page_id, title, {_ROLE} AS role, array_to_string(list_filter(b[2:], lambda x: x <> ''), chr(10) || chr(10)) AS text,
  len(list_filter(b[2:], lambda x: x <> ''))::INTEGER AS paragraph_count FROM (SELECT page_id, b, b[1] AS title FROM ({_ARTICLE}))"""


@query("division_sections", f"SELECT *, 0 AS pos FROM ({_SECTION})")
def division_sections(spark, sf_dir):
    made = H.content_blocks(main(spark, sf_dir)).select("page_id", F.posexplode(H.sections(F.col("blocks"))).alias("pos", "s"))
    return made.select("page_id", "pos", "s.role", "s.title", "s.text", "s.paragraph_count")


@query("concat_text_by_role", f"""SELECT page_id, text AS main_text, CASE role WHEN 'intro' THEN text ELSE '' END AS intro_text,
  CASE role WHEN 'appendix' THEN text ELSE '' END AS appendix_text FROM ({_SECTION})""")
def concat_text_by_role(spark, sf_dir):
    made = H.content_blocks(main(spark, sf_dir)).select("page_id", F.explode(F.array(H.sections(F.col("blocks")))).alias("s"))
    return made.select("page_id", *[c.alias(n) for n, c in A.text_by_role(F.col("s")).items()])


_SEG_TEXT = S.trim(sql_chain(P.SPACES.sql_sub(P.NOT_ALLOWED.sql_sub(f"replace({P.TAGS.sql_sub('text')}, '↩', '')")), P.PAGE_REFS))
_SEG_INTRO = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in P.INTRO_WORDS) + ")"


@query("page_segments", f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INTEGER AS segment_no, kind, text,
    CASE kind WHEN 'paragraph' THEN nullif({P.NUMBER_START.sql_group('raw', 1)}, '') END AS section_number,
    CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS title, {S.n_words('text')} AS n_words,
    coalesce(last_value(CASE WHEN kind <> 'paragraph' THEN 1 END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos), 0) AS hierarchy_level
    FROM (SELECT page_id, pos, text AS raw, {_SEG_TEXT} AS text, CASE WHEN {_SEG_INTRO} THEN 'introduction' WHEN pos = 0 THEN 'heading'
      ELSE 'paragraph' END AS kind FROM ({_BLOCK}) WHERE length(text) >= 10) WHERE text <> ''""")
def page_segments(spark, sf_dir):
    return H.segments(main(spark, sf_dir), ["page_id"]).drop("parent_section")


@query("extract_sections")
def extract_sections(spark, sf_dir):
    return H.extract_sections(main(spark, sf_dir, "url"), ["page_id"], "url")


@query("page_notes", "SELECT page_id, 'Anmerkung zu Seite ' || page_id || ', unten' AS note FROM pages")
def page_notes(spark, sf_dir):
    pages = load_text(spark, sf_dir, "pages").withColumn("html", F.concat(
        "html", F.lit("<sup>Anmerkung zu Seite "), "page_id", F.lit(", unten</sup><b class='Note'>abc</b>")))
    return H.page_notes(H.with_nodes(pages, ["page_id"]), ["page_id"])


@query("footnote_items", """SELECT page_id, page_id::VARCHAR AS number, url AS text FROM pages UNION ALL SELECT page_id, '2', 'x' FROM pages""")
def footnote_items(spark, sf_dir):
    pages = load_text(spark, sf_dir, "pages").withColumn("html", F.concat(
        "html", F.lit('<div class="footnotes"><ol><li id="fn:'), "page_id", F.lit('">'), "url", F.lit("</li><li>x</li></ol></div>")))
    return H.footnotes(H.with_nodes(pages, ["page_id"]), ["page_id"])


_UNWANTED = " OR ".join(f"contains(lower(text), '{w}')" for w in P.UNWANTED_WORDS)


@query("content_fallback", f"SELECT page_id, text FROM ({_BLOCK}) WHERE pos > 0 AND length(text) > 20 AND NOT ({_UNWANTED})")
def content_fallback(spark, sf_dir):
    return H.content_fallback(parsed(spark, sf_dir), ["page_id"]).select("page_id", "text")


@query("link_filters", """WITH l AS (SELECT page_id, 'https://x.example' || CASE page_id % 4 WHEN 0 THEN '/works/' || page_id WHEN 1 THEN '/works/1/versions/2/'
      || page_id WHEN 2 THEN '/files/' || page_id || '.PDF' ELSE '/about' END AS link,
    CASE page_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'Ein Werk: Übersetzung (Deutsch)' ELSE 'EPUB (' || page_id || ' KB)' END AS label FROM pages)
  SELECT page_id, contains(link, '/works/') AND length(label) > 10 AS work,
    contains(link, '/works/') AND length(label) > 10 AND contains(label, 'Übersetzung (Deutsch)') AS german,
    contains(link, '/works/') AND contains(link, '/versions/') AS version,
    (contains(link, '/files/') AND contains(lower(link), '.pdf')) OR (contains(lower(label), 'epub') AND contains(lower(label), 'kb')) AS download FROM l""")
def link_filters(spark, sf_dir):
    key = F.col("page_id").cast("string")
    case, name = F.col("page_id") % 4, F.col("page_id") % 3
    link = F.concat(F.lit("https://x.example"), F.when(case == 0, F.concat(F.lit("/works/"), key)).when(
        case == 1, F.concat(F.lit("/works/1/versions/2/"), key)).when(case == 2, F.concat(F.lit("/files/"), key, F.lit(".PDF"))).otherwise("/about"))
    label = F.when(name == 0, "short").when(name == 1, "Ein Werk: Übersetzung (Deutsch)").otherwise(
        F.concat(F.lit("EPUB ("), key, F.lit(" KB)")))
    return load(spark, sf_dir, "pages").select(
        "page_id", H.work_link(link, label).alias("work"), H.german_work_link(link, label).alias("german"),
        H.version_link(link).alias("version"), H.download_link(link, label).alias("download"))
