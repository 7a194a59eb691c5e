"""Queries: tables written in a source format or by a sink and read back."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versarium.queries import sqlkit as S
from versarium.queries.q_flows import scratch
from versarium.queries.registry import projected, query
from versarium.session import load
from versarium.sources import csvsplit, readers, writers

DOCS = "doc_id long, text string, lang string, source string"


def written_csv(spark, sf_dir, path):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    docs.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


def write_xml(rows, element, root, path):
    """Files of one XML document each, with 500 elements at most."""
    part = F.floor(F.col("doc_id") / 500)
    whole = F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list(element), ""), F.lit(f"</{root}>"))
    rows.groupBy(part).agg(whole.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


@query("csv_scan", "SELECT doc_id, text, lang, source FROM documents")
def csv_scan(spark, sf_dir):
    return readers.csv_scan(spark, written_csv(spark, sf_dir, scratch(spark)), DOCS)


@query("csv_scan_split", "SELECT doc_id, text, lang, source, false AS rejected FROM documents UNION ALL SELECT NULL, text, lang, source, true FROM documents WHERE doc_id % 2 = 0")
def csv_scan_split(spark, sf_dir):
    path = scratch(spark)
    written_csv(spark, sf_dir, f"{path}/good")
    docs = load(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("no. "), "doc_id").alias("doc_id"), "text", "lang", "source")
    docs.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/bad")
    rows = csvsplit.csv_scan_split(spark, f"{path}/*/*.csv", DOCS)
    return rows.select("doc_id", "text", "lang", "source", F.col(csvsplit.BAD).isNotNull().alias("rejected"))


@query("glob_scan", "SELECT doc_id, length(text)::INTEGER AS n, lang FROM documents")
def glob_scan(spark, sf_dir):
    path = scratch(spark)
    written_csv(spark, sf_dir, f"{path}/all")
    return readers.glob_scan(spark, f"{path}/*/*.csv", DOCS).select("doc_id", F.length("text").alias("n"), "lang")


projected("author_from_file", "documents", ["doc_id"], "SELECT doc_id, lang || ' ' || source AS author FROM documents",
          author=lambda: readers.author_from_file(F.concat(F.lit("kirchenvater_"), "lang", F.lit("_"), "source", F.lit(".csv"))))


@query("xml_verse_scan", f"""SELECT source AS book, doc_id::INTEGER AS chapter, n_chars::INTEGER AS verse,
  {S.trim("replace(text, chr(10), ' ')")} AS text FROM documents""")
def xml_verse_scan(spark, sf_dir):
    path = scratch(spark)
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    book = F.concat(F.lit('<BIBLEBOOK bname="'), "source", F.lit('"><CHAPTER cnumber="'), F.col("doc_id").cast("string"),
                    F.lit('"><VERS vnumber="'), F.col("n_chars").cast("string"), F.lit('">'), text, F.lit("</VERS></CHAPTER></BIBLEBOOK>"))
    write_xml(load(spark, sf_dir, "documents"), book, "XMLBIBLE", path)
    return readers.xml_verse_scan(spark, path)


@query("html_verse_scan", """SELECT CASE WHEN doc_id % 2 = 0 THEN 'NT' ELSE 'OT' END AS testament, lang AS book, doc_id::INTEGER AS chapter,
  n_chars::INTEGER AS verse, source || ' & ' || lang AS text FROM documents""")
def html_verse_scan(spark, sf_dir):
    number = F.col("n_chars").cast("string")
    html = F.concat(F.lit('<body><div class="v" id="x"><span class="vn">'), number, F.lit("</span><h3>Title</h3> <i>"), "source",
                    F.lit("</i> &amp;\n"), "lang", F.lit("<sup>1</sup></div><div>rest</div></body>"))
    place = F.when(F.col("doc_id") % 2 == 0, "nt").otherwise("ot")
    pages = load(spark, sf_dir, "documents").select(html.alias("html"), F.concat(
        F.lit("/pages/"), place, F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".html")).alias("file_path"))
    return readers.html_verses(pages)


@query("html_footnote_scan", "SELECT 'page' || doc_id AS page, n_chars::INTEGER AS number, source || ' ' || lang AS text FROM documents")
def html_footnote_scan(spark, sf_dir):
    html = F.concat(F.lit('<p>x</p><div class="fn"><a name="fn'), F.col("n_chars").cast("string"), F.lit('"></a><sup>2</sup><a href="#b">'),
                    "source", F.lit("</a> "), "lang", F.lit("</div>"))
    pages = load(spark, sf_dir, "documents").select(html.alias("html"), F.concat(
        F.lit("/p/page"), F.col("doc_id").cast("string"), F.lit(".html")).alias("file_path"))
    return readers.html_footnotes(pages)


@query("encoding_fallback", "SELECT doc_id || 'ä' || lang AS line FROM documents UNION ALL SELECT doc_id || 'é…' FROM documents")
def encoding_fallback(spark, sf_dir):
    path = scratch(spark)
    docs = load(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    docs.select(F.concat(key, F.lit("ä"), "lang")).write.option("encoding", "ISO-8859-1").csv(f"{path}/a")
    docs.select(F.concat(key, F.lit("é…"))).write.csv(f"{path}/b")
    files = readers.encoding_fallback(spark, f"{path}/*/*.csv")
    return files.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


@query("tolerant_line_parse", """SELECT source AS book, doc_id::INTEGER AS chapter, n_chars::INTEGER AS verse, lang || ', ' || source AS text
  FROM documents""")
def tolerant_line_parse(spark, sf_dir):
    path = scratch(spark)
    line = F.format_string('%s, %d,%d,"%s, %s"', "source", "doc_id", "n_chars", "lang", "source")
    noise = F.format_string("no verse, %d", "doc_id")
    load(spark, sf_dir, "documents").select(F.explode(F.array(line, noise)).alias("value")).write.text(path)
    return readers.tolerant_line_parse(spark, path)


@query("json_categories", """SELECT lower(source) || '-' || doc_id // 20 AS category, source || '-' || doc_id // 20 AS category_name, doc_id::VARCHAR AS id,
  doc_id::VARCHAR AS slug, 'Nr ' || doc_id AS title, text FROM documents""")
def json_categories(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("name", F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 20).cast("string")))
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(
        F.concat(F.lit("Nr "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body")).alias("attributes"))
    made = docs.groupBy("name").agg(F.collect_list(item).alias("data"))  # at most 20 documents
    one = F.struct(F.lit("7").alias("id"), F.struct(F.lower("name").alias("slug"), F.col("name").alias("name"),
                                                    F.struct("data").alias("prayers")).alias("attributes"))
    flat = F.struct(F.lit("7").alias("id"), F.struct(F.lower("name").alias("slug"), F.col("name").alias("name")).alias("attributes"),
                    F.col("data").alias("prayers"))
    rows = made.select(F.when(F.length("name") % 2 == 0, F.to_json(F.array(one))).otherwise(
        F.to_json(F.struct(F.array(flat).alias("data")))).alias("json"))
    return readers.json_nested_flatten(rows).select("category", "category_name", "item.*")


@query("feed_items", """SELECT 'A & B ' || doc_id AS title, 'http://x.example/' || doc_id AS link, lang || '|' || source AS categories,
  'http://a.example/' || doc_id || '.mp3' AS audio, TIMESTAMP '2024-02-03 10:00:00' AS published FROM documents""")
def feed_items(spark, sf_dir):
    path = scratch(spark)
    key = F.col("doc_id").cast("string")
    item = F.concat(F.lit("<item><title><![CDATA[A &amp; B "), key, F.lit("]]></title><link>http://x.example/"), key, F.lit("</link><category>"),
                    "lang", F.lit("</category><category>"), "source", F.lit('</category><enclosure url="http://a.example/'), key,
                    F.lit('.mp3"/><pubDate>Sat, 03 Feb 2024 11:00:00 +0100</pubDate></item>'))
    write_xml(load(spark, sf_dir, "documents"), item, "channel", path)
    return readers.feed_items(spark, path).withColumn("categories", F.array_join("categories", "|"))


@query("book_dim_scan", """SELECT p_name AS abbr, p_brand AS short, p_name || ' long' AS long, 'o' || p_partkey AS osis, 'x' AS type,
  p_size % 2 = 0 AS nt, p_partkey::INTEGER AS chapters FROM part""")
def book_dim_scan(spark, sf_dir):
    path = scratch(spark)
    row = F.struct(F.col("p_name").alias("abbr"), F.col("p_brand").alias("short"), F.concat("p_name", F.lit(" long")).alias("long"),
                   F.concat(F.lit("o"), F.col("p_partkey").cast("string")).alias("osis"), F.lit("x").alias("type"),
                   (F.col("p_size") % 2 == 0).alias("nt"), F.col("p_partkey").alias("chapters"))
    # one array per file
    load(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("file")).agg(F.to_json(F.collect_list(row)).alias("value")) \
        .select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.book_dim_scan(spark, path)


@query("write_master_sorted", "SELECT doc_id, lang, true AS in_order FROM documents")
def write_master_sorted(spark, sf_dir):
    path = scratch(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    writers.write_master_sorted(docs, path, "lang", F.desc("doc_id"))
    stored = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    place = F.row_number().over(W.partitionBy("file").orderBy("lang", F.desc("doc_id")))
    return stored.select("doc_id", "lang", (F.col("at") + 1 == place).alias("in_order"))


@query("write_chunks", "SELECT doc_id, text, true AS bounded FROM documents")
def write_chunks(spark, sf_dir):
    path = scratch(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    writers.write_chunks(docs, path, "doc_id", size=100)
    rows = readers.csv_scan(spark, path, "doc_id long, text string").select("*", F.col("_metadata.file_name").alias("file"))
    sizes = rows.groupBy("file").agg((F.count(F.lit(1)) <= 100).alias("bounded"))
    return rows.join(sizes, "file").drop("file")


@query("truncate_load", "SELECT doc_id, lang FROM documents WHERE lang <> 'en'")
def truncate_load(spark, sf_dir):
    path = scratch(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    writers.truncate_load(docs, path)
    writers.truncate_load(docs.where("lang <> 'en'"), path)
    return spark.read.parquet(path)


@query("versioned_overwrite", """SELECT 1::BIGINT AS version, doc_id FROM documents WHERE lang = 'en' UNION ALL
  SELECT 2, doc_id FROM documents WHERE lang <> 'en'""")
def versioned_overwrite(spark, sf_dir):
    path = scratch(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    made = [writers.versioned_overwrite(docs.where(c).select("doc_id"), path) for c in ("lang = 'en'", "lang <> 'en'")]
    one, two = [writers.read_version(spark, path, v).select(F.lit(v).cast("bigint").alias("version"), "doc_id") for v in made]
    return one.unionByName(two)


@query("compact_projection", "SELECT doc_id, n_chars FROM documents")
def compact_projection(spark, sf_dir):
    path = scratch(spark)
    writers.compact_projection(load(spark, sf_dir, "documents"), path, "doc_id", "n_chars")
    return spark.read.parquet(path)
