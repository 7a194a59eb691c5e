"""Sources (SRC1-SRC14). Every reader has an explicit schema; nothing is inferred."""

from pyspark.sql import functions as F

from versarium.functions import predicates as Q
from versarium.functions import text as T
from versarium.operators.ordered import first_per_key

CSV = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": False, "mode": "FAILFAST"}
VERSE_XML = ("_bname string, CHAPTER array<struct<_cnumber:int,"
             "VERS:array<struct<_vnumber:int,_VALUE:string>>>>")


def csv_scan(spark, path, schema):
    """Header, quoted multi-line fields, doubled quotes. A header that differs
    from the schema is an error."""
    return spark.read.schema(schema).options(**CSV).csv(path)


def glob_scan(spark, path, schema, skip=("backup", "Unbekannt")):
    """All CSV files of a glob, but for names with a skip word; adds file_name."""
    df = csv_scan(spark, path, schema).withColumn("file_name", F.col("_metadata.file_name"))
    for word in skip:
        df = df.where(~F.contains("file_name", F.lit(word)))
    return df


def author_from_file(file_name, prefix="kirchenvater_"):
    """``prefix_A_B.csv`` -> ``A B``."""
    stem = F.regexp_replace(file_name, r"\.csv$", "")
    return F.replace(F.regexp_replace(stem, "^" + prefix, ""), F.lit("_"), F.lit(" "))


def xml_verse_scan(spark, path):
    """One row per verse of a BIBLEBOOK / CHAPTER / VERS file."""
    books = spark.read.format("xml").option("rowTag", "BIBLEBOOK").schema(VERSE_XML).load(path)
    chapters = books.select(F.col("_bname").alias("book"), F.explode("CHAPTER").alias("c"))
    verses = chapters.select("book", F.col("c._cnumber").alias("chapter"), F.explode("c.VERS").alias("v"))
    return verses.select("book", "chapter", F.col("v._vnumber").alias("verse"),
                         T.trim_space(T.blank_null(F.col("v._VALUE"))).alias("text"))


def html_files(spark, path):
    return (spark.read.text(path, wholetext=True)
            .select(F.col("value").alias("html"), F.col("_metadata.file_path").alias("file_path")))


def html_verses(df):
    """Verses of chapter pages ``nt|ot/Book_N.html`` with columns html, file_path."""
    name = F.regexp_extract("file_path", r"([^/]+)\.html$", 1)
    folder = F.regexp_extract("file_path", r"/(nt|ot)/[^/]+$", 1)
    head = F.split(name, "_")
    # verse blocks hold no div, so the first closing tag ends them
    blocks = F.regexp_extract_all("html", F.lit(r'(?s)<div class="v"[^>]*>(.*?)</div>'), F.lit(1))
    rows = df.where(folder != "").select(
        F.when(folder == "nt", "NT").otherwise("OT").alias("testament"),
        F.element_at(head, 1).alias("book"),
        F.coalesce(F.get(head, 1).try_cast("int"), F.lit(1)).alias("chapter"),
        F.posexplode(blocks).alias("pos", "block"))
    number = F.trim(F.regexp_extract("block", r'<span class="vn">([^<]*)</span>', 1)).try_cast("int")
    bare = F.regexp_replace("block", r'(?s)<span class="vn">.*?</span>|<sup\b.*?</sup>|<h[234]\b.*?</h[234]>', " ")
    text = T.clean_verse(T.collapse_ws(T.decode_entities(F.regexp_replace(bare, "<[^>]+>", " "))))
    return (rows.select("testament", "book", "chapter", number.alias("verse"), text.alias("text"))
            .where(F.col("verse").isNotNull() & (F.col("text") != "")))


def html_verse_scan(spark, path):
    return html_verses(html_files(spark, path))


def html_footnotes(df):
    """``div.fn`` notes with their anchor number; link text is kept."""
    blocks = F.regexp_extract_all("html", F.lit(r'(?s)<div class="fn">(.*?)</div>'), F.lit(1))
    rows = df.select(F.regexp_extract("file_path", r"([^/]+)\.html$", 1).alias("page"),
                     F.posexplode(blocks).alias("pos", "block"))
    number = F.regexp_extract("block", r'<a name="fn(\d+)"', 1).try_cast("int")
    text = T.clean_markup(F.regexp_replace("block", r"(?s)<sup\b.*?</sup>", ""))
    return rows.select("page", number.alias("number"), text.alias("text"))


def manifest_scan(df, url="url"):
    """Non-empty URLs of a link list."""
    return df.where(T.trim_space(T.blank_null(F.col(url))) != "").select(T.trim_space(F.col(url)).alias("url"))


def encoding_fallback(spark, path):
    """Files decoded as UTF-8, or as Latin-1 where they are not valid UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(valid, F.decode("content", "UTF-8"))
                        .otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


def line_verses(df, value="value"):
    """Comma lines with at least four parts; the rest is text, outer quotes off."""
    parts = F.split(value, ",", 4)
    text = F.regexp_replace(F.get(parts, 3), '^"|"$', "")
    return (df.where(F.size(parts) >= 4)
            .select(F.get(parts, 0).alias("book"), F.trim(F.get(parts, 1)).try_cast("int").alias("chapter"),
                    F.trim(F.get(parts, 2)).try_cast("int").alias("verse"), text.alias("text"))
            .where(F.col("chapter").isNotNull()))


def tolerant_line_parse(spark, path):
    return line_verses(spark.read.text(path))


_ATTRS = "id:string,slug:string,key:string,title:string,name:string,text:string,content:string,body:string"
ITEM = f"struct<id:string,slug:string,title:string,text:string,attributes:struct<{_ATTRS}>>"
PLAIN_ITEM = f"struct<id:string,slug:string,title:string,text:string,attributes:struct<{_ATTRS}>>"
CATEGORY = (f"struct<id:string,name:string,attributes:struct<slug:string,name:string,title:string,"
            f"prayers:struct<data:array<{PLAIN_ITEM}>>>,prayers:array<{PLAIN_ITEM}>>")


def _first(*options):
    return F.coalesce(*[T.nonempty(o) for o in options])


def _item_fields(i):
    a = i["attributes"]
    title = F.coalesce(_first(a["title"], a["name"], i["title"]), F.lit("Gebet"))
    key = F.coalesce(i["id"], a["id"], a["slug"], T.slugify(title))
    return F.struct(key.alias("id"), F.coalesce(_first(a["slug"], a["key"], i["slug"]), key).alias("slug"),
                    title.alias("title"), F.coalesce(_first(a["text"], a["content"], a["body"], i["text"]),
                                                     F.lit("")).alias("text"))


def map_item(json):
    """One item with its alternates resolved."""
    return _item_fields(F.from_json(json, ITEM))


def json_nested_flatten(df, json="json"):
    """Categories with embedded items, from ``[...]`` or ``{"data": [...]}``."""
    wrapped = F.when(F.startswith(F.ltrim(json), F.lit("[")), F.concat(F.lit('{"data":'), json, F.lit("}"))) \
        .otherwise(F.col(json))
    cats = df.select(F.explode(F.from_json(wrapped, f"struct<data:array<{CATEGORY}>>")["data"]).alias("c"))
    name = F.coalesce(_first(F.col("c.attributes.name"), F.col("c.attributes.title"), F.col("c.name")),
                      F.lit("Kategorie"))
    cats = cats.select(F.coalesce(_first(F.col("c.attributes.slug"), T.slugify(name)), F.col("c.id")).alias("category"),
                       name.alias("category_name"),
                       F.coalesce("c.attributes.prayers.data", "c.prayers").alias("items"))
    rows = cats.where(Q.ordinary_category(F.col("category_name"))) \
        .select("category", "category_name", F.explode_outer("items").alias("i"))
    return rows.select("category", "category_name",
                       F.when(F.col("i").isNotNull(), _item_fields(F.col("i"))).alias("item"))


CELEBRATION = "struct<Tl:string,Bem:string,L1:string,AP:string,L2:string,EV:string>"


def celebration_flatten(df, keys, json="json"):
    """Ordered celebrations of a day; a byte-order mark is dropped."""
    bare = F.trim(F.regexp_replace(json, r"^\s*\x{FEFF}", ""))
    days = F.from_json(bare, f"struct<Zelebrationen:map<string,{CELEBRATION}>>")["Zelebrationen"]
    return (df.select(*keys, F.posexplode(F.map_entries(days)).alias("pos", "e"))
            .select(*keys, "pos", F.col("e.key").alias("key"), "e.value.*"))


def main_celebration(df, keys, phrase="woche im jahreskreis"):
    """The first celebration whose title has the phrase, else the last one."""
    whole = F.struct("pos", "key", "Tl", "Bem", "L1", "AP", "L2", "EV")
    fits = F.contains(F.lower("Tl"), F.lit(phrase))
    best = F.coalesce(F.min_by(F.when(fits, whole), F.when(fits, F.col("pos"))), F.max_by(whole, "pos"))
    return df.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.*")


FEED_XML = "title string, link string, category array<string>, enclosure struct<_url:string>, pubDate string"


def feed_items(spark, path):
    """Items of a feed, CDATA and entities decoded."""
    items = spark.read.format("xml").option("rowTag", "item").schema(FEED_XML).load(path)
    # the weekday in front carries no information and is not parsed
    stamp = F.regexp_extract("pubDate", r"([0-9]{1,2} [A-Za-z]{3} .*)$", 1)
    # entities inside CDATA are left for us to decode
    return items.select(
        F.trim(T.decode_entities(F.col("title"))).alias("title"), F.trim(T.decode_entities(F.col("link"))).alias("link"),
        F.transform("category", T.decode_entities).alias("categories"), F.col("enclosure._url").alias("audio"),
        F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"))


BOOK_DIM = "abbr string, short string, long string, osis string, type string, nt boolean, chapters int"


def book_dim_scan(spark, path):
    """Book metadata from a JSON array."""
    return spark.read.schema(BOOK_DIM).json(path, multiLine=True)


def page_group(df, work="work", url="url", html="html", page="page_no"):
    """Pages of a work in order, up to the first gap or not-found page."""
    good = df.where(~Q.error_page(F.col(html)))
    one = first_per_key(good, [work, page], url)
    # a run without gap has page number minus rank equal to zero
    return contiguous_pages(one, work, page)


def contiguous_pages(df, work, page):
    from versarium.operators.ordered import number_rows
    ranked = number_rows(df, [work], page, "rank_")
    return ranked.where(F.col(page) == F.col("rank_")).drop("rank_")


def page_number(url):
    """Page number in a URL query, 1 where there is none."""
    return F.coalesce(T.nonempty(F.regexp_extract(url, r"[?&]page=(\d+)", 1)).try_cast("int"), F.lit(1))


