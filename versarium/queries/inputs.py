"""Input frames derived from the given tables."""

from pyspark.sql import functions as F

from versarium.session import load, load_text, spread


def marked_documents(spark, sf_dir):
    """Documents with the marks that the cleaning rules remove; see MARKED."""
    def text(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    doc, source, lang = F.col("doc_id").cast("string"), F.col("source"), F.col("lang")
    body = F.replace(F.col("text"), F.lit(". "), F.lit(" (3). S. 12 "))
    mark = text(" [", doc, "]\nAutor: ", source, "\nPriester ", lang, "\n")
    body = F.replace(body, F.lit("\n"), mark)
    t = text(doc, ", ", body, " vgl. https://x.example/", source, " lib. IV n. 7 ",
             F.col("n_chars").cast("string"))
    return load_text(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars",
                                                        t.alias("t"))


def verses(spark, sf_dir):
    """A verse table over the book list, one row per verse and translation."""
    from versarium import dims
    flag = F.col("l_returnflag")
    tr = F.when(flag == "A", "allioli").when(flag == "N", "schoeningh").otherwise("einheit")
    rows = load(spark, sf_dir, "lineitem").select(
        F.pmod("l_suppkey", F.lit(73)).cast("int").alias("book_ix"), tr.alias("translation"),
        (F.pmod("l_orderkey", F.lit(30)) + 1).cast("int").alias("chapter"),
        (F.pmod("l_partkey", F.lit(40)) + 1).cast("int").alias("verse"),
        (F.ascii("l_linestatus") * 100 + F.col("l_linenumber")).alias("code"))
    # the least text as a number, so that the aggregation can hash
    least = rows.groupBy("book_ix", "translation", "chapter", "verse").agg(F.min("code").alias("code"))
    text = F.concat(F.chr(F.floor(F.col("code") / 100)), (F.col("code") % 100).cast("string"))
    unique = least.withColumn("text", text).drop("code")
    names = dims.books_df(spark).join(F.broadcast(dims.book_names_df(spark)), "display")
    return (unique.join(F.broadcast(names.select("book_ix", "translation", "db_name")), ["book_ix", "translation"])
            .select("translation", F.col("db_name").alias("book"), "chapter", "verse", "text"))


def citing(spark, sf_dir):
    """Orders with the parts of a reference drawn from their keys."""
    from versarium import dims
    orders = spread(load(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey", F.pmod("o_custkey", F.lit(73)).cast("int").alias("book_ix"),
        (F.pmod("o_orderkey", F.lit(29)) + 1).cast("int").alias("c"),
        (F.pmod("o_custkey", F.lit(20)) + 1).cast("int").alias("s"),
        (F.pmod("o_custkey", F.lit(20)) + 1 + F.pmod("o_orderkey", F.lit(6))).cast("int").alias("e"))
    return orders.join(F.broadcast(dims.books_df(spark)), "book_ix")


def citing_texts(spark, sf_dir):
    """Running text with two citations and a lower-case one per order."""
    return citing(spark, sf_dir).select("o_orderkey", F.format_string(
        "Siehe %s %d,%d–%d und vgl. %s %d:%d; mt 5,3.", "abbr", "c", "s", "e", "display", F.col("c") + 1,
        "s").alias("text"))


def lectionary_refs(spark, sf_dir):
    spaced = F.regexp_replace("abbr", r"^([123])", "$1 ")
    c, s, e = F.col("c"), F.col("s"), F.col("e")
    return citing(spark, sf_dir).select("o_orderkey", F.format_string(
        "Lesung aus %s %d, %d-%da.%df; %d, %d u. %d", spaced, c, s, e, e + 3, c + 1, s, s + 2).alias("ref"))
