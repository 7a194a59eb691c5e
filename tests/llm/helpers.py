"""Rows that every operator has to bear: nulls, empty and long texts, repeats, clashing columns."""

LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(30_000))
ODD = [(1, "The quick brown fox jumps over the lazy dog again and again.", "en", "s"), (2, None, "en", None), (3, "", None, "s"),
       (4, "  \n\t ", "de", "s"), (None, "a row without an id", "en", "s"), (5, LONG, None, "s"), (6, LONG, "en", "s"),
       (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "s"), (7, "é", "fr", "s"), (8, "123 !!", "en", "s")]
EXTRA = ["fp", "u", "v", "h", "m", "w", "label", "score", "node", "pos", "rank", "removed", "shingle", "side", "query_id", "text2"]


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    """The rows with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit("x").alias(c) for c in EXTRA])


def documents(spark, scale="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet")
