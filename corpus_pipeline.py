"""Training-data pipeline over `documents`: STAGES, run() and ORACLE_SQL."""

from pyspark.sql import functions as F

from versarium.llm import bpe, decontam, language, lines, simhash
from versarium.llm.common import small_batches, staged
from versarium.session import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark, docs, sf_dir):
    """Keep the documents in a language that the corpus itself teaches; unrecognised ones go."""
    small_batches(spark)
    return language.accepted(docs, language.train(docs)).select(*COLUMNS)


def line_dedup(spark, docs, sf_dir):
    """Cut the aligned blocks that earlier documents hold; a document cut to nothing goes."""
    small_batches(spark)
    cut = lines.drop_repeated_lines(docs.select(*COLUMNS)).filter("removed is null or trim(text) <> ''")
    return cut.withColumn("n_chars", F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(
        F.length("text").cast("long"))).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """Keep the first document of each SimHash component."""
    small_batches(spark)
    return simhash.one_of_each(docs).select(*COLUMNS)


def decontaminate(spark, docs, sf_dir):
    """Drop the documents that hold a benchmark item."""
    return decontam.without_leaks(docs, load(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark, docs, sf_dir):
    """Token ids of every document, with the digest of their decoded text."""
    small_batches(spark)
    return bpe.encoded(docs, keep=["lang", "source"])


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", encode)]

# Language models, patience diff, SimHash and BPE are outside SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = staged(docs, f"stage{number}")
    return docs
