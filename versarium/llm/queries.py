"""The registered queries: each applies its operator to its whole table."""

from pyspark.sql import functions as F

from versarium import session
from versarium.llm import (
    bpe, decontam, divergence, language, lines, passages, repeats, resample, secrets, simhash, toxicity, urls, vptree)
from versarium.llm.common import crc_fold, small_batches
from versarium.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


def load(spark, sf_dir, table):
    small_batches(spark)
    return session.load(spark, sf_dir, table)


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(found.fp).alias("fingerprint"), "component_id", "copies")


@query("op10_bpe")
def op10_bpe(spark, sf_dir):
    return bpe.round_trips(load(spark, sf_dir, "documents"))


@query("op2_url_filter")
def op2_url_filter(spark, sf_dir):
    return urls.judge_urls(load(spark, sf_dir, "pages"))


@query("op3_decontamination", decontam.ORACLE)
def op3_decontamination(spark, sf_dir):
    return decontam.contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op9_secrets")
def op9_secrets(spark, sf_dir):
    found = secrets.secret_spans(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), number("random"),
                        F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled("spans").alias("spans"))


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 4)
    languages = language.train(docs.filter(fold != 2))
    found = language.identify(docs, languages)
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_line_dedup")
def op6_line_dedup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    cut = lines.drop_repeated_lines(docs)
    places = F.transform("removed", lambda r: r["pos"].cast("string"))
    return cut.select("doc_id", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.array_join(places, ","), F.lit("")).alias("removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    return passages.repeated_passages(load(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    labels = labels.filter(crc_fold(F.col("doc_id"), 3) != 1)
    found = toxicity.scored(docs, toxicity.train(docs, labels))
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op7_nearest")
def op7_nearest(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query("op11_importance_resampling", resample.ORACLE)
def op11_importance_resampling(spark, sf_dir):
    return resample.resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op12_source_divergence", divergence.ORACLE)
def op12_source_divergence(spark, sf_dir):
    return divergence.audit(load(spark, sf_dir, "documents"))


@query("op13_suffix_dedup")
def op13_suffix_dedup(spark, sf_dir):
    found = repeats.without_repeats(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
