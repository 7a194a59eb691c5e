"""Corpus statistics (AGG1-AGG18). Every one is a partial + final aggregation;
distinct counts run over pre-grouped keys, not over raw rows."""

from pyspark.sql import functions as F

from versarium.operators.ordered import paged_list


def rows_per_key(df, key, n=None):
    """Rows per key, most first; ties by key, so that a limit is repeatable."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), key)
    return out if n is None else out.limit(n)


def corpus_totals(df, author, work, n_words):
    """Rows, authors, works, words. Grouping by (author, work) first leaves the
    distinct counts one row per pair."""
    pairs = df.groupBy(author, work).agg(F.count(F.lit(1)).alias("n"), F.sum(n_words).alias("w"))
    return pairs.agg(
        F.sum("n").alias("n_rows"), F.countDistinct(author).alias("n_authors"),
        F.countDistinct(work).alias("n_works"), F.sum("w").cast("bigint").alias("n_words"),
        F.round(F.sum("w") / F.sum("n"), 4).alias("mean_words"))


def works_per_author(df, author, work):
    pairs = df.groupBy(author, work).agg(F.count(F.lit(1)).alias("n"))
    return (pairs.groupBy(author)
            .agg(F.count(work).alias("n_works"), F.sum("n").alias("n_entries"))
            .withColumn("mean_entries", F.round(F.col("n_entries") / F.col("n_works"), 4)))


def distinct_values(df, column):
    """Sorted distinct values, one per row."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def role_counts(df, by, role):
    return df.groupBy(*by, role).agg(F.count(F.lit(1)).alias("n"))


def qa_rollup(df, by, role, roles):
    """Rows and rows per role, the dominant role, flags. Ties take the role
    that stands first in ``roles``."""
    counts = [F.count_if(F.col(role) == r).alias(f"n_{r}") for r in roles]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    best = F.array_max(F.array(*[
        F.struct(F.col(f"n_{r}").alias("n"), F.lit(-i).alias("tie"), F.lit(r).alias("role"))
        for i, r in enumerate(roles)]))
    flags = {f"has_{r}": (F.col(f"n_{r}") > 0).cast("int") for r in roles}
    return out.withColumn("dominant_role", best["role"]).withColumns(flags)


def structure_summary(df, by, role):
    """Role -> count map per group; the map has one entry per distinct role."""
    return (role_counts(df, by, role).groupBy(*by)
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(role, "n")))).alias("summary")))


def text_by_role(sections):
    """Main, introduction and appendix text of one array of sections. Works in
    the row, so no group is collected."""
    def joined(*roles):
        kept = F.filter(sections, lambda s: s["role"].isin(*roles) & (s["text"] != ""))
        return F.array_join(F.transform(kept, lambda s: s["text"]), "\n\n")
    main, intro = joined("main", "appendix", "notes"), joined("intro")
    return {"main_text": F.coalesce(F.nullif(main, F.lit("")), intro), "intro_text": intro,
            "appendix_text": joined("appendix")}


def max_per_key(df, key, value, out):
    return df.groupBy(key).agg(F.max(value).alias(out))


def group_collect(df, by, order, fields, size=1000):
    return paged_list(df, by, order, fields, size)


def extraction_stats(df, work, kind):
    """Works, segments, footnotes, introductions and their rate."""
    per_work = df.groupBy(work).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(kind) == "footnote").alias("f"),
        F.count_if(F.col(kind) == "introduction").alias("i"))
    return per_work.agg(
        F.count(F.lit(1)).alias("n_works"), F.sum("n").alias("n_segments"),
        F.sum("f").alias("n_footnotes"), F.sum("i").alias("n_introductions"),
        F.round(100 * F.count_if(F.col("n") > 1) / F.count(F.lit(1)), 1).alias("rate"))


def first_last(df, by, order, text):
    """First and last text of each group."""
    return df.groupBy(by).agg(F.min_by(text, order).alias("first_text"),
                              F.max_by(text, order).alias("last_text"))


def distinct_like(df, column, stems):
    """Distinct names that contain one of the stems."""
    return df.where(F.rlike(F.col(column), F.lit("(?i)" + "|".join(stems)))).select(column).distinct()
