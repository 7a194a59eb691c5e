"""Quality gate, duplicate removal and audit reports."""

from pyspark.sql import functions as F

from versarium import patterns as P
from versarium.functions import predicates as Q
from versarium.functions import text as T
from versarium.operators.ordered import first_per_key


def computed_once(df, name, column):
    """Add a costly column behind a generator, so that the optimizer does not
    copy its expression into every filter and projection that uses it."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(column)).alias(name))


def keep_first_duplicate(df, text, order, scope=(), prefix=None):
    """First row per scope (file, page) and duplicate key survives.

    Whole texts are compared, by the hash of their key; ``prefix`` compares only that many
    characters of it. A text without a letter or digit has an empty key and is no copy of another.
    """
    key = T.dup_key(F.col(text), prefix)
    # a text without a key gets one of its own, shorter than any hash, so one window serves all rows
    keyed = computed_once(df, "dup_key_", T.let(key, lambda k: F.when(k != "", F.sha2(k, 256))))
    keyed = keyed.withColumn("dup_key_", F.coalesce("dup_key_", F.monotonically_increasing_id().cast("string")))
    return first_per_key(keyed, [*scope, "dup_key_"], order).drop("dup_key_")


def dedup_exact(df, text, order, scope=()):
    """A text already seen in the scope is dropped; compared by its hash."""
    keyed = df.withColumn("hash_", F.sha2(F.col(text), 256))
    return first_per_key(keyed, [*scope, "hash_"], order).drop("hash_")


def quality_gate(df, text, order, scope=(), min_words=15):
    """Clean, validate, drop duplicates, recount words, drop short texts."""
    cleaned = computed_once(df, text, T.deep_clean(F.col(text)))
    valid = computed_once(cleaned, "valid_", Q.valid_text(F.col(text))).where("valid_").drop("valid_")
    # counted before the shuffle, so that a report without the text does not move it
    counted = valid.withColumn("n_words", T.word_count(F.col(text)))
    return keep_first_duplicate(counted, text, order, scope).where(F.col("n_words") >= min_words)


def before_after(before, after, by):
    """Rows before and after per group and in total. Counting after grouping
    keeps the shuffle at one row per group and task."""
    counted = (before.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("m"))
               .unionByName(after.groupBy(by).agg(F.lit(0).cast("bigint").alias("n"),
                                                  F.count(F.lit(1)).alias("m"))))
    return (counted.rollup(by).agg(F.sum("n").alias("original"), F.sum("m").alias("cleaned"))
            .withColumn("removed", F.col("original") - F.col("cleaned")))


def column_profile(df):
    """Type and null count of every column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    types = dict(df.dtypes)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"),
                              F.col(f"`{c}`").alias("n_null")) for c in df.columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def length_profile(df, text):
    n = F.length(text)
    return df.agg(F.max(n).cast("bigint").alias("max_length"), F.round(F.avg(n), 4).alias("mean_length"))


def duplicate_ids(df, *key):
    """Rows beyond the first per id."""
    return (df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("extra"))
            .agg(F.sum("extra").alias("duplicates")))


def astral_count(df, text):
    """Rows with a code point above U+FFFF."""
    return df.agg(F.count_if(F.rlike(F.col(text), F.lit(r"[\x{10000}-\x{10FFFF}]"))).alias("n_astral"))


def artifact_issues(c):
    """Issues of one text: the first suspicious pattern, too short, too few words."""
    first = None
    for name, rx in P.SUSPICIOUS:
        first = F.when(rx.found(c), name) if first is None else first.when(rx.found(c), name)
    return F.array_compact(F.array(
        first, F.when(F.length(T.trim_space(c)) < 50, "short_text"),
        F.when(T.word_count(c) < 15, "few_words")))


def artifact_report(df, by, text):
    """Issue counts per group."""
    issues = df.where(F.col(text).isNotNull()).select(
        by, F.explode(artifact_issues(F.col(text))).alias("issue"))
    return issues.groupBy(by, "issue").agg(F.count(F.lit(1)).alias("n"))


def artifact_examples(df, by, text, order, k=3):
    """The first k issues per group with the text's end."""
    from versarium.operators.ordered import top_per_key
    issues = df.where(F.col(text).isNotNull()).select(
        by, order, F.posexplode(artifact_issues(F.col(text))).alias("pos", "issue"),
        F.right(F.col(text), F.lit(100)).alias("tail"))
    return top_per_key(issues, [by], k, order, "pos").drop("pos")


def split_good_reject(df, rules):
    """Rows that pass every rule, and the others with the reason (SNK5).
    ``rules`` maps a reason to a condition that a good row meets."""
    reason = None
    for name, ok in rules.items():
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    marked = df.withColumn("reject_reason", reason)
    return (marked.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            marked.where(F.col("reject_reason").isNotNull()))


def size_window(df, by, low=5, high=50):
    """Groups of low..high rows, smallest first."""
    return (df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(low, high))
            .orderBy("n", by))
