"""Small helpers that the operators of this subpackage share."""

import sys
import types

from pyspark.sql import functions as F

from versarium.session import staged  # noqa: F401  (used by all operators of this subpackage)


def small_batches(spark):
    """Arrow batches of up to 2000 rows and 16 MB where the session has Spark's defaults.

    A Python worker holds a batch several times over (Arrow, strings, results), and long texts
    come in batches of 10,000 rows and 64 MB otherwise. The queries and the pipeline, which own
    their session, call this; operators leave the caller's settings alone.
    """
    for key, default, value in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", "67108864b", "16m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


def pick(df, **columns):
    """Only the named input columns, under the operator's own names.

    Everything else in `df` is left out, so further columns never clash.
    """
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def lower_ascii(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(key, folds):
    """crc32 of the key as text, modulo `folds`; the key null: of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def let(value, use):
    """`use(value)` with `value` worked out once per row, also where a lambda uses it per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_pieces(texts, limit=1 << 19):
    """Lists of texts of about `limit` characters, so that long texts do not add up in memory."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text) if text else 0
        if size > limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def held(name, make):
    """What `make` gives, once per Python worker process (workers are used for many tasks)."""
    kept = sys.modules.setdefault("_held_by_worker", types.ModuleType("_held_by_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
