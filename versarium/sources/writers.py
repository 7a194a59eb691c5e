"""Sinks (SNK1-SNK9) on plain files."""

from pyspark.sql import functions as F

from versarium.operators.ordered import first_per_key


def write_partitioned(df, path, by="author", mode="overwrite"):
    """One folder per value. The rebalance hint lets AQE cut the partition of a
    hot value into several tasks and join small ones."""
    df.hint("rebalance", F.col(by)).write.mode(mode).partitionBy(by).parquet(path)


def write_master_sorted(df, path, *order, mode="overwrite"):
    """All rows in order; the sort is by range, over as many tasks as needed."""
    df.orderBy(*order).write.mode(mode).parquet(path)


def write_chunks(df, path, *order, size=0, mode="overwrite"):
    """CSV files in order of their names, of at most ``size`` rows if given;
    else one per task of the sort."""
    (df.orderBy(*order).write.mode(mode).option("maxRecordsPerFile", size)
     .csv(path, header=True, escape='"'))


def compact_projection(df, path, *columns, mode="overwrite"):
    df.select(*columns).write.mode(mode).parquet(path)


def truncate_load(df, path, size=0):
    """Replace the whole table."""
    df.write.mode("overwrite").option("maxRecordsPerFile", size).parquet(path)


def merge_latest(base, updates, keys, order):
    """Insert or update in memory: the row with the greatest ``order`` wins,
    and an update wins over a stored row of the same order."""
    both = (base.withColumn("new_", F.lit(0)).unionByName(updates.withColumn("new_", F.lit(1))))
    return first_per_key(both, keys, F.desc(order), F.desc("new_")).drop("new_")


def upsert(df, path, keys, version, *order):
    """Store a batch as version ``version``. Only the batch is written, one row
    per key, the first by ``order``; running the same version again replaces it,
    so a retry is safe. Without an order the batch has to hold a key once."""
    last = first_per_key(df, keys, *order) if order else df
    last.write.mode("overwrite").parquet(f"{path}/v={version:010d}")


def read_latest(spark, path, keys, before=None, order=()):
    """The stored row of every key that comes first by ``order`` and, among
    equals, has the newest version; from the versions below ``before``."""
    stored = spark.read.parquet(path)
    if before is not None:
        stored = stored.where(F.col("v").cast("bigint") < before)
    return first_per_key(stored, keys, *order, F.desc("v")).drop("v")


def compact(spark, path, keys, target, order=()):
    """Write the newest rows as version 0 of a new table folder."""
    upsert(read_latest(spark, path, keys, order=order), target, keys, 0)


def next_version(spark, path):
    """Version after the newest stored one; 1 for a new table."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 1
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max([int(n[2:]) for n in names if n.startswith("v=")], default=0) + 1


def versioned_overwrite(df, path):
    """Keep the old data as a backup version and write the new one."""
    version = next_version(df.sparkSession, path)
    df.write.mode("overwrite").parquet(f"{path}/v={version:010d}")
    return version


def read_version(spark, path, version):
    return spark.read.parquet(f"{path}/v={version:010d}")
