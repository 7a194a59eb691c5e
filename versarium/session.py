"""Session builder and the few session settings the operators rely on."""

import tempfile
import uuid

import numpy as np
from pyspark.sql import SparkSession

# Settings that change results or plans. Memory and parallelism stay with the
# cluster; AQE sizes and splits the shuffle partitions at run time.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app_name="versarium", master=None, **conf):
    """A session with ENGINE_CONF; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cores="8", app_name="versarium-local"):
    return build_session(
        app_name,
        f"local[{cores}]",
        versarium__local__spread=str(cores),
        spark__sql__shuffle__partitions=str(cores),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
        spark__driver__host="127.0.0.1",
    )


def ensure_checkpoint_dir(spark):
    """The shared folder the cluster names; a local one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if shared:
        context.setCheckpointDir(shared)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="versarium-ckpt-"))
    return context.getCheckpointDir()


def staged(df, name):
    """`df` written as Parquet into the shared checkpoint folder and read back.

    Cuts the lineage: what follows does not run `df` again, and a lost executor costs a
    read of the written files at most. One folder per call, so that a retry never mixes.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/versarium/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df, *keys):
    """In a session of local_session(), whose tables are single files, deal the rows
    to the cores by key. On a cluster a scan keeps its partitions."""
    cores = df.sparkSession.conf.get("versarium.local.spread", None)
    return df.repartition(int(cores), *keys) if cores else df


TEXT_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def load_text(spark, sf_dir, table, *columns):
    """A text table, pruned to the named columns and spread over the cores."""
    keys = TEXT_KEYS[table]
    df = load(spark, sf_dir, table)
    if columns:
        df = df.select(*columns)
    return spread(df, *keys)


def in_slices(batch, sizes, limit):
    """An Arrow batch in parts whose rows' sizes add up to about ``limit``, of one row at least.

    A session may hand over 10,000 rows at once; what a task makes of a part does not add up with the others.
    """
    sizes = np.asarray(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    turn = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(turn, prepend=-1)) if len(turn) else np.zeros(0, np.int64)
    for low, high in zip(edges, np.append(edges[1:], len(turn))):
        yield batch.slice(int(low), int(high - low))
