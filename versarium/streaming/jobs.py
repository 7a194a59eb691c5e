"""Structured Streaming forms (STR1-STR6). Every sink write is keyed by the
batch id, so a batch that runs twice leaves the same data."""

from pyspark.sql import functions as F

from versarium.operators.segment import greedy_align
from versarium.operators.vectors import encode_whole, hashed_encoder
from versarium.sources.writers import read_latest, upsert


def file_stream(spark, folder, schema, pattern="*.parquet", files_per_batch=100):
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def table_stream(spark, folder, table, schema, files_per_batch=100):
    """A table as a stream, be it one Parquet file or a folder of part files. The name is given as a
    pattern, as a stream takes a plain path for a folder."""
    return file_stream(spark, f"{folder}/{table}.[p]arquet", schema, "*", files_per_batch)


def run_available(writer, checkpoint):
    """Take everything that is there now, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(stream, path, checkpoint):
    """STR1: new files into a table, saved batch by batch."""
    run_available(stream.writeStream.format("parquet").option("path", path), checkpoint)


def upsert_stream(stream, path, keys, checkpoint, *order):
    """STR3: keep the newest row per key. ``order`` (newest first) decides, also
    over batches: read with ``read_latest(..., order=order)``, late rows lose."""
    def store(batch, batch_id):
        upsert(batch, path, keys, batch_id, *order)
    run_available(stream.writeStream.foreachBatch(store).outputMode("append"), checkpoint)


def latest_per_key(stream, key, order, fields):
    """STR4: newest item per key, as an update stream."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("item")).select(key, "item.*")


def latest_stream(stream, key, order, fields, path, checkpoint):
    def store(batch, batch_id):
        upsert(batch, path, [key], batch_id)
    latest = latest_per_key(stream, key, order, fields)
    run_available(latest.writeStream.foreachBatch(store).outputMode("update"), checkpoint)


def backlog_stream(stream, done, key, text, path, checkpoint, encoder=hashed_encoder, limit=6000):
    """STR2 and STR6: items without a stored result are computed and stored."""
    todo = stream.join(done.select(key), key, "left_anti").select(key, text)

    def store(batch, batch_id):
        upsert(encode_whole(batch, key, text, limit, encoder), path, [key], batch_id)
    run_available(todo.writeStream.foreachBatch(store).outputMode("append"), checkpoint)


def cache_fill(stream, key, compute, path, checkpoint):
    """STR6: every key is computed once and kept. Repeats within a batch are dropped; what is left is
    looked up in the results of the batches before, which count as done, however long ago. No watermark
    is set, as it would drop late rows and with them keys that were never computed. ``compute`` gives
    the rows to store, one per key, for a frame of misses."""
    def store(batch, batch_id):
        misses = batch.dropDuplicates([key])
        if batch_id > 0:
            misses = misses.join(read_latest(batch.sparkSession, path, [key], before=batch_id).select(key), key, "left_anti")
        upsert(compute(misses), path, [key], batch_id)
    run_available(stream.writeStream.foreachBatch(store).outputMode("append"), checkpoint)


def align_stream(chunks, session, order, spoken, expected, path, checkpoint):
    """STR5: pointer into the expected words per session. A batch stores its chunks and folds all stored
    chunks of the sessions it touches, in order, so late chunks find their place and a batch that
    runs again gives the same pointers; there is no state besides the chunks."""
    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/chunks/v={batch_id:010d}")
        stored = batch.sparkSession.read.parquet(f"{path}/chunks").where(F.col("v").cast("bigint") <= batch_id)
        touched = stored.join(batch.select(session).distinct(), session, "left_semi")
        said = F.transform(F.array_sort(F.collect_list(F.struct(order, spoken))), lambda r: r[spoken])
        words = touched.groupBy(session).agg(F.flatten(said).alias("said_"), F.first(expected).alias("expected_"))
        moved = words.select(session, greedy_align(F.col("expected_"), F.col("said_"), F.lit(0)).alias("pointer"))
        upsert(moved, f"{path}/pointers", [session], batch_id)
    run_available(chunks.writeStream.foreachBatch(store).outputMode("append"), checkpoint)


def pointers(spark, path, session):
    return read_latest(spark, f"{path}/pointers", [session])
