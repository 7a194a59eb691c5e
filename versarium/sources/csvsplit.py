"""Reader of quoted, multi-line CSV files by many tasks (SRC1)."""

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BAD = "_bad_record"
OUT = "record string, file string, chain long, header boolean, start long"


def _lines(spark, path):
    """The lines of the files with the byte range they are read in, and the quotes in each."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.col("value").alias("line"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))


def _quotes_of_ranges(batches):
    """(file, start, quotes, closes): quotes of a range; if it starts inside quotes, does a line end outside?"""
    where, total, closes = None, 0, False
    for batch in batches:
        rows = batch.to_pandas()
        for place, part in rows.groupby(["file", "start"], sort=False)["quotes"]:
            if place != where:
                if where:
                    yield pa.RecordBatch.from_pylist([dict(file=where[0], start=where[1], quotes=total, closes=closes)])
                where, total, closes = place, 0, False
            sums = total + np.cumsum(part.to_numpy())
            closes = bool(closes or (sums % 2 == 1).any())
            total = int(sums[-1])
    if where:
        yield pa.RecordBatch.from_pylist([dict(file=where[0], start=where[1], quotes=total, closes=closes)])


def range_states(lines):
    """(file, start, inside, opened) of each byte range: does it start inside quotes, and in which range
    did the record begin that is open there? One row per range, from the quotes of the ranges before."""
    ranges = lines.select("file", "start", "quotes").mapInArrow(_quotes_of_ranges, "file string, start long, quotes long, closes boolean")
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    ends_inside = (F.col("inside").cast("int") + F.col("quotes")) % 2 == 1
    begins = ends_inside & (~F.col("inside") | F.col("closes"))
    return ranges.select("file", "start", "inside", F.last(F.when(begins, F.col("start")), ignorenulls=True).over(before).alias("opened"))


def _records(states, broken):
    """Batches of lines to the records that lie in one range, or (`broken`) to the parts of the others."""
    def give(rows, file):
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([
            pa.array(columns[0], pa.string()), pa.array([file] * len(rows), pa.string()), pa.array(columns[1], pa.int64()),
            pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.int64())], names=["record", "file", "chain", "header", "start"])

    def assemble(batches):
        known, where = states.value, None
        parts, inside, chain, first, head = [], False, None, False, False
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "start", "line", "quotes")))
            for place, lines in groupby(rows, key=lambda r: r[:2]):
                if place != where:
                    if broken and parts:
                        yield give([("\n".join(parts), chain, first, where[1])], where[0])
                    if place not in known:
                        raise ValueError(f"{place}: the byte ranges have changed since their quotes were counted")
                    where, parts, first = place, [], place[1] == 0
                    inside, chain = known[place]
                    head = inside
                    if not inside:
                        chain = place[1]
                done = []
                for _, start, line, quotes in lines:
                    parts.append(line)
                    if quotes & 1:
                        inside = not inside
                    if not inside:
                        if head == broken:
                            done.append(("\n".join(parts), chain, first, start))
                        parts, chain, first, head = [], start, False, False
                if done:
                    yield give(done, place[0])
        if broken and parts:
            yield give([("\n".join(parts), chain, first, where[1])], where[0])
    return assemble


def csv_records(spark, path):
    """(record, header) of quoted CSV files: one row per record, line breaks inside quotes kept.

    Every byte range of a file is a task of its own. A first pass counts the quotes of each range; the sums
    before a range tell whether it begins inside quotes, so its task knows which line breaks end a record.
    A record that crosses ranges is put together from its parts. The text is read three times, and only
    parts of such records are shuffled; the driver holds one entry per range. A quote that is never closed
    makes the rest of its file one record.
    """
    lines = _lines(spark, path)
    # one entry per byte range of spark.sql.files.maxPartitionBytes
    states = {(r.file, r.start): (r.inside, r.opened) for r in range_states(lines).collect()}
    shared = spark.sparkContext.broadcast(states)
    whole = lines.mapInArrow(_records(shared, False), OUT)
    parts = lines.mapInArrow(_records(shared, True), OUT)
    joined = F.array_sort(F.collect_list(F.struct("start", "record")))
    stitched = parts.groupBy("file", "chain").agg(joined.alias("p"), F.max("header").alias("header")).select(
        F.array_join(F.transform("p", lambda p: p["record"]), "\n").alias("record"), "header", "file")
    return whole.select("record", "header", "file").union(stitched)


def csv_scan_split(spark, path, schema, bad=BAD):
    """The rows of `csv_scan`, read by as many tasks as the files have byte ranges.

    Header and values are read as `csv_scan` reads them: doubled quotes, empty fields null, a header that
    differs from the schema is an error. A record that does not fit the schema fails nothing: its text is in
    the column `bad`, which is null for the others, and the fields that could not be read are null. Files
    without rows give none.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    plain = ", ".join(f"`{f.name}` string" for f in fields)
    records = csv_records(spark, path).withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    names = F.array(*[F.lower(F.col(f"h.`{f.name}`")) for f in fields])
    wanted = F.array(*[F.lit(f.name.lower()) for f in fields])
    header = F.from_csv(F.regexp_replace("record", "\\A\ufeff", ""), plain, {"escape": '"'})
    fits = F.when(~F.col("header"), True).when(names == wanted, False).otherwise(
        F.raise_error(F.concat(F.lit("header differs from the schema: "), "record")).cast("boolean"))
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{bad}` string"
    rows = records.withColumn("h", F.when(F.col("header"), header)).where(fits)
    return rows.select(F.from_csv("record", full, options).alias("r")).select("r.*")
