"""Ordered state per group: numbering, carry-forward, first per key.

A window over a group runs in one task, so these operators do not use one. The rows are sorted
into ranges of (group, order), whatever their types; each range is scanned once and written, and a
table with one row per range says what the ranges before hand on. Ties may fill several ranges.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from versarium.session import staged

PLACE = [S.StructField("part_", S.IntegerType()), S.StructField("place_", S.LongType()), S.StructField("head_", S.BooleanType())]


def _changes(batch, by, last):
    """Whether each row is of another group than the row before it, which is in ``last`` for the first."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for i, name in enumerate(by):
        column = batch.column(name)
        both = pa.concat_arrays([last[i] if last else column.slice(0, 1), column])
        one, two = both.slice(0, len(column)), column
        differ = pc.fill_null(pc.not_equal(one, two), False)
        if pa.types.is_floating(column.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(two)), False))
        new |= pc.or_(differ, pc.xor(pc.is_null(one), pc.is_null(two))).to_numpy(zero_copy_only=False)
    return new


def range_scan(df, by, order, work, fields, name, ranges=None):
    """``df`` sorted into ranges of (by, order), scanned in order and written once.

    ``work()`` makes the scan of one range: a function of (batch, new, head, part, place) that gives the
    arrays of ``fields``; new: rows that begin a group, head: rows of the group that the range begins
    with and that the range before may have begun. Adds part_, place_, head_ and the fields.
    The number of ranges is that of the shuffle partitions, adapted at run time, or ``ranges``.
    """
    salted = df.withColumn("salt_", F.rand(11))
    count = [ranges] if ranges else []
    placed = (salted.repartitionByRange(*count, *by, *order, "salt_")
              .sortWithinPartitions(*by, *order, "salt_").drop("salt_"))

    def scan(batches):
        part, place, last, head, go_on = TaskContext.get().partitionId(), 0, None, True, work()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _changes(batch, by, last)
            in_head = (np.cumsum(new) == 0) & head
            head = head and not new.any()
            last = [batch.column(k).slice(n - 1, 1) for k in by]
            made = go_on(batch, new, in_head, part, place)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(in_head), *made],
                names=names)
            place += n
    schema = S.StructType([*df.schema.fields, *PLACE, *fields])
    names = schema.fieldNames()
    return staged(placed.mapInArrow(scan, schema), name)


def range_ends(rows, by, *columns):
    """[(part, whether it goes on with the group of the range before, head_ and columns of its last row)].

    One row per range reaches the driver.
    """
    last = F.max_by(F.struct("head_", *columns, *[F.col(k).alias(f"k{i}_") for i, k in enumerate(by)]), "place_")
    first = F.min_by(F.struct(F.lit(0), *by), "place_")
    out, before = [], None
    for part, one, two in sorted(rows.groupBy("part_").agg(first.alias("a"), last.alias("b")).collect(), key=lambda r: r[0]):
        key, ends = tuple(one)[1:], tuple(two)
        go_on = before is not None and all(x == y or (x != x and y != y) for x, y in zip(before, key))
        out.append((part, go_on, ends[0], *ends[1:1 + len(columns)]))
        before = ends[1 + len(columns):]
    return out


def _per_range(rows, table, schema):
    """``rows`` with columns of a table of one row per range."""
    small = rows.sparkSession.createDataFrame(table, f"part_ int, {schema}")
    return rows.join(F.broadcast(small), "part_", "left")


def _counted_before(ends):
    """[(part, rows that the ranges before hold of its first group)] from the ends, whose last column is a count."""
    before, so_far = [], 0
    for part, go_on, head, *_, count in ends:
        earlier = so_far if go_on else 0
        before.append((part, earlier))
        so_far = count + (earlier if head else 0)
    return before


def number_rows(df, by, order, out="rn", ties=(), window=False, ranges=None):
    """1-based number of a row within its group, or in the whole table (by=()).

    ``order`` and ``ties`` may be names or sort columns; rows without an order value come first.
    window=True is for groups of known small size, such as the parts of one page: a plain window.
    Else the ranges are numbered side by side, and a range adds what the ranges before hold of its
    first group, a sum over a table of one row per range.
    """
    by = list(by)
    if window:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(order, *ties)))

    def work():
        count = 0

        def number(batch, new, head, part, place):
            nonlocal count
            at = np.arange(batch.num_rows)
            numbers = at - np.maximum.accumulate(np.where(new, at, -count)) + 1
            count = int(numbers[-1])
            return [pa.array(numbers)]
        return number
    rows = range_scan(df, by, [order, *ties], work, [S.StructField("local_", S.LongType())], "numbered", ranges)
    before = _counted_before(range_ends(rows, by, "local_"))
    number = F.col("local_") + F.when(F.col("head_"), F.col("before_")).otherwise(0)
    return _per_range(rows, before, "before_ long").withColumn(out, number).drop("part_", "place_", "head_", "local_", "before_")


def global_numbers(df, *order, out="number"):
    """Every row with its place, from 0, in the given order of the whole table."""
    return number_rows(df, (), order[0], out, order[1:]).withColumn(out, F.col(out) - 1)


def _carrying(value):
    """The scan of a range that gives the last value so far of each row's group, and whether the row waits for one of the range before."""
    held, known = None, False

    def carry(batch, new, head, part, place):
        nonlocal held, known
        column = batch.column(value)
        n, valid = len(column), column.is_valid().to_numpy(zero_copy_only=False)
        # the place that decides for a row: the last value, or the last start of a group
        at = np.maximum.accumulate(np.where(valid | new, np.arange(n), -1))
        empty = (at >= 0) & ~valid[at]
        both = pa.concat_arrays([pa.nulls(1, column.type) if held is None else held, column])
        carried = both.take(pa.array(at + 1, mask=empty))
        waits = head & (at < 0) & (not known)
        held, known = carried.slice(n - 1, 1), known or bool((at >= 0).any())
        return [carried, pa.array(waits)]
    return carry


def _handed_on(rows, ends):
    """(part_, before_): the last value of the ranges before, for the ranges that go on with their group; one row per range."""
    source, sources = None, []
    for part, go_on, _, waits, *_ in ends:
        source = source if go_on else None
        if source is not None:
            sources.append((part, source))
        source = source if waits else part
    last = rows.groupBy(F.col("part_").alias("source_")).agg(F.max_by("carried_", "place_").alias("before_"))
    return rows.sparkSession.createDataFrame(sources, "part_ int, source_ int").join(last, "source_").drop("source_")


def carry_forward(df, by, order, value, out, ties=(), window=False, ranges=None):
    """Last non-null value of the group up to and including the row; see number_rows."""
    by = list(by)
    if window:
        plain = W.partitionBy(*by).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(plain))

    fields = [S.StructField("carried_", df.schema[value].dataType), S.StructField("waits_", S.BooleanType())]
    rows = range_scan(df, by, [order, *ties], lambda: _carrying(value), fields, "carried", ranges)
    small = _handed_on(rows, range_ends(rows, by, "waits_"))
    joined = rows.join(small, "part_", "left")  # one row per range
    return (joined.withColumn(out, F.when(F.col("waits_"), F.col("before_")).otherwise(F.col("carried_")))
            .drop("part_", "place_", "head_", "carried_", "waits_", "before_"))


def number_under_headers(df, by, order, header, out, number, ties=(), ranges=None):
    """The rows whose ``header`` is null, each with the last header before it in its group and its 1-based
    number among such rows of the group: carry_forward and number_rows with one sort, scan and write.

    ``df`` is written first, as Spark reads what it sorts into ranges twice. One row per range is broadcast, with a header.
    """
    by, df = list(by), staged(df, "headed")

    def work():
        carry, count = _carrying(header), 0

        def both(batch, new, head, part, place):
            nonlocal count
            counts = batch.column(header).is_null().to_numpy(zero_copy_only=False)
            so_far = np.cumsum(counts)
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            numbers = so_far - np.where(first >= 0, so_far[first] - counts[first], -count)
            count = int(numbers[-1])
            return [*carry(batch, new, head, part, place), pa.array(numbers)]
        return both
    fields = [S.StructField("carried_", df.schema[header].dataType), S.StructField("waits_", S.BooleanType()), S.StructField("local_", S.LongType())]
    rows = range_scan(df, by, [order, *ties], work, fields, "under-headers", ranges)
    ends = range_ends(rows, by, "waits_", "local_")
    joined = _per_range(rows.where(F.col(header).isNull()), _counted_before(ends), "earlier_ long").join(
        F.broadcast(_handed_on(rows, ends)), "part_", "left")
    return (joined.withColumn(out, F.when(F.col("waits_"), F.col("before_")).otherwise(F.col("carried_")))
            .withColumn(number, F.col("local_") + F.when(F.col("head_"), F.col("earlier_")).otherwise(0))
            .drop(header, "part_", "place_", "head_", "carried_", "waits_", "local_", "earlier_", "before_"))


def first_per_key(df, by, *order):
    """First row per key. Spark keeps one row per key and map task before the
    shuffle (WindowGroupLimit), so a hot key does not pile up in one task."""
    return top_per_key(df, by, 1, *order).drop("rank_")


def top_per_key(df, by, k, *order):
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank_", rank).where(F.col("rank_") <= k)


def batch_no(df, order, size=1000, ties=(), ranges=None):
    """Number of the batch of ``size`` rows that a row falls into."""
    numbered = number_rows(df, (), order, "rn_", ties, ranges=ranges)
    return numbered.withColumn("batch_no", F.floor((F.col("rn_") - 1) / size).cast("int") + 1).drop("rn_")


def paged_list(df, by, order, fields, size=1000, ranges=None):
    """The ordered list of a group, in pages of ``size`` entries, so that a
    group of any size stays in rows of bounded width."""
    numbered = number_rows(df, by, order, "rn_", ranges=ranges)
    page = F.floor((F.col("rn_") - 1) / size).cast("int") + 1
    return (numbered.withColumn("page", page).groupBy(*by, "page")
            .agg(F.count(F.lit(1)).alias("n_items"),
                 F.sort_array(F.collect_list(F.struct("rn_", *fields))).alias("items")))


def sort_by_name(df, name, *ties, locale="de"):
    """Order of a reader of the language: umlauts beside their base letters."""
    return df.orderBy(F.collate(F.col(name), locale), *ties)


def sort_by_year(df, year, *ties, descending=False):
    """A missing year comes last in both directions."""
    order = F.col(year).desc_nulls_last() if descending else F.col(year).asc_nulls_last()
    return df.orderBy(order, *ties)
