"""Inverted index in blocks and ranked search that skips the blocks that cannot matter (TXS1)."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from versarium import patterns as P
from versarium.functions import stems
from versarium.session import in_slices, staged

SPAN = 4096  # ids that one block of a term covers at most
WORDS = 1 << 20  # words or places that a task holds at once, or those of one row


def search_tokens(text, stemmed=False):
    """The lower-case words of a text, as German stems if asked for."""
    words = P.SEARCH_TOKEN.all(F.lower(text))
    return F.transform(words, stems.german) if stemmed else words


def _counted(span):
    """Batches of (key_, words_) to the counts of each term, by term and range of `span` ids."""
    def count(batches):
        for whole in batches:
            for batch in in_slices(whole, pc.list_value_length(whole.column("words_")), WORDS):
                words = batch.column("words_")
                table = pa.table({"term": pc.list_flatten(words), "key": batch.column("key_").take(pc.list_parent_indices(words))})
                table = table.group_by(["term", "key"]).aggregate([([], "count_all")]).sort_by([("term", "ascending"), ("key", "ascending")])
                if not len(table):
                    continue
                term, key = table["term"].combine_chunks(), table["key"].to_numpy()
                part = np.floor_divide(key, span)
                code = pc.dictionary_encode(term).indices.to_numpy()
                first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])]))
                ends = pa.array(np.append(first, len(key)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    term.take(pa.array(first)), pa.array(part[first]),
                    pa.ListArray.from_arrays(ends, pa.array((key - part * span).astype("int32"))),
                    pa.ListArray.from_arrays(ends, pa.array(table["count_all"].to_numpy().astype("int32")))],
                    names=["term", "part", "places", "tfs"])
    return count


def _merged(batches):
    """Blocks whose places may repeat, in any order, to the same with each place once and its counts added."""
    for whole in batches:
        for batch in in_slices(whole, pc.list_value_length(whole.column("places")), WORDS):
            places, tfs = batch.column("places"), batch.column("tfs")
            row, place = pc.list_parent_indices(places).to_numpy(), pc.list_flatten(places).to_numpy()
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])]))
            summed = np.add.reduceat(pc.list_flatten(tfs).to_numpy()[order], first)
            ends = pa.array(np.searchsorted(row[first], np.arange(len(batch) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("term"), batch.column("part"), pa.ListArray.from_arrays(ends, pa.array(place[first])),
                pa.ListArray.from_arrays(ends, pa.array(summed.astype("int32")))], names=["term", "part", "places", "tfs"])


def stem_table(words):
    """(term, stem) of the distinct terms: the rules run once per word, however often texts say it."""
    return staged(words.select("term").distinct().select("term", stems.german(F.col("term")).alias("stem")), "stems")


def write_term_index(df, key, text, path, span=SPAN, stemmed=False):
    """Posting blocks (term, part, places, tfs, docs, most) of the texts, written to ``path``.

    A block holds one term in the ids `part * span + place`: places rise, ``tfs`` are the counts beside
    them, ``most`` bounds the greatest. Words are counted in the task that reads the texts, so only
    blocks are shuffled. They are sorted by term and range: a search reads the files and row groups of
    its terms only, and a term of very many documents fills many blocks. Ids are integers; rows
    without id or text are left out, rows that repeat an id count together.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("key_"), search_tokens(F.col(text)).alias("words_"))
    kind = "term string, part long, places array<int>, tfs array<int>"
    packed = staged(rows.mapInArrow(_counted(span), kind), "postings")
    if stemmed:
        packed = packed.join(stem_table(packed), "term").select(F.col("stem").alias("term"), "part", "places", "tfs")
    both = F.flatten(F.collect_list(F.arrays_zip("places", "tfs")))
    blocks = packed.repartitionByRange("term", "part").groupBy("term", "part").agg((both if stemmed else F.array_sort(both)).alias("b"))
    blocks = blocks.select("term", "part", F.col("b.places").alias("places"), F.col("b.tfs").alias("tfs"))
    if stemmed:  # several words of a document have one stem
        blocks = blocks.mapInArrow(_merged, kind)
    docs = F.size(F.array_distinct("places"))
    # an id met in two tasks stands twice: the sum bounds its count
    most = F.when(docs == F.size("places"), F.array_max("tfs")).otherwise(F.aggregate("tfs", F.lit(0), lambda a, x: a + x))
    blocks.select("*", docs.alias("docs"), most.alias("most")).sortWithinPartitions("term", "part").write.mode("overwrite").parquet(path)


def _query_terms(spark, query, stemmed):
    one = spark.range(1).select(F.explode(search_tokens(F.lit(query), stemmed)).alias("term"))
    return sorted({r.term for r in one.collect()})


def _hits(blocks, parts, terms, key, span):
    pairs = blocks.join(parts.select("part"), "part").select(
        "term", "part", F.explode(F.arrays_zip("places", "tfs")).alias("p"))
    found = pairs.groupBy("part", F.col("p.places").alias("place")).agg(
        F.size(F.collect_set("term")).alias("n"), F.sum("p.tfs").alias("hits")).where(F.col("n") == len(terms))
    return found.select((F.col("part") * span + F.col("place")).alias(key), "hits")


def needed_parts(index, terms, limit, span=SPAN, wave=16):
    """(part, bound) of the ranges that can hold one of the first ``limit`` documents.

    ``bound`` is the sum of the terms' greatest counts in the range. The `wave` ranges of greatest bound
    are searched first. The hits of their document of rank `limit` are a floor: no document of a range
    whose bound is lower can come among the first.
    """
    blocks = index.where(F.col("term").isin(terms))
    bounds = staged(blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("most").alias("bound"))
                    .where(F.col("n") == len(terms)).drop("n"), "bounds")
    first = bounds.orderBy(F.desc("bound"), "part").limit(wave)
    best = _hits(blocks, first, terms, "key_", span).orderBy(F.desc("hits")).limit(limit)
    count, floor = best.agg(F.count(F.lit(1)), F.min("hits")).first()
    return bounds if count < limit else bounds.where(F.col("bound") >= floor)


def index_search(index, key, query, limit=None, span=SPAN, stemmed=False, wave=16):
    """Documents with all words of the query, most hits first, ties by id; the first ``limit`` or all.

    The rows are those of the full ranking; with a limit only the blocks of `needed_parts` are opened.
    A query without words finds nothing.
    """
    terms = _query_terms(index.sparkSession, query, stemmed)
    blocks = index.where(F.col("term").isin(terms))
    if limit is None or not terms:
        parts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms))
    else:
        parts = needed_parts(index, terms, limit, span, wave)
    ranked = _hits(blocks, parts, terms, key, span).orderBy(F.desc("hits"), key)
    return ranked if limit is None else ranked.limit(limit)
