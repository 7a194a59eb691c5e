"""Line dedup: overlapping documents by shared line hashes, aligned with patience diff."""

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from versarium.llm.common import let, pick, staged

MIN_WORDS = 5
_DENSE = "".join(rf"\p{{Is{name}}}" for name in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
_WORDS = rf"[{_DENSE}]|[^\s\p{{Z}}{_DENSE}]+"  # scripts without spaces: each character counts as a word
_MAY_BE_DENSE = r"[\x{0E00}-\x{1FFF}\x{2E80}-\x{10FFFF}]"  # all of those scripts are here
_PLAIN_WORDS = r"[^\s\xA0\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}]+"  # the same words elsewhere


def _keyed(text):
    """(pos, h, words) of every line that is not blank; spaces at the ends do not count.

    Asking each character for its script is most of the work, so a text is asked once whether it
    has a character from where these scripts are.
    """
    def lines_of(parts):
        every = F.transform(parts["lines"], lambda line, i: F.struct(i.alias("pos"), F.trim(line).alias("line")))
        return F.transform(F.filter(every, lambda x: x["line"] != ""), lambda x: F.struct(
            x["pos"], F.xxhash64(x["line"]).alias("h"),
            F.when(parts["dense"], F.regexp_count(x["line"], F.lit(_WORDS)))
            .otherwise(F.regexp_count(x["line"], F.lit(_PLAIN_WORDS))).alias("words")))
    return let(F.struct(F.split(text, "\n").alias("lines"), text.rlike(_MAY_BE_DENSE).alias("dense")), lines_of)


def patience(a, b):
    """Matched index pairs of two sequences: equal ends, then the longest increasing run of
    items that are unique in both, then the same between its matches."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        ca, cb = Counter(a[i:j]), Counter(b[k:m])
        where = {b[y]: y for y in range(k, m) if cb[b[y]] == 1}
        pairs = [(x, where[a[x]]) for x in range(i, j) if ca[a[x]] == 1 and a[x] in where]
        if not pairs:
            # nothing unique: the n-th occurrence meets the n-th
            places, left, right = {}, Counter(), Counter()
            for y in range(k, m):
                places[b[y], right[b[y]]] = y
                right[b[y]] += 1
            for x in range(i, j):
                if (a[x], left[a[x]]) in places:
                    pairs.append((x, places[a[x], left[a[x]]]))
                left[a[x]] += 1
            if not pairs:
                continue
        chain = _increasing(pairs)
        out += chain
        for (x, y), (u, v) in zip([(i - 1, k - 1), *chain], [*chain, (j, m)]):
            todo.append((x + 1, u, y + 1, v))
    return sorted(out)


def _increasing(pairs):
    """The longest run of pairs that increases on both sides; `pairs` increase on the first."""
    tails, ends, back = [], [], [None] * len(pairs)
    for n, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        back[n] = ends[at - 1] if at else None
        tails[at:at + 1], ends[at:at + 1] = [y], [n]
    chain, n = [], ends[-1]
    while n is not None:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def common_blocks(earlier, later, min_words):
    """Indices in `later` of aligned blocks that have `min_words` words or more.

    Both are (rank, hash, words) lists; a block is a run of matched lines that stand next to each
    other in both documents, blank lines aside.
    """
    out, run, words, last = [], [], 0, None
    for x, y in patience(earlier[1], later[1]):
        here = (earlier[0][x], later[0][y])
        if last is not None and here != (last[0] + 1, last[1] + 1):
            out += run if words >= min_words else []
            run, words = [], 0
        run.append(y)
        words += later[2][y]
        last = here
    return out + (run if words >= min_words else [])


def sequence_keys(rank, h, words, min_words):
    """Hashes of lines that follow each other: every two, every run that has just reached
    `min_words` words, and all lines of the text."""
    import xxhash
    keys, h = [], h.view(np.uint64)
    key, total, start = h.copy(), words.astype(np.int64), np.arange(len(h))
    for size in range(1, len(h)):
        start = start[start < len(h) - size]
        go_on = (rank[start + size] == rank[start] + size) & ((total[start] < min_words) | (size == 1))
        start = start[go_on]
        if not len(start):
            break
        key[start] = (key[start] ^ (key[start] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[start + size]
        total[start] += words[start + size]
        keys.append(key[start[(total[start] >= min_words) | (size == 1)]])
    if len(h) > 1:
        keys.append(np.array([xxhash.xxh64_intdigest(h.tobytes())], dtype=np.uint64))
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.zeros(0, np.int64)


def repeated_lines(documents, id_col="doc_id", text_col="text", min_words=MIN_WORDS):
    """(doc_id, pos, h, source_id): lines that an earlier document holds in an aligned block.

    Documents are ordered by id. Every line held by several documents links each later one to the
    first that holds it, so a line with n holders gives n - 1 links, and no line is too frequent;
    a pair knows how rare its rarest line is (`holders`). So does every two adjacent lines, every run
    of adjacent lines that reaches `min_words` words, and the sequence of all shared lines of a text,
    for its own first holder, as that may be another document. Each linked pair is aligned with
    patience diff and the aligned blocks of `min_words` words or more are marked in the later document. The
    first holder of a line always keeps it.

    Null and empty texts and blank lines take no part; nor do rows without id. Rows that repeat an
    id are one document. Identical documents are linked to the first of them only. An empty table
    gives no rows. `pos` counts all lines of the text from 0, `h` is the hash of the line.
    """
    docs = pick(documents, doc_id=id_col, text=text_col).filter("doc_id is not null and text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = staged(docs.select("doc_id", F.posexplode(_keyed(F.col("text"))).alias("rank", "x"))
                  .select("doc_id", "rank", "x.*"), "lines")
    heads = staged(rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other"),
                                         F.count(F.lit(1)).alias("holders"))
                   .filter("first <> other").drop("other"), "heads")
    marked = staged(rows.join(heads, "h"), "shared")
    line = F.array_sort(F.collect_list(F.struct("rank", "h", "words", "pos")))
    lists = staged(marked.groupBy("doc_id").agg(line.alias("lines")), "lists")

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sequence_keys(r.rank, r.h, r.words, min_words) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"doc_id": np.repeat(batch["doc_id"].to_numpy(), [len(f) for f in found]),
                                "h": np.concatenate([np.zeros(0, np.int64), *found])})

    keys = staged(lists.select("doc_id", *[f"lines.{c}" for c in ("rank", "h", "words")]).mapInPandas(
        sequences, f"doc_id {kind}, h long"), "sequences")
    # written, as `heads` are, so that the join on a key of very many texts can be split
    holders = staged(keys.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other"),
                                           F.count(F.lit(1)).alias("holders")).filter("first <> other").drop("other"), "holders")
    links = marked.select("doc_id", "first", "holders").union(keys.join(holders, "h").select("doc_id", "first", "holders"))
    pairs = staged(links.filter("first < doc_id").groupBy("doc_id", "first").agg(F.min("holders").alias("holders")), "pairs")
    sides = (pairs.join(lists.select("doc_id", F.col("lines").alias("b")), "doc_id")
             .join(lists.select(F.col("doc_id").alias("first"), F.col("lines").alias("a")), "first")
             .select("doc_id", "first", "b.pos", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("rank", "h", "words")]))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                both = set(row.a_h.tolist()) & set(row.b_h.tolist())
                a, b = [[v for v in zip(*[x.tolist() for x in side]) if v[1] in both] for side in (
                    (row.a_rank, row.a_h, row.a_words), (row.b_rank, row.b_h, row.b_words, row.pos))]
                a, b = list(zip(*a)), list(zip(*b))
                out += [(row.doc_id, b[3][i], b[1][i], row.first) for i in common_blocks(a, b, min_words)]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "h", "source_id"]).astype({"pos": "int64", "h": "int64"})

    found = sides.mapInPandas(align, f"doc_id {kind}, pos long, h long, source_id {kind}")
    return found.groupBy("doc_id", "pos", "h").agg(F.min("source_id").alias("source_id"))


def drop_repeated_lines(documents, id_col="doc_id", text_col="text", min_words=MIN_WORDS):
    """`documents` with `text_col` cut to the lines that stay, and `removed`: array of (pos, h).

    All other columns and rows stay as they are; texts without a removed line are untouched.
    A column `removed` of the caller stays too, and the array is then called `removed_`, or as many
    underscores as are free. See `repeated_lines` for null, empty and repeated rows.
    """
    found = repeated_lines(documents, id_col, text_col, min_words)
    cut = staged(found.groupBy(F.col("doc_id").alias("__cut_id")).agg(F.array_sort(F.collect_list(
        F.struct(F.col("pos").cast("int").alias("pos"), "h"))).alias("__cut")), "removed")
    text, name = F.col(f"`{text_col}`"), "removed"
    while name in documents.columns:
        name += "_"

    def rest(lines):
        keys = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), F.xxhash64(F.trim(line)).alias("h")))
        return F.array_join(F.transform(F.array_except(keys, F.col("__cut")), lambda k: F.get(lines, k["pos"])), "\n")
    joined = documents.join(cut, F.col(f"`{id_col}`") == F.col("__cut_id"), "left").drop("__cut_id")
    return joined.withColumn(text_col, F.when(F.col("__cut").isNull() | text.isNull(), text).otherwise(
        let(F.split(text, "\n"), rest))).withColumnRenamed("__cut", name)
