"""Source divergence: hash-consed segment trees over term ids, priced by a shared traversal."""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versarium.llm.common import pick, staged
from versarium.operators.ordered import global_numbers

MIN_DOCUMENTS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
CHUNK = 1024  # term ids below one subtree, a power of two
BLOCK = 48  # sources of one language that meet in one task
HELD = 200_000  # counts that a task keeps before it hands them on
SLICE = 64  # pairs of trees that are walked together

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def term_counts(rows):
    """(lang, source, term, n, docs): occurrences and documents; the empty term marks the group."""
    def rows_of(found):
        parts = [(lang, source, t, n[t], docs[t]) for (lang, source), (n, docs) in found.items() for t in (b"", *n)]
        columns = list(zip(*parts)) or [()] * 5
        frame = pd.DataFrame(dict(zip(("lang", "source", "term", "n", "docs"), columns)))
        return frame.assign(term=[t.decode("utf-8", "replace") for t in columns[2]])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                words = _TERM.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only
                size -= len(n)
                n.update(words)
                docs.update(set(words))
                size += len(n)
                if size > HELD:
                    yield rows_of(found)
                    found, size = {}, 0
        if found:
            yield rows_of(found)
    counted = rows.mapInPandas(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count, total):
    """1 + floor(SCALE * (count + SMOOTH) / total) in whole numbers, three digits at a time; total < 2^53."""
    rest, quotient = count + SMOOTH, 0
    for _ in range(3):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // total
        rest = rest % total
    return 1 + quotient


class Forest:
    """Segment trees over the rows of a matrix of counts, 2^h columns; equal subtrees are one node.

    Nodes of a level are numbered by content over all trees and places: a node is its pair of
    children. `values` are the counts of the leaf nodes, -1 where there is no term.
    """

    def __init__(self, counts):
        self.values, nodes = np.unique(counts, return_inverse=True)
        nodes = nodes.reshape(counts.shape)
        self.bare = [self.values <= 0]  # no term below occurs
        self.children = []
        while nodes.shape[1] > 1:
            kinds = len(self.bare[-1])
            made, nodes = np.unique(nodes[:, ::2] * kinds + nodes[:, 1::2], return_inverse=True)
            nodes = nodes.reshape(len(counts), -1)
            left, right = made // kinds, made % kinds
            self.bare.append(self.bare[-1][left] & self.bare[-1][right])
            self.children.append((left, right))
        self.roots = nodes[:, 0]

    def distances(self, one, two, totals):
        """Sum over the terms of |share in tree one - share in tree two| for each pair of trees.

        Both trees are walked together from the root. A pair of nodes that a pair of trees meets again
        is one entry with the number of its places, so what is below it is priced once.
        """
        out = [self._walk(one[i:i + SLICE], two[i:i + SLICE], totals) for i in range(0, len(one), SLICE)]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _walk(self, one, two, totals):
        pair, a, b, times = np.arange(len(one)), self.roots[one], self.roots[two], np.ones(len(one), dtype=np.int64)
        for (left, right), kinds in zip(reversed(self.children), map(len, reversed(self.bare[:-1]))):
            pair, times = np.tile(pair, 2), np.tile(times, 2)
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            keys, which = np.unique((pair * kinds + a) * kinds + b, return_inverse=True)
            sums = np.zeros(len(keys), dtype=np.int64)
            np.add.at(sums, which, times)
            times, b, a, pair = sums, keys % kinds, keys // kinds % kinds, keys // kinds // kinds
        x, y = self.values[a], self.values[b]
        apart = np.abs(share(x, totals[one][pair]) - share(y, totals[two][pair]))
        sums = np.zeros(len(one), dtype=np.int64)
        np.add.at(sums, pair, np.where(x < 0, 0, apart * times))
        return sums

    def excess(self, one, two, totals):
        """(place, share in tree one - share in tree two) of the terms that occur in tree one.

        Subtrees of `one` without an occurrence are left out; equal leaf pairs are priced once.
        """
        a, b, place = self.roots[[one]], self.roots[[two]], np.zeros(1, np.int64)
        for level in range(len(self.children), 0, -1):
            go_on = ~self.bare[level][a]
            a, b, place = a[go_on], b[go_on], 2 * place[go_on]
            left, right = self.children[level - 1]
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            place = np.concatenate([place, place + 1])
        go_on = ~self.bare[0][a]
        a, b, place = a[go_on], b[go_on], place[go_on]
        keys, which = np.unique(a * len(self.values) + b, return_inverse=True)
        x, y = self.values[keys // len(self.values)], self.values[keys % len(self.values)]
        return place, (share(x, totals[one]) - share(y, totals[two]))[which]


def _priced(cells, members, lang, chunk, size, top):
    """Rows (lang, part, source, other, id, value) of one chunk of one language.

    `cells`: source, id, n, total; `members`: source, side, n_all, lang_all, terms. Pairs are taken
    between side 0 and side 1, or within side 0 if there is no side 1; terms of side 0 then.
    """
    names, alone = members["source"].tolist(), not members["side"].any()
    first = int(chunk) * size
    terms = int(members["terms"].iloc[0])
    counts = np.zeros((len(names) + 1, size), dtype=np.int64)
    at = {name: i for i, name in enumerate(names)}
    rows, place = cells["source"].map(at).to_numpy(dtype=np.int64), cells["id"].to_numpy(dtype=np.int64) - first
    counts[rows, place] = cells["n"].to_numpy()
    counts[-1, place] = cells["total"].to_numpy()  # the whole language, wherever a member has the term
    counts[:, max(0, terms - first):] = -1
    totals = np.append(members["n_all"].to_numpy(dtype=np.int64), members["lang_all"].iloc[0]) + SMOOTH * terms
    totals = np.maximum(totals, 1)
    forest = Forest(counts)
    side = members["side"].to_numpy()
    one, two = np.triu_indices(len(names), 1) if alone else [x.ravel() for x in np.meshgrid(
        np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij")]
    found = [pd.DataFrame({"part": "pair", "source": members["source"].to_numpy()[one], "other": members["source"].to_numpy()[two],
                           "id": -1, "value": forest.distances(one, two, totals)})]
    for i, name in enumerate(names if alone else []):
        place, value = forest.excess(i, len(names), totals)
        place, value = place[value > 0], value[value > 0]
        best = np.lexsort((place, -value))[:top]
        found.append(pd.DataFrame({"part": "term", "source": name, "other": None, "id": first + place[best], "value": value[best]}))
    return pd.concat(found, ignore_index=True).assign(lang=lang)


def audit(documents, lang_col="lang", source_col="source", text_col="text", min_documents=MIN_DOCUMENTS,
          top=TOP_TERMS, size=CHUNK, block=BLOCK):
    """lang, source, part, item, value, rank: how far the sources of a language are apart.

    Terms are runs of letters, and of all characters outside ASCII; a language keeps those in
    `min_documents` of its documents. A group (lang, source) gives a kept term the smoothed share
    1 + floor(SCALE (count + SMOOTH) / (N + SMOOTH V)). Part `pair` has the summed distance of a
    source from every other of its language (0 without kept terms), part `term` its `top` terms whose
    share exceeds the language's most. Ranks fall by value, ties by item in UTF-8 order.

    Null text, lang and source count as empty strings; rows without a term still name their group;
    repeated rows count each; an empty table gives no rows. Counts below 2^53 are exact.

    Term ids follow the order of the terms, `size` of them make one subtree and one task; sources
    meet in blocks of up to about `block`, so no task holds all of a language.
    """
    rows = pick(documents, lang=lang_col, source=source_col, text=text_col).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = staged(term_counts(rows), "counts")
    kept = (counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
            .filter(F.col("docs") >= min_documents).select("lang", "term", "total"))
    numbered = global_numbers(staged(kept, "kept"), "lang", "term")
    spans = numbered.groupBy("lang").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_all"))
    terms = staged(numbered.join(spans.select("lang", "start"), "lang").select(
        "lang", "term", "total", (F.col("number") - F.col("start")).alias("id")), "terms")
    cells = staged(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]).select(
        "lang", "source", "id", "n", "total"), "cells")
    groups = counts.filter("term = ''").select("lang", "source")
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).join(
        spans.drop("start"), "lang", "left").na.fill(0, ["terms", "lang_all"])
    dealt = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    members = staged(groups.join(own, ["lang", "source"], "left").na.fill(0, ["n_all"]).join(langs, "lang").withColumn("block", dealt), "members")

    def meetings(frame):
        """Every row once per meeting of its block with another (side 0 or 1) or with itself."""
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        return frame.withColumn("with", other).withColumns({
            "i": F.least("block", "with"), "j": F.greatest("block", "with"), "side": (F.col("block") > F.col("with")).cast("int")})
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("terms") / size), F.lit(1)) - 1))
    roster = meetings(members).withColumn("chunk", chunks).select(
        "lang", "chunk", "i", "j", "source", "side", "n_all", "lang_all", "terms")
    parts = meetings(cells.join(members.select("lang", "source", "block", "blocks"), ["lang", "source"])).select(
        "lang", F.floor(F.col("id") / size).alias("chunk"), "i", "j", "source", "id", "n", "total")

    def price(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _priced(left, right.sort_values("source", ignore_index=True), key[0], key[1], size, top)
        return found[["lang", "part", "source", "other", "id", "value"]]
    keys = ["lang", "chunk", "i", "j"]
    found = staged(parts.groupBy(*keys).cogroup(roster.groupBy(*keys)).applyInPandas(
        price, "lang string, part string, source string, other string, id long, value long"), "priced")
    best = W.partitionBy("lang", "source")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = pairs.union(pairs.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    first = found.filter("part = 'term'").withColumn("rank", F.row_number().over(best.orderBy(F.desc("value"), "id"))).filter(F.col("rank") <= top)
    named = first.join(terms.select("lang", "id", "term"), ["lang", "id"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return both.withColumn("rank", F.row_number().over(best.orderBy(F.desc("value"), "item"))).union(named)


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') w FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(term) v FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN kept USING (lang) GROUP BY g.lang),
cnt AS (SELECT lang, source, term, count(*) n FROM (SELECT lang, source, unnest(w) term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
ln AS (SELECT lang, term, sum(n) n FROM cnt GROUP BY lang, term),
cells AS (SELECT lang, source, term, coalesce(n, 0) n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) total
          FROM grp JOIN kept USING (lang) LEFT JOIN cnt USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + 1000000000 * (n + 5)::HUGEINT // (total + 5 * v))::BIGINT p FROM cells JOIN v USING (lang)),
q AS (SELECT lang, term, (1 + 1000000000 * (n + 5)::HUGEINT // (sum(n) OVER (PARTITION BY lang) + 5 * v))::BIGINT q FROM ln JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source item, sum(abs(a.p - b.p)) AS val FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
          GROUP BY a.lang, a.source, b.source),
every AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(val, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
