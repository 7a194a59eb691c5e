"""Source divergence: the trees against plain sums, the audit against a plain version."""

import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

from helpers import ODD, documents, frame  # noqa: E402

from versarium.llm import divergence  # noqa: E402


def plain(rows, least, top=50):
    docs = defaultdict(Counter)
    counts = defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang, source in counts:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for (other, _), c in counts.items():
            if other == lang:
                whole.update({t: c[t] for t in kept})

        def shares(c):
            total = sum(c[x] for x in kept) + 5 * len(kept)
            return [1 + 10**9 * (c[t] + 5) // total for t in kept]
        own = shares(counts[lang, source])
        pairs = [(sum(abs(p - q) for p, q in zip(own, shares(c))), s)
                 for (other, s), c in counts.items() if other == lang and s != source]
        terms = [(p - q, t) for t, p, q in zip(kept, own, shares(whole)) if counts[lang, source][t]]
        for part, found in (("pair", pairs), ("term", [x for x in terms if x[0] > 0])):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, n + 1) for n, (value, item) in enumerate(found) if part == "pair" or n < top}
    return out


def got(spark, rows, **options):
    found = divergence.audit(frame(spark, [(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)]), **options).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def test_matches_a_plain_version(spark):
    rows = [tuple(r) for r in documents(spark).select("lang", "source", "text").collect()]
    want = plain(rows, 5)
    assert got(spark, rows, min_documents=5) == want
    # many small subtrees, and sources in several blocks
    assert got(spark, rows, min_documents=5, size=128, block=8) == want


def test_odd_rows(spark):
    rows = [(r[2], r[3], r[1]) for r in ODD] + [("xx", "a", "ä Ä b b"), ("xx", "b", None), ("xx", "c", "b ä"), (None, None, "ä")]
    for least in (1, 2, 99):
        assert got(spark, rows, min_documents=least, top=3) == plain(rows, least, 3)
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string, value int")).collect() == []


def test_equal_subtrees_are_one_node_and_sums_are_exact():
    random = np.random.default_rng(1)
    block = random.integers(0, 3, 8)
    counts = np.stack([np.tile(block, 8), np.zeros(64, np.int64), random.integers(0, 9, 64), np.tile(block, 8)])
    counts[:, 60:] = -1
    counts[2, 3] = 2**49
    forest = divergence.Forest(counts)
    assert len(forest.children[2][0]) < 4 * 8  # eight equal subtrees of eight terms in two of the four trees
    assert forest.roots[0] == forest.roots[3]
    totals = np.maximum(np.where(counts > 0, counts, 0).sum(axis=1) + 5 * 60, 1)
    one, two = np.triu_indices(4, 1)

    def share(row, place):
        return 1 + 10**9 * (int(counts[row, place]) + 5) // int(totals[row])
    want = [sum(abs(share(a, i) - share(b, i)) for i in range(60)) for a, b in zip(one, two)]
    assert forest.distances(one, two, totals).tolist() == want
    place, value = forest.excess(0, 2, totals)
    assert dict(zip(place.tolist(), value.tolist())) == {i: share(0, i) - share(2, i) for i in range(60) if counts[0, i] > 0}
