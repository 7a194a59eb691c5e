"""SimHash, line dedup and substring dedup against brute force."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))

from helpers import LONG, ODD, documents, frame  # noqa: E402

from versarium.llm import graph, lines, passages, simhash  # noqa: E402


def slow_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v
    items = sorted(parent)
    for i, a in enumerate(items):
        for b in items[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[root(b)] = root(a)
    return {v: root(v) for v in items}


def test_fingerprints_and_components(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows}
    roots = slow_components(fps.values())
    least = {}
    for doc, fp in fps.items():
        least[roots[fp]] = min(doc, least.get(roots[fp], doc))
    found = simhash.near_duplicates(documents(spark))
    got = {r[0]: (r[1], r[2]) for r in found.select("doc_id", simhash.hex_fingerprint(found.fp), "component_id").collect()}
    assert got == {doc: (f"{fp:016x}", least[roots[fp]]) for doc, fp in fps.items()}


@pytest.mark.parametrize("group", [64, 2])
def test_links_connect_what_is_close(spark, group):
    pick = random.Random(3)
    values = {0, (1 << 63) - 1, -1, -(1 << 63)}
    for _ in range(12):
        base = pick.getrandbits(64)
        for _ in range(25):  # many in one block group, chains and stars
            base ^= 1 << pick.randrange(48, 64)
            values.add(base - (1 << 64) if base >= 1 << 63 else base)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.close_pairs(df, group=group)
    got = {r[0]: r[1] for r in graph.components(links).collect()}
    want = slow_components([v % (1 << 64) for v in values])
    same = lambda v: v if v < 1 << 63 else v - (1 << 64)
    groups = Counter(want.values())
    for v, r in want.items():
        if groups[r] > 1:
            assert got[same(v)] == min(same(x) for x, y in want.items() if y == r)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(7, 7), (300, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in (7, *range(200, 260), 300)} == {7}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_bears_odd_rows(spark):
    got = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(frame(spark, ODD)).collect()]
    assert len(got) == len(ODD)
    by = {g[0]: g for g in got}
    assert by[2][1:] == by[3][1:] == by[4][1:] == (0, 2) and by[6][2] == 5 and by[None][2] is None
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    kept = simhash.one_of_each(frame(spark, ODD))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 5, 7, 8] and "fp" in kept.columns


def check_alignment(a, b):
    pairs = lines.patience(a, b)
    assert all(a[x] == b[y] for x, y in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    return pairs


def test_patience():
    assert check_alignment("abcd", "xbcdy") == [(1, 1), (2, 2), (3, 3)]
    assert check_alignment("XAXB", "AXB") == [(1, 0), (2, 1), (3, 2)]
    assert check_alignment("", "abc") == [] and len(check_alignment("ab" * 300, "ba" * 300)) >= 599
    pick = random.Random(1)
    for _ in range(200):
        check_alignment([pick.randrange(6) for _ in range(pick.randrange(14))], [pick.randrange(6) for _ in range(pick.randrange(14))])


A, B, C, D = [f"{x} one two three four five six" for x in "ABCD"]


def removed(spark, rows):
    cut = lines.drop_repeated_lines(frame(spark, [(i, t, "en", "s") for i, t in rows]))
    return {r.doc_id: ([x.pos for x in r.removed_ or []], r.text) for r in cut.collect()}


def test_later_copies_of_lines_go(spark):
    got = removed(spark, [(1, f"{A}\n{B}\n{C}"), (2, f"own words here\n{B}\n{C}\n\nend"), (3, f"{D}\n{A}"), (4, D), (5, "short\nhi"), (6, "short\nyo")])
    assert got[1] == ([], f"{A}\n{B}\n{C}") and got[2] == ([1, 2], "own words here\n\nend")
    assert got[3] == ([1], D) and got[4] == ([0], "")
    assert got[5][0] == got[6][0] == []  # one word is no block


def test_short_lines_go_with_their_block(spark):
    got = removed(spark, [(1, "a b\nc d\ne f\nz"), (2, "x\na b\nc d\ne f"), (3, "a b\nq\nc d")])
    assert got[2][0] == [1, 2, 3] and got[3][0] == []


def test_a_line_of_very_many_documents(spark):
    rows = [(i, f"{A}\nonly of document {i} and so on") for i in range(400)]
    got = removed(spark, rows)
    assert got[0][0] == [] and all(got[i] == ([0], f"only of document {i} and so on") for i in range(1, 400))


def test_lines_keep_a_copy_and_match_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    split = {i: [line.strip(" ") for line in t.split("\n")] for i, t in rows}
    first = {}
    for i in sorted(split):
        for line in split[i]:
            first.setdefault(line, i)
    gone = set()
    for i, own in split.items():
        at = [(n, line) for n, line in enumerate(x for x in own if x)]
        where = [n for n, x in enumerate(own) if x]
        for f in {first[x] for x in own if x} - {i}:
            other = [x for x in split[f] if x]
            both = set(other) & {x for _, x in at}
            a = [(n, x, x.count(" ") + 1) for n, x in enumerate(other) if x in both]
            b = [(n, x, x.count(" ") + 1) for n, x in at if x in both]
            gone |= {(i, where[b[k][0]]) for k in lines.common_blocks(list(zip(*a)), list(zip(*b)), 5)}
    found = lines.repeated_lines(documents(spark))
    assert {(r.doc_id, r.pos) for r in found.collect()} == gone and gone
    assert all(first[split[i][n]] < i for i, n in gone)


def test_lines_bear_odd_rows(spark):
    cut = lines.drop_repeated_lines(frame(spark, ODD))
    got = cut.collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.removed_} == {6} and "fp" in cut.columns
    assert lines.drop_repeated_lines(frame(spark, [])).count() == 0


def words(seed, n):
    pick = random.Random(seed)
    return ["".join(pick.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_chains_match_the_quadratic_form():
    pick = random.Random(4)
    for _ in range(60):
        m = [(pick.randrange(3000), pick.randrange(3000)) for _ in range(pick.randrange(1, 25))]
        best = []
        for x, y in sorted(m):
            best.append((x, y, 1 + max([0.0, *(s - passages.GAP * (x - u + y - v) for u, v, s in best if u < x and v < y)])))
        top = passages.chains(m)[0]
        score = len(top) - passages.GAP * (m[top[-1]][0] - m[top[0]][0] + m[top[-1]][1] - m[top[0]][1])
        assert abs(score - max(s for _, _, s in best)) < 1e-9
        assert sorted(i for c in passages.chains(m) for i in c) == list(range(len(m)))


def test_common_runs_share_a_seed():
    for seed in range(40):
        run = words(seed, 25)
        texts = [" ".join(words(seed + 1000, 30) + run + words(seed + 2000, 9)), " ".join(words(seed + 3000, seed % 7) + run)]
        d, h, *_ = passages.seeds_of(texts)
        assert set(h[d == 0]) & set(h[d == 1])


def test_passages_are_found(spark):
    shared = words(1, 60)
    edited = shared[:20] + ["changed"] + shared[21:45] + ["two", "more"] + shared[45:]
    rows = [(1, " ".join(words(2, 80) + shared + words(3, 80))), (2, "Once. " + " ".join(shared).upper() + " end"),
            (3, " ".join(words(4, 50) + edited + words(5, 50))), (4, " ".join(words(6, 200))), (5, " ".join(shared[:15])),
            (6, " ".join(words(7, 30) + shared + words(8, 30) + shared))]
    got = passages.repeated_passages(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    # 6 and 2 also share the seeds that only the end of a text keeps
    assert {(2, 1), (3, 1), (6, 1)} <= {(r.doc_id, r.source_id) for r in got} <= {(2, 1), (3, 1), (6, 1), (6, 2)}
    text = dict(rows)
    for r in got:
        if r.doc_id == 2:
            assert text[2][r.start:r.stop].lower() == text[1][r.source_start:r.source_stop] == " ".join(shared)
        if r.doc_id == 3:
            assert r.matched == 59 and text[3][r.start:r.stop] == " ".join(edited)
    assert len([r for r in got if (r.doc_id, r.source_id) == (6, 1)]) == 2


def test_passage_of_very_many_documents(spark):
    shared = " ".join(words(9, 55))
    rows = [(i, " ".join(words(100 + i, 20)) + " " + shared, "en", "s") for i in range(300)]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(1, 300)) and all(r.source_id < r.doc_id for r in got)
    assert len(got) < 3 * 299  # links to the first holder of each seed, not among all


def test_passages_bear_odd_rows(spark):
    got = passages.repeated_passages(frame(spark, ODD)).collect()
    assert {(r.doc_id, r.source_id) for r in got} == {(6, 5)}
    assert max(r.stop for r in got) == len(LONG)
    assert passages.repeated_passages(frame(spark, [])).count() == 0
