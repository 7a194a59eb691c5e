"""Repeated byte strings against brute force: index, pieces, whole table."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from helpers import ODD, documents, frame  # noqa: E402

from versarium.llm import repeats  # noqa: E402


def plain(texts, width):
    """(n_bytes, n_removed, n_spans, sha256 of what stays) of each text."""
    data = [(t or "").encode("utf-8") for t in texts]
    counts = Counter(hashlib.md5(d[i:i + width]).digest() for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, dtype=np.int64)
        for i in range(len(d) - width + 1):
            if counts[hashlib.md5(d[i:i + width]).digest()] > 1:
                gone[i] += 1
                gone[i + width] -= 1
        gone = np.cumsum(gone)[:-2] > 0 if len(d) else np.zeros(0, bool)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, width=repeats.WIDTH, **options):
    got = repeats.without_repeats(frame(spark, [(i, t, "en", "s") for i, t in rows]), width=width, **options).collect()
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert found == Counter((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], width)))
    return got


def mixed(seed, texts=40):
    pick = random.Random(seed)
    base = ["".join(pick.choice("abcdefgh äß") for _ in range(400)) for _ in range(3)]
    for i in range(texts):
        text = ""
        for _ in range(pick.randint(0, 5)):
            at = pick.randrange(300)
            text += pick.choice(base)[at:at + pick.randint(5, 300)]
            if pick.random() < 0.4:
                text += "".join(pick.choice("xyz") for _ in range(pick.randint(1, 40)))
            if pick.random() < 0.1:
                text += "a" * pick.randint(10, 150)
        yield i, text


@pytest.mark.parametrize("hot", [2, 1000])
def test_made_texts_match_brute_force(spark, hot):
    check(spark, list(mixed(3)), width=60, hot=hot, shard=4000)


def test_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    got = check(spark, rows)
    assert any(r.n_removed for r in got)
    check(spark, rows, hot=1)


def test_odd_rows(spark):
    check(spark, [(r[0], r[1]) for r in ODD])
    passage = "".join(random.Random(2).choice("abcdefghij ") for _ in range(500))
    rows = [(1, f"head one {passage} tail"), (2, f"other start {passage}"), (2, f"other start {passage}"), (None, passage), (None, "x" + passage),
            (7, passage[:399]), (8, passage[50:450]), (9, "z" * 3000), (10, "z" * 400), (11, "ab" * 300), (2, "short")]
    check(spark, rows)
    empty = spark.createDataFrame([], "doc_id long, text string, start int")
    assert repeats.without_repeats(empty).collect() == []
    text_ids = spark.createDataFrame([("a", passage), ("b", passage + "!"), (None, "x")], "doc_id string, text string")
    assert {(r.doc_id, r.n_removed) for r in repeats.without_repeats(text_ids).collect()} == {("a", 500), ("b", 500), (None, 0)}


def test_long_texts_are_cut_in_overlapping_stretches(monkeypatch):
    monkeypatch.setattr(repeats, "ROOM", 1000)
    text = "".join(random.Random(4).choice("abcdefgh") for _ in range(5300))
    spots = []
    for part in repeats._parts([text, "kurz", "ü" * 900], 400):
        for row, at, data in part:
            spots += [(row, at + i, data[i:i + 400]) for i in range(len(data) - 399)]
    want = [(row, i, d[i:i + 400]) for row, d in ((0, text.encode()), (2, ("ü" * 900).encode())) for i in range(len(d) - 399)]
    assert sorted(spots) == want


def test_run_index_matches_brute_force():
    pick = random.Random(6)
    for _ in range(60):
        strings = [bytes(pick.choice(b"ab") for _ in range(pick.randint(1, 30))) + b"\xff" for _ in range(pick.randint(1, 6))]
        raw, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
        suffixes = [(s[i:], k, ends[k] - len(s) + i) for k, s in enumerate(strings) for i in range(len(s))]
        assert repeats.suffix_array(raw, ends).tolist() == [x[2] for x in sorted(suffixes)]
        index = repeats.RunIndex(raw, ends)
        found = index.matching_statistics()

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) - 1 and a[n] == b[n]:
                n += 1
            return n
        for s, _, at in suffixes:
            assert found[at] == max([common(s, other) for other, _, place in suffixes if place != at], default=0)
    copies = [b"the same string again and again, with no change\xff"] * 50
    index = repeats.RunIndex(np.frombuffer(b"".join(copies), np.uint8), np.cumsum([len(c) for c in copies]))
    assert len(index.heads) < 200 < index.size / 10  # runs, not bytes
