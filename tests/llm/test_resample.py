"""Importance resampling against a plain version, and what it does with odd rows."""

import hashlib
import math
import re
import sys
from collections import Counter
from pathlib import Path
from zlib import crc32

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from helpers import ODD, documents, frame  # noqa: E402

from versarium.llm import resample  # noqa: E402


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(rows, target, percent=25, min_words=20):
    """{row number: (doc_id, n_features, weight, score)} and the numbers drawn, best first."""
    def hashed(text):
        w = words_of(text)
        return [crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]], len(w)
    source, wanted = Counter(), Counter()
    for _, text in rows:
        source.update(hashed(text)[0])
    for text in target:
        wanted.update(hashed(text)[0])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    out, fit = {}, []
    for n, (doc, text) in enumerate(rows):
        f, count = hashed(text)
        gain = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in f)
        weight = gain // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out[n] = (doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))))
        if count >= min_words:
            fit.append(n)
    fit.sort(key=lambda n: (-out[n][3], out[n][0] is None, out[n][0] or 0))
    return out, fit[:percent * len(fit) // 100]


def check(spark, rows, target, **options):
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resampled(docs, goal, **options).collect()
    want, drawn = plain(rows, target, **{k: v for k, v in options.items() if k in ("percent", "min_words")})
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(want.values())
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(want[n][0], want[n][3]) for n in drawn]
    return got


def test_matches_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    check(spark, rows, target)
    check(spark, rows, target, percent=100, min_words=0)


def test_odd_rows_ties_and_repeats(spark):
    rows = [(r[0], r[1]) for r in ODD]
    check(spark, rows, ["the quick brown fox", None, ""], percent=50, min_words=1)
    check(spark, rows, [], percent=100, min_words=0)
    # one id and text on many rows: as many are drawn as asked for, all of one score
    many = [(3, "one two three four")] * 40 + [(i, "one two three four") for i in range(50, 60)]
    got = check(spark, many, ["one two"], percent=30, min_words=2)
    assert sum(r["rank"] is not None for r in got) == 15


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(resample, "noise", lambda column, seed: column * 0)
    docs = spark.createDataFrame([(i, f"same words {'here' if i % 2 else 'there'}") for i in range(400, 0, -1)], "doc_id long, text string")
    goal = spark.createDataFrame([("here",)], "text string")
    drawn = resample.resampled(docs, goal, percent=70, min_words=1).filter("rank is not null").orderBy("rank").collect()
    first = 1 if drawn[0].doc_id % 2 else 2
    order = [*range(first, 401, 2), *range(3 - first, 401, 2)]
    assert [r.doc_id for r in drawn] == order[:280]


def test_empty_tables_and_other_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, score int")
    assert resample.resampled(empty, empty).collect() == []
    assert resample.drawn_documents(frame(spark, ODD), frame(spark, ODD[:1]), percent=100).columns[-1] == "text2"
    with pytest.raises(ValueError):
        resample.resampled(spark.createDataFrame([("a", "b")], "doc_id string, text string"), empty)


def test_cutoff_by_sections():
    for values in ([5, 5, 5], [1, 2, 3, 9, 9, 40], list(range(-300, 300, 7))):
        for wanted in range(1, len(values) + 1):
            got = resample._greatest(lambda marks: [sum(v >= m for v in values) for m in marks], min(values), max(values), wanted, 3)
            assert got == sorted(values, reverse=True)[wanted - 1]
