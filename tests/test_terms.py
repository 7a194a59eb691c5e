"""Term index and German stems."""

import random

import pytest
from pyspark.sql import functions as F

from versarium.functions import stems
from versarium.operators import search as X
from versarium.operators import terms as I

# words and stems of the published sample vocabulary, and one word per rule
STEMS = {"aufeinander": "aufeinand", "aufeinanderfolge": "aufeinanderfolg", "aufeinanderfolgenden": "aufeinanderfolg",
         "aufeinanderschlügen": "aufeinanderschlug", "aufenthalt": "aufenthalt", "aufenthaltes": "aufenthalt",
         "kategorie": "kategori", "kategorien": "kategori", "kategorisch": "kategor", "kategorischen": "kategor",
         "kater": "kat", "katers": "kat", "katze": "katz", "kätzchen": "katzch", "ab": "ab", "straße": "strass",
         "kenntnisse": "kenntnis", "bauer": "bau", "gnädig": "gnadig", "häßlichkeit": "hasslich", "heiligung": "heilig", "": ""}


def test_german_stems(spark):
    df = spark.createDataFrame([(w,) for w in STEMS] + [(None,)], "w string")
    got = {r.w: r.s for r in df.select("w", stems.german(F.col("w")).alias("s")).collect()}
    assert got.pop(None) is None
    assert got == STEMS


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = ["licht", "wort", "friede", "zeit", "haus", "berg"]
    rows = [(i * 7 - 300, " ".join(rng.choices(words, [9, 5, 4, 2, 1, 1], k=rng.randrange(1, 40)))) for i in range(900)]
    rows += [(5000, "wort " * 90 + "zeit " * 80), (rows[3][0], "wort zeit"), (None, "wort zeit"), (7000, None), (7001, "")]
    return spark.createDataFrame(rows, "k long, t string").repartition(5)


def test_index_search_equals_the_full_ranking(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    I.write_term_index(corpus, "k", "t", path, span=64)
    index = spark.read.parquet(path)
    postings = X.term_postings(corpus.where("k is not null"), "k", "t")
    for query in ("Wort zeit", "berg", "licht wort friede zeit haus berg", "wort fehlt"):
        want = [tuple(r) for r in X.term_search(postings, "k", query).collect()]
        assert [tuple(r) for r in I.index_search(index, "k", query, span=64).collect()] == want
        for limit in (1, 7, 40):
            got = I.index_search(index, "k", query, limit, span=64, wave=3)
            assert [tuple(r) for r in got.collect()] == want[:limit]
    assert I.index_search(index, "k", "?!", 5, span=64).count() == 0
    every = index.where("term in ('wort', 'zeit')").select("part").distinct().count()
    assert I.needed_parts(index, ["wort", "zeit"], 1, span=64, wave=3).count() == 1 < every
    assert index.agg(F.max(F.size("places"))).first()[0] <= 2 * 64


def test_stemmed_index_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "Die Katzen der Kategorien"), (2, "eine Katze"), (3, "Kater")], "k int, t string")
    I.write_term_index(df, "k", "t", str(tmp_path / "a"), stemmed=True)
    found = I.index_search(spark.read.parquet(str(tmp_path / "a")), "k", "katze", 10, stemmed=True)
    assert [tuple(r) for r in found.collect()] == [(1, 1), (2, 1)]
    I.write_term_index(df.where("k > 9"), "k", "t", str(tmp_path / "b"))
    assert I.index_search(spark.read.schema(spark.read.parquet(str(tmp_path / "a")).schema).parquet(str(tmp_path / "b")), "k", "x", 3).count() == 0


def test_words_of_one_stem_add_up_over_tasks(spark, tmp_path):
    rows = [(i, "Katze Katzen katze Haus") for i in range(40)] + [(3, "Katzen"), (100, "Hauses")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    I.write_term_index(df, "k", "t", str(tmp_path), stemmed=True)
    got = {r.term: (r.docs, r.most, sum(r.tfs), r.places == sorted(set(r.places))) for r in spark.read.parquet(str(tmp_path)).collect()}
    assert got == {"katz": (40, 4, 121, True), "haus": (41, 1, 41, True)}


def test_batches_are_worked_off_in_slices(monkeypatch):
    import pyarrow as pa

    from versarium.operators import html as H
    from versarium.session import in_slices
    batch = pa.RecordBatch.from_pydict({"key_": pa.array(range(50), pa.int64()), "words_": [["a", "b"]] * 49 + [None]})
    monkeypatch.setattr(I, "WORDS", 10)
    out = list(I._counted(4096)(iter([batch])))
    assert len(out) == 10 and max(len(b.column("places").flatten()) for b in out) == 10
    assert sum(len(b.column("places").flatten()) for b in out) == 98
    pages = pa.RecordBatch.from_pydict({"html": ["<p>x</p>", None, "y" * 90, ""] * 3})
    parts = list(in_slices(pages, pa.compute.binary_length(pages.column("html")), 100))
    assert [v for p in parts for v in p.column("html").to_pylist()] == pages.column("html").to_pylist() and len(parts) == 3
    assert list(in_slices(pages.slice(0, 0), pa.compute.binary_length(pages.slice(0, 0).column("html")), 100)) == []
    assert H.PAGE_BYTES == 1 << 20
