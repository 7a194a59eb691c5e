"""Readers, page parsing, sinks and streams on hand-made fixtures."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from versarium.operators import aggregate as A
from versarium.operators import html as H
from versarium.plans import corpus
from versarium.sources import readers as R
from versarium.sources import writers as S
from versarium.streaming import jobs


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_multiline_and_header_check(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"Zeile ""eins""\nZeile zwei"\n2,\n', encoding="utf-8")
    got = R.csv_scan(spark, str(tmp_path / "a.csv"), "id int, text string")
    assert rows(got) == [(1, 'Zeile "eins"\nZeile zwei'), (2, None)]
    (tmp_path / "b.csv").write_text("id,other\n1,x\n", encoding="utf-8")
    with pytest.raises(Exception):
        R.csv_scan(spark, str(tmp_path / "b.csv"), "id int, text string").collect()


def test_glob_and_author(spark, tmp_path):
    for name in ("corpus_A_von_B.csv", "corpus_A_backup.csv", "corpus_Unbekannt.csv"):
        (tmp_path / name).write_text("id\n1\n", encoding="utf-8")
    got = R.glob_scan(spark, str(tmp_path / "corpus_*.csv"), "id int")
    assert rows(got.select(R.author_from_file(F.col("file_name"), "corpus_"))) == [("A von B",)]


def test_xml_verses(spark, tmp_path):
    (tmp_path / "v.xml").write_text(
        '<XMLBIBLE><BIBLEBOOK bname="Eins"><CHAPTER cnumber="1"><VERS vnumber="1"> Am Anfang </VERS><VERS vnumber="2"/></CHAPTER>'
        '</BIBLEBOOK><BIBLEBOOK bname="Zwei"><CHAPTER cnumber="3"><VERS vnumber="4">Text</VERS></CHAPTER></BIBLEBOOK></XMLBIBLE>',
        encoding="utf-8")
    assert sorted(rows(R.xml_verse_scan(spark, str(tmp_path / "v.xml")))) == [
        ("Eins", 1, 1, "Am Anfang"), ("Eins", 1, 2, ""), ("Zwei", 3, 4, "Text")]


CHAPTER = """<html><body><div id="navbar"><a href="#">x</a></div><div class="biblehtmlcontent verses" id="verses">
<div class="v" id="v1"><h4>Titel</h4><span class="vn">1</span> Erster Vers, /<span class="br-ind"><br><span class="indent">&nbsp;</span></span>zweite
Zeile! <sup class="fnm"><a name="fnm1" href="#fn1">1</a></sup></div>
<div class="v" id="v2"><span class="vn">2a</span> ohne Zahl</div><div class="v" id="v3"><span class="vn">3</span> </div></div>
<div class="biblehtmlcontent footnotes"><div class="fn"><sup class="fnt"><a name="fn1" href="#fnm1">1</a></sup> siehe Röm 15,11</div></div></body></html>"""


def test_html_verses_and_notes(spark, tmp_path):
    for folder, name in (("ot", "Ps_117.html"), ("nt", "1.Joh_2.html"), ("meta", "Einl_1.html"), ("nt", "Phlm.html")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(CHAPTER, encoding="utf-8")
    files = R.html_files(spark, str(tmp_path / "*" / "*.html"))
    text = "Erster Vers, / zweite Zeile!"
    assert sorted(rows(R.html_verses(files))) == [("NT", "1.Joh", 2, 1, text), ("NT", "Phlm", 1, 1, text), ("OT", "Ps", 117, 1, text)]
    assert ("Ps_117", 1, "siehe Röm 15,11") in rows(R.html_footnotes(files))


def test_encodings_and_lines(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("Größe".encode("utf-8"))
    (tmp_path / "l.txt").write_bytes("Größe".encode("latin-1"))
    assert [r.text for r in R.encoding_fallback(spark, str(tmp_path / "*.txt")).collect()] == ["Größe", "Größe"]
    df = spark.createDataFrame([("Buch,Kapitel,Vers,Text",), ('Gen,1,2,"Und, ja"',), ("a,b",)], "value string")
    assert rows(R.line_verses(df)) == [("Gen", 1, 2, "Und, ja")]


def test_prayers_json(spark):
    cat = {"id": 7, "attributes": {"name": "Morgen & Abend", "prayers": {"data": [
        {"id": 1, "attributes": {"name": "Erstes", "body": "Text"}}, {"attributes": {"title": "Zweites Gebet"}}]}}}
    docs = [json.dumps({"data": [cat, {"id": 8, "attributes": {"name": "Alle"}}]}), json.dumps([{"id": 9, "name": "Leer"}])]
    got = R.json_nested_flatten(spark.createDataFrame([(d,) for d in docs], "json string")).collect()
    assert sorted((r.category, r["item"] and r["item"].id, r["item"] and r["item"].text) for r in got if r["item"]) == [
        ("morgen-abend", "1", "Text"), ("morgen-abend", "zweites-gebet", "")]
    assert [r.category for r in got if not r["item"]] == ["leer"]


def test_celebrations(spark):
    day = {"Zelebrationen": {"x": {"Tl": "Fest", "L1": "Mt 1, 1"}, "yw": {"Tl": "3. Woche im Jahreskreis"}, "z": {"Tl": "Letzte"}}}
    df = spark.createDataFrame([(1, "﻿" + json.dumps(day)), (2, '{"Zelebrationen": {}}'),
                                (3, json.dumps({"Zelebrationen": {"a": {"Tl": "A"}, "b": {"Tl": "B"}}}))], "k int, json string")
    flat = R.celebration_flatten(df, ["k"])
    assert flat.count() == 5
    assert sorted((r.k, r.key) for r in R.main_celebration(flat, ["k"]).collect()) == [(1, "yw"), (3, "b")]


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title><![CDATA[Morning Prayer &amp; more]]></title><link> https://x.example/1 </link><category>a</category>"
        '<category>b &amp; c</category><enclosure url="https://x.example/1.mp3"/><pubDate>Wed, 01 May 2024 06:00:00 +0000</pubDate></item>'
        "<item><title>Night Prayer</title></item></channel></rss>", encoding="utf-8")
    got = R.feed_items(spark, str(tmp_path / "f.xml")).orderBy("title").collect()
    assert got[0].title == "Morning Prayer & more"
    assert got[0].categories == ["a", "b & c"] and got[0].link == "https://x.example/1" and got[0].audio.endswith("1.mp3")
    assert got[0].published is not None and got[1].published is None


def test_book_dim(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"abbr": "Gen", "short": "Genesis", "long": "Das Buch Genesis", "osis": "Gen",
                                                  "type": "ot", "nt": False, "chapters": 50}]), encoding="utf-8")
    assert rows(R.book_dim_scan(spark, str(tmp_path / "b.json"))) == [("Gen", "Genesis", "Das Buch Genesis", "Gen", "ot", False, 50)]


def test_page_group_stops_at_the_gap(spark):
    bad = "x The page you requested was not found. y"
    df = spark.createDataFrame([("w", 1, "a", "ok"), ("w", 2, "b", "ok"), ("w", 4, "d", "ok"), ("v", 1, "e", bad), ("u", 1, "f", "ok"),
                                ("u", 2, "g", bad), ("u", 3, "h", "ok")], "work string, page_no int, url string, html string")
    assert sorted(R.page_group(df).select("work", "page_no").collect()) == [("u", 1), ("w", 1), ("w", 2)]


PAGE = """<html><head><title>T</title><script>var x = "</p><div>";</script></head><body><nav><p>Menü</p></nav><main>
<div class="meta"><p>Weg</p><p>Weg</p><p>Weg</p></div>
<div class="wrap"><section class="content"><h1>Der Autor</h1><p>Erster <b>fetter</b> Absatz.<p>Zweiter &amp; letzter Absatz.
<h2>Anhang zum Werk</h2><ul><li>eins</li><li>zwei</li></ul>
<h2>Anmerkungen hier</h2><blockquote>Zitat</blockquote><table><tr><td>a</td><td>b</td></tr></table>
<div class="footnotes"><ol><li data-footnote-number="9">Note neun</li><li id="fn:3">Note drei</li><li>Note ohne <a href="#fnref4">4</a></li><li>Letzte</li></ol></div>
<p>Nach den Noten.</p></section></div></main><footer>Ende</footer></body></html>"""


@pytest.fixture
def page(spark):
    df = spark.createDataFrame([(1, "https://x.example/works/cpg-2001/a", PAGE),
                                (2, "https://x.example/b", '<main><p class="Error-Message">weg</p></main>')],
                               "page_id bigint, url string, html string")
    return H.with_main_content(H.with_nodes(df, ["page_id", "url"]))


def test_main_content_and_blocks(page):
    got = H.content_blocks(page).collect()
    assert [r.page_id for r in got] == [1]
    assert [(b.kind, b.tag, b.text) for b in got[0].blocks] == [
        ("heading", "h1", "Der Autor"), ("paragraph", "p", "Erster fetter Absatz."), ("paragraph", "p", "Zweiter & letzter Absatz."),
        ("heading", "h2", "Anhang zum Werk"), ("list", "ul", "eins zwei"), ("heading", "h2", "Anmerkungen hier"),
        ("paragraph", "blockquote", "Zitat"), ("table", "table", "a b"), ("footnotes", "div", got[0].blocks[8].text),
        ("paragraph", "p", "Nach den Noten.")]


def test_sections_and_texts(page):
    made = H.content_blocks(page).select(F.explode(F.array(H.sections(F.col("blocks")))).alias("s"))
    sections = made.first().s
    assert [(s.role, s.title, s.paragraph_count) for s in sections] == [
        ("main", "Der Autor", 2), ("appendix", "Anhang zum Werk", 1), ("notes", "Anmerkungen hier", 2), ("main", None, 1)]
    texts = made.select(*[c.alias(n) for n, c in A.text_by_role(F.col("s")).items()]).first()
    assert texts.appendix_text == "eins zwei" and texts.intro_text == ""
    assert texts.main_text.startswith("Erster fetter") and texts.main_text.endswith("Nach den Noten.")


def test_footnote_numbers(page):
    assert rows(H.footnotes(page, ["page_id"])) == [(1, "9", "Note neun"), (1, "3", "Note drei"), (1, "4", "Note ohne 4"), (1, "4", "Letzte")]


def test_segments_and_metadata(page):
    kinds = [(r.kind, r.hierarchy_level) for r in H.segments(page, ["page_id"]).orderBy("segment_no").collect()]
    assert kinds[0] == ("paragraph", 0) and ("heading", 2) in kinds
    assert rows(H.page_metadata(page, ["page_id"])) == [(1, "Der Autor", "Anhang zum Werk", "cpg-2001")]


def test_links(spark):
    html = """<a class=x href="/works/1/versions/2">Übersetzung (Deutsch): Brief</a><a href='https://y.example/files/a.epub'>EPUB</a>
      <a href="/works/1/versions/2">noch einmal</a><a name="n">kein Ziel</a>"""
    df = spark.createDataFrame([(1, "https://x.example/de/works", html)], "page_id bigint, url string, html string")
    got = H.extract_links(df, ["page_id"]).orderBy("pos")
    assert [r.link for r in got.collect()] == ["https://x.example/works/1/versions/2", "https://y.example/files/a.epub"]
    tests = got.select(H.german_work_link(F.col("link"), F.col("label")), H.version_link(F.col("link")),
                       H.download_link(F.col("link"), F.col("label")))
    assert rows(tests) == [(True, True, False), (False, False, True)]


def test_extract_sections_titles_and_numbers(spark):
    long = "Dies ist ein Absatz mit mehr als zehn Wörtern, der stehen bleibt."
    html = f"<article><h1>Der ganze Titel hier</h1><p>{long}</p><p>{long}</p><p>kurz und wenig Text.</p><p>Neu: {long}</p></article>"
    df = spark.createDataFrame([(1, "w", html)], "page_id bigint, work string, html string")
    content = H.with_main_content(H.with_nodes(df, ["page_id", "work"]))
    got = H.extract_sections(content, ["page_id"], "work").orderBy("section").collect()
    assert [(r.section, r.title) for r in got] == [(1, "Der ganze Titel hier"), (2, "Der ganze Titel hier")]


def test_corpus_build_ids_are_unique(spark):
    para = " ".join(f"Dieser Satz nummer {w} gehört hierher." for w in "abcdefghijklmno")
    pages = [(i, f"https://x.example/works/{i}", f"<article><h1>Autor A</h1><h2>Werk {i}</h2><p>{para} Seite{i}x</p><p>{para[::-1]} {i}</p></article>")
             for i in range(3)]
    got = corpus.corpus_build(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    assert got and len({r.id for r in got}) == len(got)
    assert all(r.word_count >= 15 and r.language == "de" for r in got)


# ---- sinks --------------------------------------------------------------------------------
def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a{i % 3}", "x" * (i % 7)) for i in range(2500)], "id int, author string, t string")
    S.write_chunks(df, str(tmp_path / "chunks"), "id", size=1000)
    parts = sorted((tmp_path / "chunks").glob("part-*.csv"))
    assert all(len(p.read_text().splitlines()) <= 1001 for p in parts)
    S.write_partitioned(df, str(tmp_path / "parts"))
    assert sorted(p.name for p in (tmp_path / "parts").glob("author=*")) == ["author=a0", "author=a1", "author=a2"]
    S.write_master_sorted(df, str(tmp_path / "m"), "author", "id")
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2500
    S.truncate_load(df, str(tmp_path / "m"))
    S.compact_projection(df, str(tmp_path / "c"), "id", "t")
    assert spark.read.parquet(str(tmp_path / "c")).columns == ["id", "t"]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    two = spark.createDataFrame([(2, "c"), (2, "c"), (3, "d")], "k int, s string")
    assert S.versioned_overwrite(one, path) == 1 and S.versioned_overwrite(two, path) == 2
    assert sorted(rows(S.read_version(spark, path, 1))) == [(1, "a"), (2, "b")]
    S.upsert(two, path, ["k"], 2)
    S.upsert(two, path, ["k"], 2)
    want = [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(rows(S.read_latest(spark, path, ["k"]))) == want
    S.compact(spark, path, ["k"], str(tmp_path / "n"))
    assert sorted(rows(S.read_latest(spark, str(tmp_path / "n"), ["k"]))) == want
    assert sorted(rows(S.merge_latest(one, two.dropDuplicates(), ["k"], "k"))) == want


# ---- streams ---------------------------------------------------------------------------------
def test_streams_over_several_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "k int, o int, s string"
    for i, batch in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 3, "c")], [(1, 2, "late"), (3, 1, "d")])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    def stream():
        return jobs.file_stream(spark, src, schema, files_per_batch=1)
    jobs.latest_stream(stream(), "k", ["o"], ["o", "s"], str(tmp_path / "a"), str(tmp_path / "ac"))
    assert sorted(rows(S.read_latest(spark, str(tmp_path / "a"), ["k"]))) == [(1, 3, "c"), (2, 1, "b"), (3, 1, "d")]
    jobs.ingest(stream(), str(tmp_path / "i"), str(tmp_path / "ic"))
    jobs.ingest(stream(), str(tmp_path / "i"), str(tmp_path / "ic"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 5
    done = spark.createDataFrame([(2,)], "k int")
    jobs.backlog_stream(stream(), done, "k", "s", str(tmp_path / "b"), str(tmp_path / "bc"))
    assert sorted(r.k for r in S.read_latest(spark, str(tmp_path / "b"), ["k"]).collect()) == [1, 3]


def test_align_stream_keeps_the_pointer(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "t")
    schema = "k int, n int, said array<string>, goal array<string>"
    goal = ["im", "anfang", "war", "das", "wort"]
    for batch in ([(1, 1, ["im", "anfank"], goal), (2, 1, ["nein"], goal)], [(1, 2, ["das", "wort"], goal)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    jobs.align_stream(jobs.file_stream(spark, src, schema, files_per_batch=1), "k", "n", "said", "goal", out, str(tmp_path / "c"))
    assert sorted(rows(jobs.pointers(spark, out, "k"))) == [(1, 5), (2, 0)]


def test_late_chunks_find_their_place(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "t")
    schema = "k int, n int, said array<string>, goal array<string>"
    goal = ["im", "anfang", "war", "das", "wort", "und"]
    for batch in ([(1, 2, ["das", "wort"], goal)], [(1, 1, ["im", "anfang", "war"], goal)], [(1, 3, ["und"], goal)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    jobs.align_stream(jobs.file_stream(spark, src, schema, files_per_batch=1), "k", "n", "said", "goal", out, str(tmp_path / "c"))
    assert rows(jobs.pointers(spark, out, "k")) == [(1, 6)]


def test_cache_fill_computes_a_key_once(spark, tmp_path):
    src, schema, asked = str(tmp_path / "src"), "k int, t timestamp", []
    for batch in ("(1, timestamp'2026-01-01 00:00:00'), (2, timestamp'2026-01-01 00:00:01'), (1, timestamp'2026-01-01 00:00:02')",
                  "(1, timestamp'2026-01-03 00:00:00'), (3, timestamp'2026-01-03 00:00:00')",
                  "(2, timestamp'2026-01-09 00:00:00'), (4, timestamp'2026-01-09 00:00:00')"):
        spark.sql(f"select * from values {batch} as x(k, t)").coalesce(1).write.mode("append").parquet(src)

    def compute(misses):
        asked.extend(r.k for r in misses.collect())
        return misses.select("k", (F.col("k") * 10).alias("answer"))
    jobs.cache_fill(jobs.file_stream(spark, src, schema, files_per_batch=1), "k", compute, str(tmp_path / "t"), str(tmp_path / "c"))
    assert sorted(rows(S.read_latest(spark, str(tmp_path / "t"), ["k"]))) == [(1, 10), (2, 20), (3, 30), (4, 40)]
    assert sorted(asked) == [1, 2, 3, 4]


def test_late_rows_lose_in_upserts(spark, tmp_path):
    from versarium.streaming import jobs
    batches = [[(1, 3, "new"), (2, 1, "old")], [(1, 2, "late"), (2, 5, "newer")], [(1, 1, "later still"), (3, 1, "own")]]
    for i, part in enumerate(batches):
        spark.createDataFrame(part, "k int, o int, s string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "k int, o int, s string", files_per_batch=1)
    jobs.upsert_stream(stream, str(tmp_path / "t"), ["k"], str(tmp_path / "c"), F.desc("o"))
    got = S.read_latest(spark, str(tmp_path / "t"), ["k"], order=[F.desc("o")]).collect()
    assert {(r.k, r.o, r.s) for r in got} == {(1, 3, "new"), (2, 5, "newer"), (3, 1, "own")}


@pytest.mark.parametrize("files", [1, 3])
def test_table_stream_reads_files_and_folders(spark, tmp_path, files):
    rows_in = [(i, i % 4, f"text {i}") for i in range(20)]
    table = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows_in, "k int, o int, s string").repartition(files).write.parquet(table)
    if files == 1:  # the table is the file itself
        table = next((tmp_path / "docs.parquet").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    name = Path(table).stem
    stream = jobs.table_stream(spark, str(tmp_path), name, "k int, o int, s string")
    jobs.upsert_stream(stream, str(tmp_path / "t"), ["o"], str(tmp_path / "c"), F.desc("k"))
    stored = S.read_latest(spark, str(tmp_path / "t"), ["o"], order=[F.desc("k")])
    assert sorted((r.o, r.k) for r in stored.collect()) == [(0, 16), (1, 17), (2, 18), (3, 19)]


@pytest.mark.parametrize("name", ["align_stream", "backlog_stream"])
def test_stream_queries_read_tables_of_several_files(spark, tmp_path, name):
    from versarium.queries import catalog
    tables = {"documents": ([(i, f"text {i}", "de", "s", 6) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long"),
              "labels": ([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"),
              "conversations": ([(c, t, "user", f"am anfang war {c} wort") for c in range(4) for t in range(3)],
                                "conv_id long, turn int, role string, text string")}
    for table, (values, schema) in tables.items():
        spark.createDataFrame(values, schema).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    keys = {"align_stream": list(range(4)), "backlog_stream": [0, 3, 4, 5, 6, 7, 8]}
    assert sorted(r[0] for r in found.collect()) == keys[name]
