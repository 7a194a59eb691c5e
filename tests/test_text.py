"""Column functions on literal cases, and the quirks we fixed."""

import random
import re

import pytest
from pyspark.sql import functions as F

from versarium import patterns as P
from versarium import rx
from versarium.functions import arrays, classify as C, predicates as Q, sqlreg
from versarium.functions import text as T
from versarium.rx import Rx


def test_space_and_tags(values):
    assert values(T.collapse_ws, ["  a\u00a0\n b\t", None, ""]) == ["a b", None, ""]
    assert values(T.strip_tags, ["<p class='x'>a</p>b"]) == ["ab"]
    assert values(T.br_to_newline, ["a<br/>b<br>&nbsp;<i>c</i> "]) == ["a\nb\n c"]


def test_amp_decodes_last(values):
    assert values(T.decode_entities, ["&amp;lt; &lt;b&gt; &#39;&quot;&nbsp;"]) == ["&lt; <b> '\" "]


def test_word_count_is_python_split(values):
    texts = ["", "  a  b ", "a\u00a0b\u2003c\n d", None]
    assert values(T.word_count, texts) == [len((t or "").split()) for t in texts]


def test_footnotes_pages_references(values):
    assert values(T.strip_footnote_refs, ["a[12] b(3)↩︎ c↩"]) == ["a b c"]
    assert values(T.strip_page_numbers, ["12 Wort\nS. 109Wort 7\n"]) == ["Wort\nWort"]
    assert values(T.strip_biblio_refs, ["Autor: - Max § 2 CPG 2001 lib. IV cap. 3"]) == ["Max    "]


def test_metadata_lines(values):
    text = "Titel Werk: x\nText bleibt\n12\nS\nSeite 4 von 5"
    assert values(T.strip_metadata_lines, [text]) == ["Text bleibt\nSeite 4 von 5"]
    assert values(lambda c: T.strip_metadata_lines(c, "download"), [text]) == ["Text bleibt\nS"]
    assert values(lambda c: T.strip_nav_lines(c, "strict", 15),
                  ["Navigation und mehr\n kurz \nEin Satz, der lang genug ist"]) == ["Ein Satz, der lang genug ist"]


def test_lines(values):
    assert values(T.keep_substantive_lines, ["KURZ\nEINE LANGE ZEILE NUR IN GROSS\nDiese Zeile ist lang genug."]) == \
        ["Diese Zeile ist lang genug."]
    assert values(T.drop_repeated_line, ["a\na\nb\na"]) == ["a\nb\na"]
    assert values(T.drop_name_lists, ["Marcus, Priester\nEin ganzer Satz vom Priester bleibt hier stehen\nAnna Berta"]) == \
        ["Ein ganzer Satz vom Priester bleibt hier stehen"]


def test_titles_ids_names(values, spark):
    assert values(T.clean_title, ["Übersetzung (Deutsch): Brief an X (BKV 2) (SWKV)"]) == ["Brief an X"]
    assert values(lambda c: T.clean_title(c, True), ["Brief 12 "]) == ["Brief"]
    row = spark.range(1).select(T.make_id(F.lit("A. von B"), F.lit("w" * 40), F.lit(3)).alias("a"),
                                T.make_id(F.lit("A. v"), F.lit("x y"), F.lit(3), True).alias("b")).first()
    assert row == ("A__von_B_" + "w" * 30 + "_3", "A._v_x_y_3")
    assert values(T.safe_filename, ['A: "b"  c?']) == ["a_b_c"]
    assert values(T.name_from_filename, ["Ikone_hiernoymus.jpg", "300px-anna_vom_see-62b05f-200.png", "Clemens_I.webp"]) == \
        ["Hieronymus", "Anna Vom See", "Clemens von Rom"]
    assert values(T.describe_name, ["Origenes", "Niemand"]) == ["Alexandrinischer Gelehrter", "Kirchenvater"]


def test_slug_spells_umlauts_first(values):
    # the original folded ä to a before its umlaut rule could fire
    assert values(T.slugify, ["  Äpfel & Öl, ça va? ", "ß"]) == ["aepfel-oel-ca-va", "ss"]


def test_fold(values):
    assert values(T.fold_diacritics, ["Éñ ǆ ﬁ Ärger ΐ"]) == ["en dz fi arger ι"]
    assert values(lambda c: T.normalize_unicode(c, "NFKC"), ["ﬁ ²", None]) == ["fi 2", None]
    assert values(T.fold_umlauts, ["MatthÃ¤us Rö÷m"]) == ["Matthaeus Roeoem"]
    assert values(T.normalize_word, ["„Größe!“ é"]) == ["große“e"]


def test_markers(values):
    assert values(T.strip_markers, ["Text $ŽG://ESyn0812/ hier [] ;,"]) == ["Text  hier"]
    assert values(T.normalize_quotes, ["„a“ – b"]) == ['"a" - b']


def test_references(values, spark):
    assert values(T.ref_norm, ["1. Kön", "Röm"]) == ["1Koen", "Roem"]
    assert values(T.display_ref, ["Ps 135 (134), 1a-2b u. 3 (R: 3a)"]) == ["Ps 135, 1-2.3"]
    row = spark.range(1).select(
        T.cache_key(F.lit(" Joh "), F.lit(None).cast("string"), F.lit(3), F.lit(None).cast("int")).alias("a"),
        T.format_ref(F.lit("Johannes"), F.lit(3), F.lit(16)).alias("b"),
        T.note_label(F.lit("{FN12}"), F.lit("")).alias("c"), T.note_label(F.lit(None), F.lit("a:b:7")).alias("d")).first()
    assert tuple(row) == ("joh:allioli:3:0", "Johannes 3,16", "12.", "7.")


def test_urls(values):
    assert values(T.url_work_id, ["https://x/works/cpg-2001/a", "https://x/works/17", "plain"]) == ["cpg-2001", "17", "plain"]
    assert values(T.url_format, ["a.PDF", "a.epub.pdf", "x"]) == ["pdf", "epub", "unknown"]
    assert values(T.rtf_to_text, ["{\\rtf1 Ein \\b0 Text}"]) == ["Ein Text"]
    assert values(T.sentence_per_line, ["Eins. Zwei! Drei..."]) == ["Eins.\nZwei!\nDrei…"]


def test_snippet_and_vector(values):
    assert values(T.snippet, ["a" * 80, "a" * 81]) == ["a" * 80, "a" * 80 + "..."]
    assert values(T.vector_literal, [[0.5, -1.0]], "array<float>") == ["[0.50000000,-1.00000000]"]


def test_dup_key_prefix_is_the_rule(values):
    long = "wort " * 40
    assert values(T.dup_key, [long + "x", long + "y"])[0] == values(T.dup_key, [long + "y"])[0]
    whole = values(lambda c: T.dup_key(c, None), [long + "x", long + "y"])
    assert whole[0] != whole[1]


def test_deep_clean_is_idempotent_on_clean_text(values):
    dirty = "398, Ein Text [1] mit S. 12 Marken (3) und lib. IV Resten.. https://x.y/z , de"
    once = values(T.deep_clean, [dirty])
    assert once == ["Ein Text mit Marken und Resten."]
    assert values(T.deep_clean, once) == once


def test_valid_text(values):
    good = "Dies ist ein langer Satz, welcher wirklich genug Wörter enthält, damit diese Prüfung ihn am Ende behält, nicht wahr"
    bad = [None, "kurz", "1 2 3 " * 20, "Titel " + good, "ab cd ef gh " * 10, "12345678 " * 20]
    assert values(Q.valid_text, [good, *bad]) == [True] + [False] * 6


def test_predicates(values):
    assert values(Q.unwanted_content, ["Bitte IMPRESSUM lesen", "Text"]) == [True, False]
    assert values(lambda c: Q.ilike_term(c, "50%_a"), ["x 50%_A y", "x 50 a y", None]) == [True, False, False]
    assert values(lambda c: Q.multi_pattern_or(c, ["a%b", "zz"]), ["A B", "q", "ZZ"]) == [True, False, True]
    assert values(lambda c: Q.number_rest(c)["text"], ["12. " + "x" * 31, "12. kurz"]) == ["x" * 31, None]
    assert values(Q.ordinary_category, ["Alle", "Rosenkranz", "Morgen", None]) == [False, False, True, True]


def test_dates_and_classes(values, spark):
    assert values(C.parse_years, ["ca. 250–328", "354 - 430", "unbekannt"]) == [(250, 328), (354, 430), (None, None)]
    assert values(C.german_date, ["2024-05-01", "Mai", None]) == ["01. Mai 2024", "Mai", None]
    frames = spark.createDataFrame([(325, 381), (325, None), (None, 787), (0, None)], "a int, b int")
    assert [r[0] for r in frames.select(C.timeframe(F.col("a"), F.col("b"))).collect()] == ["325 - 381", "325", "787", None]
    assert values(C.section_role, ["Einleitung", "Ergänzung", "Anmerkungen", "Kap. 1", None]) == \
        ["intro", "appendix", "notes", "main", "main"]
    assert values(C.chapter_header, ["Kapitel 12", "3. Satz", "Nichts"]) == ["12", "3", None]
    assert values(C.section_start, ["Kapitel 3", "12. Anfang", "anfang"]) == [True, True, False]
    assert values(C.reading_seconds, ["x", "x" * 440, "x" * 99999]) == [12, 20, 180]
    assert values(C.positive_int, ["5", "-1", "x"]) == [5, None, None]
    assert values(lambda c: C.detect_hour(c, F.array(F.lit("Night Prayer"))), ["Evening Prayer", "x"]) == ["Vespers", "Compline"]


def test_author_order_matters(spark):
    rows = spark.createDataFrame([("/works/leo-gregor", "t"), ("/works/9", "Theodoret, cyrill_jer"), ("/w/cpg-2001/", "t"),
                                  ("/w/1", "t")], "u string, t string")
    assert [r[0] for r in rows.select(C.author_by_substring(F.col("u"), F.col("t"))).collect()] == \
        ["Gregor von Nazianz", "Theodoret von Cyrus", "Corpus_cpg-2001", "Unbekannt"]


def test_segment_type(spark):
    rows = spark.createDataFrame([("h2", "Buch IV", ""), ("h3", "Kapitel 7", ""), ("h3", "Titel", ""), ("p", "12. 3 Text", ""),
                                  ("p", "12. Text", ""), ("div", "Text", "Footnote"), ("p", "Vorwort", "")], "a string, b string, c string")
    kinds = rows.select(C.segment_type(F.col("a"), F.col("b"), F.col("c")).alias("k"), "b")
    got = kinds.select("k", C.section_number(F.col("k"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("book", "IV"), ("chapter", "7"), ("heading", None), ("verse", "12"), ("paragraph", "12"),
                                       ("footnote", None), ("introduction", None)]


def test_structure_counts_distinct_marks(spark):
    # the original kept only the count of the last pattern that matched
    text = "Kapitel 1 Kapitel 1 Kapitel 2 § 3 Buch I"
    profile = C.structure_profile(F.lit(text), F.lit("<p>x</p>(1)"))
    row = spark.range(1).select(*[c.alias(n) for n, c in profile.items()]).first()
    assert (row.chapter_count, row.book_count, row.content_type, row.footnote_count) == (3, 1, "multi_book_work", 1)


def test_json(values):
    assert values(arrays.json_array_from_text, ['Hier: ["a", "b"] Ende', "nichts"]) == [["a", "b"], None]
    assert values(lambda c: arrays.safe_json(c, "struct<k:int>")["k"], ['{"k": 3}', "{{", ""]) == [3, None, None]


def test_sql_functions_match_the_column_functions(spark):
    sqlreg.register(spark)
    text = "S. 12 Ein [3] Text — it's (4)"
    row = spark.sql("SELECT strip_footnote_refs(t), strip_page_numbers(t), word_count(t), dup_key(t) FROM VALUES (?) AS v(t)",
                    args=[text]).first()
    want = spark.range(1).select(*[f(F.lit(text)) for f in (T.strip_footnote_refs, T.strip_page_numbers, T.word_count, T.dup_key)]).first()
    assert tuple(row) == tuple(want)


def test_every_sql_function_equals_its_column_function(spark):
    sqlreg.register(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    odd = ["", "a", "S. 12 Ein [3] <b>Text</b> — it's &lt;4&gt; &amp;amp; 'x' \\ \"q\"", "Kapitel 3\nKapitel 3\nÄÖÜ ß Œuvre é Ψ", "https://x.de/a/cpg1234.pdf",
           "Buch IV. 12 $ŽT://ESyn0812/Nr. 4 (a) , ; .. ; S. 3", "{\\rtf1 Ein\\par zwei}", "GROSS " * 18, "Nr. 7 x", "12 34 56 78 " * 20, " \u00a0 rand \u00a0 "]
    df = docs.union(spark.createDataFrame([(t,) for t in odd] + [(None,)], "text string")).cache()
    column = {name: getattr(T, name, None) or getattr(C, name, None) or getattr(Q, name, None) for name in sqlreg.definitions()}
    one = [n for n, (args, _, _) in sqlreg.definitions().items() if args == "t STRING" and column[n]]
    assert len(one) >= 34
    differs = {}
    for name in one:
        got = df.select("text", F.expr(f"{name}(text)").alias("a"), column[name](F.col("text")).alias("b")).where("NOT (a <=> b)").first()
        if got:
            differs[name] = got
    assert not differs
    row = spark.sql("""SELECT make_id('A. B', 'Über: das Werk', '3') AS a, format_ref('Joh', 3, 16) AS b, vector_literal(array(0.5D, -1D)) AS c,
      snippet('abcdef', 4) AS d, name_similarity('abcd', 'abce') AS e, search_tokens('Der Weg') AS f""")
    want = spark.range(1).select(T.make_id(F.lit("A. B"), F.lit("Über: das Werk"), F.lit("3")), T.format_ref(F.lit("Joh"), F.lit(3), F.lit(16)),
                                 T.vector_literal(F.array(F.lit(0.5), F.lit(-1.0))), T.snippet(F.lit("abcdef"), 4), F.lit(0.75), F.array(F.lit("der"), F.lit("weg")))
    assert tuple(row.first()) == tuple(want.first())


PATTERNS = [(name, rx) for name, value in vars(P).items() for rx in
            (value if isinstance(value, list) else value.values() if isinstance(value, dict) else [value]) if isinstance(rx, Rx)]


def test_every_pattern_compiles_in_both_engines(spark):
    import duckdb
    con = duckdb.connect()
    for name, rx in PATTERNS:
        con.execute("SELECT regexp_matches('x', ?)", [rx.re2]).fetchall()
    spark.range(1).select(*[F.rlike(F.lit("x"), F.lit(rx.java)) for _, rx in PATTERNS]).collect()
    assert len(PATTERNS) > 80


def test_pattern_classes_are_unicode():
    with pytest.raises(ValueError):
        Rx(r"[\W]")
    assert re.search(r"\\p\{L\}", Rx(r"\w").java)


def test_java_classes_hold_the_same_characters(spark):
    codes = spark.createDataFrame([(chr(i),) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000], "c string")
    wrong = [F.count_if(F.rlike("c", F.lit(flags + rx.expand(p, rx._JAVA_CLASSES))) != F.rlike("c", F.lit(flags + rx.expand(p)))).alias(f"w{i}_{j}")
             for i, flags in enumerate(("(?d)", "(?diu)")) for j, p in enumerate((r"\s", r"\d", r"\w", r"\S", r"\W", r"[^\w\s]", r"[\d,]"))]
    assert set(codes.agg(*wrong).first()) == {0}
    assert r"\p{Z}" not in P.SPACES.java and r"\p{Z}" in P.SPACES.re2
    for rule in P.BIBLIO_REFS:
        same = F.rlike("c", F.lit(rule.java[:rule.java.index("]") + 1])) if rule.java.startswith("(?d)[") else None
        if same is not None:  # the first letter alone
            letter = rule.java[5]
            assert codes.agg(F.count_if(same != F.rlike("c", F.lit(f"(?diu){letter}")))).first()[0] == 0


def test_cleaning_by_what_a_text_holds_equals_the_plain_chain(spark):
    rng = random.Random(5)
    parts = ["Autor:", "AUTOR:", "TiTel Werk:", "Tag:", "ıdentifier:", "Time:", "cpG 1", "BKV", "sWkV", "Übersetzung (x):", "kommentar (y):", "lib. ıv",
             "Hiſt. x", "e. İV", "c. 3", "CAP. 4", "§ 5", "nr. 6", "N. 7", "S. 8", "[9]", "(1)", "2.", ", de", ", 12", " 34", "AB 5", "http://x.y",
             "www.z", "\n", " ", " ", " ", "\x1c", "  ", ",", ";", "..", "( )", "[ ]", "Priester", "Diakon X", "Max Muster", "Max, Muster.",
             "wort", "ende", "K", "K:", "é", "٣", "²", "!", "„", "↩", "a b c Bischof", "𝄞"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)

    def slow(rule):
        return lambda c: F.regexp_replace(c, f"(?d{rule.flags}{'u' if 'i' in rule.flags else ''})" + rx.expand(rule.pattern), rule.to)
    steps = [P.TRIM_ARTIFACTS + P.PAGE_NUMBERS + P.FOOTNOTE_REFS[:2], P.FOOTNOTE_REFS[2:] + P.NUMBERING + P.WEB_ARTIFACTS, P.BIBLIO_REFS[:9], P.BIBLIO_REFS[9:]]
    plain = df.select("t", F.col("t").alias("x"))
    for rules in steps:
        for rule in rules:
            plain = plain.select("t", slow(rule)(F.col("x")).alias("x"))

    def keep(line):
        n = F.size(F.filter(F.split(F.regexp_replace(line, rx.expand(r"\s+"), " "), " "), lambda w: w != ""))
        pair = (n == 2) & P.TWO_NAMES.found(F.regexp_replace(line, rx.expand(r"\A\s+|\s+\z"), ""))
        return ~(((n <= 3) & P.NAME_TITLES.found(line)) | pair)
    lines = F.array_join(F.filter(F.split("x", "\n", -1), keep), "\n")
    plain = plain.select("t", F.when(P.PRIEST_OR_DEACON.found(F.col("x")), lines).otherwise(F.col("x")).alias("x"))
    for rule in [*P.TIDY, P.EDGE_SPACE]:
        plain = plain.select("t", slow(rule)(F.col("x")).alias("x"))
    both = plain.select("t", "x", T.deep_clean(F.col("t")).alias("y"))
    assert both.where("x != y").take(3) == []
