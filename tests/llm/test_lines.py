"""Line dedup where the first holder of a single line is not enough."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from helpers import frame  # noqa: E402

from versarium.llm import lines  # noqa: E402

A, B = [f"{x} one two three four five six" for x in "AB"]


def removed(spark, rows):
    cut = lines.drop_repeated_lines(frame(spark, [(i, t, "en", "s") for i, t in rows]))
    assert "removed_" in cut.columns  # a column of the caller
    return {r.doc_id: [x.pos for x in r.removed_ or []] for r in cut.collect()}


def test_copies_of_later_holders_go(spark):
    short = ["a b", "c", "d e", "f"]
    got = removed(spark, [(1, f"{A}\n{B}"), (2, f"{B}\n{A}"), (3, f"{B}\n{A}"), *[(10 + i, f"own {i}\n{x}") for i, x in enumerate(short)],
                          (20, "\n".join(["head", *short])), (21, "\n".join([*short, "tail"]))])
    assert len(got[2]) == 1 and got[3] == [0, 1]
    assert got[20] == [] and got[21] == [0, 1, 2, 3]


def test_lines_against_all_pairs(spark):
    pick, kinds = random.Random(5), [f"l{i} " + "w " * (i % 7) + "end" for i in range(40)]
    rows = {}
    for i in range(80):
        own = [pick.choice(kinds) for _ in range(6)]
        if i > 5:
            source = rows[pick.randrange(i)]
            at = pick.randrange(len(source))
            own[3:3] = source[at:at + 5]
        rows[i] = own
    want = set()
    for i, own in rows.items():
        for j in range(i):
            both = set(own) & set(rows[j])
            a, b = [list(zip(*[(n, x, len(x.split())) for n, x in enumerate(s) if x in both])) for s in (rows[j], own)]
            want |= {(i, b[0][k]) for k in lines.common_blocks(a, b, 5)} if both else set()
    got = {(i, n) for i, at in removed(spark, [(i, "\n".join(x)) for i, x in rows.items()]).items() for n in at}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_words_of_scripts_without_spaces_and_of_tabs(spark):
    chinese, thai, tabs = "今天天气很好我们去公园散步", "สวัสดีครับทุกคน", "one\ttwo\tthree\tfour\tfive\tsix"
    got = removed(spark, [(1, f"{chinese}\nx"), (2, f"y\n{chinese}"), (3, thai), (4, thai), (5, tabs), (6, tabs),
                          (7, "今天天"), (8, "今天天"), (9, "one  two   three"), (10, "one  two   three")])
    assert got[2] == [1] and got[4] == [0] and got[6] == [0]
    assert got[8] == got[10] == []  # three words


def test_a_callers_own_column_and_text_ids_stay(spark):
    rows = spark.createDataFrame([("a", f"{A}\nx", 1), ("b", f"y\n{A}", 2), (None, A, 3)], "doc_id string, text string, removed int")
    got = lines.drop_repeated_lines(rows)
    assert got.columns == ["doc_id", "text", "removed", "removed_"]
    assert {(r.doc_id, r.text, r.removed) for r in got.collect()} == {("a", f"{A}\nx", 1), ("b", "y", 2), (None, A, 3)}


def test_words_are_counted_alike_with_and_without_dense_scripts(spark):
    from pyspark.sql import functions as F
    lines_ = ["plain words here", "a\u00a0b\u2003c\u2028d\u202fe\u205ff", "dash \u2014 quote \u201cx\u201d", "\u4eca\u5929 ok", "\u0e2a\u0e27 x y",
              "\u1680a\u1680b", "tab\tand\x0bmore", "\u3000wide\u3000gap", "emoji \U0001f600 x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines_)], "i int, t string")
    got = df.select("i", F.get(lines._keyed(F.col("t")), F.lit(0))["words"].alias("n"),
                    F.regexp_count("t", F.lit(lines._WORDS)).alias("want")).collect()
    assert all(r.n == r.want for r in got)
