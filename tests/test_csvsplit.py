"""CSV files read by byte ranges, against the reader that takes a file as one."""

import random

import pytest

from versarium.sources import csvsplit as C
from versarium.sources import readers as R


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def field(rng):
    kind = rng.randrange(7)
    if kind == 0:
        return ""
    if kind == 1:
        return '""'
    if kind == 2:
        return '"' + "\n".join('Zeile ""eins""' + " lang" * rng.randrange(30) for _ in range(rng.randrange(1, 9))) + '"'
    if kind == 3:
        return '"a,b ""c"""'
    return "wort" * rng.randrange(1, 5) + " über"


def test_split_reader_equals_the_whole_file_reader(spark, tmp_path, small_ranges):
    rng = random.Random(11)
    schema = "id int, a string, b string"
    for name in "xyz":
        rows = [f"{i},{field(rng)},{field(rng)}" for i in range(60)]
        (tmp_path / f"{name}.csv").write_text("id,a,b\n" + "\n".join(rows) + ("\n" if name == "x" else ""), encoding="utf-8")
    (tmp_path / "empty.csv").write_text("id,a,b\n")
    (tmp_path / "long.csv").write_text('id,a,b\n1,"' + "\n".join(["lange Zeile ohne Ende"] * 90) + '",x\n\n2,y,z\n')
    path = str(tmp_path / "*.csv")
    got = C.csv_scan_split(spark, path, schema)
    assert got.where("_bad_record is not null").count() == 0
    key = lambda r: (r[0], repr(r[1:]))
    assert sorted(map(tuple, got.drop("_bad_record").collect()), key=key) == sorted(map(tuple, R.csv_scan(spark, path, schema).collect()), key=key)
    lines = C._lines(spark, path)
    assert lines.select("file", "start").distinct().count() > 100 and lines.rdd.getNumPartitions() > 20


def test_bad_rows_and_headers(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_bytes('\ufeffid,t\r\n1,"eins\r\nzwei"\r\nx,drei\r\n4,vier'.encode())
    got = sorted((tuple(r) for r in C.csv_scan_split(spark, str(tmp_path / "a.csv"), "id int, t string").collect()), key=repr)
    assert [r[0] for r in got] == [1, 4, None]
    assert got[1] == (4, "vier", None) and got[2][1:] == ("drei", "x,drei") and got[0][1].split() == ["eins", "zwei"]
    (tmp_path / "b.csv").write_text("id,other\n1,x\n")
    with pytest.raises(Exception, match="header differs"):
        C.csv_scan_split(spark, str(tmp_path / "b.csv"), "id int, t string").collect()
