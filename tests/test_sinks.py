from pyspark.sql import functions as F
from test_container import sample

from folioscope.__main__ import main
from folioscope.sources import contents


def test_contents_file(spark, tmp_path):
    (tmp_path / "a.cnt").write_text("; comment\r\n:Title A book\n:Base a.hlp>main\n1 Intro\n2 Start=ctx_start\n2 More = ctx>win@b.hlp\n1 End=ctx_end\n:Include b.cnt\nnonsense\n")
    got = contents.scan(spark, str(tmp_path))
    rows = [tuple(r)[2:] for r in got.orderBy("ord").collect()]
    assert rows == [
        ("title", None, "A book", None),
        ("base", None, "a.hlp>main", None),
        ("book", 0, "Intro", None),
        ("topic", 1, "Start", "ctx_start"),
        ("topic", 1, "More", "ctx>win@b.hlp"),
        ("topic", 0, "End", "ctx_end"),
        ("include", None, "b.cnt", None),
        ("error", None, "nonsense", None),
    ]
    assert [r["parent"] for r in contents.tree(got).orderBy("ord").collect()] == [None, 3, 3, None]


def test_contents_lines(spark):
    titles = spark.createDataFrame([("f", 0, "One"), ("f", 9, "Two")], "file string, topic_offset long, title string")
    names = spark.createDataFrame([("f", 0, "ctx_b"), ("f", 0, "ctx_a")], "file string, topic_offset long, name string")
    windows = spark.createDataFrame([("f", 0, 2)], "file string, topic_offset long, window long")
    assert [r["line"] for r in contents.write_lines(titles, names, windows).collect()] == ["1 One=ctx_a>2"]


def test_main(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.hlp").write_bytes(sample())
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--format", "json", "--html"]) == 0
    page = spark.read.parquet(str(tmp_path / "out/html")).first()["html"]
    assert '<a href="#topic-0">First</a>' in page and "See contents now<br><br>end" in page
    files = spark.read.json(str(tmp_path / "out/file"))
    assert files.where("name = '|CF1'").select(F.unbase64("content")).first()[0] == b"A()\0\0B()\0"
