import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.functions.text import context_hash, html_escape, reverse_hash, rtf_escape
from folioscope.operators import relational as R
from folioscope.operators import search as S

VECTORS = {"": 1, "A": 0x11, "INDEX": 0x053D24A6, "CONTENTS": 0x25F4558A, "HELP": 0x001DBA49, "TEST": 0x002C4A5E}


def test_context_hash(spark):
    got = spark.createDataFrame([(k,) for k in VECTORS], "n string").select("n", context_hash(F.col("n")).alias("h")).collect()
    assert {r["n"]: r["h"] for r in got} == VECTORS


@pytest.mark.parametrize(("h", "name"), [(-1, "21KSYK4"), (0, "21KSYK5"), (1, "")])
def test_reverse_hash(h, name):
    assert reverse_hash(h) == name


def test_reverse_hash_is_a_preimage(spark):
    names = [(h, reverse_hash(h)) for h in (2, 77, 123456789, 0x25F4558A, 4294967294)]
    got = spark.createDataFrame(names, "h long, n string").where(~F.startswith("n", F.lit("CTX_")))
    assert got.where(context_hash(F.col("n")) != F.col("h")).count() == 0


def test_escapes(spark):
    r = spark.createDataFrame([("<a & 'b'> {\\}",)], "x string").select(html_escape(F.col("x")), rtf_escape(F.col("x"))).first()
    assert r[0] == "&lt;a &amp; &#x27;b&#x27;&gt; {\\}" and r[1] == "<a & 'b'> \\{\\\\\\}"


def test_asof_crosses_buckets(spark):
    starts = spark.createDataFrame([("f", 10, 1), ("f", 500, 2), ("g", 0, 3)], "f string, s long, t long")
    probes = spark.createDataFrame([("f", 9), ("f", 10), ("f", 499), ("f", 10_000), ("g", 7), ("h", 7)], "f string, p long")
    got = R.asof_join(probes, starts, ["f"], "p", "s", ["t"], width=16).collect()
    assert {(r["f"], r["p"]): r["t"] for r in got} == {("f", 9): None, ("f", 10): 1, ("f", 499): 1, ("f", 10_000): 2, ("g", 7): 3, ("h", 7): None}


def test_running_total_crosses_buckets(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), "id", F.lit(3).alias("v"))
    got = R.running_total(rows, ["k"], "id", "v", "t", width=64)
    assert got.where(F.col("t") != F.floor(F.col("id") / 2) * 3).count() == 0


def test_targets(spark):
    t = spark.createDataFrame([("macro:x()",), ("topic:TOPIC12",), ("popup:0A1b",), ("ctx>win@f.hlp",), ("topic_offset:9",), ("idh_x",)], "t string")
    assert [r[0] for r in t.select(S.resolved(F.col("t"))).collect()] == ["macro", "topic", "hash", "external", "offset", "context"]
    parts = t.where("t like 'ctx%'").select(*S.split_reference(F.col("t"))).first()
    assert tuple(parts) == ("ctx", "win", "f.hlp")


def test_neighbours_cross_buckets(spark):
    rows = [("a", k, k * 10) for k in (1, 2, 40, 41, 300)] + [("b", 7, None)]
    got = {(r["k"], r["o"]): (r["prev"], r["next"]) for r in R.neighbours(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], "o", "v", width=16).collect()}
    assert got == {("a", 1): (None, 20), ("a", 2): (10, 400), ("a", 40): (20, 410), ("a", 41): (400, 3000), ("a", 300): (410, None), ("b", 7): (None, None)}


def test_fold(spark):
    words = ["STRASSE Straße", "ΣΟΦΟΣ σοφος", "ﬁn FIN", "Été"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.fold(F.col("w"))).collect()
    assert [r[0] for r in got] == [w.casefold() for w in words]


def test_names_from_titles(spark):
    rows = [(h, t) for t, n in (("Print Dialog", "idh_PrintDialog"), ("A & B", "A_B"), ("", "x")) for h in [text.hash_of(n)]]
    got = {r["t"]: r["name"] for r in text.names_from_titles(spark.createDataFrame(rows, "h long, t string"), "h", "t", "name").collect()}
    assert got == {"Print Dialog": "idh_PrintDialog", "A & B": "A_B", "": None}


def test_hash_of_parts(spark):
    names = [("idh_", "Print"), ("", "x"), ("a", ""), ("Ünï©", "€_.!0")]
    got = spark.createDataFrame(names, "a string, b string").select("a", "b", text.hash_and_power(F.col("a")).alias("l"), text.hash_and_power(F.col("b")).alias("r"), context_hash(F.concat("a", "b")).alias("h")).collect()
    assert all(r["h"] == text.hash_of(r["a"] + r["b"]) == (r["l"]["h"] * r["r"]["p"] + r["r"]["h"]) % 2**32 for r in got)


def test_numbered(spark):
    got = R.numbered(spark.range(500).select((F.col("id") * 7 % 500).alias("v")), ["v"], "n").collect()
    assert all(r["v"] == r["n"] for r in got) and len(got) == 500
