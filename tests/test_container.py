import struct

import pytest
from containers import container, display, heading, squeeze, system, topic, tree

from folioscope.sources import codec
from folioscope.sources.container import Container, scan, tables, topic_texts


def rows(data, kind=None):
    got = Container("x.hlp", data).records()
    return [r for r in got if kind is None or r[1] == kind]


@pytest.mark.parametrize("data", [b"", b"a", b"abcabcabcabcabcabcabc" * 9, bytes(range(256)) * 3, b"\0" * 5000])
def test_lz77_round_trip(data):
    assert codec.lz77(squeeze(data)) == data


def test_lz77_stops_at_its_limit():
    assert len(codec.lz77(squeeze(b"ab" * 4000), 100)) == 100


def test_phrases_and_runs():
    phrases = [b"help", b"topic"]
    assert codec.phrases_expand(b"a \x01\x00x\x01\x03", phrases) == b"a helpxtopic "
    assert codec.hall_expand(bytes([0, 2, 0x07, 0x0F, 0x03]) + b"z", phrases) == b"helptopic \0z"
    assert codec.run_length(b"\x03a\x82xy") == b"aaaxy"
    assert codec.picture_bytes(squeeze(b"\x03a\x82xy"), 3) == b"aaaxy"


def test_compressed_numbers():
    r = codec.Reader(bytes([20, 21, 2]))
    assert (r.unsigned_word(), r.unsigned_word()) == (10, 10 + 256)
    r = codec.Reader(bytes([128]) + struct.pack("<H", (5 + 16384) * 2))
    assert (r.signed_word(), r.signed_long()) == (0, 5)
    with pytest.raises(EOFError):
        codec.Reader(b"\1").take("i")


def test_phrase_lengths():
    # bits 0: lengths 1 + unary steps, then one more bit
    assert codec.phrase_lengths(bytes([0b1011, 0, 0, 0]), 1, 0) == [4]
    with pytest.raises(EOFError):
        codec.phrase_lengths(b"", 1, 2)


@pytest.mark.parametrize("pages", [1, 3])
def test_tree_keeps_order(pages):
    from folioscope.sources.container import entries

    made = [b"k%d\0" % i + struct.pack("<i", i) for i in range(9)]
    assert [e[1] for e in entries(tree(made, pages), "z", "i")] == list(range(9))


def sample(compress=False):
    link = b"\xe3" + struct.pack("<I", 0x25F4558A)
    text = display([b"\x80" + struct.pack("<h", 1), link, b"\x89", b"\x82"], [b"", b"See ", b"contents", b" now", b"end"])
    records = [heading(b"First", [b"CopyTopic()"]), text, heading(b"Second", forward=-1), display([], [b"more"])]
    keys = [b"alpha\0" + struct.pack("<hi", 2, 0), b"beta\0" + struct.pack("<hi", 1, 8)]
    return container(
        {
            "|SYSTEM": system([(1, b"\x83w\x83\x8b\x83v\0"), (9, struct.pack("<H", 0x0411)), (11, b"\x80")], flags=4 if compress else 0),
            "|TOPIC": topic(records, compress),
            "|CONTEXT": tree([struct.pack("<iI", 0x25F4558A, 0), struct.pack("<iI", -2, 40)]),
            "|KWBTREE": tree(keys),
            "|KWDATA": struct.pack("<3i", 0, 40, -1),
            "|KWMAP": struct.pack("<HiH", 1, 0, 0),
            "|TOMAP": struct.pack("<2I", 12, 99),
            "|CF1": b"A()\0\0B()\0",
            "x.GRP": struct.pack("<3I3I", 0x000A3333, 0, 9, 1, 5, 1),
            "|Rose": b"not a tree",
        }
    )


@pytest.mark.parametrize("compress", [False, True])
def test_whole_container(compress):
    data = sample(compress)
    assert [r[7] for r in rows(data, "file") if r[3] == "|CF1"] == [b"A()\0\0B()\0"]
    assert rows(data, "system_record")[0][6] == "ヘルプ"  # the title comes before the code page
    assert [r[3] for r in rows(data, "topic")] == ["First", "Second"]
    assert [(r[3], r[6]) for r in rows(data, "span")] == [(None, "See "), ("topic:25F4558A", "contents"), (None, " now"), (None, "\n\n"), (None, "end"), (None, "more")]
    assert [r[3] for r in rows(data, "link")] == ["topic:25F4558A"]
    assert [(r[4], r[5]) for r in rows(data, "context")] == [(0x25F4558A, 0), (0xFFFFFFFE, 40)]
    assert [(r[6], r[4], r[5]) for r in rows(data, "keyword")] == [("alpha", 2, 0), ("beta", 1, 8)]
    assert [r[5] for r in rows(data, "posting")] == [0, 40, -1]
    assert [r[4] for r in rows(data, "topic_number")] == [16, 17]
    assert [r[6] for r in rows(data, "config_macro")] == ["A()", "B()"]
    assert [(r[3], r[4], r[5]) for r in rows(data, "group")] == [("1", 1, 5)]
    assert [r[3] for r in rows(data, "error")] == ["|Rose"]


@pytest.mark.parametrize("cut", range(0, 4000, 97))
def test_truncated_input_is_a_row(cut):
    got = rows(sample()[:cut])
    assert all(len(r) == 8 for r in got) and got


def test_scan_and_views(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.hlp").write_bytes(sample())
    (tmp_path / "b.HLP").write_bytes(sample(True))
    (tmp_path / "bad.hlp").write_bytes(b"plain text")
    found = scan(spark, str(tmp_path))
    views = tables(found)
    assert views["topic"].count() == 4
    assert sorted(r["text"] for r in topic_texts(found).collect()) == ["See contents now\n\nend"] * 2 + ["more"] * 2
    assert views["error"].where("component = 'header'").count() == 1
    # keyword to topics: a slice of its postings
    k, p = views["keyword"].alias("k"), views["posting"].alias("p")
    joined = k.join(p, (k["file"] == p["file"]) & (k["type"] == p["type"]) & (p["data_offset"] >= k["data_offset"]) & (p["data_offset"] < k["data_offset"] + 4 * k["count"]))
    assert joined.where("keyword = 'alpha'").count() == 4


def test_stream(spark, tmp_path):
    from folioscope.streaming.ingest import stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.hlp").write_bytes(sample())
    q = stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from arrived where kind = 'topic'").count() == 2


def blocks(stream, size, lengths=None):
    """A topic stream cut into blocks of ``size`` bytes with their headers."""
    room = size - 12
    return b"".join(struct.pack("<iii", -1, 12, -1) + stream[a : a + room].ljust(room if a + room < len(stream) else 0, b"\0") for a in range(0, len(stream), room))


def linked(records, place):
    """Links laid one after another; ``place``: the position (or, before 3.1, the step) that leads to a byte of the stream."""
    out = b""
    for k, (kind, one, two, _) in enumerate(records):
        size = 21 + len(one) + len(two)
        after = place(len(out), len(out) + size) if k + 1 < len(records) else -1
        out += struct.pack("<5iB", size, len(two), -1, after, 21 + len(one), kind) + one + two
    return out


def wide(n):
    return display([], [b"w" * n])


@pytest.mark.parametrize(("minor", "flags", "size"), [(15, 0, 2048), (21, 0, 4096), (21, 8, 2048)])
def test_links_cross_blocks(minor, flags, size):
    """Positions as the format has them: 2,048 a block before 3.1, with steps that count headers; then 0x4000 a block."""
    records = [heading(b"One"), wide(1500), heading(b"Two"), wide(1500), heading(b"Three"), wide(900)]
    room = size - 12
    spot = lambda at: at // room * (2048 if minor < 16 else 0x4000) + at % room + 12
    place = (lambda a, b: spot(b) - spot(a)) if minor < 16 else (lambda a, b: spot(b))
    stream = linked(records, place)
    body = blocks(stream, size)
    if flags == 8:  # packed blocks: each holds as much of the stream as was squeezed into it
        body = b""
        half = 1700
        spot = lambda at: at // half * 0x4000 + at % half + 12
        stream = linked(records, lambda a, b: spot(b))
        for a in range(0, len(stream), half):
            body += (struct.pack("<iii", -1, 12, -1) + squeeze(stream[a : a + half])).ljust(size, b"\0") if a + half < len(stream) else struct.pack("<iii", -1, 12, -1) + squeeze(stream[a : a + half])
    got = rows(container({"|SYSTEM": struct.pack("<HHHlH", 0x036C, minor, 1, 0, flags) + (b"Old\0" if minor < 16 else b""), "|TOPIC": body}), "topic")
    assert [r[3] for r in got] == ["One", "Two", "Three"]


def test_long_numbers_by_hand():
    """A long number of four bytes: low bit 1, 31 bits less 0x40000000."""
    r = codec.Reader(struct.pack("<I", ((70_000 + 0x40000000) << 1 | 1) & 0xFFFFFFFF))
    assert r.signed_long() == 70_000


def test_window_records(spark):
    from folioscope.sources.system import windows

    body = struct.pack("<H10s9s51s5hII", 0x0001 | 0x0002 | 0x0004 | 0x0008 | 0x0010 | 0x0020 | 0x0040, b"secondary\0", b"main\0", b"A window\0", 653, 102, 360, -600, 0, 0, 0)
    data = container({"|SYSTEM": system([(6, body), (1, b"x\0"), (6, body[:40])])})
    from folioscope.sources.container import decode

    files = spark.createDataFrame([("f", data)], "path string, content binary")
    got = windows(tables(decode(files))["system_record"]).orderBy("number").collect()
    assert tuple(got[0])[1:10] == (0, "secondary", "main", "A window", 653, 102, 360, -600, None)
    assert got[1]["number"] == 1 and got[1]["x"] is None and got[1]["name"] == "main"


def test_resolution_of_odd_targets(spark):
    from folioscope.operators.resolve import resolve

    topics = spark.createDataFrame([("f", 0, 0), ("f", 1, 500)], "file string, ord long, topic_offset long")
    contexts = spark.createDataFrame([("f", 0x11, 500)], "file string, hash long, topic_offset long")
    index = spark.createDataFrame([("f", "Straße", 0), ("f", "two", 1)], "file string, keyword string, ord long")
    asked = [None, "", "topic:TOPIC9", "topic:TOPICx", "popup:11", "topic:1F4", "topic:zz", "macro:JumpID()", 'macro:PopupID("", "A")', "macro:jumpcontext(7)", 'macro:ALink("STRASSE; two")', 'macro:KLink("two")', "macro:KLink(\"x\")", "macro:broken(", "window:2", "popup:11"]
    got = resolve(spark.createDataFrame([("f", t, 1) for t in asked], "file string, target string, _n long").drop("_n"), topics, contexts, index)
    seen = {r["target"]: (r["kind"], r["ord"]) for r in got.collect()}
    assert got.count() == len(asked)
    want = {None: ("unresolved", None), "": ("unresolved", None), "topic:TOPIC9": ("unresolved", None), "topic:TOPICx": ("unresolved", None), "popup:11": ("popup", 1), "topic:1F4": ("topic", 1), "topic:zz": ("unresolved", None), "macro:JumpID()": ("macro", None)}
    want |= {'macro:PopupID("", "A")': ("popup", 1), "macro:jumpcontext(7)": ("external", None), 'macro:ALink("STRASSE; two")': ("choice", 0), 'macro:KLink("two")': ("topic", 1), 'macro:KLink("x")': ("unresolved", None), "macro:broken(": ("macro", None), "window:2": ("external", None)}
    assert seen == want
