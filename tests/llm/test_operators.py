import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontaminate, imatch, neardup, pii, quality, sharding, tokenfiles, toxicity, urls
from folioscope.llm.common import Workspace
from folioscope.llm.components import components
from folioscope.llm.queries import URL_RULES, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def edited(n, seed=4):
    """A text, copies with more and more words changed, and others."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    out = [" ".join(base)]
    for k in range(n):
        w = list(base)
        for _ in range(k // 4):
            w[r.randrange(150)] = f"c{k}x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out + [" ".join(f"o{r.randrange(10**6)}" for _ in range(40)) for _ in range(20)]


def same(df, want):
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())))
    assert got == sorted(map(str, want))


def test_op1_against_all_pairs(spark):
    rows = list(enumerate(edited(60)))
    random.Random(1).shuffle(rows)
    want = [(k, n, c, k == c) for (k, _), (n, c) in zip(rows, brute.components(rows), strict=True)]
    same(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), want)


@pytest.mark.parametrize("percent", [80, 60])
def test_op1_at_other_percents(spark, percent):
    """Pairs of 60 shingles that share just enough of all: none is lost by signature or banding."""
    r, rows = random.Random(percent), []
    word = lambda: f"w{r.randrange(10**9)}"
    own = round(60 * (100 / percent - 1))  # shared / (shared + own) is percent
    for k in range(300):
        start, shared = [word() for _ in range(own)], [word() for _ in range(64)]
        rows += [(2 * k, " ".join(shared)), (2 * k + 1, " ".join(start + shared))]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    want = [c for pair in range(0, 600, 2) for _, c in brute.components(rows[pair : pair + 2], percent)]
    assert [got[k] for k in range(600)] == want == [k - k % 2 for k in range(600)]


def test_op1_plan():
    assert neardup.plan_for(85)[1:3] == (32, 5) and neardup.plan_for(80)[1:3] == (47, 5)
    for percent in range(3, 101):
        _, bands, per_band, _ = neardup.plan_for(percent)
        assert bands * per_band <= neardup.HASHES and (1 - (percent / 100) ** per_band) ** bands <= (1e-8 if percent > 3 else 1e-6)
    for percent in (-1, 0, 1, 101):
        with pytest.raises(ValueError):
            neardup.plan_for(percent)


def test_op1_without_one_middle(spark, monkeypatch):
    """A chain in one bucket whose ends aren't linked: found inside blocks, however small they are."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(24):
        w = list(base)
        for j in range(3 * k, 3 * k + 8):
            w[j] = f"e{k}"
        rows.append((k, " ".join(w)))
    want = [(k, n, c, k == c) for (k, _), (n, c) in zip(rows, brute.components(rows), strict=True)]
    same(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), want)


def test_op1_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = [(k, n, c, k == c) for (k, _), (n, c) in zip(rows, brute.components(rows), strict=True)]
    same(neardup.near_duplicates(odd), want)
    assert neardup.near_duplicates(none).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "test"), "x")
    assert {(q["node"], q["component"]) for q in got.where("node <> component").collect()} == {(x, find(x)) for x in parent if find(x) != x}


def texts(n=400):
    r = random.Random(3)
    parts = ["a", "b", "'s", "'t", "'re", "'ll", "'", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "!", "?", "\u00a0", "\x1c", "\x85", "<|endoftext|>", "日本", "🙂", "'S", " '", "the", " of", "aaaa", "....."]
    return ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(n)]


def test_op2_equals_the_library(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    some = texts() + ["".join(f"a{c}1{c} {c}\n " for c in points[i : i + 300]) for i in range(0, len(points), 40_000)]
    own = bpe.Encoder(tokenizer_path())
    for text, ids in zip(some, own.encode(some), strict=True):
        whole = library.encode(text, add_special_tokens=False)
        assert ids.tolist() == whole.ids, text
        assert own.decode(ids) == library.decode(whole.ids, skip_special_tokens=False)


def test_op2_every_code_point_is_classed_as_the_library_does(library):
    split = library.pre_tokenizer
    kinds = bpe.kinds()
    for c in [*range(0x3000), *range(0x3000, 0x110000, 997)]:
        if not 0xD800 <= c < 0xE000:
            cut = len(split.pre_tokenize_str(f"a{chr(c)}")) == 1
            assert cut == (kinds[c] == bpe.LETTER), hex(c)


def test_op2_small_blocks(monkeypatch, library):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "PIECE", 20)
    monkeypatch.setattr(bpe, "CACHE", 30)
    some = texts(100)
    own = bpe.Encoder(tokenizer_path())
    assert [x.tolist() for x in own.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_op2_odd_rows(odd, none, library):
    rows = odd.select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe.round_trip(odd, tokenizer_path()).collect()))) == sorted(map(str, want))
    assert bpe.round_trip(none, tokenizer_path()).count() == 0
    back = bpe.decode(bpe.encode(odd, tokenizer_path()), tokenizer_path())
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in rows)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://WWW.Example.com/en/1?x=/#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/x", "a.net", "/es/x", "net/es/", "block"),
        ("http://a.com?q=/", "a.com", "", None, "allow"),
        ("a.com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://y://z", "y:", "//z", None, "allow"),
    ],
)
def test_op3_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    got = urls.judge(pages, spark.createDataFrame([], "page_id long, bad boolean"), URL_RULES).first()
    assert tuple(got) == (1, host, path, rule, verdict)


def test_op3_mines_combinations(spark):
    """Neither token is bad alone; both together are."""
    rows, labels = [], []
    for k in range(400):
        casino, win = k % 2 == 0, k % 3 == 0
        rows.append((k, f"http://{'casino' if casino else 'books'}.org/{'win' if win else 'read'}/{k}"))
        labels.append((k, casino and win))
    pages = spark.createDataFrame(rows + [(900, "http://casino.org/win/7"), (901, "http://casino.org/read/7"), (902, None), (900, "http://casino.org/win/7")], "page_id long, url string")
    got = urls.judge(pages, spark.createDataFrame(labels, "page_id long, bad boolean"), [])
    seen = {(r["page_id"], r["verdict"]) for r in got.collect()}
    assert got.count() == 404 and all((k, "block" if bad else "allow") in seen for k, bad in labels)
    assert {(900, "block"), (901, "allow"), (902, "allow")} <= seen


def test_op4_files(spark, odd, none, library):
    folder = tokenfiles.new_folder(spark)
    manifest = tokenfiles.write(odd, tokenizer_path(), folder)
    got = tokenfiles.read(spark, folder, manifest).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
        fits = [library.encode(t, add_special_tokens=False).ids + [0] for k, t in rows if k == r["doc_id"]]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in fits]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [k for k, _ in rows]
    name = manifest[0][0]
    whole = list(tokenfiles.read_shuffled(folder, name, np.arange(manifest[0][2])))
    back = list(tokenfiles.read_shuffled(folder, name, np.arange(manifest[0][2])[::-1]))
    assert [(k, i.tolist()) for k, i in whole] == [(k, i.tolist()) for k, i in back[::-1]]
    assert tokenfiles.write(none, tokenizer_path(), folder) == [] and tokenfiles.read(spark, folder, []).count() == 0


def test_op4_notices_damage(tmp_path):
    record = tokenfiles.frame(tokenfiles.pack(None, np.array([1, 70_000]), 4))
    assert tokenfiles.unpack(record[12:-4])[0] is None and tokenfiles.unpack(record[12:-4])[1].tolist() == [1, 70_000]
    for k in range(len(record)):
        (tmp_path / "x").write_bytes(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :])
        with open(tmp_path / "x", "rb") as f, pytest.raises(ValueError, match="checksum"):
            tokenfiles.read_frame(f)


def test_op5_learns_pairs():
    """Two terms that are toxic only together: no linear score tells them."""
    r = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([r.integers(100, 4000, 20), [1] if k & 1 else [], [2] if k & 2 else []])).astype(np.int32) for k in range(4000)]
    labels = np.array([float(k & 3 == 3) for k in range(4000)])
    own = toxicity.Machine(np.array([1, 2]))
    own.fit(own.chosen(rows), labels)
    own.calibrate(own.chosen(rows), labels)
    assert ((own.scores(rows) >= 0.5) == (labels == 1)).mean() > 0.99


def test_op5_held_out_rows(spark):
    r = random.Random(1)
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 5 == 0
        w = [f"w{r.randrange(3000)}" for _ in range(60)] + (["Scum", "ÉGOUT"][k % 2 :][:1] if toxic else [])
        r.shuffle(w)
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows + [(5000, None), (None, "x"), (5001, "")], "doc_id long, text string")
    got = {q["doc_id"]: q for q in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [k for k in range(1500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] for k in held) and sum(q["held_out"] for q in got.values()) >= len(held)
    assert np.mean([got[k]["predicted"] == labels[k][1] for k in held]) > 0.98
    assert got[5000]["score"] == got[5001]["score"] and not got[5000]["predicted"]


def test_op5_odd_rows(spark, odd, none):
    no = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(odd, no).collect()
    assert len(got) == 15 and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in got)
    assert toxicity.score(none, no).count() == 0


def test_op6_texts_and_neighbours(spark, odd):
    rows = sorted({(r["doc_id"], r["text"] or "") for r in odd.where("doc_id <> 2 and doc_id is not null").collect()}, reverse=True)
    got = {r["doc_id"]: r for r in imatch.compare(odd.where("doc_id <> 2 and doc_id is not null")).collect()}
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(rows):
        n = len(t) // 3
        new = t[: len(t) - n] + rows[(i + 1) % len(rows)][1][:n]
        assert got[k]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[k]["n_chars"] == len(t)
        if new == t:
            assert got[k]["near_edited"] == 1.0
    assert got[7]["fingerprint"] == got[8]["fingerprint"] != got[1]["fingerprint"]


def test_op6_odd_rows(odd, none):
    got = imatch.compare(odd).collect()
    assert len(got) == 15 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert imatch.compare(none).count() == 0 and imatch.fingerprints(odd).count() == 15


def test_op6_lexicon_by_term(spark):
    """Far more terms than there are places: the band is told by each term's own count, and few others share its places."""
    docs = spark.range(400).select(F.expr("concat_ws(' ', transform(sequence(1, 1500), j -> 'u' || id || 'x' || j), 'p' || (id div 2), 'm' || (id % 20), 'everywhere')").alias("text"))
    own = imatch.frequent(docs)
    words = [f"p{k}" for k in range(200)] + [f"m{k}" for k in range(20)]
    want = {r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()}
    assert {r["term"] for r in own.collect()} == want
    terms = docs.select(F.explode(imatch.terms(F.col("text"))).alias("t")).distinct()
    let_in = terms.where(imatch.in_lexicon(F.col("t"), imatch.lexicon(own))).count()
    assert len(want) <= let_in <= len(want) + 600_000 * len(want) / 2**imatch.BITS * 2


def test_op6_reads_every_term_and_any_two_compare(spark):
    """Every changed word changes the fingerprint of a long text; texts of any lengths have the likeness of their words."""
    words = [f"w{k}" for k in range(1500)]
    rows = [words] + [words[:k] + [f"x{k}"] + words[k + 1 :] for k in range(0, 1500, 75)]
    rows += [words[:n] for n in (5, 12, 40, 300, 1000)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    got = [r[0] for r in imatch.fingerprints(df).orderBy("doc_id").select("fingerprint").collect()]
    assert len(set(got)) == len(rows)
    # each text's lexicon terms are those of two bits in three
    prints = df.select("doc_id", imatch.fingerprint(F.col("text"), F.array_repeat(F.lit(0x36DB6DB6DB6DB6DB).cast("long"), 1 << (imatch.BITS - 6))).alias("p"))
    pairs = prints.alias("a").crossJoin(prints.alias("b")).select(F.col("a.doc_id"), F.col("b.doc_id"), imatch.likeness(F.col("a.p"), F.col("b.p")))
    for a, b, near in pairs.collect():
        one, two = set(rows[a]), set(rows[b])
        assert abs(near - len(one & two) / len(one | two)) < 0.25


def test_op6_short_and_common(docs):
    """No text that shares a third of its words with its edited text loses all likeness to it."""
    text = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    ids = sorted(text, reverse=True)
    for r in imatch.compare(docs).select("doc_id", "near_edited").collect():
        t, then = text[r["doc_id"]], text[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        n = len(t) // 3
        one, two = (set(re.findall(r"[^\W_]+", x.lower())) for x in (t, t[: len(t) - n] + then[:n]))
        assert r["near_edited"] > 0 or len(one & two) < 0.3 * len(one | two)


def test_op6_likeness(docs):
    got = imatch.compare(docs).toPandas()
    assert got.near_edited.mean() > 0.3 and got.near_next.mean() < 0.05


def test_op7_against_labels(spark, docs):
    from paths import SF

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.selected == (got.quality == 1)).mean() > 0.95 and got.selected[got.quality == 1].mean() > 0.98
    kept = quality.select(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.classify(docs, labels).where("selected").count()


def test_op7_weights_are_sums_of_log_ratios():
    column = pa.array(["a b", None, "", "A B c"])
    total, target = np.ones(quality._BUCKETS, np.int64), np.zeros(quality._BUCKETS, np.int64)
    target[::2] = 5
    ratio = quality.log_ratios(total, target)
    got = quality.weights(ratio, column)
    assert np.isnan(got[1]) and np.isnan(got[2])
    for words, word_row, shapes, shape_row, _ in quality.features(column):
        for k in (0, 3):
            want = ratio[words[word_row == k]].sum() + ratio[shapes[shape_row == k] + (1 << quality.WORD_BITS)].sum()
            assert abs(got[k] - want) < 1e-9


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 5000])
def test_op7_top_k(spark, k):
    keys = spark.range(1000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("key"))
    every = sorted((-r["key"], r["doc_id"]) for r in keys.collect())
    last = every[min(k, 1000) - 1][0] if k else -1e9
    want = [x for x in every if x[0] <= last]  # those that tie with the k-th come too
    assert sorted((-r["key"], r["doc_id"]) for r in quality.top_k(keys.union(spark.createDataFrame([(5000, None)], keys.schema)), k).collect()) == want and len(want) >= min(k, 1000)


def test_op7_odd_rows(spark, odd, none):
    no = spark.createDataFrame([], "doc_id long, quality int")
    got = {(r["doc_id"], r["log_weight"] is None): r["selected"] for r in quality.classify(odd, no).collect()}
    assert not got[(4, True)] and not got[(5, True)] and got[(7, False)]
    assert quality.select(none, no).count() == 0


def items():
    r = random.Random(5)
    words = [f"q{k}" for k in range(40)]
    return [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate([30, 25, 12, 10, 9, 3, 1, 0])] + [(8, None), (9, "é-É z9 " * 8)]


def test_op8_against_all_windows(spark):
    r, bench = random.Random(6), items()
    rows = []
    for k in range(120):
        w = [f"q{r.randrange(40)}" for _ in range(r.randrange(60))]
        i = bench[k % 10][1] or ""
        part = i.split()
        a = r.randrange(len(part) + 1)
        rows.append((k, " ".join(w + part[a : a + r.randrange(16)] + w[:5]).replace("q1 ", "Q1, ")))
    want = brute.contamination([t for _, t in rows], bench)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(bench, "item_id long, text string")
    one = {q["doc_id"]: tuple(q)[1:5] for q in decontaminate.decontaminate(docs, bench).collect()}
    assert [one[k] for k, _ in rows] == want
    assert decontaminate.clean(docs, bench).count() == sum(w[1] == 0 for w in want)


def test_op8_full_sketch_and_shuffled_join(spark, monkeypatch):
    """A sketch too small to tell anything lets all through, and nothing is broadcast: the same rows."""
    monkeypatch.setattr(decontaminate.Workspace, "stash", lambda self, df, name, own=decontaminate.Workspace.stash: own(self, df, name).hint("merge"))
    bench = items()
    rows = [(k, " ".join((bench[k % 4][1] + " " + bench[(k + 1) % 4][1]).split()[k:])) for k in range(20)] + [(99, None)]
    want = brute.contamination([t for _, t in rows], bench)
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), bits=8)
    got = {q["doc_id"]: tuple(q)[1:5] for q in got.collect()}
    assert [got[k] for k, _ in rows] == want


def test_op8_odd_rows(spark, odd, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd, empty).where("contaminated").count() == 0
    bench = spark.createDataFrame([(None, "word word"), (2, "été")], "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = sorted(tuple(r)[1:4] for r in decontaminate.decontaminate(odd, bench).collect())
    assert got == sorted(w[:3] for w in brute.contamination([t for _, t in rows], [("", "word word"), (2, "été")]))
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.clean(none, bench).count() == 0


def test_op9_base_spans(spark):
    r = random.Random(8)
    parts = ["a@b.c", "x.y+z@m-1.example.com", "@", ".", "1.2.3.4", "10.20.30.256", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+", "+1 (555) 555-0100", "12", "é🙂", "(", ")", "7", "a"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randrange(14)))) for k in range(600)]
    got = {q["doc_id"]: q for q in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        base = brute.pii(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (t, base, got[k]["spans"])
        assert set(base) <= set(filter(None, got[k]["spans"].split(",")))
        assert [got[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(b.startswith(kind) for b in base) for kind in pii.KINDS]


def learned(spark, more):
    r = random.Random(9)
    rows = [(k, f"we rang +1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)} about {r.choice(['4111111111111111', '4111111111111112'])} now") for k in range(200)]
    return spark.createDataFrame(rows + more, "doc_id long, text string")


def test_op9_adds_what_a_longer_match_hid(spark):
    docs = learned(spark, [(900, "call +1 (555) 555-0100 190.1.2.3 today"), (901, "no 1234567890123456 here")])
    got = {q["doc_id"]: q["spans"] for q in pii.detect(docs).collect()}
    assert got[900] == "ip:23:32,phone:5:22" and got[901] == ""
    clean = {q["doc_id"]: q["text"] for q in pii.redact(docs).collect()}
    assert clean[900] == "call [PHONE] [IP] today" and clean[901] == "no 1234567890123456 here"


def test_op9_odd_rows(odd, none):
    assert pii.detect(odd).count() == 15 and pii.detect(none).count() == 0
    base = {q["doc_id"]: q["base_sha256"] for q in pii.detect(odd).collect()}
    assert all(base[r["doc_id"]] == hashlib.sha256(",".join(brute.pii(r["text"])).encode()).hexdigest() for r in odd.where("doc_id is not null").collect())
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.count() == 15
    # the trees have no phone to learn from: the number that a failing match holds stays
    assert {r["text"] for r in clean.where("doc_id is null and text like 'Mail%'").collect()} == {"Mail me: [EMAIL] or +1 (555) 555-0199 [IP] now"}


def test_op9_long_runs(spark):
    text = "1" * 100_000 + " " + "a" * 100_000 + " " + "1." * 20_000 + "+" + "1 " * 20_000
    assert pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["n_email"] == 0


@pytest.mark.parametrize("n", [0, 1, 15, 16, 1003])
def test_op10_exact_sizes(spark, n):
    got = sharding.shuffle(spark.range(n).withColumnRenamed("id", "doc_id"), 16, seed=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    assert sorted(r["doc_id"] for r in got) == list(range(n))
    assert sorted(map(len, by.values()), reverse=True) == [x for x in sharding.equal_sizes(n, 16) if x]
    assert all(sorted(s for s, _ in rows) == list(range(len(rows))) for rows in by.values())


def test_op10_is_uniform(spark):
    """Shards don't follow the order of rows: neighbours share one about as often as any two."""
    rows = sharding.shuffle(spark.range(4000).withColumnRenamed("id", "doc_id"), 8, seed=1).toPandas().sort_values("doc_id")
    together = (rows.shard.values[1:] == rows.shard.values[:-1]).mean()
    assert abs(together - 1 / 8) < 0.03
    assert abs(np.corrcoef(rows.doc_id, rows.slot)[0, 1]) < 0.08


def test_op10_hypergeometric_law():
    draw = random.Random(0)
    got = [sharding.hypergeometric(draw, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(got) - 6) < 0.05 and abs(np.var(got) - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    assert sharding.hypergeometric(draw, 5, 0, 3) == 3 and sharding.hypergeometric(draw, 0, 5, 3) == 0
    assert abs(sharding.hypergeometric(draw, 10**10, 10**10, 10**6) - 500_000) < 5_000


def test_op10_odd_rows(odd):
    got = sharding.shuffle(odd, 4)
    assert got.count() == 15 and set(got.columns) == set(odd.columns)
