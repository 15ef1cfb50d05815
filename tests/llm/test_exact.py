"""Cases where a cut, a prefix or a hash that can be fooled would show."""

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest
from paths import SF
from pyspark.sql import functions as F

from folioscope.llm import bpe, common, decontaminate, imatch, neardup, pii, quality, queries, sharding, toxicity, urls
from folioscope.llm.common import Workspace
from folioscope.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def thue_morse(n, letters="ab"):
    return "".join(letters[k.bit_count() & 1] for k in range(n))


def twins():
    """Words that a polynomial modulo a power of two can't tell apart."""
    return [t for n in (1024, 2048, 4096) for t in (thue_morse(n), thue_morse(n, "ba"))]


def test_op1_thue_morse(spark):
    rows = list(enumerate(twins() + [f"{w} and more words follow it" for w in twins()]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == brute.components(rows) == [(n, k) for k, (n, _) in enumerate(brute.components(rows))]


def test_op2_thue_morse_and_equal_hashes(monkeypatch):
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = twins() + ["a b c d <|endoftext|> e <|endoftext|>"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in bpe.Encoder(tokenizer_path()).encode(texts)] == want
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    assert [x.tolist() for x in bpe.Encoder(tokenizer_path()).encode(texts)] == want


def test_op8_thue_morse(spark, monkeypatch):
    bench = list(enumerate(twins()[::2]))
    texts = [f"x {t} y" for t in twins()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {q["doc_id"]: tuple(q)[1:5] for q in decontaminate.decontaminate(docs, items).collect()}
    assert [got[k] for k in range(len(texts))] == brute.contamination(texts, bench)


def test_op1_one_stranger_among_copies(spark):
    """Ten thousand linked nodes and one that isn't, in a bucket: rows follow the blocks, not their product with the nodes."""
    n, plan = 10_000, neardup.plan_for(85)
    sigs = spark.range(n + 1).select(F.col("id").alias("node"), F.unhex(F.repeat(F.lit("07"), neardup.HASHES)).alias("sig"), F.unhex(F.repeat(F.lit("05"), 8 * plan.bands)).alias("keys"))
    bucket = 0x0505050505050505
    labelled = spark.range(n + 1).select(F.lit(bucket).alias("bucket"), F.lit(0).cast("long").alias("pivot"), F.col("id").alias("node"), F.when(F.col("id") == n, F.col("id")).otherwise(0).alias("label"))
    pairs = neardup.block_pairs(labelled, sigs)
    assert pairs.count() == -(-(n + 1) // neardup.BLOCK)
    assert pairs.select(F.sum(F.size("whole"))).first()[0] == n + 1 and pairs.select(F.sum(F.size("part"))).first()[0] <= 21
    got = pairs.mapInArrow(lambda b: neardup._within(plan, b), "u long, v long").collect()
    assert sorted(map(tuple, got)) == [(n, k) for k in range(1, n)]  # the pivot has been tried


def test_op1_recall_of_every_hundredth(spark, docs):
    """Rows whose id is divisible by 100 against all rows: no link of theirs is missed."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = {k: brute.shingles(t) for k, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    for q in (k for k in sets if k % 100 == 0):
        for k, s in sets.items():
            if s and sets[q] and 100 * len(s & sets[q]) >= 85 * len(s | sets[q]):
                assert got[q] == got[k]


def test_op3_few_labels_teach_nothing(spark):
    """98 labelled urls, a quarter bad at random: no rule rests on a handful of rows."""
    r = random.Random(4)
    rows = [(k, f"http://h{r.randrange(60)}.org/en/{k}") for k in range(300)]
    labels = [(k, r.random() < 0.25) for k in range(98)]
    pages, known = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")
    assert urls.judge(pages, known, []).where("verdict = 'block'").count() == 0


def test_op3_rules_must_hold_again(spark):
    """A host that is bad wherever it is mined from, and good in the held rows, isn't blocked."""
    base = [(k, f"http://{'bad' if k % 4 == 0 else 'fine'}.org/{k}") for k in range(600)]
    df = spark.createDataFrame(base, "id long, url string").withColumn("held", F.pmod(F.xxhash64(F.lit(4), "id", "url"), F.lit(3)) == 0)
    true = df.withColumn("bad", F.contains("url", F.lit("bad.org")))
    assert {r["token"] for r in urls.mine(true.select("id", "url", "bad")).collect()} >= {"bad"}
    false = df.withColumn("bad", F.contains("url", F.lit("bad.org")) & ~F.col("held"))
    assert urls.mine(false.select("id", "url", "bad")).count() == 0


def test_op3_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://a.com/" + "x/" * 50_000), (5, "http://a.com/"), (5, "http://a.com/"), (None, "http://a.net/es/")]
    pages = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], "page_id long, url string, host int, rule int, verdict int, blocked int")
    labels = spark.createDataFrame([(4, True), (5, None), (None, True)], "page_id long, bad boolean")
    got = sorted(map(str, (tuple(r) for r in urls.judge(pages, labels, queries.URL_RULES).collect())))
    want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.com", "/" + "x/" * 50_000, "com/", "allow")]
    want += [(5, "a.com", "/", "com/", "allow")] * 2 + [(None, "a.net", "/es/", "net/es/", "block")]
    assert got == sorted(map(str, want))
    assert urls.judge(pages.where("false"), labels, queries.URL_RULES).count() == 0


def test_op5_every_term_of_a_long_text_teaches(spark):
    """Toxic texts of 30,000 words: the one telling word counts wherever its hash sorts."""
    r = random.Random(2)
    for word in ("scum", "filth", "vermin"):
        rows = []
        for k in range(60):
            w = [f"w{r.randrange(10**7)}" for _ in range(30_000 if k % 3 == 0 else 30)] + ([word] if k % 3 == 0 else [])
            rows.append((k, " ".join(w), int(k % 3 == 0)))
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
        space = Workspace(spark, "test")
        terms = space.stash(df.withColumns({"held": F.lit(False), "luck": F.lit(0).cast("long")}).select("toxic", "held", "luck", "text").mapInArrow(toxicity._termed, "toxic int, held boolean, luck long, terms array<int>"), "t")
        own = next(toxicity.terms(spark.createDataFrame([(word,)], "t string").toArrow().column(0)))
        known, g = toxicity.evidence(terms, 20, 40)
        assert known[g.argmax()] == int(own[0]) and (g > g.max() / 2).sum() == 1
        assert terms.agg(F.max(F.size("terms"))).first()[0] > 29_000


def test_op5_brute_force(spark):
    """The registered query's scores are the machine's, of terms found by a plain loop."""
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, SF, "documents", "doc_id", "text").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, SF, "labels", "doc_id", "toxic").collect()}
    assert got.keys() == docs.keys()
    for k, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [k for k in labels if zlib.crc32(str(k).encode()) % 5 == 0 and k in got]
    assert np.mean([got[k]["predicted"] == labels[k] for k in held]) > 0.9
    machine = toxicity.train(common.table(spark, SF, "documents", "doc_id", "text"), spark.createDataFrame([(k, t) for k, t in labels.items() if zlib.crc32(str(k).encode()) % 5], "doc_id long, toxic int"))
    for k in list(docs)[:60]:
        terms = next(toxicity.terms(spark_array(docs[k])))
        x = machine.place[terms]
        x = x[x >= 0]
        y = machine.bias + machine.w[x].sum() + sum(float(machine.v[i] @ machine.v[j]) for n, i in enumerate(x) for j in x[:n])
        assert abs(1 / (1 + np.exp(-np.clip(machine.slope * (y - machine.offset), -30, 30))) - got[k]["score"]) < 1e-4


def spark_array(text):
    import pyarrow as pa

    return pa.array([text], pa.string())


def test_op6_shared_terms_of_unlike_numbers(spark):
    """250 of 600 terms are shared: a likeness as near to theirs as 260 of 600 has."""
    words = [f"w{k}" for k in range(600)]
    kept = F.array_repeat(F.lit(0x36DB6DB6DB6DB6DB).cast("long"), 1 << (imatch.BITS - 6))
    rows = [(k, " ".join(words[:k])) for k in (250, 260, 600)]
    prints = spark.createDataFrame(rows, "n long, text string").select("n", imatch.fingerprint(F.col("text"), kept).alias("p"))
    one, other = prints.alias("a"), prints.where("n = 600").alias("b")
    got = {r["n"]: r["x"] for r in one.crossJoin(other).select(F.col("a.n"), imatch.likeness(F.col("a.p"), F.col("b.p")).alias("x")).collect()}
    assert all(abs(got[n] - n / 600) < 0.25 and got[n] > 0 for n in (250, 260)) and got[600] == 1


def test_op6_brute_force(spark):
    """The registered query against plain Python: order, edited texts, lexicon, subsets and likeness."""
    docs = {r["doc_id"]: r["text"] or "" for r in common.table(spark, SF, "documents", "doc_id", "text").collect()}
    ids = sorted(docs, reverse=True)
    split = lambda t: list(dict.fromkeys(w for w in re.split(r"[^\w]+|_", t.lower()) if w))
    edited = {}
    for i, k in enumerate(ids):
        n = len(docs[k]) // 3
        edited[k] = docs[k][: len(docs[k]) - n] + docs[ids[(i + 1) % len(ids)]][:n]
    words = {w for t in [*docs.values(), *edited.values()] for w in split(t)} | {t for t in [*docs.values(), *edited.values()] if not split(t)}
    code = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    df = {}
    for t in docs.values():
        for w in split(t):
            df[w] = df.get(w, 0) + 1
    low, high = max(2, int(len(docs) * imatch.RARE)), max(2, int(len(docs) * imatch.COMMON))
    slot = lambda w: (code[w] & (2**64 - 1)) >> (64 - imatch.BITS)
    held = {slot(w) for w, n in df.items() if low <= n <= high}
    inside = {w for w in code if slot(w) in held}

    def subsets(items, kind):
        out = {}
        for w in items:
            place = (code[w] & (2**64 - 1)) >> (64 - imatch.TOP)
            for level in range(imatch.BASE, imatch.TOP + 1):
                if place % (1 << level) < 1 << imatch.BASE:
                    out.setdefault((level, place % (1 << imatch.BASE), kind), set()).add(w)
        return out

    def shape(t):
        every = split(t) or [t]
        kept = [w for w in every if w in inside]
        rest = [w for w in every if w not in set(kept)] if len(kept) < 2 * imatch.FEW else []
        return len(kept), len(every), subsets(kept, 0), subsets(rest, 1)

    def likeness(a, b):
        if a == b:
            return 1.0
        few = min(a[0], b[0]) < imatch.FEW and max(a[0], b[0]) < 2 * imatch.FEW
        most = max(a[1], b[1]) if few else max(a[0], b[0])
        level = max(imatch.BASE, int(np.ceil(np.log2(most))) + 1)
        one, two = ({s: v for part in x[2 : 4 if few else 3] for s, v in part.items() if s[0] == level} for x in (a, b))
        return sum(one.get(s) == two.get(s) for s in one.keys() | two.keys()) / max(1, len(one.keys() | two.keys()))

    shapes, changed = {k: shape(t) for k, t in docs.items()}, {k: shape(t) for k, t in edited.items()}
    prints = {}
    for r in queries.op6_imatch(spark, SF).collect():
        k = r["doc_id"]
        after = ids[(ids.index(k) + 1) % len(ids)]
        assert r["edited_sha256"] == hashlib.sha256(edited[k].encode()).hexdigest() and r["n_chars"] == len(docs[k])
        for field, want in (("fingerprint", shapes[k]), ("edited_fingerprint", changed[k])):
            kept, every, _, one, two = (r[field] + ":" * (4 - r[field].count(":"))).split(":")
            assert (int(kept), int(every), len([x for x in one.split(".") if x]), len([x for x in two.split(".") if x])) == (want[0], want[1], len(want[2]), len(want[3]))
        assert abs(r["near_edited"] - likeness(shapes[k], changed[k])) < 1e-9 and abs(r["near_next"] - likeness(shapes[k], shapes[after])) < 1e-9
        assert prints.setdefault(docs[k], r["fingerprint"]) == r["fingerprint"]


def test_op6_least_id(spark):
    rows = [(-(1 << 63), "one two"), (None, "three four"), (5, "five six")]
    got = {r["doc_id"] for r in imatch.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {-(1 << 63), None, 5}


def test_op7_brute_force(spark):
    """The registered query: its weights by a plain sum, and its sample by sorting all keys."""
    got = queries.op7_quality(spark, SF).toPandas()
    keys = got.gumbel_key.dropna().sort_values(ascending=False)
    k = int(got.selected.sum())
    assert 0 < k < len(keys) and set(got.gumbel_key[got.selected]) == set(keys.iloc[:k])
    noise = got.gumbel_key - got.log_weight / quality.TEMPERATURE
    assert abs(noise.mean() - 0.5772) < 0.4 and abs(noise.std() - 1.2825) < 0.4  # a Gumbel's mean and deviation


def test_op7_noise_decides_between_close_weights(spark):
    """Of a thousand texts of one weight the sample takes k by chance, of heavier ones nearly all."""
    from types import SimpleNamespace

    own = quality.Classifier(SimpleNamespace(value=None), 0.0, 7)
    rows = spark.range(2000).select("id", F.when(F.col("id") < 1000, 0.5).otherwise(3.5).alias("log_weight"), F.lit("x").alias("t"))
    rows = rows.select("id", "log_weight", own.key(F.col("log_weight"), F.col("id"), F.col("t")).alias("gumbel_key")).cache()
    kept = quality.top_k(rows, 1000, "gumbel_key").toPandas()
    light = int((kept.log_weight < 1).sum())
    assert len(kept) == 1000 and 20 < light < 150  # in expectation: weights e**0.5 and e**3.5


def test_op9_planted_spans_without_three_digits_in_a_row(spark):
    """Quads of one and two digits inside longer failing matches: found, whatever else the text lacks."""
    r = random.Random(3)
    rows = [(k, f"the host {r.randrange(10, 99)}.{r.randrange(10)}.{r.randrange(99)}.{r.randrange(1, 99)} is up") for k in range(120)]
    docs = spark.createDataFrame(rows + [(900, "the host 10.2.3.4 is up"), (901, "nothing")], "doc_id long, text string")
    got = {q["doc_id"]: q["spans"] for q in pii.detect(docs).collect()}
    assert got[900] == "ip:9:17" and got[901] == ""


def test_op9_precision_and_recall_of_added_spans(spark):
    """What trees add to base spans, against planted truth that no check can find."""
    r = random.Random(7)

    def luhn(n):
        while True:
            s = "".join(str(r.randrange(10)) for _ in range(n))
            if brute.luhn(s):
                return s

    rows, truth = [], {}
    for k in range(900):
        mail = f"jo.{k}@mail{k % 9}.example.com"
        call = f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
        kind = k % 6
        if kind == 0:
            rows.append((k, f"please mail {mail} today"))
        elif kind == 1:
            rows.append((k, f"please call {call} today"))
        elif kind == 2:
            rows.append((k, f"my card {luhn(16)} is new"))
        elif kind == 3:
            rows.append((k, f"order {r.randrange(10**15, 10**16)} has shipped"))  # one in ten passes by chance
        elif kind == 4:  # a phone number hidden by a longer match that fails
            text = f"please call {call} 10.0.{r.randrange(10)}.{r.randrange(10)} today"
            rows.append((k, text))
            truth[k] = f"phone:{text.index('+')}:{text.index(call) + len(call)}"
        else:  # an address spelt out
            text = f"please mail jo.{k} (at) mail{k % 9}.example.com today"
            rows.append((k, text))
            truth[k] = f"email:{text.index('jo.')}:{text.index(' today')}"
    got = {q["doc_id"]: q["spans"].split(",") for q in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {(k, s) for (k, t), own in zip(rows, (got[k] for k, _ in rows), strict=True) for s in own if s and s not in brute.pii(t)}
    right = added & set(truth.items())
    assert len(right) >= 0.95 * len(truth) and len(right) >= 0.95 * len(added)


def test_op9_labels_are_no_function_of_features():
    assert not {"luhn", "quad", "digits"} & set(pii.FEATURES)


def test_op10_query(spark):
    """Sizes, checksums and law of the registered query, by a plain loop."""
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents", "doc_id", "text").collect()}
    got = queries.op10_sharding(spark, SF).collect()
    assert {r["doc_id"] for r in got} == docs.keys() and len(got) == len(docs)
    shards = {}
    for r in got:
        text = docs[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len((text or "").encode()) + 1, zlib.crc32((text or "").encode()))
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert set(shards) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_op10_exact_law():
    """Probabilities of large tables to ten digits, by exact integers."""
    from math import comb, exp

    for good, bad, n in ((30, 70, 20), (500, 1500, 700), (7, 90_000, 1000)):
        for x in range(max(0, n - bad), min(n, good) + 1, 7):
            p, q = n / (good + bad), (good + bad - n) / (good + bad)
            got = exp(sharding._log_binomial(x, good, p, q) + sharding._log_binomial(n - x, bad, p, q) - sharding._log_binomial(n, good + bad, p, q))
            want = comb(good, x) * comb(bad, n - x) / comb(good + bad, n)
            assert abs(got - want) <= 1e-10 * want
    draw = random.Random(1)
    got = [sharding.hypergeometric(draw, 10**10, 15 * 10**10, 10**6) for _ in range(300)]
    assert abs(np.mean(got) - 62_500) < 60 and 180 < np.std(got) < 310


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), master="spark://x:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
