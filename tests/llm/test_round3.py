"""Resampling towards a target, spelling variants and mixing, against plain Python."""

import random
import re
from collections import defaultdict

import brute
import numpy as np
import pytest
from paths import SF
from pyspark.sql import functions as F

from folioscope.llm import mixing, queries, resampling, toxicity, variants, words


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("size", [1 << 22, 64])
def test_op11_brute_force(spark, docs, monkeypatch, size):
    """Blocks of 64 bytes cut nearly every text; features reach across the cuts."""
    monkeypatch.setattr(resampling, "BLOCK", size)
    data = rows_of(docs.limit(40))
    column = docs.limit(40).select(F.coalesce("text", F.lit(""))).toArrow().column(0)
    import pyarrow as pa

    raw, offsets = resampling.utf8(pa.array(column.to_pylist(), pa.string()))
    for longest in (1, 2, 3):
        got = [flat for _, _, flat, _, _ in resampling.bucket_lists(raw, offsets, longest, 10_000)]
        want = []
        for _, text in data:
            w = [x.decode() for x in brute.words(text)]
            want += [resampling.zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w)]
        assert sorted(np.concatenate(got).tolist()) == sorted(want)


def test_op11_query_and_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([("alpha beta gamma delta word",), (None,), ("",)], "text string")
    got = resampling.resample(odd, bench)
    assert sorted(map(tuple, got.collect()), key=str) == brute.resampled(rows_of(odd), [r[0] for r in bench.collect()])
    assert resampling.resample(none, bench).count() == 0
    empty = resampling.resample(odd, bench.where("false"))
    assert sorted(map(tuple, empty.collect()), key=str) == brute.resampled(rows_of(odd), [])


@pytest.mark.parametrize("words_a_range", [100_000, 150, 3])
def test_op12_brute_force(spark, docs, monkeypatch, words_a_range):
    monkeypatch.setattr(variants, "RANGE", words_a_range)
    some = docs if words_a_range > 3 else docs.limit(12)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group_variants(some).collect()}
    assert got == brute.variants(rows_of(some))


def test_op12_chains_ties_and_runs_of_letters(spark, monkeypatch):
    """Forms of forms, ties, words that end at a node, repeated letters, Latin-1 capitals that stay."""
    monkeypatch.setattr(variants, "RANGE", 7)
    counts = {"nachbarn": 3000, "nachbar": 200, "nachba": 9, "nachbarx": 20, "nachbaxx": 2, "aaaaaaa": 50, "aaaaaaaa": 5, "baaaaaaa": 5, "aaaaaab": 2, "Éclairage": 40, "éclairage": 4, "eclairage": 4, "eclairag": 2, "straßenx": 2, "strasenx": 30, "×÷×÷×÷×": 2}
    data = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    for deleted in (31, 2**31):
        got = {r["word"]: tuple(r)[1:] for r in variants.group_variants(spark.createDataFrame(data, "doc_id long, text string"), deleted=deleted).select("word", "form", "root", "n", "n_near", "form_n").collect()}
        assert got == brute.variants(data, deleted=deleted)
    assert got["nachbaxx"][:2] == ("nachbarx", "nachbarn")


def test_op12_odd_rows(spark, odd, none):
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group_variants(odd).collect()} == brute.variants(rows_of(odd))
    assert variants.group_variants(none).count() == 0
    long = "y" * 3000
    twice = spark.createDataFrame([(k, f"{long}{'z' * (k % 2)} {long}") for k in range(12)], "doc_id long, text string")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group_variants(twice, deleted=10**9).collect()}
    assert got == brute.variants(rows_of(twice), deleted=10**9)


def mixed(df):
    """The mix, after its rows, sizes, targets and limits have been held against plain Python."""
    source = {}
    for r in df.select("doc_id", "source", "text").collect():
        source.setdefault(r["doc_id"], []).append((r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))))
    sizes = defaultdict(int)
    for own in source.values():
        for s, n in own:
            sizes[s] += n
    want = brute.shared_out(sizes)
    got = mixing.mix(df).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6)) for r in got) == sorted((str(k), n, sizes[s], round(want[s], 6)) for k, own in source.items() for s, n in own)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    return got, want


def test_op13_near_its_targets(spark, docs):
    got, want = mixed(docs)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken = defaultdict(int)
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 5 for s in want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_op13_rates_tilt_by_size(spark):
    """Rates are min(2, exp(number * size)): their logarithms lie on a line through 0."""
    data = [(k, "s" if k < 400 else "t", "w " * (1 + k % 40)) for k in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    space = mixing.Workspace(spark, "test")
    cells = mixing.sizes(df).groupBy(*mixing.SOURCE, "size").agg(F.sum("_k").alias("_n"))
    for r in mixing.balanced(space, cells, mixing.targets(space, cells)).collect():
        own = [1 + k % 40 for k in range(1200) if (k < 400) == (r["_name"] == "s")]
        total = sum(n * min(2.0, np.exp(r["_dual"] * n / r["_mean"])) for n in own)
        assert abs(total - r["target"]) <= 1e-6 * r["target"]


def test_op13_odd_rows(spark, odd, none):
    own = odd.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "b").when(F.col("doc_id") % 3 == 1, "a"))
    mixed(own)
    assert mixing.mix(none.withColumn("source", F.lit("x"))).count() == 0
    silent = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [tuple(r)[1:4] for r in mixing.mix(silent).collect()] == [(0, 0, 0.0), (0, 0, 0.0)]
    # one size, one source, one id: ranked by number only
    same = spark.createDataFrame([(7, "a", "one two")] * 50 + [(k, "b", "w " * 9) for k in range(50)], "doc_id long, source string, text string")
    got, _ = mixed(same)
    assert len(got) == 100


def test_words_at_the_borders_of_pieces(monkeypatch):
    """Capitals on both sides of every cut: no word is cut in two."""
    monkeypatch.setattr(words, "PIECE", 64)
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("ABcdÉ1") for _ in range(r.randrange(1, 30))) for _ in range(60)) for _ in range(4)] + ["X" * 500, "A " * 200, ""]
    import pyarrow as pa

    data, offsets = words_of(pa.array(texts))
    for first, last, hashes, at in words.word_hashes(data, offsets, words.ALNUM):
        for k in range(first, last):
            own = brute.words(texts[k])
            assert at[k - first + 1] - at[k - first] == len(own)
            flat = np.frombuffer(b"".join(own), np.uint8) if own else np.zeros(0, np.uint8)
            ends = np.cumsum([len(w) for w in own]).astype(np.int64)
            assert (words.span_hashes(flat, ends - [len(w) for w in own], ends) == hashes[at[k - first] : at[k - first + 1]]).all() if own else True


def words_of(column):
    from folioscope.llm.common import utf8

    return utf8(column)


def test_windows_behind_a_cut_are_found(spark):
    """A text beyond a piece, capitals everywhere, benchmark windows at its end (op8), the telling word too (op5)."""
    from folioscope.llm import decontaminate

    item = " ".join(f"Item{k} word" for k in range(12))
    text = "ABCDE FGHIJ " * 110_000 + item
    docs = spark.createDataFrame([(1, text), (2, "ABCDE FGHIJ")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: (220_024, 24, 1), 2: (2, 0, 0)}
    import pyarrow as pa

    assert len(next(toxicity.terms(pa.array([text])))) == len({w for w in brute.words(text)})


def test_registered_queries(spark):
    for name in ("op11_resampling", "op12_variants", "op13_mixing"):
        assert queries.QUERIES[name](spark, SF).count() > 0
