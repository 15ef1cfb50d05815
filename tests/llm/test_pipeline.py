import brute
from paths import SF

import corpus_pipeline
from folioscope.llm.queries import tokenizer_path


def test_stages_hold_on_their_own_input(spark, docs):
    now, seen = docs, [docs]
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        now = spark.createDataFrame(now.toPandas(), now.schema)
        seen.append(now)
    raw, good, single, clean, private, ids = seen
    for a, b in zip(seen[:4], seen[1:5], strict=True):
        assert a.columns == b.columns and b.count() <= a.count() and b.count() > 0
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    firsts = {c for _, c in brute.components(rows, 80)}  # the stage links from 0.80, as its contract says
    assert {r["doc_id"] for r in single.collect()} == firsts
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = [(r["doc_id"], r["text"]) for r in single.collect()]
    hits = brute.contamination([t for _, t in before], bench)
    assert {r["doc_id"] for r in clean.collect()} == {k for (k, _), h in zip(before, hits, strict=True) if not h[1]}
    assert all(not brute.pii(r["text"]) and r["n_chars"] == len(r["text"]) for r in private.collect())
    import tokenizers

    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    got = {r["doc_id"]: r["token_ids"] for r in ids.collect()}
    assert got.keys() == texts.keys()
    assert all(got[k] == library.encode(t, add_special_tokens=False).ids for k, t in texts.items())


def test_odd_rows(spark, odd, none, tmp_path):
    """Nulls, empty texts, repeats and clashing columns pass all stages."""
    for start in (odd, none):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert set(now.columns) == {"doc_id", "n_tokens", "token_ids"}
        assert (now.count() > 0) == (start is odd)


def test_run(spark, docs):
    """Run gives what the stages give one after the other, and leaves the session as it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    got = sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    assert spark.conf.get(key, None) == before
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert got == sorted(map(str, now.collect())) and got


def test_near_duplicates_from_80(spark):
    """The stage links what is 0.80 alike or more, as all pairs tell."""
    rows = []
    for k in range(40):
        shared = [f"s{k}x{j}" for j in range(64)]
        rows += [(2 * k, " ".join(shared)), (2 * k + 1, " ".join([f"o{k}x{j}" for j in range(14 + k % 4)] + shared))]  # 60 of 74 to 77
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    want = {c for _, c in brute.components(rows, 80)}
    assert {r["doc_id"] for r in got.collect()} == want and 40 < len(want) < len(rows)


def test_rows_that_share_an_id(spark):
    """Unlike texts of one id all stay; of copies one does, that of the least id, with or without ids."""
    rows = [(3, "a b c d e f"), (3, "g h i j k l"), (2, "a b c d e f"), (None, "m n o p q r"), (None, "m n o p q r"), (None, "s t u v w x"), (None, "g h i j k l"), (4, None), (4, None)]
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, _row int, _number int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    want = [(2, "a b c d e f"), (3, "g h i j k l"), (None, "m n o p q r"), (None, "s t u v w x"), (4, None), (4, None)]
    assert got.columns == docs.columns and sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))
