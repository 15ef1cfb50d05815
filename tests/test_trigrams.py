"""What the search by trigrams shuffles, and its verification against plain Python."""

import random

import numpy as np
import pytest

from folioscope.operators import trigrams


def shuffled(spark):
    """Bytes that stages of this session have written to shuffles."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_trigram_search_shuffles_a_list_once_for_many_sets(spark):
    texts = spark.range(6000).selectExpr("id", "concat('common other mixed', if(id % 3 = 0, ' third', ''), ' w', id) as text").repartition(4).localCheckpoint()
    asked = spark.range(600).selectExpr("id as q", "concat('common other mixed third w', id) as query").localCheckpoint()
    index, before = trigrams.build(texts, "id", "text"), shuffled(spark)
    found = trigrams.search(index, asked, "q", "query").collect()
    words = [f"common other mixed{' third' if k % 3 == 0 else ''} w{k}" for k in range(6000)]
    assert sorted(map(tuple, found)) == sorted((q, k) for q in range(600) for k in range(0, 6000, 3) if f"w{q}" in words[k])
    wrote = shuffled(spark) - before
    assert wrote < 1_500_000, wrote


@pytest.mark.parametrize("shortest", [1, 3])
@pytest.mark.parametrize("piece", [40, 1 << 23])
def test_terms_are_verified_in_texts_of_any_length(monkeypatch, piece, shortest):
    monkeypatch.setattr(trigrams, "PIECE", piece)
    r = random.Random(9)
    texts = [(r.randrange(60), "".join(r.choices(["a", "b", "é", "ß", "🙂", " ", "\n", "\xa0", "\0"], k=r.choice([0, 5, 30, 90])))) for _ in range(80)]
    terms = {"".join(r.choices(["a", "b", "é", "🙂", "\xa0", "\0"], k=k)) for k in range(shortest, 8) for _ in range(20)}
    block = trigrams._Block(3)
    block.found, block.sought = {}, {t: np.arange(60) for t in terms}
    for place, text in texts:
        block.read(place, text)
    rows = block.rows().to_pylist()
    got = {x["term"]: trigrams._places(trigrams._bits(x["places"])).tolist() for x in rows}
    want = {t: sorted({place for place, text in texts if t in text}) for t in terms}
    assert got == {t: places for t, places in want.items() if places} and {x["block"] for x in rows} == {3}
