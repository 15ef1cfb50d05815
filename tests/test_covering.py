"""Points in ranges at size, at all levels and over many batches, against plain Python."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.operators import intervals


def _rows_made(node):
    """The rows that all nodes of an executed plan put out."""
    below = node.executedPlan() if "AdaptiveSparkPlanExec" in node.getClass().getName() else node.plan() if "QueryStageExec" in node.getClass().getName() else None
    children = [node.children().apply(k) for k in range(node.children().size())] if below is None else [below]
    made = node.metrics().get("numOutputRows")
    return (made.get().value() if made.isDefined() and below is None else 0) + sum(map(_rows_made, children))


def test_covering_makes_a_few_rows_for_each_point_and_range(spark):
    wide = 1 << 40
    points = spark.range(20_000).select((F.col("id") * 7919 * (1 << 20) % wide).alias("p"))
    ranges = spark.range(2_000).select((F.col("id") * 104729 * (1 << 19) % wide).alias("lo"), F.col("id").alias("g")).withColumn("hi", F.col("lo") + F.col("g") * F.col("g") * 12_345 * (1 << 9) % wide)
    got = intervals.covering(points, ranges, [], "p", "lo", "hi", "g", "g")
    assert len(got.collect()) == 20_000
    # 18 at three levels of nodes; looking each point up in the cells of every level made 68
    assert _rows_made(got._jdf.queryExecution().executedPlan()) < 30 * 22_000


def test_covering_at_all_levels_and_extremes(spark):
    r = random.Random(3)
    least, most = -(1 << 63), (1 << 63) - 1
    some = lambda: r.choice([least, most, 0, -1, r.randrange(-40_000, 40_000), r.randrange(-40_000, 40_000), 16_383, 16_384, r.randrange(-(1 << 45), 1 << 45), r.randrange(least, most)])
    keys = ["a", "ß", None]
    ranges = [(r.choice(keys), *sorted((some(), some())), r.choice([None, *range(30)]), r.choice([None, "x", "y", f"n{k}"])) for k in range(80)]
    ranges += [(k, a := some(), min(a + r.randrange(40_000), most), 40 + r.randrange(9), "z") for k in keys for _ in range(20)]
    points = [(r.choice(keys), some()) for _ in range(500)] + [("a", p) for _, lo, hi, *_ in ranges for p in (lo, hi)] + [("a", 7)] * 300
    got = intervals.covering(spark.createDataFrame(points, "k string, p long"), spark.createDataFrame(ranges, "k string, lo long, hi long, o int, g string"), ["k"], "p", "lo", "hi", "g", "o")
    rank = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    want = [(k, p, max(((o, g) for j, lo, hi, o, g in ranges if k is not None and j == k and lo <= p <= hi), key=rank, default=(0, None))[1]) for k, p in points]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_nodes_painted_over_many_batches(monkeypatch):
    r = random.Random(4)
    size, nodes = 1 << intervals.BITS, [(k, n) for k in "ab" for n in (-2, 0, 1, 7)]
    rows = []
    for key, node in nodes:
        blocks = [(key, node, k := r.choice([0, 3, 9, intervals.BITS]), r.randrange(1 - size, size) if k == intervals.BITS else r.randrange(size - (1 << k) + 1), o, o * 10) for o in range(r.choice([0, 1, 30]))]
        rows += [(key, node, -1, p, None, None) for p in r.sample(range(size), r.choice([1, 400]))] + blocks
    columns = list(zip(*rows, strict=True))
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    table = pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "_node", "_kind", "_from", "_order", "_carry"])
    want = []
    for key, node, kind, p, *_ in rows:
        over = [o for j, m, b, s, o, _ in rows if (j, m) == (key, node) and b >= 0 and s <= p < s + (1 << b)]
        want += [(key, node * size + p, max(over), max(over) * 10)] if kind < 0 and over else []
    for n in (1, 64, 1 << 17):
        monkeypatch.setattr(intervals, "ROWS", n)
        got = [tuple(x.values()) for b in intervals._painted(1, iter(table.to_batches(max_chunksize=23))) for x in b.to_pylist()]
        assert sorted(got) == sorted(want)
