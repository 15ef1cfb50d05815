"""A uniform shuffle of rows into shards of exact sizes, by a hypergeometric communication matrix.

Rows are dealt to blocks by a hash of a row number. How many rows of each block go to each shard
is drawn from the multivariate hypergeometric law, which is the law of those counts under a
uniform shuffle; so shard sizes hold exactly, before any row moves. Each block is permuted by
random keys and cut by its counts; rows are exchanged; each shard is permuted again. Only
DataFrame operations touch rows. The driver draws the matrix: one row for about a million rows of
input, as many columns as shards.

Each window sorts about ``ROWS`` rows at most, whatever ids repeat or texts are equal, because
row numbers differ.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace

ROWS = 1 << 20
LEAST_BLOCKS = 256


def _stirling(n: float) -> float:
    """log(n!) less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    x = 1 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - x / 1680) * x) * x) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without loss of digits where both are close."""
    d = x - mean
    if abs(d) >= 0.1 * (x + mean):
        return (x * math.log(x / mean) if x else 0.0) + mean - x
    v = d / (x + mean)
    total, term, k = d * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * k + 1)
        if more == total:
            return more
        total, k = more, k + 1


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """The log probability of x out of n by the saddle-point expansion, exact to the last digits at any size."""
    if x == 0:
        return n * math.log1p(-p) if n else 0.0
    if x == n:
        return n * math.log(p)
    rest = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return rest + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def hypergeometric(draw: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement are good. Inversion from the mode outwards.

    Probabilities are ratios of three binomial ones, so that rows by the billion lose no digits; a
    draw that rounding leaves beyond all values is made again.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    p, q = n / (good + bad), (good + bad - n) / (good + bad)
    top = math.exp(_log_binomial(mode, good, p, q) + _log_binomial(n - mode, bad, p, q) - _log_binomial(n, good + bad, p, q)) if q else 1.0
    while True:
        u = draw.random() - top
        down = up = top
        i = j = mode
        while u > 0 and (up > 0 or down > 0):
            if j < high:
                up *= (good - j) * (n - j) / ((j + 1) * (bad - n + j + 1))
                j += 1
                u -= up
                if u <= 0:
                    return j
            else:
                up = 0.0
            if i > low:
                down *= i * (bad - n + i) / ((good - i + 1) * (n - i + 1))
                i -= 1
                u -= down
                if u <= 0:
                    return i
            else:
                down = 0.0
        if u <= 0:
            return mode


def matrix(blocks: dict[int, int], sizes: list[int], seed: int) -> list[tuple[int, list[int]]]:
    """For each block how many of its rows go to shards 0, 0 to 1, and so on (running totals)."""
    draw = random.Random(seed)
    left, out = list(sizes), []
    for block in sorted(blocks):
        n, rest, totals, total = blocks[block], sum(left), [], 0
        for shard, room in enumerate(left):
            rest -= room
            got = hypergeometric(draw, room, rest, n)
            left[shard] -= got
            n -= got
            total += got
            totals.append(total)
        out.append((block, totals))
    return out


def equal_sizes(n: int, shards: int) -> list[int]:
    """Sizes at most one apart; the first shards have the one more."""
    return [n // shards + (k < n % shards) for k in range(shards)]


def shuffle(rows: DataFrame, shards: int, seed: int = 0, sizes: list[int] | None = None) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Every row gets one place, rows with null or repeated ids too. ``sizes`` must add up to the
    number of rows; without it they are equal, or one apart. Columns named shard or slot are
    replaced; all others stay, whatever their names. Null, empty and very long texts and repeated
    rows are rows like others. What the draw depends on: the seed and the order of rows in the
    input's partitions. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    space = Workspace(spark, "shuffle")
    rows = rows.drop("shard", "slot")
    packed = rows.select(F.struct(*rows.columns).alias("_kept"), F.monotonically_increasing_id().alias("_row"))
    # each row's number is written with it; from here on nothing depends on how partitions are read
    numbered = space.stash(packed, "rows")
    n = numbered.count()
    count = max(LEAST_BLOCKS, -(-n // ROWS))
    sizes = equal_sizes(n, shards) if sizes is None else sizes
    if sum(sizes) != n:
        raise ValueError(f"sizes add up to {sum(sizes)}; there are {n} rows")
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "_row")
    blocked = numbered.withColumn("_block", F.pmod(hashed("block"), F.lit(count)).cast("int"))
    counts = {r["_block"]: r["count"] for r in blocked.groupBy("_block").count().collect()}
    if not counts:
        return rows.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    dealt = spark.createDataFrame(matrix(counts, sizes, seed), "_block int, _totals array<long>")
    local = Window.partitionBy("_block").orderBy(hashed("local"), "_row")
    place = F.row_number().over(local)
    shard: Column = F.size(F.filter("_totals", lambda t: t < F.col("_place"))).cast("int")
    parts = max(16, -(-n // (shards * ROWS)))
    sent = (
        blocked.join(dealt, "_block")
        .withColumn("_place", place)
        .withColumn("shard", shard)
        .withColumn("_part", F.pmod(hashed("part"), F.lit(parts)).cast("int"))
        .select("_kept", "_row", "shard", "_part")
    )
    sent = space.stash(sent, "sent")
    totals = sent.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")
    totals = totals.select("shard", "_part", before.alias("_before"))
    again = Window.partitionBy("shard", "_part").orderBy(hashed("again"), "_row")
    slot = (F.col("_before") + F.row_number().over(again) - 1).cast("long")
    return sent.join(totals, ["shard", "_part"]).withColumn("slot", slot).select("_kept.*", "shard", "slot")
