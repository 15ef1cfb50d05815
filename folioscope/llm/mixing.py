"""Mixing sources to target weights by entropy balancing.

Sources share a given part of all words by weight; no source gets more than ``most`` times its own
words, and what is above goes to the others by weight until none is above. Within a source each
document gets a rate: of all rates from 0 to ``most`` that take the source's target in words, those
of least relative entropy to taking each document once. Their dual has one number a source; a
document of s words has the rate min(most, exp(number * s / mean size)). Newton's method finds the
numbers, all sources at once, a distributed sum over (source, size) a round; a step that leaves
the bracket known so far is halved instead.

Rates become whole copies. Documents of one source and size have one rate, so a source's sizes, from
the largest, are rounded to numbers of copies and the words left over are carried to the next
smaller size: a source misses its target by about its smallest documents. The copies of one size
go to its documents evenly, the odd ones to those whose ids have the least hashes.

A source has at most sqrt(2 * its words) sizes, which is what one task reads when it rounds; the
documents of one source and size are ranked in chunks of about ``CHUNK``.

Odd rows: a null text has no words, a null source is a source of its own, the last in order.
Documents without words are taken once and count nothing. Rows that repeat id, source and size are
told apart by number only, so reruns agree in them too; null ids are such rows. Very long texts are
counted whole. An empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace
from folioscope.llm.ordering import placed

WEIGHTS, SHARE, MOST = (3, 1, 2), 150, 2
#: Documents of one source and size that are ranked at once.
CHUNK = 4096
#: A source's rates are found when their words are so close to its target, as a share of it.
CLOSE = 1e-9
ROUNDS = 100
SOURCE = ["_missing", "_name"]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, _missing, _name, size, _k): documents by id, source and size, with the number of rows that share all three."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    slim = docs.select("doc_id", source.isNull().alias("_missing"), F.coalesce(source, F.lit("")).alias("_name"), size.alias("size"))
    return slim.groupBy("doc_id", *SOURCE, "size").agg(F.count("*").alias("_k"))


def targets(space: Workspace, cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(_missing, _name, source_size, docs, target) of each source.

    A water level: each source gets level * weight or, where that is more, ``most`` times its words.
    The level rises while sources reach their limit; the driver sees three sums a round.
    """
    own = cells.groupBy(*SOURCE).agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.sum("_n").alias("docs"))
    own = placed(space, own, [F.col(c).asc() for c in SOURCE], "_place", "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int"))
    own = space.stash(own.select(*SOURCE, "source_size", "docs", weight.cast("double").alias("_weight"), (F.col("source_size") * most).cast("double").alias("_limit")), "weighted")
    first = own.agg(F.sum("source_size"), F.sum("_weight")).first()
    all_words, free = first[0] or 0, first[1] or 1.0
    wanted, level, full = all_words * share / 100, all_words * share / 100 / free, 0
    while True:
        stopped = F.col("_limit") <= level * F.col("_weight")
        now = own.agg(F.count_if(stopped), F.sum(F.when(stopped, F.col("_limit"))), F.sum(F.when(~stopped, F.col("_weight")))).first()
        if now[0] == full or not now[2]:
            break
        full, level = now[0], (wanted - now[1]) / now[2]
    return own.select(*SOURCE, "source_size", "docs", F.least(F.col("_limit"), level * F.col("_weight")).alias("target"))


def balanced(space: Workspace, cells: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """``aims`` with the dual's number of each source (``_dual``) and its mean size: infinite where all is taken ``most`` times."""
    mean = F.col("source_size") / F.col("docs")
    some = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * most) & (F.col("target") > 0)
    # sizes are at least one word: beyond these bounds all rates are too small, or all at their limit
    low = F.when(some, F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) * mean - 1)
    high = F.when(some, mean * np.log(most) + 1)
    end = F.when(F.col("target") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    now = aims.select("*", mean.alias("_mean"), low.alias("_low"), high.alias("_high"), F.when(some, F.lit(0.0)).otherwise(end).alias("_dual"), (~some).alias("_done"))
    now = space.stash(now, "dual0")
    for k in range(1, ROUNDS):
        if not now.where("not _done").limit(1).count():
            break
        x = F.col("size") / F.col("_mean")
        rate = F.exp(F.col("_dual") * x)
        words = (F.col("size") * F.col("_n")).cast("double")
        active = now.where("not _done").select(*SOURCE, "_mean", "_dual")
        sums = cells.where("size > 0").join(active, SOURCE).groupBy(*SOURCE).agg(F.sum(words * F.least(F.lit(float(most)), rate)).alias("_taken"), F.sum(F.when(rate < most, words * x * rate)).alias("_slope"))
        step = now.join(sums, SOURCE, "left")
        over = F.col("_taken") > F.col("target")
        low, high = F.when(over, F.col("_low")).otherwise(F.col("_dual")), F.when(over, F.col("_dual")).otherwise(F.col("_high"))
        newton = F.col("_dual") - F.log(F.col("_taken") / F.col("target")) * F.col("_taken") / F.col("_slope")
        inside = newton.isNotNull() & ~F.isnan(newton) & (newton > low) & (newton < high)
        close = F.abs(F.col("_taken") - F.col("target")) <= CLOSE * F.col("target")
        moved = F.when(close, F.col("_dual")).when(inside, newton).otherwise((low + high) / 2)
        done = F.col("_done")
        step = step.select(*aims.columns, "_mean", F.when(done, F.col("_low")).otherwise(low).alias("_low"), F.when(done, F.col("_high")).otherwise(high).alias("_high"), F.when(done, F.col("_dual")).otherwise(moved).alias("_dual"), (done | close).alias("_done"))
        now = space.stash(step, f"dual{k}")
    return now.select(*aims.columns, "_mean", "_dual")


def copies(cells: DataFrame, duals: DataFrame, most: int = MOST) -> DataFrame:
    """(_missing, _name, size, _n, _copies): how many copies the documents of one source and size get together."""
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(float(most)), F.exp(F.col("_dual") * F.col("size") / F.col("_mean"))))

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False)
        out, rest = [], 0.0
        for size, n, r in zip(group["size"].tolist(), group["_n"].tolist(), group["_rate"].tolist(), strict=True):
            if size:
                ideal = n * r * size + rest
                k = min(max(round(ideal / size), 0), most * n)
                rest = ideal - k * size
            else:
                k = n
            out.append(k)
        return group.drop(columns="_rate").assign(_copies=out)

    rated = cells.join(duals.select(*SOURCE, "_mean", "_dual"), SOURCE).select(*SOURCE, "size", "_n", rate.alias("_rate"))
    return rated.groupBy(*SOURCE).applyInPandas(rounded, "_missing boolean, _name string, size long, _n long, _copies long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document; ``taken`` is copies * size.

    ``weights`` go round the sources in code-point order; together they share ``share`` percent of all words.
    """
    space = Workspace(docs.sparkSession, "mixing")
    slim = space.stash(sizes(docs), "sizes")
    cells = space.stash(slim.groupBy(*SOURCE, "size").agg(F.sum("_k").alias("_n")), "cells")
    duals = balanced(space, cells, targets(space, cells, weights, share, most), most)
    dealt = space.stash(copies(cells, duals, most), "copies")
    key = [*SOURCE, "size"]
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 2)
    chunk = F.floor(hashed / float(1 << 62) * F.ceil(F.col("_n") / CHUNK))
    rows = slim.join(dealt, key).withColumns({"_hash": hashed, "_chunk": chunk})
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*key, "_chunk").agg(F.sum("_k").alias("_all"))
    chunks = chunks.select(*key, "_chunk", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*key, "_chunk").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_own", F.coalesce(F.sum("_k").over(inside), F.lit(0))).join(chunks, [*key, "_chunk"])
    # of rows that share id, source and size so many get the odd copy
    odd = F.greatest(F.lit(0), F.least(F.col("_k"), F.col("_copies") % F.col("_n") - F.col("_base") - F.col("_own")))
    each = ranked.withColumn("_odd", odd).withColumn("_each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
    taken = F.expr("_copies div _n") + (F.col("_each") <= F.col("_odd")).cast("long")
    known = duals.select(*SOURCE, "source_size", "target")
    out = each.select("doc_id", *SOURCE, "size", taken.alias("copies")).join(known, SOURCE)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
