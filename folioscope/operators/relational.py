"""Relational operators that Spark lacks: by-position lookups, running totals, winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.scratch import stash

#: Width of the buckets of an order column; a bucket's rows are sorted in one task.
WIDTH = 1 << 16


def running_total(df: DataFrame, by: list[str], order: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """The sum of ``value`` over all earlier rows of the same key, by ``order`` (a number).

    Rows are cut into buckets of ``width`` of the order column. Buckets are summed first, their
    sums run over at most one row a bucket, and each bucket's rows run alone; so a key that holds
    most rows is no single task. Rows that share an order value count each other in no fixed order.
    """
    cut = df.withColumn("_bucket", F.floor(F.col(order) / width))
    sums = cut.groupBy(*by, "_bucket").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = (F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")
    return cut.join(base, [*by, "_bucket"]).withColumn(out, total).drop("_bucket", "_base")


def asof_join(probes: DataFrame, starts: DataFrame, by: list[str], at: str, start: str, carry: list[str], width: int = WIDTH) -> DataFrame:
    """For each probe the ``carry`` columns of the greatest ``start`` at or before ``at``, per key.

    Nulls where none is. Both sides are cut into buckets of ``width`` positions; each bucket takes
    over the last start of the buckets before it, so a probe meets only its own bucket. Of equal
    starts the last by the carried columns wins.
    """
    kept = F.struct(F.col(start).alias("_start"), *carry)
    right = starts.select(*by, F.floor(F.col(start) / width).alias("_bucket"), F.col(start).alias("_at"), kept.alias("_row"), F.lit(0).alias("_probe"))
    left = probes.select(*by, F.floor(F.col(at) / width).alias("_bucket"), F.col(at).alias("_at"), F.struct(*probes.columns).alias("_own"), F.lit(1).alias("_probe"))
    last = right.groupBy(*by, "_bucket").agg(F.max("_row").alias("_row"))
    both = last.unionByName(left.select(*by, "_bucket").distinct(), allowMissingColumns=True).groupBy(*by, "_bucket").agg(F.max("_row").alias("_row"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select(*by, "_bucket", F.last("_row", ignorenulls=True).over(before).alias("_carried"))
    merged = right.unionByName(left, allowMissingColumns=True)
    order = Window.partitionBy(*by, "_bucket").orderBy("_at", "_probe", "_row").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("_found", F.last("_row", ignorenulls=True).over(order)).where("_probe = 1")
    found = found.join(carried, [*by, "_bucket"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select("_own.*", *(F.col("_found")[c].alias(c) for c in carry))


def first_wins(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def last_wins(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def neighbours(df: DataFrame, by: list[str], order: str, value: str, ties: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """The value before and after each row in its sequence, by ``order`` (a number) and ``ties``.

    Each bucket of ``width`` positions is sorted alone; at its edges stand the last and the first
    value of the buckets around it, so a key that holds most rows is no single task.
    """
    rank = F.struct(order, *(ties or []))
    cut = df.withColumn("_bucket", F.floor(F.col(order) / width))
    kept = F.struct(F.col(value).alias("v"))
    edges = cut.groupBy(*by, "_bucket").agg(F.min_by(kept, rank).alias("_first"), F.max_by(kept, rank).alias("_last"))
    around = Window.partitionBy(*by).orderBy("_bucket")
    edges = edges.select(*by, "_bucket", F.lag("_last").over(around).alias("_before"), F.lead("_first").over(around).alias("_after"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order, *(ties or []))
    near = cut.withColumns({"_prev": F.lag(kept).over(inside), "_next": F.lead(kept).over(inside)}).join(edges, [*by, "_bucket"])
    return near.select(*df.columns, F.coalesce("_prev", "_before")["v"].alias("prev"), F.coalesce("_next", "_after")["v"].alias("next"))


def zip_by_position(left: DataFrame, right: DataFrame, order: str | list[str] = "ord") -> DataFrame:
    """Two lists side by side; the short side is null."""
    return left.join(right, order, "left")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Each row's place in the whole table's order, from 0: ranges are numbered alone, after the rows of the ranges before.

    The ranged rows are written with their range's number, so that a retry changes no place. Equal
    rows come in no fixed order.
    """
    ranged = stash(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + F.col("_own") - 1).select(*df.columns, out)
