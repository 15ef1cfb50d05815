"""Values carried along an order, walks with barriers, and chains of links: in buckets, so that no key is a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.relational import WIDTH, numbered, running_total
from folioscope.sources.scratch import stash


def fill_forward(df: DataFrame, by: list[str], order: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """The last ``value`` that isn't null up to each row, this one included, of the same key, by ``order`` (a number).

    Each bucket of ``width`` positions takes over the last value of those before it. Null where
    none has come yet; of rows that share a position the one of the greatest value counts last.
    """
    cut = df.withColumns({"_bucket": F.floor(F.col(order) / width), "_held": F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v")))})
    last = cut.groupBy(*by, "_bucket").agg(F.max_by("_held", F.when(F.col("_held").isNotNull(), F.struct(F.col(order).alias("_o"), F.col(value).alias("_v")))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.col(order), F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("_own", F.last("_held", ignorenulls=True).over(inside)).join(carried, [*by, "_bucket"])
    return own.select(*df.columns, F.coalesce("_own", "_carried")["v"].alias(out))


def running_base(df: DataFrame, by: list[str], order: str, value: str, marker: str, out: str, width: int = WIDTH) -> DataFrame:
    """The sum of ``value`` since the last row where ``marker`` is true, that row's own value excluded; null before any such row.

    The running total at the marker is carried forward and taken off.
    """
    summed = running_total(df, by, order, value, "_total", width)
    summed = summed.withColumn("_at", F.when(F.col(marker), F.col("_total") + F.col(value)))
    filled = fill_forward(summed, by, order, "_at", "_base", width)
    return filled.select(*df.columns, F.when(F.col(marker), F.lit(0).cast("long")).otherwise(F.col("_total") + F.col(value) - F.col("_base")).alias(out))


def walk(df: DataFrame, by: list[str], order: str, step: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``_sum``, the sum of ``step`` up to each row, and ``_low``, the least sum before it (0 at most).

    A walk that a floor of 0 holds up stands at _sum - min(_low, _sum) after the row, and the floor
    holds it up where _sum < _low.
    """
    inside = Window.partitionBy(*by, "_bucket").orderBy(order)
    up_to, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    cut = df.withColumn("_bucket", F.floor(F.col(order) / width)).withColumn("_in", F.sum(step).over(up_to)).withColumn("_least", F.min("_in").over(earlier))
    each = cut.groupBy(*by, "_bucket").agg(F.sum(step).alias("_all"), F.min("_in").alias("_dip"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_base", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    each = each.select(*by, "_bucket", "_base", F.coalesce(F.min(F.col("_base") + F.col("_dip")).over(before), F.lit(0)).alias("_floor"))
    whole = cut.join(each, [*by, "_bucket"])
    low = F.least(F.lit(0), F.col("_floor"), F.coalesce(F.col("_base") + F.col("_least"), F.lit(0)))
    return whole.select(*df.columns, (F.col("_base") + F.col("_in")).cast("long").alias("_sum"), low.cast("long").alias("_low"))


def browse_sequences(links: DataFrame) -> DataFrame:
    """(node, chain, place): nodes of (node, next) in chains, numbered in the order of their first nodes, places from 0.

    Of several links to a node that of the least node counts, the others end their chains; a link to
    nothing, or to a node that isn't there, ends a chain; a cycle is cut before its least node. A
    node links to one node: of several rows the least ``next`` counts; null nodes are left out.
    Pointer doubling over the links backward: rounds are the logarithm of the longest chain.
    """
    own = links.where("node is not null").groupBy("node").agg(F.min("next").alias("next"))
    back = own.where("next is not null and next <> node").groupBy(F.col("next").alias("_to")).agg(F.min("node").alias("_from"))
    nodes = own.select("node").join(back, F.col("node") == F.col("_to"), "left").select("node", F.col("_from").alias("up"))
    rooted, looped = _doubled(nodes)
    if looped is not None:
        cut = looped.join(nodes, "node").select("node", F.when(F.col("node") != F.col("least"), F.col("up")).alias("up"))
        rooted = rooted.union(_doubled(cut)[0])
    rooted = stash(rooted, "rooted")
    firsts = numbered(rooted.where("steps = 0").select("node"), ["node"], "chain")
    return rooted.join(firsts.select(F.col("node").alias("up"), "chain"), "up").select("node", "chain", F.col("steps").alias("place"))


def _doubled(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, up, steps): each node's first node and its distance; and (node, least) of nodes on cycles, if there are any.

    Nodes that have reached their first take no part in later rounds.
    """
    now = nodes.select("node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.least("node", F.coalesce("up", "node")).alias("least"), F.col("up").isNull().alias("done"))
    now = stash(now, "doubling")
    many, reach = now.where("not done").count(), 1
    while now.where("not done").limit(1).count() and reach < 2 * many:
        further = now.select(F.col("node").alias("up"), F.col("up").alias("_far"), F.col("steps").alias("_more"), F.col("least").alias("_least"), F.col("done").alias("_ended"))
        moved = now.where("not done").join(further, "up").select("node", F.col("_far").alias("up"), (F.col("steps") + F.col("_more")).alias("steps"), F.least("least", "_least").alias("least"), F.col("_ended").alias("done"))
        now = stash(now.where("done").unionByName(moved), "doubling")
        reach *= 2
    looped = now.where("not done").select("node", "least")
    return now.where("done").select("node", "up", "steps"), looped if looped.limit(1).count() else None
