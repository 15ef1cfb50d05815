"""Places in the order of a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace


def placed(space: Workspace, df: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """``df`` with each row's place (a long, from 0) in the order of the whole table.

    Ranges of the order are sorted alone and written with each row's number in its range, so that
    a retry changes no place; the sizes of the ranges (one row a range) are summed up before them.
    Rows that are equal in all of ``order`` come in no fixed order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = space.stash(ranged, name).withColumn("_part", F.shiftright("_id", 33))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.col("_id") - F.shiftleft("_part", 33)
    return ranged.join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_before") + own).alias(out))
