"""Names that don't collide, and names of which only the beginning is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import hash_and_power
from folioscope.operators.relational import asof_join, running_total


def without_collisions(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """``df`` with a name that no other row has: the first row of a name, by ``order`` (a whole number, one for each row), keeps it, later ones get "_2", "_3" and so on.

    Numbers are passed over where a row of the input has such a name already. Whatever the order of
    the rows, the names are the same. A null name stays null, as often as it comes.

    How many numbers are free below a name that is taken says which later row it puts off: an as-of
    lookup, so a name that a third of the rows have is no single task.
    """
    mine = df.where(F.col(name).isNotNull())
    ranked = running_total(mine.withColumn("_one", F.lit(1)), [name], order, "_one", "_rank")
    # "a_2" stands in the way of "a": its number, and how many numbers from 2 on are free before it
    parts = mine.select(name).distinct().select(F.regexp_extract(name, "(?s)^(.*)_([1-9][0-9]{0,17})$", 1).alias("_base"), F.regexp_extract(name, "(?s)^(.*)_([1-9][0-9]{0,17})$", 2).try_cast("long").alias("_number"))
    parts = parts.where("_number >= 2")
    first = mine.select(F.col(name).alias("_base")).groupBy("_base").agg(F.count("*").alias("_n")).where("_n > 1")
    # only numbers that rows of the name may come to matter: at most twice as many as there are rows
    taken = parts.join(first, "_base").select("_base", "_number")
    place = F.row_number().over(Window.partitionBy("_base").orderBy("_number"))
    taken = taken.withColumn("_i", place.cast("long")).select(F.col("_base").alias(name), (F.col("_number") - 1 - F.col("_i")).alias("_free"), "_i")
    later = asof_join(ranked.where("_rank > 0").withColumn("_probe_at", F.col("_rank") - 1), taken, [name], "_probe_at", "_free", ["_i"])
    number = F.col("_rank") + 1 + F.coalesce("_i", F.lit(0))
    later = later.select(*df.columns, F.concat_ws("_", name, number.cast("string")).alias(out))
    kept = ranked.where("_rank = 0").select(*df.columns, F.col(name).alias(out))
    return kept.unionByName(later).unionByName(df.where(F.col(name).isNull()).withColumn(out, F.lit(None).cast("string")))


def names_by_ending(beginnings: DataFrame, endings: DataFrame, key: str, hash_col: str, begin: str, end: str, out: str) -> DataFrame:
    """(key, name) for each row of ``beginnings`` and each ending that gives its hash: meeting in the middle.

    The hash of a name is that of its beginning times 43**k plus that of its ending of k characters,
    modulo 2**32. So each beginning asks for one hash of an ending for each length that endings
    have (at most as many as characters in the longest), and an equi-join on (length, hash) finds
    it: the work is beginnings * lengths + endings, not beginnings * endings. Names that only
    share the hash by chance are found too. Null hashes and texts meet nothing.
    """
    tails = endings.where(F.length(end) > 0).select(F.col(end).alias("_end")).distinct().select("_end", hash_and_power(F.col("_end")).alias("_t"))
    tails = tails.select("_end", F.col("_t.h").alias("_tail"), F.col("_t.n").alias("_n"))
    powers = {r[0]: pow(43, r[0], 1 << 32) for r in tails.select("_n").distinct().collect()}
    if not powers:
        return beginnings.select(key, F.lit(None).cast("string").alias(out)).where(F.lit(False))
    heads = beginnings.where(F.col(hash_col).isNotNull() & F.col(begin).isNotNull()).select(key, F.col(hash_col).alias("_h"), F.col(begin).alias("_begin"), hash_and_power(F.col(begin))["h"].alias("_head"))
    signed = F.when(F.col("_head") >= 1 << 31, F.col("_head") - (1 << 32)).otherwise(F.col("_head"))
    asked = [F.struct(F.lit(n).cast("int").alias("_n"), F.pmod(F.col("_h") - F.pmod(signed * F.lit(p), F.lit(1 << 32)), F.lit(1 << 32)).alias("_tail")) for n, p in powers.items()]
    heads = heads.select(key, "_begin", F.inline(F.array(*asked)))
    return heads.join(tails, ["_n", "_tail"]).select(key, F.concat("_begin", "_end").alias(out))
