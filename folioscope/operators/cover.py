"""Set cover in few rounds, and groups that have all of a set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.sources.scratch import drop, stash


def cover_in_rounds(pairs: DataFrame, cost: DataFrame, step: float = 0.1, seed: int = 0) -> DataFrame:
    """(round, key, new): keys of (key, item) that together have all items, near the choice of plain greedy.

    A round looks at all keys whose gain (open items for their ``cost``) is within a factor of 1 +
    ``step`` of the best. Each open item votes for that one of them with the least hash of key,
    round and seed; those that get at least 1 / (1 + step) of their open items are chosen together,
    the one of the least hash always. So each chosen key is nearly as good as the greedy's next one,
    and rounds follow the logarithm of the gains' spread and of the number of keys, not the number
    of keys chosen. Null keys and items are left out; a key without a cost, or one of 0 or less,
    costs 1. Items and keys stay in Spark; the driver sees a number a round.
    """
    price = F.when(F.col("cost") > 0, F.col("cost")).otherwise(1).cast("double")
    open_ = pairs.select("key", "item").dropna().distinct().join(cost.groupBy("key").agg(F.min("cost").alias("cost")), "key", "left")
    open_, chosen, k = stash(open_.select("key", "item", price.alias("_price")), "cover"), None, 0
    while True:
        gains = open_.groupBy("key").agg(F.count("*").alias("_n"), F.first("_price").alias("_price")).withColumn("_gain", F.col("_n") / F.col("_price"))
        gains = stash(gains, "gains")
        best = gains.agg(F.max("_gain")).first()[0]
        if best is None:
            break
        luck = F.xxhash64(F.col("key"), F.lit(k), F.lit(seed))
        able = gains.where(F.col("_gain") * (1 + step) >= best).select("key", "_n", luck.alias("_luck"))
        votes = open_.join(able, "key").groupBy("item").agg(F.min(F.struct("_luck", "key")).alias("_to"))
        votes = votes.groupBy(F.col("_to.key").alias("key")).agg(F.count("*").alias("_votes"))
        taken = votes.join(able, "key").where(F.col("_votes") * (1 + step) >= F.col("_n")).select(F.lit(k).alias("round"), "key", F.col("_votes").alias("new"))
        taken = stash(taken, "taken")
        had = open_.join(taken.select("key"), "key", "left_semi").select("item").distinct()
        left = stash(open_.join(had, "item", "left_anti"), "cover")
        drop(open_, gains)
        open_, chosen, k = left, taken if chosen is None else chosen.unionByName(taken), k + 1
    return chosen if chosen is not None else open_.select(F.lit(0).alias("round"), "key", F.lit(0).cast("long").alias("new"))


def having_all(members: DataFrame, required: DataFrame, group: str, item: str) -> DataFrame:
    """(group, n_had, complete, missing): of each group how many of the required items it has, whether all, and those it lacks, sorted.

    ``required`` is a stated set, small beside the data: it goes into each row of the result that
    lacks something. Members that nobody requires are dropped before they are shuffled; each
    group and item counts once. A group without any required member lacks all; null groups are a
    group, null items are no items; of no required items each group has all.
    """
    wanted = required.where(F.col(item).isNotNull()).select(item).distinct()
    whole = wanted.agg(F.sort_array(F.collect_list(item)).alias("_all"))
    found = members.join(F.broadcast(wanted), item, "left_semi").select(group, item).distinct()
    had = found.groupBy(F.col(group).alias("_g")).agg(F.collect_list(item).alias("_had"))
    own = members.select(group).distinct().join(had, F.col(group).eqNullSafe(F.col("_g")), "left").join(F.broadcast(whole))
    lacks = F.when(F.col("_had").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_had"))
    n = F.coalesce(F.size("_had"), F.lit(0)).cast("long")
    return own.select(group, F.when(F.col("_had").isNull(), F.lit(0).cast("long")).otherwise(n).alias("n_had"), (F.size(lacks) == 0).alias("complete"), lacks.alias("missing"))
