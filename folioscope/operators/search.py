"""Search, keyword indexes, links and their resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import fold
from folioscope.operators.relational import WIDTH

HREF = r'<a [^>]*href="([^"]*)"'


def all_terms(hay: Column, query: str) -> Column:
    """Whether every word of the query is a substring, whatever the case; an empty query fits all.

    The text is folded once for all words.
    """
    terms = query.casefold().split()
    has_all = lambda h: reduce(lambda a, b: a & b, (F.contains(h, F.lit(t)) for t in terms))
    return F.exists(F.array(fold(hay)), has_all) if terms else F.lit(True)


def prefix_else_contains(df: DataFrame, column: str, text: str, limit: int, *order: str) -> DataFrame:
    """Rows that start with a text or, if none does, rows that contain it; the first ``limit``."""
    kind = F.when(F.startswith(fold(F.col(column)), F.lit(text.lower())), 1).when(F.contains(fold(F.col(column)), F.lit(text.lower())), 2)
    ranked = df.withColumn("_kind", kind).where("_kind is not null")
    best = ranked.agg(F.min("_kind").alias("_best"))
    return ranked.join(F.broadcast(best), F.col("_kind") == F.col("_best")).drop("_kind", "_best").orderBy(*order).limit(limit)


def inverted_index(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(keyword, key), one row for each distinct word of each row; counts by ``postings``."""
    return df.select(key, F.explode(F.array_distinct(words)).alias("keyword")).where("keyword <> ''")


#: A block of a keyword's postings covers so many keys.
POSTINGS = 4096


def postings(index: DataFrame, key: str) -> DataFrame:
    """Each keyword's keys in order, joined by commas, a row for each block of ``POSTINGS`` key values.

    So that no keyword, however common, makes a row beyond that size.
    """
    listed = F.array_join(F.transform(F.sort_array(F.collect_set(key)), lambda k: k.cast("string")), ",")
    blocks = index.groupBy("keyword", F.floor(F.col(key) / POSTINGS).alias("block")).agg(F.collect_set(key).alias("_"), listed.alias("keys"))
    return blocks.select("keyword", "block", F.size("_").cast("long").alias("n"), "keys")


def headings(entries: DataFrame) -> DataFrame:
    """Entries "parent,child" at level 1 and others at level 0, with parents that no entry names."""
    parent = F.trim(F.split_part(F.col("keyword"), F.lit(","), F.lit(1)))
    child = F.contains("keyword", F.lit(","))
    own = entries.select("keyword", F.when(child, 1).otherwise(0).alias("level"), F.lit(False).alias("made"))
    parents = entries.where(child).select(parent.alias("keyword")).distinct()
    missing = parents.join(entries.select("keyword").distinct(), "keyword", "left_anti")
    return own.unionByName(missing.select("keyword", F.lit(0).alias("level"), F.lit(True).alias("made")))


def links(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, target) of each link of a page, in order."""
    return df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("ord", "target"))


def resolved(target: Column) -> Column:
    """The kind of a target by its grammar: macro, external, topic, popup, context."""
    return (
        F.when(F.startswith(target, F.lit("macro:")), "macro")
        .when(F.contains(target, F.lit("@")) | target.rlike("^(file|window|https?):"), "external")
        .when(target.rlike("^(topic|popup):TOPIC[0-9]+$"), "topic")
        .when(target.rlike("^(topic|popup):[0-9A-Fa-f]{1,8}$"), "hash")
        .when(target.rlike("^topic_offset:[0-9]+$"), "offset")
        .otherwise("context")
    )


def split_reference(target: Column) -> tuple[Column, Column, Column]:
    """Context, window and file of ``context>window@file``."""
    pattern = r"^([^>@]*)(?:>([^@]*))?(?:@(.*))?$"
    return tuple(F.regexp_extract(target, pattern, k) for k in (1, 2, 3))


def dangling(links_: DataFrame, known: DataFrame, target: str) -> DataFrame:
    """Links whose target nothing has."""
    return links_.join(known.select(F.col(target)).distinct(), target, "left_anti")


def keyword_stats(df: DataFrame, by: str, keyword: str, order: str) -> DataFrame:
    """Counts and lengths of keywords for each key and in total; of equal lengths the first counts."""
    n = F.length(keyword)
    first = lambda sign: F.min_by(keyword, F.struct((sign * n).alias("n"), F.col(order).alias("o")))
    return df.rollup(by).agg(
        F.count("*").alias("total"),
        F.count_distinct(keyword).alias("uniq"),
        F.round(F.avg(n.cast("double")), 6).alias("avg_len"),
        F.max(n).cast("long").alias("max_len"),
        F.min(n).cast("long").alias("min_len"),
        first(-1).alias("longest"),
        first(1).alias("shortest"),
    )


#: Contents entries have levels below this.
LEVELS = 10


def contents_parent(df: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """Each entry with the ``order`` (a number) of the nearest earlier entry of a smaller level (its parent).

    Buckets of positions take over each level's last entry from those before, so that a single
    list of any length is cut into tasks.
    """
    at = lambda k: F.max(F.when(F.col(level) == k, F.col(order)))
    cut = df.withColumn("_bucket", F.floor(F.col(order) / WIDTH))
    tops = cut.groupBy(*by, "_bucket").agg(*(at(k).alias(f"_{k}") for k in range(LEVELS)))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "_bucket", *(F.max(f"_{k}").over(earlier).alias(f"_{k}") for k in range(LEVELS)))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = cut.withColumns({f"_in{k}": at(k).over(inside) for k in range(LEVELS)}).join(tops, [*by, "_bucket"])
    last = [F.when(F.lit(k) < F.col(level), F.coalesce(f"_in{k}", f"_{k}")) for k in range(LEVELS)]
    return found.select(*df.columns, F.greatest(*last).alias("parent"))
