"""URL filters: rules given by hand, and token combinations that FP-growth mines from labels.

A url's tokens are the labels of its host, the segments of its path (numbers as #) and the names
of its query's parameters. Labelled urls, with their label as one more item, go to Spark's
FP-growth; association rules whose consequence is the bad label, and whose support and confidence
reach their limits, block the urls that hold all tokens of one. They are matched by an inverted
index: each token of a distinct url meets the rules that have it, and a rule holds where as many
of its tokens met as it has. A url under a rule given by hand isn't judged by mined ones.

Mining uses at most ``SAMPLE`` labelled rows, those of the least hash of their id. A rule rests on
``LEAST_COUNT`` rows at least, whatever their share, and must reach its confidence again on a third
of the rows that it wasn't mined from; so labels that don't go with urls give no rules at any size.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Workspace

SAMPLE = 20_000
LEAST_SUPPORT, LEAST_CONFIDENCE = 0.005, 0.8
LEAST_COUNT, LEAST_HELD = 20, 5
BAD = "=bad"


def host(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z in small letters."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    segments = F.transform(F.split(F.lower(path(url)), "/"), lambda s: F.concat(F.lit("/"), F.regexp_replace(s, "[0-9]+", "#")))
    names = F.transform(F.split(F.lower(query), "&"), lambda s: F.concat(F.lit("?"), F.split(s, "=")[0]))
    every = F.concat(F.split(host(url), "\\."), segments, names)
    return F.array_distinct(F.filter(every, lambda t: F.length(t) > F.when(t.rlike("^[/?]"), 1).otherwise(0)))


def ruled(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. Rules: (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_ == h) | F.endswith(host_, F.lit(f".{h}"))) & F.startswith(path_, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, sample: int = SAMPLE, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Rules from rows of (id, url, bad): ``rule`` number, ``token`` and ``size``, one row a token."""
    rows = labelled.where("url is not null and bad is not null").orderBy(F.xxhash64(F.lit(3), "id"), "id", "url", "bad").limit(sample)
    rows = rows.select("url", "bad", (F.pmod(F.xxhash64(F.lit(4), "id", "url"), F.lit(3)) == 0).alias("held"))
    rows = Workspace(labelled.sparkSession, "urls").stash(rows, "sample")
    learnt, held = rows.where("not held"), rows.where("held")
    n = learnt.count()
    if n < LEAST_COUNT:
        return labelled.sparkSession.createDataFrame([], "rule long, token string, size int")
    bad = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    model = FPGrowth(itemsCol="items", minSupport=max(support, LEAST_COUNT / n), minConfidence=confidence).fit(learnt.select(F.concat(tokens(F.col("url")), bad).alias("items")))
    rules = model.associationRules.where(F.col("consequent")[0] == BAD).select(F.array_sort("antecedent").alias("tokens"))
    rules = rules.select(F.xxhash64("tokens").alias("rule"), F.explode("tokens").alias("token"), F.size("tokens").alias("size")).distinct()
    shown = held.join(_met(held, rules), "url").groupBy("rule").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    good = shown.where((F.col("n") >= LEAST_HELD) & (F.col("bad") >= confidence * F.col("n"))).select("rule")
    return rules.join(good, "rule", "left_semi")


def _met(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule) of distinct urls that hold all tokens of a rule, by an inverted index."""
    every = urls.select("url").where("url is not null").distinct().withColumn("token", F.explode(tokens(F.col("url"))))
    met = every.join(rules, "token").groupBy("url", "rule", "size").agg(F.count("*").alias("n"))
    return met.where("n = size").select("url", "rule")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that hold all tokens of a mined rule."""
    return _met(urls, rules).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: id, ``host``, ``path``, ``rule`` and ``verdict``.

    ``labels`` has the id and ``bad`` (boolean); null labels teach nothing. A null url, or one
    without ://, has an empty host and path and is allowed. Without bad labels, or with fewer than
    ``LEAST_COUNT`` labelled urls to mine, nothing is mined. Very long urls are judged whole;
    repeated rows and ids each have their row, and an empty table gives an empty one. No column but
    the named is read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    labelled = rows.join(labels.select(F.col(id_col).alias("id"), "bad"), "id")
    blocked = matched(rows, mine(labelled)).withColumn("blocked", F.lit(True))
    out = rows.join(blocked, "url", "left").select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "blocked")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
