"""Decodes containers under a path and writes their tables.

    spark-submit -m folioscope IN OUT [--format parquet|json] [--html]
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from folioscope.functions.text import html_escape, label
from folioscope.session import session
from folioscope.sources import container


def pages(views: dict, texts):
    """One page of HTML a file: a table of contents and a section a topic, in order."""
    topics = views["topic"].join(texts.withColumnRenamed("topic", "ord"), ["file", "ord"], "left")
    title = html_escape(label(F.col("title"), F.col("ord") + 1))
    body = F.replace(html_escape(F.coalesce("text", F.lit(""))), F.lit("\n"), F.lit("<br>"))
    anchor = F.concat(F.lit("topic-"), F.col("ord"))
    part = F.concat(F.lit('<section id="'), anchor, F.lit('"><h2>'), title, F.lit("</h2><p>"), body, F.lit("</p></section>"))
    entry = F.concat(F.lit('<li><a href="#'), anchor, F.lit('">'), title, F.lit("</a></li>"))
    gathered = topics.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ord", entry.alias("e"), part.alias("p")))).alias("t"))
    listed = lambda c: F.array_join(F.transform("t", lambda x: x[c]), "")
    return gathered.select("file", F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><ul>'), listed("e"), F.lit("</ul>"), listed("p"), F.lit("</body></html>")).alias("html"))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--format", choices=["parquet", "json"], default="parquet")
    parser.add_argument("--html", action="store_true", help="also write a page of each file")
    asked = parser.parse_args(args)
    spark = session("folioscope")
    # decoded once; every table below reads these files
    container.scan(spark, asked.source).write.mode("overwrite").partitionBy("kind").parquet(f"{asked.target}/records")
    records = spark.read.schema(container.RECORD).parquet(f"{asked.target}/records")
    views = container.tables(records)
    for kind, view in views.items():
        if asked.format == "json":  # binary columns become base64
            view = view.select(*(F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in view.dtypes))
        view.write.mode("overwrite").format(asked.format).save(f"{asked.target}/{kind}")
    if asked.html:
        pages(views, container.topic_texts(records)).write.mode("overwrite").parquet(f"{asked.target}/html")
    return int(views["topic"].isEmpty() and not views["error"].isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
