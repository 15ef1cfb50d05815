"""Streams that stop and are started again give what the batch query gives."""

from paths import SF
from pyspark.sql import functions as F

from folioscope.operators.navigation import replay
from folioscope.streaming import arrivals


def _arrive(df, folder, number):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{number}")


def test_texts_once_and_counts_over_restarts(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    # later files bring back texts of earlier ones
    parts = [docs.where("doc_id < 80"), docs.where("doc_id between 60 and 140"), docs.where("doc_id > 120").union(docs.limit(10))]
    folder = tmp_path / "in"
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(folder))
        rows = arrivals.arriving(spark, str(folder), docs.schema, files=1)
        arrivals.keep_once(rows, "text", str(tmp_path / "once"), str(tmp_path / "c1")).awaitTermination()
        arrivals.count_by(rows, "source", "text", str(tmp_path / "counts"), str(tmp_path / "c2")).awaitTermination()
        if k == 1:  # started again with nothing new
            arrivals.keep_once(rows, "text", str(tmp_path / "once"), str(tmp_path / "c1")).awaitTermination()
    every = parts[0].union(parts[1]).union(parts[2])
    once = [r[0] for r in spark.read.parquet(str(tmp_path / "once")).select("text").collect()]
    assert sorted(map(str, once)) == sorted(str(r[0]) for r in every.select("text").distinct().collect())
    want = every.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    got = arrivals.latest(spark, str(tmp_path / "counts"), "source")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_histories_over_restarts(spark, tmp_path):
    move = F.when(F.col("event_type") == "error", "back").when(F.col("event_type") == "signup", "forward").otherwise("visit")
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 300").select("event_id", "user_id", move.alias("move"), F.col("event_type").alias("page"))
    for k in range(3):
        events.where((F.col("event_id") >= k * 100) & (F.col("event_id") < k * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = arrivals.arriving(spark, str(tmp_path / "in"), events.schema)
        out = arrivals.replayed(rows, "user_id", "event_id", "move", "page")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id", "user_id", "shown", "depth")
    want = replay(events, "user_id", "event_id", "move", "page").select("event_id", "user_id", "shown", "depth")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
