"""Tables that grow file by file: texts kept once, running counts, histories with back and forward.

Each is a Structured Streaming query that takes what has arrived, ends (``availableNow``) and goes on
from its checkpoint when it is started again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, files: int = 1000) -> DataFrame:
    """A stream of the rows of Parquet files as they arrive in a folder, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def _batched(target: str):
    """Writes each batch to a folder of its number: one that is run again after a failure replaces what it wrote."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return write


def keep_once(rows: DataFrame, text: str, target: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes each distinct text to ``target`` once, whichever file and run it comes in; null is a text.

    The state is a hash of 32 bytes a distinct text, spread over the shuffle partitions, in the state store.
    """
    hashed = rows.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("\0null")).cast("binary"), 256))
    once = hashed.dropDuplicates(["content_hash"])
    return once.writeStream.foreachBatch(_batched(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_by(rows: DataFrame, key: str, text: str, target: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes the running counts and characters of each key that a batch has changed; the last batch's counts."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
    return counts.writeStream.outputMode("update").foreachBatch(_batched(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str) -> DataFrame:
    """Of what ``count_by`` has written, each key's last counts."""
    written = spark.read.parquet(target)
    last = F.max_by(F.struct("n", "chars"), "batch")
    return written.groupBy(key).agg(last.alias("_last")).select(key, "_last.*")


def step(pages: list, place: int, move: str | None, page: str | None) -> tuple[list, int]:
    """One move of a history: its pages and the number of the page shown, 0 before any."""
    if move == "back":
        return pages, max(place - 1, min(place, 1))
    if move == "forward":
        return pages, min(place + 1, len(pages))
    if place and pages[place - 1] == page:
        return pages, place
    return [*pages[:place], page], place + 1


def replayed(events: DataFrame, user: str, order: str, move: str, page: str) -> DataFrame:
    """A stream of (user, order, shown, depth): ``operators.navigation.replay`` for events that arrive in order of batches.

    A user's history is its state; within a batch, rows are taken by ``order``.
    """
    shape = f"{user} long, {order} long, shown string, depth long"

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, place = json.loads(state.get[0]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for at, m, p in zip(rows[order], rows[move], rows[page], strict=True):
            pages, place = step(pages, place, m, None if pd.isna(p) else p)
            out.append((key[0], at, pages[place - 1] if place else None, place))
        state.update((json.dumps([pages, place]),))
        yield pd.DataFrame(out, columns=[user, order, "shown", "depth"])

    rows = events.select(user, order, move, page)
    return rows.groupBy(user).applyInPandasWithState(go, shape, "history string", "append", GroupStateTimeout.NoTimeout)
