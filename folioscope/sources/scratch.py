"""Written tables in the folder that the cluster shares, so that no executor's loss costs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local master, as in tests, gets one of its own where that is unset."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    context = spark.sparkContext
    if not (there := context._jsc.sc().getCheckpointDir()).isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
        there = context._jsc.sc().getCheckpointDir()
    return there.get().rstrip("/")


#: Where this driver's written tables lie; ``clear`` deletes what is left of them.
_kept: set[str] = set()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and returns it as read back: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    _kept.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    for t in tables:
        _kept.discard(t._scratch)
        _delete(t.sparkSession, t._scratch)


def clear(spark: SparkSession) -> None:
    """Deletes every written table of this driver: for one that runs many queries, once their results are written elsewhere."""
    while _kept:
        _delete(spark, _kept.pop())
