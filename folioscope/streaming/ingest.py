"""Containers as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.sources.container import decode

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, path: str, glob: str = "*.{hlp,mvb,HLP,MVB}") -> DataFrame:
    """The records of files under a path as they arrive (a streaming DataFrame); one batch decodes a file once."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema(FILE).load(path)
    return decode(files)
