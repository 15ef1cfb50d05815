"""Contents files (text beside a container) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.search import contents_parent

DIRECTIVE = r"^:(Title|Base|Index|Include|Link|Tab)\b\s*(.*)$"
ENTRY = r"^(\d+)\s+([^=]*?)\s*(?:=\s*(.*?)\s*)?$"


def scan(spark: SparkSession, path: str, glob: str = "*.{cnt,CNT}") -> DataFrame:
    """(file, ord, kind, level, label, reference) of each line that says something.

    Kinds: title, base, index, include (reported, never followed), book (an entry without a
    reference), topic, and error for a line that is none of these. Comments and empty lines are
    left out. Lines may end in any way.
    """
    whole = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path, wholetext=True)
    lines = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("ord", "line"))
    return parsed(lines)


def parsed(lines: DataFrame) -> DataFrame:
    """What ``scan`` says of lines (file, ord, line) from anywhere; a null line says nothing."""
    lines = lines.withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, ';')")
    word = F.lower(F.regexp_extract("line", f"(?i){DIRECTIVE}", 1))
    level = F.regexp_extract("line", ENTRY, 1)
    reference = F.nullif(F.regexp_extract("line", ENTRY, 3), F.lit(""))
    kind = F.when(word != "", word).when(level == "", "error").when(reference.isNull(), "book").otherwise("topic")
    label = F.when(word != "", F.regexp_extract("line", f"(?i){DIRECTIVE}", 2)).when(level == "", F.col("line")).otherwise(F.regexp_extract("line", ENTRY, 2))
    return lines.select("file", "ord", kind.alias("kind"), F.when((level != "") & (word == ""), level.cast("int") - 1).alias("level"), label.alias("label"), F.when(word == "", reference).alias("reference"))


def tree(entries: DataFrame) -> DataFrame:
    """Books and topics with the ord of their parent."""
    return contents_parent(entries.where("kind in ('book', 'topic')"), ["file"], "ord", "level")


def write_lines(titles: DataFrame, names: DataFrame, windows: DataFrame) -> DataFrame:
    """Contents lines from titles, context names and windows of topic offsets: (file, topic_offset, line)."""
    key = ["file", "topic_offset"]
    joined = titles.join(names.groupBy(*key).agg(F.min("name").alias("name")), key).join(windows, key, "left")
    window = F.when(F.col("window").isNotNull(), F.concat(F.lit(">"), F.col("window").cast("string"))).otherwise("")
    return joined.select(*key, F.concat(F.lit("1 "), F.col("title"), F.lit("="), F.col("name"), window).alias("line"))
