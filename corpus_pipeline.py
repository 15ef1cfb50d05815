"""A corpus pipeline: quality, near duplicates, benchmark passages, personal data, token ids.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontaminate, neardup, pii, quality
from folioscope.llm.common import Workspace, table
from folioscope.llm.queries import tokenizer_path


#: Documents whose shingle sets are at least so alike are near duplicates.
PERCENT = 80


#: Bytes of a batch between Spark and its Python workers while ``run`` lasts: what bounds their memory where texts are long.
BATCH = 1 << 25


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; so do null texts and those without words. Rows that repeat id and text go the same way; other columns stay, whatever their names; an empty table stays empty."""
    return quality.select(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays; rows that share an id, or have none, are documents of their own.

    Null and empty texts are near nothing and stay; very long texts are compared whole; repeated rows are near duplicates; an empty table stays empty; other columns stay, whatever their names.
    """
    numbered = docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_number"))
    numbered = Workspace(spark, "numbered").stash(numbered, "rows")
    found = neardup.near_duplicates(numbered.select("_number", F.col("_row.text").alias("text")), percent=PERCENT, id_col="_number")
    ids = numbered.select(F.col("_number").alias("doc_id"), F.col("_row.doc_id").alias("_id"))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("doc_id"))
    stay = found.join(ids, "doc_id").groupBy("component_id").agg(F.min_by("doc_id", order).alias("_number"))
    return numbered.join(stay, "_number", "left_semi").select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none; repeated rows go the same way; very long texts are read whole; other columns stay, whatever their names."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind in brackets; n_chars follows the text.

    Null and empty texts stay as they are; very long texts are searched whole; repeated rows are redacted alike; an empty table stays empty; other columns stay, whatever their names.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document: doc_id, n_tokens, token_ids. Null and empty texts have none; null and repeated ids each have their row; no other column is kept."""
    ids = bpe.encode(docs, tokenizer_path())
    return ids.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("encoding", encode),
]

#: SQL has no BPE and no trained classifier; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; each one's result is written to the shared folder.

    Once it is, the scratch tables of the stage and the result before it are deleted, so that the
    folder holds two copies of the corpus at most beside a stage's own tables. Null, empty and very
    long texts, repeated rows, clashing columns and an empty table: as each stage states. While it
    lasts, batches for Python workers hold at most ``BATCH`` bytes; the session's setting is put back.
    """
    space, last = Workspace(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before_run = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH))
    try:
        for name, stage in STAGES:
            before = len(Workspace.kept)
            docs = space.stash(stage(spark, docs, sf_dir), name)
            for scratch in Workspace.kept[before:]:
                scratch.clear()
            if last:
                space.drop(last)
            last = name
    finally:
        spark.conf.unset(key) if before_run is None else spark.conf.set(key, before_run)
    return docs
