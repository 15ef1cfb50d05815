"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontaminate, imatch, mixing, neardup, oracles, pii, quality, resampling, sharding, tokenfiles, toxicity, urls, variants
from folioscope.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates from 85 percent: doc_id, n_shingles, component_id, kept. Odd rows: as ``neardup.near_duplicates`` defines them."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded texts: doc_id, n_tokens, ids_sha256, decoded_sha256. Odd rows: as ``bpe.round_trip`` defines them."""
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged urls: page_id, host, path, rule, verdict. Bad: a page whose document is labelled of low quality or toxic. Odd rows: as ``urls.judge`` defines them."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), bad, URL_RULES)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written and read back: doc_id, start, n_tokens, ids_crc32. Odd rows: as ``tokenfiles.write`` and ``read`` define them."""
    folder = tokenfiles.new_folder(spark)
    manifest = tokenfiles.write(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), folder, end_id=0)
    return tokenfiles.read(spark, folder, manifest)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores: doc_id, held_out, score, predicted. Odd rows: as ``toxicity.score`` defines them."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.score(docs, labels)


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and of edited texts, and their likeness. Odd rows: as ``imatch.compare`` defines them."""
    return imatch.compare(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling: doc_id, log_weight, gumbel_key, selected. Odd rows: as ``quality.classify`` defines them."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.classify(docs, labels)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents share with the benchmark: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Odd rows: as ``decontaminate.decontaminate`` defines them."""
    docs, benchmark = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.decontaminate(docs, benchmark)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data: doc_id, counts and digest of base spans, all spans. Odd rows: as ``pii.detect`` defines them."""
    return pii.detect(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of equal numbers of rows, law ``rows``: doc_id, size, text_crc32, law, shard, slot, grown_shard. Null texts are empty; other odd rows: as ``sharding.shuffle`` defines them."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc.cast("long").alias("text_crc32"))
    out = sharding.shuffle(rows, 16, seed=10)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's texts: doc_id, n_features, weight, score, rank. Odd rows: as ``resampling`` defines them."""
    return resampling.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants: word, form, root, n, n_near, form_n. Odd rows: as ``variants`` defines them."""
    return variants.group_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target, copies, taken. Odd rows: as ``mixing`` defines them."""
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": op1_neardup,
    "op2_bpe": op2_bpe,
    "op3_urls": op3_urls,
    "op4_token_files": op4_token_files,
    "op5_toxicity": op5_toxicity,
    "op6_imatch": op6_imatch,
    "op7_quality": op7_quality,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_sharding": op10_sharding,
    "op11_resampling": op11_resampling,
    "op12_variants": op12_variants,
    "op13_mixing": op13_mixing,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_neardup": oracles.OP1_NEARDUP,
    "op8_decontaminate": oracles.OP8_DECONTAMINATE,
    "op11_resampling": oracles.OP11_RESAMPLING,
    "op12_variants": oracles.OP12_VARIANTS,
}
