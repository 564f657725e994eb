"""The registered queries of the training-data operators: each reads its whole table,
calls its operator with production parameters and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .filter_audit import interaction_audit
from .html_extract import extract_text
from .langid import identify_languages
from .near_dedup import near_duplicates
from .packing import best_fit_packing
from .pii import span_digest
from .prefix_trie import conversation_trie
from .quality_model import score_quality
from .quality_rules import quality_rules
from .sharding import shard_documents
from .url_filter import filter_urls
from .warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2).select("doc_id", "n_shingles", "component_id", "kept")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(table(spark, sf_dir, "documents"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), special_tokens=True)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op11_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    splice = (lambda c: c - c % 20, lambda c: F.crc32(c.cast("string").cast("binary")) % 4, 3)
    return conversation_trie(table(spark, sf_dir, "conversations"), splice)


# What SQL can say of these operators, as queries of their own (see oracles.py).

def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_minhash_dedup(spark, sf_dir).select("doc_id", "n_shingles")


def base_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii_spans(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents; and of each law's shards that their bytes, and slots, are as the law says."""
    d = op3_histogram_shards(spark, sf_dir)
    shards = d.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("top"), F.count_distinct("slot").alias("slots"))
    even = shards.agg((F.max("bytes") - F.min("bytes") <= 2 * d.agg(F.max("size")).first()[0]).alias("even"), F.bool_and((F.col("top") + 1 == F.col("n")) & (F.col("slots") == F.col("n"))).alias("gapless"))
    return d.select("doc_id", "size").join(F.broadcast(even))  # one row


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality_rules(spark, sf_dir).drop("kept")


def token_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its first piece begins at 0 and every piece where the one before ends."""
    d = op8_best_fit_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("stop"), F.min("start").alias("start"))
    return d.select("doc_id", (F.col("n") == F.col("stop")).alias("whole"), "start")


COMPANIONS = (shingle_counts, base_pii_counts, shard_sizes, url_rules, base_quality_counts, token_sums)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return own | {f.__name__: f for f in COMPANIONS}
