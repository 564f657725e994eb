"""A training corpus from the table `documents`: quality rules, near-duplicates, benchmark
decontamination, personal data, packing. Each stage takes all that the one before kept;
run() writes each stage's result to the shared folder and reads it for the next.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty
tables and further columns; all but the last return the columns that they got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import Shelf, drop_rows
from textloom.llm.decontaminate import benchmark_matches
from textloom.llm.near_dedup import near_duplicates
from textloom.llm.packing import best_fit_packing
from textloom.llm.pii import redact
from textloom.llm.quality_rules import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject (null and blank texts among them)."""
    shelf = Shelf(spark, "pipeline")
    rejected = shelf.put(quality_rules(docs).filter("not kept").select("doc_id", "text_hash"), "rejected")
    text = F.coalesce(F.col("text"), F.lit(""))
    return drop_rows(docs, rejected, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64(text)})


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicate texts (five-word shingles, 0.8): that of
    the least id, of that id's texts in the group one; of equal rows one. Texts that are near no
    other stay, whatever their id; so do rows without an id or without words."""
    shelf = Shelf(spark, "pipeline")
    judged = shelf.put(near_duplicates(docs).select("doc_id", "text_hash", "first", "component_key"), "judged")
    keys = {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64(F.col("text").cast("string"))}
    left = drop_rows(docs, judged.filter("not first"), keys)
    repeated = judged.filter("first and component_key is not null").groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash")
    if repeated.isEmpty():
        return left
    repeated = shelf.put(repeated, "repeated")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    again = left.select(row, *[mine.alias(f"__{c}") for c, mine in keys.items()])
    wanted = repeated.select(*[F.col(c).alias(f"__{c}") for c in keys])
    firsts = again.join(wanted, ["__doc_id", "__text_hash"], "left_semi").groupBy("__doc_id", "__text_hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return drop_rows(left, repeated, keys).unionByName(firsts)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a copy, edited or not, of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = Shelf(spark, "pipeline").put(benchmark_matches(docs, benchmark).select("doc_id", "text_hash"), "found")
    return drop_rows(docs, found, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64("text")})


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by its kind; n_chars follows the text."""
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", n_chars)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return best_fit_packing(docs, special_tokens=True)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminate),
    ("pii", personal_data),
    ("packing", pack),
]
#: Minima, alignments and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf = Shelf(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = shelf.put(stage(spark, docs, sf_dir), name)
        if k:
            shelf.drop(STAGES[k - 1][0])
    return docs
