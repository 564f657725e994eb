"""Features kept by a fingerprint of their source, and shards dealt anew each epoch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .filters import file_exists


def fingerprints(spark: SparkSession, folder: str, settings: dict) -> DataFrame:
    """(file, fingerprint) of the files below a folder: a digest of name, length and time of change, and
    of the settings; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    parts = F.concat_ws("|", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"), F.lit(json.dumps(settings, sort_keys=True)))
    return files.select(F.col("path").alias("file"), F.sha2(parts, 256).alias("fingerprint"))


def cached_features(spark: SparkSession, folder: str, settings: dict, build: Callable[[DataFrame], DataFrame], cache: str) -> tuple[DataFrame, int]:
    """What build() makes of the lines (file, value) of the text files below a folder, with their
    fingerprint, and how many files had to be built: those whose fingerprint the cache lacks. build()
    keeps the column file.

    A file's rows are one folder of the cache, which counts as soon as the index has its fingerprint:
    what a lost run has left is built again, over itself. Rows of other fingerprints are passed over."""
    wanted = fingerprints(spark, folder, settings)
    index = f"{cache}/index"
    missing = wanted
    if file_exists(spark, index):
        missing = wanted.join(spark.read.schema("file string, fingerprint string").parquet(index), "fingerprint", "left_anti")
    missing = [(r["file"], r["fingerprint"]) for r in missing.select("file", "fingerprint").collect()]  # names of files
    if missing:
        named = spark.createDataFrame(missing, "file string, fingerprint string")
        lines = spark.read.text([f for f, _ in missing]).select(F.col("_metadata.file_path").alias("__path"), "value")
        # Names as the two readers give them differ in slashes and escapes alone.
        plain = lambda c: F.url_decode(F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "^file:/+", "/"))
        rows = build(lines.withColumn("file", plain(F.col("__path"))).drop("__path"))
        rows = rows.join(F.broadcast(named.select(plain(F.col("file")).alias("file"), "fingerprint")), "file")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(f"{cache}/rows")
        named.coalesce(1).write.mode("append").parquet(index)
    found = spark.read.parquet(f"{cache}/rows").join(F.broadcast(wanted.select("fingerprint")), "fingerprint")
    return found, len(missing)


def epoch_order(df: DataFrame, shard: str, key: str, epoch: int, seed: int = 0) -> DataFrame:
    """df with `turn`, the place of its shard, and `place`, its own inside the shard (both from 0): each
    epoch has orders of its own, the same on any cluster. Shards are few; one is a task's."""
    digest = lambda c: F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), F.col(c).cast("string")))
    shards = df.select(shard).distinct()
    turns = shards.select(shard, (F.row_number().over(Window.orderBy(digest(shard), shard)) - 1).cast("long").alias("turn"))  # a row for each shard
    place = (F.row_number().over(Window.partitionBy(shard).orderBy(digest(key), key)) - 1).cast("long")
    return df.join(F.broadcast(turns), shard).withColumn("place", place)
