"""Label statistics, class weights, length statistics, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_stats(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of each label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): all rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select(label, (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def dense_weights(spark, weights: DataFrame, label: str, top: int) -> DataFrame:
    """(id, weight) for ids 0 to top, 1.0 where there is none."""
    ids = spark.range(top + 1)
    return ids.join(weights.withColumnRenamed(label, "id"), "id", "left").select("id", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def length_stats(df: DataFrame, length: str, *keys: str) -> DataFrame:
    """Exact min, max, mean, median, 75th and 99th percentile (linear interpolation)."""
    return df.groupBy(*keys).agg(
        F.min(length).cast("long").alias("min"), F.max(length).cast("long").alias("max"), F.avg(length).alias("mean"),
        F.median(length).alias("median"), F.percentile(length, F.lit(0.75)).alias("p75"), F.percentile(length, F.lit(0.99)).alias("p99"),
    )


def weighted_mean(value, weight):
    return F.sum(value * weight) / F.sum(weight)


def perplexity(loss):
    return F.exp(F.avg(loss))


def split_averages(df: DataFrame, flag: str, value: str) -> DataFrame:
    """(flag, mean * 100, n): over all rows (flag null) and for each flag, in one pass."""
    return df.groupingSets([[], [flag]], flag).agg((F.avg(value) * 100).alias("score"), F.count("*").alias("n"))
