"""Bags (tables of keys, items and counts) and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bag(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    return df.groupBy(*keys, item).agg(F.count("*").alias("n"))


def intersection(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Items of both with the lesser count."""
    return a.join(b.withColumnRenamed("n", "__n"), on).withColumn("n", F.least("n", "__n")).drop("__n")


def union_max(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Items of either with the greater count."""
    return a.select(*on, "n").unionByName(b.select(*on, "n")).groupBy(*on).agg(F.max("n").alias("n"))


def gram_array(tokens: str, low: int, high: int) -> Column:
    """array<struct<order, gram>>: n-grams of low to high tokens, joined by a space."""
    def of(k):
        many = F.transform(F.sequence(F.lit(1), F.size(tokens) - k + 1), lambda i: F.array_join(F.slice(tokens, i, k), " "))
        grams = F.when(F.size(tokens) >= k, many).otherwise(F.array().cast("array<string>"))
        return F.transform(grams, lambda g: F.struct(F.lit(k).alias("order"), g.alias("gram")))

    return F.concat(*[of(k) for k in range(low, high + 1)])


def ngrams(df: DataFrame, keys: list[str], tokens: str, low: int, high: int) -> DataFrame:
    """(keys, order, gram, n): the counts of gram_array()."""
    each = df.select(*keys, F.explode(gram_array(tokens, low, high)).alias("g"))
    return each.select(*keys, "g.order", "g.gram").groupBy(*keys, "order", "gram").agg(F.count("*").alias("n"))
