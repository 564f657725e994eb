"""Row filters of manifests, pairs and labelled tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def within(value: Column, low: float | None, high: float | None) -> Column:
    """Inclusive bounds, None for none."""
    keep = F.lit(True)
    if low is not None:
        keep = keep & (value >= low)
    if high is not None:
        keep = keep & (value <= high)
    return keep


def filter_stats(df: DataFrame, seconds: Column, keep: Column) -> DataFrame:
    """(kept, filtered: rows; kept_hours, filtered_hours) in one pass."""
    return df.agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("filtered"),
        F.round(F.coalesce(F.sum(F.when(keep, seconds)), F.lit(0.0)) / 3600, 6).alias("kept_hours"),
        F.round(F.coalesce(F.sum(F.when(~keep, seconds)), F.lit(0.0)) / 3600, 6).alias("filtered_hours"),
    )


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows by `order`; None and 0 keep all."""
    return df if n in (None, 0) else df.orderBy(*order).limit(n)


def good_pair(source: Column, target: Column, *, most: int = 128, least: int = 3, apart: int = 25, ratio: float = 2.5) -> Column:
    """Whether a sentence pair is fit for translation, by the token counts of its sides."""
    quotient = F.greatest(source - 2, F.lit(1)) / F.greatest(target - 2, F.lit(1))
    inside = source.between(least, most) & target.between(least, most)
    return inside & (F.abs(source - target) <= apart) & quotient.between(1 / ratio, ratio)


def short_pair(a: str, b: str, limit: int = 10) -> Column:
    return (F.size(F.split(a, " ")) < limit) & (F.size(F.split(b, " ")) < limit)


def known_pairs(pairs: DataFrame, vocabulary: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """The pairs whose words, of both sides, all stand in vocabulary(word): rows that hold
    a word outside it are found by an anti join and dropped by another."""
    used = pairs.select(*key, F.explode(F.array_distinct(F.concat(words(F.col(a)), words(F.col(b))))).alias("word"))
    return pairs.join(used.join(vocabulary, "word", "left_anti").select(*key).distinct(), key, "left_anti")


def file_exists(spark, *paths: str) -> bool:
    """Whether all paths exist, in any file system that Spark reads."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return False
    return True
