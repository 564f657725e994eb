"""Figures of an evaluation epoch from its batches, descriptors of data sets by split, and labels that
must be known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from .metrics import bleu, f1_averages


def batch_means(df: DataFrame, batch: str, value: str) -> DataFrame:
    """One row: (batches, rows, of_batches: mean of the batches' means, of_rows). Null values count nowhere."""
    each = df.filter(F.col(value).isNotNull()).groupBy(batch).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.avg("mean").alias("of_batches"), (F.sum("total") / F.sum("n")).alias("of_rows"))


def gathered(df: DataFrame, keys: list[str], logits: str, labels: str, mask: str | None = None) -> DataFrame:
    """(keys, place, label, predicted) of the positions of a batch's rows: logits are an array of arrays,
    the greatest of each counts; where the mask is 0 there is no row."""
    parts = F.arrays_zip(F.transform(F.col(logits), argmax).alias("predicted"), F.col(labels).alias("label"), (F.col(mask) if mask else F.transform(F.col(labels), lambda _: F.lit(1))).alias("mask"))
    rows = df.select(*keys, F.posexplode(parts).alias("place", "p")).filter("p.mask != 0")
    return rows.select(*keys, "place", F.col("p.label").alias("label"), F.col("p.predicted").alias("predicted"))


def epoch_report(df: DataFrame, tasks: dict[str, tuple[str, str]]) -> DataFrame:
    """(task, rows, accuracy, macro, weighted, micro) of each task's (truth, predicted) columns; rows
    without a truth are left out of their task."""
    found = []
    for task, (truth, predicted) in tasks.items():
        own = df.filter(F.col(truth).isNotNull())
        same = own.agg(F.count("*").alias("rows"), F.avg(F.coalesce(F.col(truth) == F.col(predicted), F.lit(False)).cast("double")).alias("accuracy"))
        found.append(same.crossJoin(f1_averages(own, truth, predicted)).select(F.lit(task).alias("task"), "*"))  # one row each
    return reduce(DataFrame.unionByName, found)


def closest_length(hypothesis: Column, references: list[Column]) -> Column:
    """Of several lengths the one nearest to the hypothesis', the shorter of two; null ones aside."""
    return F.array_min(F.filter(F.array(*[F.when(r.isNotNull(), F.struct(F.abs(r - hypothesis).alias("apart"), r.alias("length"))) for r in references]), lambda x: x.isNotNull()))["length"]


def sentence_scores(counts: DataFrame, keys: list[str], lengths: DataFrame, orders: int = 4, smoothing: str = "exp") -> DataFrame:
    """(keys, bleu) of each sentence from matched_ngrams() and (keys, hypothesis_length,
    reference_length), by as many orders as it has n-grams of; without words, 0."""
    wide = counts.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("order") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in range(1, orders + 1) for c in ("correct", "hypothesis_total")])
    both = lengths.join(wide, keys, "left")
    score = F.lit(0.0)
    for k in range(1, orders + 1):  # of the longest order that it has n-grams of
        own = bleu([F.col(f"correct{j}") for j in range(1, k + 1)], [F.col(f"hypothesis_total{j}") for j in range(1, k + 1)], F.col("hypothesis_length"), F.col("reference_length"), smoothing=smoothing)
        score = F.when(F.col(f"hypothesis_total{k}") > 0, own).otherwise(score)
    return both.select(*keys, score.alias("bleu"))


def split_descriptors(df: DataFrame, split: str, label: str, trained: str = "train") -> DataFrame:
    """(split, label, n, share, weight, classes): labels are ids; weight is that of the label in the
    split `trained`, classes the greatest id of any split and one."""
    counts = df.groupBy(split, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(split).agg(F.sum("n").alias("total"))
    train = counts.filter(F.col(split) == trained)
    sums = train.agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    weights = train.crossJoin(sums).select(label, (F.col("all") / (F.col("kinds") * F.col("n"))).alias("weight"))  # one row
    top = counts.agg((F.max(label) + 1).cast("long").alias("classes"))
    out = counts.join(F.broadcast(totals), split).join(F.broadcast(weights), label, "left").crossJoin(top)  # one row; labels are few
    return out.select(split, label, "n", (F.col("n") / F.col("total")).alias("share"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "classes")


def known_ids(df: DataFrame, label: str, table: DataFrame, out: str = "id") -> DataFrame:
    """df with the id of its label from table (label, id); a label that the table lacks fails the job,
    a null one has no id."""
    ids = table.select(F.col("label").alias("__label"), F.col("id").alias("__id"))
    joined = df.join(ids, F.col(label) == F.col("__label"), "left")
    failed = F.raise_error(F.concat(F.lit("no id for the label "), F.col(label).cast("string"))).cast("long")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col(label).isNotNull() & F.col("__id").isNull(), failed).otherwise(F.col("__id")).alias(out))
