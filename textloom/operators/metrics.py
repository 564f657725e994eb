"""Corpus metrics: error rates, n-gram translation scores, answers, classification, dialogue."""

from __future__ import annotations

from collections import Counter
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import edit_distance
from .order import running_total


def character_error_rate(hypothesis: Column, reference: Column) -> Column:
    """sum(edits) / sum(reference characters), infinite without any."""
    n = F.sum(F.char_length(reference))
    return F.when(n == 0, float("inf")).otherwise(F.sum(F.levenshtein(hypothesis, reference)) / n)


def word_error_rate(hypothesis: Column, reference: Column) -> Column:
    """The same over arrays of words."""
    n = F.sum(F.size(reference))
    return F.when(n == 0, float("inf")).otherwise(F.sum(edit_distance(hypothesis, reference)) / n)


#: Sentences that are Python objects at once; the rest of a batch stays Arrow's.
ROWS = 200


def _matched(batches, keys: int, low: int, high: int):
    """Key columns, hypothesis, references -> key columns, order, correct, both totals."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            rows, counts = [], []
            columns = [c.to_pylist() for c in batch.columns[keys:]]
            for k, (hypothesis, *references) in enumerate(zip(*columns, strict=True)):
                for n in range(low, high + 1):
                    h, *others = (Counter(zip(*(tokens[j:] for j in range(n)), strict=False)) for tokens in (hypothesis or (), *(r or () for r in references)))
                    r = reduce(lambda a, b: a | b, others)  # of several references the greater count
                    if h or r:
                        rows.append(k)
                        counts.append((n, (h & r).total(), h.total(), r.total()))
            out = list(zip(*counts, strict=True)) if counts else [()] * 4
            kept = pa.array(rows, pa.int64())
            own = [c.take(kept) for c in batch.columns[:keys]]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:])],
                [*batch.schema.names[:keys], "order", "correct", "hypothesis_total", "reference_total"],
            )


def matched_ngrams(pairs: DataFrame, keys: list[str], hypothesis: str, reference: str | list[str], low: int, high: int) -> DataFrame:
    """(keys, order, correct, hypothesis_total, reference_total) of each sentence; sentences
    without n-grams of an order have no row for it. Of several references each n-gram has its
    greatest count; a null one has none. Tokens are arrays, or strings for characters. Matches
    lie inside a row, so they are counted there and no n-gram is shuffled."""
    references = [reference] if isinstance(reference, str) else reference
    rows = pairs.select(*keys, hypothesis, *references)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)]]
    schema = ", ".join([*kinds, "order int, correct long, hypothesis_total long, reference_total long"])
    return rows.mapInArrow(partial(_matched, keys=len(keys), low=low, high=high), schema)


def bleu(correct: list[Column], total: list[Column], hypothesis_length: Column, reference_length: Column, *, smoothing: str = "exp", add: float = 1.0) -> Column:
    """BLEU (0 to 100) from clipped counts of each order. smoothing: exp (halving), floor
    (0.1), add-k (from the third order on) or none."""
    logs, halvings = [], F.lit(1.0)
    for k, (c, t) in enumerate(zip(correct, total, strict=True)):
        c, t = c.cast("double"), t.cast("double")
        if smoothing == "add-k" and k > 1:
            c, t = c + add, t + add
        precision = c / t
        if smoothing == "exp":
            halvings = F.when(c == 0, halvings * 2).otherwise(halvings)
            precision = F.when(c == 0, 1.0 / (halvings * t)).otherwise(precision)
        elif smoothing == "floor":
            precision = F.when(c == 0, 0.1 / t).otherwise(precision)
        logs.append(F.when((t > 0) & (precision > 0), F.log(precision)))
    brevity = F.when(hypothesis_length < reference_length, F.exp(1 - reference_length / hypothesis_length)).otherwise(1.0)
    mean = reduce(lambda a, b: a + b, logs) / len(logs)
    return F.coalesce(100 * brevity * F.exp(mean), F.lit(0.0))


def bleu_of_least(correct: list[Column], total: list[Column], hypothesis_length: Column, reference_length: Column, *, smooth: bool = False) -> Column:
    """BLEU (0 to 100) by the least reference length: brevity exp(1 - 1 / (ratio + 1e-6)) up to a ratio
    of 1; smooth: one more of each count; without, an order that matches nothing makes it 0."""
    precisions = [(c + 1) / (t + 1) if smooth else F.when(t > 0, c / t).otherwise(0.0) for c, t in zip(correct, total, strict=True)]
    ratio = hypothesis_length / reference_length
    brevity = F.when(ratio > 1, 1.0).otherwise(F.exp(1 - 1 / (ratio + 1e-6)))
    mean = reduce(lambda a, b: a + b, [F.log(p) for p in precisions]) / len(precisions)
    return F.when(F.least(*precisions) > 0, 100 * F.exp(mean) * brevity).otherwise(0.0)


def f_score(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    return F.when(precision + recall > 0, (1 + beta**2) * precision * recall / (beta**2 * precision + recall)).otherwise(0.0)


def class_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, tp, fp, fn) of every label that occurs."""
    both = df.select(F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit"), F.lit(0).alias("p")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(0).alias("hit"), F.lit(1).alias("p")),
    )).alias("x")).select("x.*")
    sums = both.groupBy("label").agg(F.sum("hit").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    return sums.select("label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))


def _rates() -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of class_counts(), 0 where there is nothing to divide by."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return p, r, f_score(p, r)


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support)."""
    p, r, f1 = _rates()
    return class_counts(df, truth, predicted).select(
        "label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), (F.col("tp") + F.col("fn")).alias("support")
    )


def f1_averages(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: macro, weighted and micro F1 in percent."""
    f1, support = _rates()[2], F.col("tp") + F.col("fn")
    return class_counts(df, truth, predicted).agg(
        (F.avg(f1) * 100).alias("macro"), (F.sum(f1 * support) / F.sum(support) * 100).alias("weighted"),
        (F.sum("tp") / F.sum(F.col("tp") + F.col("fp")) * 100).alias("micro"),
    )


def binary_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, F1 and Matthews correlation of 0/1 columns."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    c = df.agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p), ("tn", ~t & ~p))])
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"),
        F.when(under > 0, (tp * tn - fp * fn) / under).otherwise(0.0).alias("mcc"),
    )


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the average rank of `value` (ties share): counts of equal values, totalled."""
    counts = df.groupBy(value).agg(F.count("*").alias("__n"))
    placed = running_total(counts, value, F.col("__n"), "__before")
    return df.join(placed.select(value, (F.col("__before") + (F.col("__n") + 1) / 2).alias(out)), value)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n, share of the truth's rows)."""
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))  # classes squared


def _shared(a: Column, b: Column) -> Column:
    """How many tokens two arrays share, repeats counted as often as both hold them."""
    def many(tokens, token):
        return F.size(F.filter(tokens, lambda t: t == token))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, token: n + F.least(many(a, token), many(b, token)))


def token_f1(pairs: DataFrame, keys: list[str], predicted: str, gold: str | list[str]) -> DataFrame:
    """(keys, exact, f1) of answers as arrays of normalised tokens, the best over several gold
    answers (null ones aside); two empty answers agree. All inside the row: answers are short."""
    def scores(g):
        p, g = F.col(predicted), F.col(g)
        n_p, n_g, same = F.size(p), F.size(g), _shared(p, g)
        f1 = F.when((n_p == 0) | (n_g == 0), (n_p == n_g).cast("double")).otherwise(f_score(same / n_p, same / n_g))
        return F.when(g.isNotNull(), (p == g).cast("int")), F.when(g.isNotNull(), f1)

    exact, f1 = zip(*(scores(g) for g in ([gold] if isinstance(gold, str) else gold)), strict=True)
    best = (lambda cs: cs[0] if len(cs) == 1 else F.greatest(*cs))
    return pairs.select(*keys, best(exact).alias("exact"), best(f1).alias("f1"))


def best_threshold(df: DataFrame, probability: str, score: str, has_answer: str) -> DataFrame:
    """(threshold, best): answers whose no-answer probability exceeds the threshold count as
    none; start from all none, walk up the probabilities, take the first greatest total.
    Equal probabilities are one step, so the walk is over their aggregated sums."""
    steps = df.groupBy(probability).agg(
        F.sum(F.when(F.col(has_answer), F.col(score)).otherwise(-F.lit(1.0))).alias("gain"), F.count_if(~F.col(has_answer)).cast("double").alias("none")
    )
    start = steps.agg(F.coalesce(F.sum("none"), F.lit(0.0)).alias("start"))
    walk = running_total(steps, probability, F.col("gain"), "before").join(F.broadcast(start))  # one row
    walk = walk.select(F.col(probability).alias("threshold"), (F.col("start") + F.col("before") + F.col("gain")).alias("at"))
    every = walk.union(start.select(F.lit(0.0).alias("threshold"), F.col("start").alias("at")))
    return every.agg(F.max_by("threshold", F.struct("at", -F.col("threshold"))).alias("threshold"), F.max("at").alias("best"))
