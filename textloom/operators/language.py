"""N-gram language models as tables: counts, and probabilities with backoff by absolute discounting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is taken from each count and given to what was not seen.
DISCOUNT = 0.5
#: Parts the symbols of a context.
MARK = "\x1f"
#: Most n-grams that are sent to all tasks.
MOST_GRAMS = 2_000_000


def ngram_counts(sequences: DataFrame, column: str, order: int) -> DataFrame:
    """(context, symbol, size, n) of all runs of 1 to `order` symbols in the arrays of `column`; the context
    is what stands before the last symbol, joined by MARK. A null or empty array has none."""
    a = F.col(column)

    def runs_of(k: int):
        def run(i):
            return F.struct(F.array_join(F.slice(a, i, F.lit(k - 1)), MARK).alias("context"), F.get(a, i + k - 2).alias("symbol"), F.lit(k).alias("size"))

        return F.transform(F.sequence(F.lit(1), F.size(a) - k + 1), run)

    none = F.array().cast("array<struct<context:string,symbol:string,size:int>>")
    every = F.concat(*[F.when(F.size(a) >= k, runs_of(k)).otherwise(none) for k in range(1, order + 1)])
    return sequences.filter(a.isNotNull()).select(F.inline(every)).groupBy("context", "symbol", "size").agg(F.count("*").alias("n"))


def backoff_model(counts: DataFrame, vocabulary: int, order: int, discount: float = DISCOUNT) -> DataFrame:
    """(context, symbol, size, p, weight): p is the probability of a symbol after its context; weight, with a
    null symbol, is what multiplies the probability after the context less its first symbol where
    a symbol was not seen. A symbol never seen at all has the empty context's weight / vocabulary.

    Each order is joined with the one below it on (shorter context, symbol); the shorter run is
    always there, as it ends every longer one."""
    shorter = F.when(F.contains("context", F.lit(MARK)), F.expr(f"substring(context, instr(context, '{MARK}') + 1)")).otherwise(F.lit(""))
    sums = counts.groupBy("context", "size").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    weights = sums.select("context", "size", "total", (F.lit(discount) * F.col("kinds") / F.col("total")).alias("weight"))
    seen = counts.join(weights, ["context", "size"]).withColumn("own", F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")).withColumn("shorter", shorter)
    level = seen.filter("size = 1").select("context", "symbol", "size", (F.col("own") + F.col("weight") / vocabulary).alias("p"))
    out = level
    for k in range(2, order + 1):
        below = level.select(F.col("context").alias("shorter"), "symbol", F.col("p").alias("below"))
        level = seen.filter(F.col("size") == k).join(below, ["shorter", "symbol"]).select("context", "symbol", "size", (F.col("own") + F.col("weight") * F.col("below")).alias("p"))
        out = out.union(level)
    own = out.withColumn("weight", F.lit(None).cast("double"))
    return own.union(weights.select("context", F.lit(None).cast("string"), "size", F.lit(None).cast("double"), "weight"))


class Backoff:
    """A model's table in a task: log probabilities of a symbol after others."""

    def __init__(self, rows: list[tuple], vocabulary: int, order: int):
        self.p = {(c, s): math.log(p) for c, s, p, _ in rows if s is not None}
        self.weight = {c: math.log(w) if w > 0 else -math.inf for c, s, _, w in rows if s is None}
        self.nothing, self.order = -math.log(vocabulary), order
        self.known: dict = {}

    def log(self, before: tuple[str, ...], symbol: str) -> float:
        before = before[max(0, len(before) - self.order + 1) :]
        if (before, symbol) not in self.known:
            total, left = 0.0, before
            while (x := self.p.get((MARK.join(left), symbol))) is None:
                total += self.weight.get(MARK.join(left), 0.0)
                if not left:
                    x = self.nothing
                    break
                left = left[1:]
            self.known[before, symbol] = total + x
        return self.known[before, symbol]


def collected(model: DataFrame, vocabulary: int, order: int, most: int = MOST_GRAMS) -> Backoff:
    """A model of at most `most` rows, for a broadcast; a larger one is an error."""
    rows = model.select("context", "symbol", "p", "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a model of more than {most} n-grams: count fewer orders, or drop rare runs")
    return Backoff(rows, vocabulary, order)
