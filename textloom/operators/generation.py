"""Generators of sequences from a table of transitions: greedy, beam search with length penalty,
sampling among the k likeliest. All prompts take a step together, as a join with the table. Where
that holds bare counts, only states that the prompts reach are ranked, each when it is first met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept

#: So many states with their likeliest tokens are sent to all tasks; beyond it a step's join shuffles.
BROADCAST_STATES = 200_000
#: The same of states alone, or with a total.
BROADCAST_KEYS = 1_000_000
#: Counts that tell a state's frequent tokens from the rest.
FLOORS = tuple(2 * 4**k for k in range(10))
#: Digits of log probabilities that decide: what is alike to them is a tie.
DIGITS = 9


def pair_counts(sequences: DataFrame, column: str, end: str) -> DataFrame:
    """(state, token, n): how often a token follows another in the arrays of `column`; `end` follows the last."""
    a = F.col(column)
    steps = F.arrays_zip(a.alias("state"), F.concat(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.lit(end))).alias("token"))
    return sequences.filter(F.size(a) > 0).select(F.inline(steps)).groupBy("state", "token").agg(F.count("*").alias("n"))


def _logp() -> Column:
    return F.round(F.log(F.col("n") / F.col("total")), DIGITS).alias("logp")


def transitions(sequences: DataFrame, column: str, end: str) -> DataFrame:
    """(state, token, logp): the pair counts as logarithms of each token's share in its state."""
    counts = pair_counts(sequences, column, end)
    totals = counts.groupBy("state").agg(F.sum("n").alias("total"))
    return counts.join(totals, "state").select("state", "token", _logp())


def likeliest(table: DataFrame, k: int) -> DataFrame:
    """(state, next: array of (token, logp)): of each state the k likeliest tokens, ties by token.
    Tasks drop what is not among their own k before any row moves."""
    place = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("logp"), "token"))
    best = table.withColumn("place", place).filter(F.col("place") <= k)
    each = F.array_sort(F.collect_list(F.struct((-F.col("logp")).alias("less"), "token")))
    return best.groupBy("state").agg(F.transform(each, lambda x: F.struct(x["token"].alias("token"), (-x["less"]).alias("logp"))).alias("next"))


class _Likeliest:
    """The k likeliest tokens of states, from a table of (state, token, logp), ranked at once, or of
    (state, token, n), whose states are ranked when `join` first meets them."""

    def __init__(self, table: DataFrame, k: int):
        self.k, self.counts = k, None
        if "n" not in table.columns:
            self.known = kept(likeliest(table, k), "likeliest")
            self.size = self.known.count()
            return
        self.counts, self.known, self.size = kept(table, "pairs"), None, 0

    def _meet(self, rows: DataFrame) -> None:
        states = rows.select("state").distinct()
        new = kept(states if self.known is None else states.join(self.known, "state", "left_anti"), "states")
        size = new.count()
        if not size and self.known is not None:
            return
        few = size <= BROADCAST_KEYS
        sent = F.broadcast if few else lambda df: df
        own = kept(self.counts.join(sent(new), "state", "left_semi"), "reached")
        # Tokens below the greatest floor that k tokens of their state reach are not among the k: they are not sorted.
        floor = F.coalesce(*[F.when(F.count_if(F.col("n") >= n) >= self.k, n) for n in reversed(FLOORS)], F.lit(1))
        totals = own.groupBy("state").agg(F.sum("n").alias("total"), floor.alias("floor"))
        best = own.join(sent(totals), "state").filter("n >= floor").select("state", "token", _logp())
        best = kept(likeliest(best, self.k), "likeliest")
        self.size += best.count()
        self.known = best if self.known is None else self.known.unionByName(best)

    def join(self, rows: DataFrame) -> DataFrame:
        """rows with `next` of their `state` (null: nothing follows, or the state is null)."""
        if self.counts is not None:
            self._meet(rows.filter("state is not null"))
        return rows.join(F.broadcast(self.known) if self.size <= BROADCAST_STATES else self.known, "state", "left")


def _length(tokens: Column, end: str) -> Column:
    """1 and the tokens before the end; the prompt is one of them."""
    return 1 + F.size(F.filter(tokens, lambda t: t != end))


def beam_search(prompts: DataFrame, key: str, start: str, table: DataFrame, *, width: int, steps: int, end: str, penalty: float = 0.0, n_best: int = 1) -> DataFrame:
    """(key, rank, tokens, score, logp) of sequences of at most `steps` tokens after each prompt's
    `start` (key unique, neither null). A hypothesis ends with the token `end` or in a state that
    nothing follows; ended ones stay in the beam as they are. They are ranked by log probability
    / length ** penalty, the length being that before the step (at last, that of all), ties by
    tokens. penalty 0 and width 1 are greedy. table: transitions, or pair counts."""
    table = _Likeliest(table, width)
    score = lambda n: F.round(F.col("logp") / F.pow(n, F.lit(float(penalty))), DIGITS)
    place = F.row_number().over(Window.partitionBy("__key").orderBy(F.desc("__score"), "tokens"))
    beams = prompts.select(F.col(key).alias("__key"), F.array(F.col(start)).alias("tokens"), F.lit(0.0).alias("logp"), F.lit(False).alias("done"))
    for _ in range(steps):
        alive = table.join(beams.filter("not done").withColumn("state", F.element_at("tokens", -1)))
        each = alive.unionByName(beams.filter("done"), allowMissingColumns=True)
        more = F.transform("next", lambda x: F.struct(F.concat("tokens", F.array(x["token"])).alias("tokens"), (F.col("logp") + x["logp"]).alias("logp"), (x["token"] == end).alias("done")))
        stay = F.array(F.struct("tokens", "logp", F.lit(True).alias("done")))
        n = _length(F.col("tokens"), end)
        each = each.select("__key", n.alias("__n"), F.inline(F.coalesce(more, stay)))
        ranked = each.withColumn("__score", score(F.col("__n"))).withColumn("__place", place).filter(F.col("__place") <= width)
        beams = kept(ranked.select("__key", "tokens", "logp", "done"), "beams")
        if beams.filter("not done").isEmpty():
            break
    last = beams.withColumn("__score", score(_length(F.col("tokens"), end))).withColumn("__place", place).filter(F.col("__place") <= n_best)
    return last.select(F.col("__key").alias(key), (F.col("__place") - 1).alias("rank"), "tokens", F.col("__score").alias("score"), "logp")


def uniform(*parts) -> Column:
    """A number inside (0, 1), the same for the same parts on any cluster."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def sampled(prompts: DataFrame, key: str, start: str, table: DataFrame, *, k: int, steps: int, end: str, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """(key, tokens, logp): each token is drawn among the state's k likeliest with probabilities as
    exp(logp / temperature): that of the greatest logp / temperature plus Gumbel noise, the noise
    exp(logp / temperature): that of the greatest logp / temperature plus Gumbel noise, the noise
    being a function of (seed, key, step, token). table: transitions, or pair counts. After the
    end, and where nothing follows, no token is drawn."""
    table = _Likeliest(table, k)
    rows = prompts.select(F.col(key).alias("__key"), F.array(F.col(start)).alias("tokens"), F.lit(0.0).alias("logp"))
    for step in range(steps):
        last = F.element_at("tokens", -1)
        noise = lambda x: -F.log(-F.log(uniform(seed, F.col("__key"), step, x["token"])))  # noqa: B023, E731
        drawn = F.array_max(F.transform("next", lambda x: F.struct(F.round(x["logp"] / temperature + noise(x), DIGITS).alias("g"), x["token"].alias("token"), x["logp"].alias("logp"))))
        # Ended rows have no state; they take no part in the join.
        rows = kept(rows.withColumn("state", F.when((last != end) | (F.size("tokens") == 1), last)), "sampled")
        ended = rows.filter("state is null").select("__key", "tokens", "logp")
        rows = table.join(rows.filter("state is not null")).withColumn("__drawn", drawn).select(
            "__key", F.when(F.col("__drawn").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array("__drawn.token"))).alias("tokens"), (F.col("logp") + F.coalesce("__drawn.logp", F.lit(0.0))).alias("logp")
        ).unionByName(ended)
    return rows.withColumnRenamed("__key", key)
