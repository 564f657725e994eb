"""URL filters: explicit rules first; for the rest a character language-model ratio.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, are counted
over four fifths of the URLs that the rules decide (exploded 4-grams, pre-aggregated); the other
fifth, by a hash of the URL, calibrates the threshold. They read all of a URL after the scheme. The
alphabet of 32 symbols bounds the counts, so the driver turns at most 32^4 sums into a fixed table of log
ratios: contexts of three characters where they make up 1/4096 of the text or more (at
most 4096 of them), else of two, each interpolated down to one (Witten-Bell). Scoring is a
fold over a URL's characters with DataFrame functions; nothing is shuffled for it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Position is code; digits are folded to 0, other characters to _, and ^ begins and ends.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0/.-_"
A = len(ALPHABET)
CONTEXTS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """The URL after its first ://; empty for null or without."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty for null or without ://."""
    rest = after_scheme(url)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _codes(rest: Column) -> Column:
    plain = F.translate(F.translate(rest, UPPER, LOWER), "123456789", "000000000")
    plain = F.regexp_replace(plain, "[^a-z0/.-]", "_")
    return F.transform(F.regexp_extract_all(F.concat(plain, F.lit("^")), F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _counts(labelled: DataFrame) -> dict[str, dict[int, int]]:
    """(verdict, codes) -> verdict -> 4-gram code -> how often, over all rows."""
    padded = labelled.select("verdict", F.concat(F.array_repeat(F.lit(0), 3), "codes").alias("c"))
    grams = F.transform(F.sequence(F.lit(3), F.size("c") - 1), lambda i: ((F.get("c", i - 3) * A + F.get("c", i - 2)) * A + F.get("c", i - 1)) * A + F.get("c", i))
    rows = padded.select("verdict", F.explode(grams).alias("gram")).groupBy("verdict", "gram").count().collect()
    out: dict[str, dict[int, int]] = {"allow": {}, "block": {}}
    for r in rows:
        out[r["verdict"]][r["gram"]] = r["count"]
    return out


class _Markov:
    """Interpolated probabilities p(c | up to 3 characters) from 4-gram counts."""

    def __init__(self, grams: dict[int, int]):
        self.counts: list[dict[int, int]] = [{}, {}, {}, {}]
        for gram, n in grams.items():
            for order in range(4):
                key = gram % A ** (order + 1)
                self.counts[order][key] = self.counts[order].get(key, 0) + n
        self.context: list[dict[int, tuple[int, int]]] = []
        for order in range(4):
            sums: dict[int, tuple[int, int]] = {}
            for key, n in self.counts[order].items():
                total, kinds = sums.get(key // A, (0, 0))
                sums[key // A] = (total + n, kinds + 1)
            self.context.append(sums)

    def p(self, order: int, gram: int) -> float:
        """gram: the code of order + 1 characters."""
        if order < 0:
            return 1 / A
        total, kinds = self.context[order].get(gram // A, (0, 0))
        lower = self.p(order - 1, gram % A**order if order else 0)
        if not total:
            return lower
        return (self.counts[order].get(gram, 0) + kinds * lower) / (total + kinds)


def _literal(values, kind: str) -> Column:
    """A constant array, folded once when the query is planned."""
    text = ",".join(f"{v:.4g}" if kind == "float" else str(v) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{kind}>")


def ratio_table(grams: dict[str, dict[int, int]]) -> tuple[list[float], list[int], list[float]]:
    """(log ratio by 3-gram, row of each 3-character context or -1, log ratios by row and character)."""
    good, bad = _Markov(grams["allow"]), _Markov(grams["block"])
    base = [math.log(good.p(2, g) / bad.p(2, g)) for g in range(A**3)]
    seen: dict[int, int] = {}
    for side in (good, bad):
        for context, (n, _) in side.context[3].items():
            seen[context] = seen.get(context, 0) + n
    least = max(8, sum(seen.values()) / CONTEXTS)
    often = sorted(context for context, n in seen.items() if n >= least)
    row = [-1] * A**3
    long_: list[float] = []
    for k, context in enumerate(often):
        row[context] = k
        long_ += [math.log(good.p(3, context * A + c) / bad.p(3, context * A + c)) for c in range(A)]
    return base, row, long_ or [0.0]


def score_of(codes: Column, table: tuple[list[float], list[int], list[float]]) -> Column:
    """Mean log ratio per character: above 0, more like the accepted."""
    base, row, long_ = _literal(table[0], "float"), _literal(table[1], "int"), _literal(table[2], "float")
    start = F.struct(F.lit(0).alias("context"), F.lit(0.0).alias("total"))

    def step(acc, c):
        at = F.get(row, acc["context"])
        value = F.when(at >= 0, F.get(long_, at * A + c)).otherwise(F.get(base, (acc["context"] % (A * A)) * A + c))
        return F.struct(((acc["context"] % (A * A)) * A + c).alias("context"), (acc["total"] + value.cast("double")).alias("total"))

    return F.aggregate(codes, start, step, lambda acc: acc["total"] / F.size(codes))


def calibrated(scores: DataFrame) -> float:
    """(verdict, held, score) -> the threshold that parts accepted from rejected best (greatest
    sum of both right shares), from exact counts in steps of 0.01 of the held-out URLs; of all,
    if these lack a verdict."""
    every = scores.groupBy("held", "verdict", F.floor(F.least(F.greatest(F.col("score"), F.lit(-5.0)), F.lit(5.0)) * 100).cast("int").alias("step")).count().collect()
    rows = [r for r in every if r["held"]]
    if len({r["verdict"] for r in rows}) < 2:
        rows = every
    sums = {v: sum(r["count"] for r in rows if r["verdict"] == v) for v in ("allow", "block")}
    if not all(sums.values()):
        return -math.inf
    good, bad, best, cut = 1.0, 1.0, 1.0, -math.inf
    by_step: dict[int, dict[str, int]] = {}
    for r in rows:
        own = by_step.setdefault(r["step"], {})
        own[r["verdict"]] = own.get(r["verdict"], 0) + r["count"]
    for step in sorted(by_step):
        good -= by_step[step].get("allow", 0) / sums["allow"]
        bad -= by_step[step].get("block", 0) / sums["block"]
        if good + 1 - bad > best + 1e-12:
            best, cut = good + 1 - bad, (step + 1) / 100
    return cut


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages.

    verdict is the longest fitting rule's, else allow where the URL's score reaches the
    calibrated threshold. Null URLs and URLs without :// have an empty host and path and are
    scored like an empty URL. Where the rules accept or reject nothing, all else is allowed.
    Repeated rows are each returned; other columns are not read; an empty table gives no rows."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rest = after_scheme(F.col(url_col).cast("string"))
    d = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.select("*", rule.alias("rule"), verdict.alias("by_rule"), _codes(F.col("rest")).alias("codes"))
    held = F.pmod(F.xxhash64("rest"), F.lit(5)) == 4
    labelled = d.filter("rule is not null").select(F.col("by_rule").alias("verdict"), "codes", held.alias("held"))
    grams = _counts(labelled.filter("not held"))
    if not all(grams.values()):  # a handful of URLs, all of one side held out
        grams = _counts(labelled)
    if not all(grams.values()):
        return d.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    score = score_of(F.col("codes"), ratio_table(grams))
    cut = calibrated(labelled.select("verdict", "held", score.alias("score")))
    d = d.select("*", score.alias("score"))
    return d.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")).alias("verdict"), "score")
