"""Personal data: regular expressions propose spans, checksum validators confirm them
and context words nearby adjust the score. DataFrame functions alone.

Matches come from regexp_extract_all and the text between them from split by the same
pattern, whose lengths give every match's place in code points. Running totals go by blocks of
the square root of their number, and places inside a text by blocks of fixed size, so that a
text with hundreds of thousands of matches takes no more than in proportion. A text pays for a
kind only if it holds a character that the kind needs. Nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. Possessive repeats and the anchor at the start of a run
# (or at the last match's end) find the same leftmost matches without backtracking.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": (f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "."),
    "card": ("[0-9](?:[\\x20-]?[0-9])++", None),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", "+"),
}
# Further patterns, with their score before checksum and context.
MORE = {
    "iban": ("\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b", 0.5),
    "national_id": ("\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b", 0.4),
    "local_phone": ("\\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\\b", 0.4),
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.7}
CONTEXT = {
    "email": "e?mail|contact|write",
    "ip": "\\bip\\b|address|host|server",
    "card": "card|visa|credit|carte|(?:kredit)?karte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "national_id": "ssn|social|security|passport|identity",
    "local_phone": "phone|tel|call|mobile|fax",
}
CHECKSUM_BONUS, CONTEXT_BONUS, CONTEXT_CHARS, LEAST_SCORE = 0.4, 0.4, 40, 0.8
KINDS = (*BASE, *MORE)
#: Code points that a match of each kind has at least.
LEAST_CHARS = {"email": 5, "ip": 7, "card": 2, "phone": 4, "iban": 12, "national_id": 11, "local_phone": 12}
#: Code points of the blocks of a text that is rewritten.
PART = 4096
_SPAN = "struct<start:int,stop:int,value:string,at:int>"
_FULL = "struct<kind:string,start:int,stop:int,value:string,score:double>"
_INTS = "array<int>"


def _running(values: Column, join, start: Column, body) -> Column:
    """body(array), the array holding join() of all values up to each place; in blocks, because a
    fold that appends to an array copies it at each step."""

    def fold(array, first):
        empty = F.struct(first.alias("at"), F.array().cast(_INTS).alias("out"))

        def step(acc, x):
            now = join(acc["at"], x)
            return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(array, empty, step, lambda acc: acc["out"])

    def by_blocks(array):
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(array))).cast("int"))
        return let(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(array) - 1) / width).cast("int"))), lambda k: F.slice(array, k * width + 1, width)), of_blocks)

    def of_blocks(parts):
        ends = fold(F.transform(parts, lambda p: F.aggregate(p, start, join)), start)
        return let(ends, lambda e: let(F.flatten(F.transform(parts, lambda p, k: fold(p, F.when(k > 0, F.get(e, k - 1)).otherwise(start)))), body))

    return let(values, by_blocks)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(matches: str, between: str) -> Column:
    """[{start, stop, value, at: its number}] of the matches, given the pieces of text around them."""
    widths = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(between, i)))

    def spans(stops):
        return F.transform(matches, lambda m, i: F.struct((F.get(stops, i) - F.length(m)).alias("start"), F.get(stops, i).alias("stop"), m.alias("value"), i.alias("at")))

    found = _running(widths, lambda a, b: a + b, F.lit(0), spans)
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of the base spans. These are put in order; of a span, those that begin
    before its end are counted by halving, and the furthest end among them is known."""
    def first_ones(ordered, stop):
        """How many of the ordered spans begin before `stop`."""
        steps = F.sequence(F.ceil(F.log2(F.size(ordered) + 1)).cast("int"), F.lit(0))

        def halve(n, k):
            more = n + F.pow(F.lit(2), k).cast("int")
            return F.when((more <= F.size(ordered)) & (F.get(ordered, more - 1)["start"] < stop), more).otherwise(n)

        return F.aggregate(steps, F.lit(0), halve)

    def kept(ordered):
        def free(stops):
            return F.filter(spans, lambda s: F.coalesce(F.get(stops, first_ones(ordered, s["stop"]) - 1) <= s["start"], F.lit(True)))

        return _running(F.transform(ordered, lambda b: b["stop"]), lambda a, b: F.greatest(a, b), F.lit(0), free)

    ordered = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"))))
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(let(ordered, kept))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn checksum."""
    def add(total, i):
        x = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 by the mod-97 rule."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def add(total, c):
        digit = c.rlike("[0-9]")
        return F.when(digit, (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.regexp_extract_all(moved, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), add) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, "\\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return mod97(F.translate(value, " ", ""))
    return F.lit(True)


def _confirmed(kind: str) -> Column:
    return F.filter(f"p_{kind}", lambda s: _valid(kind, s["value"]))


def _scored(kind: str, spans: str) -> Column:
    start = SCORES.get(kind) or MORE[kind][1]
    start += CHECKSUM_BONUS if kind in ("card", "iban") else 0.0

    between, matches = F.col(f"b_{kind}"), F.col(f"m_{kind}")

    def near(s):
        """The characters around a span: of so many pieces beside it that their matches alone are as long."""
        at, n = s["at"], F.lit(CONTEXT_CHARS)
        many = -(-CONTEXT_CHARS // LEAST_CHARS[kind])
        before = F.transform(
            F.sequence(F.greatest(F.lit(0), at - many), at),
            lambda j: F.concat(F.right(F.get(between, j), n), F.when(j < at, F.right(F.get(matches, j), n)).otherwise("")),
        )
        after = F.transform(
            F.sequence(at + 1, F.least(F.size(between) - 1, at + 1 + many)),
            lambda j: F.concat(F.when(j > at + 1, F.left(F.get(matches, j - 1), n)).otherwise(""), F.left(F.get(between, j), n)),
        )
        return F.lower(F.concat(F.right(F.array_join(before, ""), n), F.lit("\n"), F.left(F.array_join(after, ""), n)))

    def full(s):
        score = F.least(F.lit(1.0), F.lit(start) + F.when(near(s).rlike(f"(?<!\\p{{L}})(?:{CONTEXT[kind]})"), CONTEXT_BONUS).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), score.alias("score"))

    return F.transform(spans, full)


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs with a column more: array of {kind, start, stop, value, score}, by kind in the
    order of KINDS, then by start; code points, stop exclusive. A column of docs that is
    named like out_col is replaced.

    Base kinds (email, ip, card, phone) hold their validator's matches whatever the score.
    The kinds of MORE are added if they reach LEAST_SCORE with checksum and context and
    overlap no base span. Null and empty texts: an empty array. No row is lost."""
    kept = [c for c in docs.columns if c != out_col]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    d = d.select("*", F.col("t").rlike("[0-9]").alias("has_digit"))
    need = {kind: F.contains(F.col("t"), F.lit(c)) if c else F.col("has_digit") for kind, (_, c) in BASE.items()}
    need["ip"] &= F.col("has_digit")
    pattern = {kind: p for kind, (p, _) in (BASE | MORE).items()}
    nothing = F.array().cast("array<string>")
    d = d.select("*", *[F.when(need.get(k, F.col("has_digit")), F.regexp_extract_all("t", F.lit(pattern[k]), F.lit(0))).otherwise(nothing).alias(f"m_{k}") for k in KINDS])
    d = d.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("t", pattern[k], -1)).otherwise(nothing).alias(f"b_{k}") for k in KINDS])
    around = [f"{c}_{k}" for c in "mb" for k in KINDS]
    d = d.select("row", *around, *[_placed(f"m_{k}", f"b_{k}").alias(f"p_{k}") for k in KINDS])
    d = d.select("row", *around, *[_confirmed(k).alias(f"v_{k}") for k in KINDS])
    d = d.select("row", *[_scored(k, f"v_{k}").alias(f"s_{k}") for k in KINDS])
    d = d.select("row", F.concat(*[F.col(f"s_{k}") for k in BASE]).alias("base"), F.concat(*[F.col(f"s_{k}") for k in MORE]).alias("more"))
    added = _apart(F.filter("more", lambda s: s["score"] >= LEAST_SCORE), F.col("base"))
    return d.select(*[F.col("row")[c].alias(c) for c in kept], F.concat("base", added).alias(out_col))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data in the text replaced by its [KIND]; spans that
    overlap become one. Texts without spans, null ones included, stay as they are."""
    found = find_pii(docs, text_col, "__pii")
    ordered = F.array_sort(F.transform("__pii", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    found = found.withColumn("__ordered", ordered)
    text = F.col(f"`{text_col}`")
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))

    def replaced(parts, stops):
        """stops: the furthest stop of all spans up to each; a span that starts before it is part of the one before."""

        def cut(start, stop):
            first = F.floor(start / PART).cast("int")
            held = F.slice(parts, first + 1, F.greatest(F.lit(0), F.floor((stop - 1) / PART).cast("int") - first + 1))
            return F.when(stop > start, F.substr(F.array_join(held, ""), start - first * PART + 1, stop - start)).otherwise("")

        def piece(s, k):
            last = F.when(k > 0, F.get(stops, k - 1)).otherwise(F.lit(0))
            return F.when(s["start"] >= last, F.concat(cut(last, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform("__ordered", piece), ""), cut(F.element_at(stops, -1), F.length(text)))

    def rewritten(parts):
        return _running(F.transform("__ordered", lambda s: s["stop"]), lambda a, b: F.greatest(a, b), F.lit(0), lambda stops: replaced(parts, stops))

    new = F.when(F.size("__ordered") > 0, let(parts, rewritten)).otherwise(text)
    return found.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def span_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of find_pii()."""
    found = find_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[counted(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )
