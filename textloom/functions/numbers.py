"""Numbers in English text as words: times, ordinals, dollars and cents, decimals, and thousands that
stand apart ("12 000"). One fold over a text's numbers carries what stands apart from one to the
next; all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# English number words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
_THOUSANDS = ("", " thousand", " million", " billion", " trillion", " quadrillion", " quintillion", " sextillion", " septillion", " octillion", " nonillion", " decillion")
_ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
# What counts as a number (with a dollar sign in front, and the word after it), a time,
# an ordinal, the rest of a number that stands apart, and decimals.
_NUMBER = r"([$]?)(^|\s)(\S*[0-9]\S*)(?=(\s|$)((\S*)(\s|$))?)"
_TIME = r"^([0-9]{1,2}):([0-9]{2})(am|pm)?"
_ORDINAL = r"^([0-9]+)(st|nd|rd|th)"
_REST = r"^([0-9]{3})([.,][0-9]{1,2})?([!.?])?$"
_DECIMALS = r"([.,][0-9]{1,2})$"


def _one_of(words: list[str] | tuple[str, ...], k: Column) -> Column:
    """By place; the list is one constant of the plan."""
    return F.get(F.split(F.lit("|".join(words)), "[|]"), k.cast("int"))


def _below_thousand(n: Column) -> Column:
    rest = n % 100
    tail = F.when(rest < 20, _one_of(_ONES, rest)).otherwise(F.concat(_one_of(_TENS, F.floor(rest / 10)), F.when(rest % 10 > 0, F.concat(F.lit("-"), _one_of(_ONES, rest % 10))).otherwise("")))
    hundred = F.concat(_one_of(_ONES, F.floor(n / 100)), F.lit(" hundred"))
    return F.when(n < 100, tail).when(rest == 0, hundred).otherwise(F.concat(hundred, F.lit(" and "), tail))


def _digits(s: Column) -> Column:
    """Digit by digit."""
    each = F.filter(F.split(s, ""), lambda c: c != "")
    return F.array_join(F.transform(each, lambda c: _one_of(_ONES, c)), " ")


def number_words(text: Column) -> Column:
    """The digits of a text as one number; without any, zero. Beyond 36 digits they are told one by one."""
    def told(digits: Column) -> Column:
        # Groups of three digits from the last on, their words with the thousands' names.
        n_groups = F.floor((F.length(digits) + 2) / 3).cast("int")
        padded = F.lpad(digits, 3 * len(_THOUSANDS), "0")
        groups = F.transform(F.sequence(n_groups, F.lit(1)), lambda k: F.struct(F.substr(padded, 3 * (len(_THOUSANDS) - k) + 1, F.lit(3)).cast("int").alias("n"), (k - 1).alias("k")))
        parts = F.transform(F.filter(groups, lambda g: g["n"] > 0), lambda g: F.struct(F.concat(_below_thousand(g["n"]), _one_of(_THOUSANDS, g["k"])).alias("words"), (g["n"] + 1000 * g["k"]).alias("low")))

        def joined(p: Column) -> Column:
            high = F.array_join(F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x["words"]), ", ")
            last = F.element_at(p, -1)
            # What is below a hundred follows thousands with "and".
            return F.when(F.size(p) == 1, last["words"]).otherwise(F.concat(high, F.when(last["low"] < 100, " and ").otherwise(", "), last["words"]))

        return F.when(digits == "", "zero").when(F.length(digits) > 3 * len(_THOUSANDS), _digits(digits)).otherwise(let(parts, joined))

    return let(F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^0+", ""), told)


def ordinal_words(digits: Column) -> Column:
    """The number's words, the last one as an ordinal."""
    def told(words: Column) -> Column:
        last = F.regexp_extract(words, "([a-z]+)$", 1)
        irregular = _one_of(list(_ORDINALS.values()), F.nullif(F.array_position(F.split(F.lit("|".join(_ORDINALS)), "[|]"), last), F.lit(0)) - 1)
        changed = F.coalesce(irregular, F.when(last.endswith("y"), F.concat(F.substr(last, F.lit(1), F.length(last) - 1), F.lit("ieth"))).otherwise(F.concat(last, F.lit("th"))))
        return F.concat(F.substr(words, F.lit(1), F.length(words) - F.length(last)), changed)

    return let(number_words(digits), told)


def _found(text: Column) -> Column:
    """Of each number: dollar sign, space before, itself, the next word."""
    groups = [F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(k)) for k in (1, 2, 3, 6)]
    return F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("sign", "space", "number", "next"), strict=True)])


def _kinds(found: Column) -> Column:
    """The fold: (space, kind, value) of each number; one with a rest to come is held back."""
    def step(state: Column, m: Column) -> Column:
        number = m["number"]
        money = state["money"] | (m["sign"] != "") | number.startswith("$")
        whole = F.concat(state["held"], number)

        def out(space, kind, value):
            return F.array_append(state["out"], F.struct(space.alias("space"), kind.alias("kind"), value.alias("value")))

        def after(held, money, row):
            return F.struct(held.alias("held"), money.alias("money"), row.alias("out"))

        return (
            F.when(number.rlike(_TIME), after(state["held"], state["money"], out(m["space"], F.lit("time"), number)))
            .when(number.rlike(_ORDINAL), after(state["held"], state["money"], out(m["space"], F.lit("ordinal"), number)))
            .when(m["next"].rlike(_REST), after(whole, money, out(F.lit(" "), F.lit("held"), F.lit(""))))
            .otherwise(after(F.lit(""), F.lit(False), out(m["space"], F.when(money, "money").otherwise("plain"), whole)))
        )

    start = F.struct(F.lit("").alias("held"), F.lit(False).alias("money"), F.array().cast("array<struct<space:string,kind:string,value:string>>").alias("out"))
    return F.aggregate(found, start, step, lambda s: s["out"])


def _interleaved(pieces: Column, between: Column) -> Column:
    """Pieces with what stands between them, which is computed once."""
    return let(between, lambda b: F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(b, i), F.lit("")))), ""))


def _told(m: Column) -> Column:
    value = m["value"]
    minutes, half = F.regexp_extract(value, _TIME, 2), F.regexp_extract(value, _TIME, 3)
    time = F.concat(
        number_words(F.regexp_extract(value, _TIME, 1)), F.when(minutes == "00", "").otherwise(F.concat(F.lit(" "), number_words(minutes))), F.when(half == "", "").otherwise(F.concat(F.lit(" "), half))
    )
    decimals = F.regexp_extract(value, _DECIMALS, 1)

    def amount(whole: Column) -> Column:
        cents = F.substr(decimals, F.lit(2))
        # Known and kept: it is always dollars, and cent only for as many dollars as cents.
        money = F.concat(number_words(whole), F.lit(" dollars"), F.when(decimals == "", "").otherwise(F.concat(F.lit(" and "), number_words(cents), F.when(whole == cents, " cent").otherwise(" cents"))))
        parts = F.transform(F.regexp_extract_all(whole, F.lit("([0-9,]+)"), F.lit(1)), lambda n: F.concat(F.lit(" "), number_words(n), F.lit(" ")))
        plain = F.when(decimals == "", _interleaved(F.split(whole, "[0-9,]+"), parts)).otherwise(F.concat(number_words(whole), F.lit(" point "), _digits(cents)))
        return F.when(m["kind"] == "money", money).otherwise(plain)

    whole = F.replace(F.substr(value, F.lit(1), F.length(value) - F.length(decimals)), F.lit("."), F.lit(""))
    told = F.when(m["kind"] == "time", time).when(m["kind"] == "ordinal", ordinal_words(F.regexp_extract(value, _ORDINAL, 1))).when(m["kind"] == "held", "").otherwise(let(whole, amount))
    return F.concat(m["space"], told)


def speak_numbers(text: Column) -> Column:
    """A text with its numbers as words; null stays null. Spaces are left as they come: collapse them after."""
    return _interleaved(F.split(text, _NUMBER), F.transform(_kinds(_found(text)), _told))
