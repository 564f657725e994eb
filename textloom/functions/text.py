"""Text functions, Column -> Column: normalisers, tokenisers, detokenisers. All run inside
Spark's JVM but unaccent(), which is an Arrow function over batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STRIP = "(?U)^\\s+|\\s+$"
#: A word's characters, of any script.
_IN_WORD = "[\\p{L}\\p{N}_]"

# Spoken forms of abbreviations with a full stop, common ones first.
ABBREVIATIONS = {
    "ms": "miss", "mrs": "misess", "mr": "mister", "messrs": "messeurs", "dr": "doctor", "drs": "doctors", "st": "saint", "co": "company",
    "jr": "junior", "sr": "senior", "rev": "reverend", "hon": "honorable", "sgt": "sergeant", "capt": "captain", "maj": "major", "col": "colonel",
    "lt": "lieutenant", "gen": "general", "prof": "professor", "lb": "pounds", "rep": "representative", "ave": "avenue", "etc": "et cetera",
    "jan": "january", "feb": "february", "mar": "march", "apr": "april", "jun": "june", "jul": "july", "aug": "august", "sep": "september",
    "oct": "october", "nov": "november", "dec": "december",
    "ltd": "limited", "fig": "figure", "figs": "figures", "gent": "gentlemen", "ft": "fort", "esq": "esquire", "prep": "preperation",
    "bros": "brothers", "ind": "independent", "mme": "madame", "pro": "professional", "vs": "versus", "inc": "include",
}


def words(text) -> Column:
    """array<string> of the white-space separated words; null stays null."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)\\s+", " "), "^ | $", "")


def normalise_base(text) -> Column:
    """Ends stripped, lower case."""
    return F.lower(F.regexp_replace(text, _STRIP, ""))


def has_currency(text) -> Column:
    return F.col(text).rlike("[£€]") if isinstance(text, str) else text.rlike("[£€]")


def expand_abbreviations(text: Column) -> Column:
    """Spoken forms in place of abbreviations; of one with two (st.) the first. One search finds all
    runs of them ("dr." alone mostly, or "co.ltd."); in a run one goes after the other, in the order
    of ABBREVIATIONS, and what is spoken already keeps its neighbour from being one."""
    longest = max(map(len, ABBREVIATIONS))
    run = f"(?i)(?<!{_IN_WORD})(?=[a-z]{{2,{longest}}}\\.)(?:(?:{'|'.join(ABBREVIATIONS)})\\.)+"
    single = F.create_map(*[F.lit(x) for short, spoken in ABBREVIATIONS.items() for x in (f"{short}.", spoken)])

    def in_turn(out):
        for short, spoken in ABBREVIATIONS.items():
            out = F.regexp_replace(out, f"(?i)(?<!{_IN_WORD}){short}\\.", spoken)
        return out

    def spoken(found):
        return F.when(found.isNull(), "").otherwise(F.coalesce(F.try_element_at(single, F.lower(found)), in_turn(found)))

    pieces, runs = F.split(text, run, -1), F.regexp_extract_all(text, F.lit(run), F.lit(0))
    return F.array_join(F.zip_with(pieces, runs, lambda piece, found: F.concat(piece, spoken(found))), "")


def spoken_punctuation(text: Column, keep: str = "'") -> Column:
    """+, & and % as words; other marks but `keep` as spaces."""
    for mark, word in (("+", "plus"), ("&", "and"), ("%", "percent")):
        text = F.replace(text, F.lit(mark), F.lit(f" {word} "))
    rest = "".join(c for c in PUNCTUATION if c not in keep and c not in "+&%")
    return F.translate(text, rest, " " * len(rest))


def normalise_answer(text: Column) -> Column:
    """Answers as compared in question answering: lower case, no marks, no articles."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    return collapse(F.regexp_replace(plain, f"(?<!{_IN_WORD})(a|an|the)(?!{_IN_WORD})", " "))


def strip_punctuation(text: Column) -> Column:
    """Lower case without ASCII marks, the backslash excepted."""
    return F.lower(F.translate(text, PUNCTUATION.replace("\\", ""), ""))


def tokenise_13a(text: Column) -> Column:
    """Western tokenisation of translation scores: marks become words of their own, but full
    stops and commas stay inside numbers and dashes split only after digits."""
    # The replacements and patterns of this tokenisation.
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    text = F.regexp_replace(text, "([\\{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])", " $1 ")
    text = F.regexp_replace(text, "([^0-9])([\\.,])", "$1 $2 ")
    text = F.regexp_replace(text, "([\\.,])([^0-9])", " $1 $2")
    text = F.regexp_replace(text, "([0-9])(-)", "$1 $2 ")
    return collapse(text)


def tokenise_international(text: Column) -> Column:
    """By Unicode classes: marks split unless between digits, symbols always."""
    text = F.regexp_replace(text, "([^\\p{Nd}])(\\p{P})", "$1 $2 ")
    text = F.regexp_replace(text, "(\\p{P})([^\\p{Nd}])", " $1 $2")
    return collapse(F.regexp_replace(text, "(\\p{S})", " $1 "))


def han_apart(text: Column) -> Column:
    """Spaces around each Han character and wide mark."""
    return F.regexp_replace(text, "(\\p{IsHan}|[\\u3000-\\u303f\\uff00-\\uffef])", " $1 ")


def tokenise_zh(text: Column) -> Column:
    """Each Han character a word, then tokenise_13a."""
    return tokenise_13a(han_apart(text))


def coerce(value: Column, kind: str, default: Column | None = None) -> Column:
    """A setting's text as bool, int, float, decimal, date, datetime, list (by commas) or dict
    (key=value by commas); null where it does not parse, the default where it is null."""
    if kind == "bool":
        out = ~F.lower(F.trim(value)).isin("false", "0", "no", "n", "f", "none", "")
    elif kind == "list":
        out = F.transform(F.split(value, ","), lambda x: F.trim(x))
    elif kind == "dict":
        out = F.str_to_map(value, F.lit(","), F.lit("="))
    else:
        types = {"int": "long", "float": "double", "decimal": "decimal(38,18)", "date": "date", "datetime": "timestamp"}
        out = F.trim(value).try_cast(types[kind])
    return out if default is None else F.coalesce(out, default)


def char_ids(text: Column, labels: str, unknown: int = -1) -> Column:
    """array<int>: each character's place in labels, lower-cased; unknown ones dropped
    when they stand for the blank (-1)."""
    letters = F.regexp_extract_all(normalise_base(text), F.lit("(?s)."), F.lit(0))
    ids = F.transform(letters, lambda c: F.instr(F.lit(labels), c) - 1)
    if unknown == -1:
        return F.filter(ids, lambda k: k >= 0)
    return F.transform(ids, lambda k: F.when(k < 0, unknown).otherwise(k))


def phoneme_ids(text: Column, labels: list[str], unknown: int = -1) -> Column:
    """array<int>: words split at _, each part's place in labels."""
    parts = F.flatten(F.transform(F.split(text, " "), lambda w: F.split(w, "_")))
    table = F.array(*map(F.lit, labels))
    return F.transform(parts, lambda p: F.when(F.array_contains(table, p), F.array_position(table, p) - 1).otherwise(unknown).cast("int"))


def known_tokens(tokens: Column, vocabulary: Column, unknown: str = "<UNK>") -> Column:
    """Tokens that the vocabulary, an array, lacks are the unknown one; empty ones go."""
    return F.transform(F.filter(tokens, lambda w: w != ""), lambda w: F.when(F.array_contains(vocabulary, w), w).otherwise(F.lit(unknown)))


def vocabulary_ids(tokens: Column, table: Column, unknown: str = "<UNK>") -> Column:
    """Ids of tokens by a map token -> id."""
    return F.transform(tokens, lambda w: F.coalesce(F.element_at(table, w), F.element_at(table, F.lit(unknown))))


def text_of_ids(ids: Column, words: Column, first_special: Column, sep: str = " ") -> Column:
    """The inverse: tokens by id from an array, special ones, whose ids follow all others', left out."""
    return F.array_join(F.transform(F.filter(ids, lambda k: k < first_special), lambda k: F.get(words, k.cast("int"))), sep)


def decode_ids(ids: Column, labels: str) -> Column:
    """The inverse of char_ids()."""
    return F.array_join(F.transform(ids, lambda k: F.substr(F.lit(labels), k + 1, F.lit(1))), "")


def detokenise(text: Column) -> Column:
    """Cosmetics after joining tokens: no space before marks and inside brackets."""
    for pattern, new in ((" ([.,!?;:%)\\]])", "$1"), ("([(\\[]) ", "$1"), ("\" ([^\"]*) \"", "\"$1\""), ("(\\d) ([.,]) (\\d)", "$1$2$3")):
        text = F.regexp_replace(text, pattern, new)
    return text


@F.pandas_udf(T.StringType())
def unaccent(text: pd.Series) -> pd.Series:
    """NFD without combining marks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def to_ascii(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; what is not ASCII then is dropped."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def clean_english(text: Column) -> Column:
    """Transliterated, lower case, white space collapsed."""
    return collapse(F.lower(to_ascii(text)))


def normalise_utterance(text: Column) -> Column:
    """Lower case without accents; sentence marks apart, all else but letters as spaces."""
    plain = F.regexp_replace(unaccent(F.lower(text)), "([.!?])", " $1")
    return collapse(F.regexp_replace(plain, "[^a-zA-Z.!?]+", " "))


@F.pandas_udf(T.StringType())
def speak_numbers(text: pd.Series) -> pd.Series:
    """Digits as English words: ordinals, dollars, decimals and whole numbers."""
    import re

    ones = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
    odd = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}

    def whole(n: int) -> str:
        if n < 20:
            return ones[n]
        if n < 100:
            return tens[n // 10] + (f" {ones[n % 10]}" if n % 10 else "")
        for size, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
            if n >= size:
                return f"{whole(n // size)} {name}" + (f" {whole(n % size)}" if n % size else "")
        return ""

    def ordinal(n: int) -> str:
        head, _, last = whole(n).rpartition(" ")
        last = odd.get(last) or (last[:-1] + "ieth" if last.endswith("y") else last + "th")
        return f"{head} {last}".strip()

    def say(m) -> str:
        digits = m["n"].replace(",", "")
        if m["ord"]:
            return ordinal(int(digits))
        out = whole(int(digits)) + (" point " + " ".join(ones[int(c)] for c in m["frac"]) if m["frac"] else "")
        return f"{out} dollars" if m["money"] else out

    shape = re.compile(r"(?P<money>\$)?(?P<n>\d{1,15}(?:,\d{3})*)(?:\.(?P<frac>\d+))?(?P<ord>st|nd|rd|th)?")
    return text.map(lambda t: None if t is None else shape.sub(say, t))


@F.pandas_udf(T.StringType())
def project_answer(predicted: pd.Series, original: pd.Series) -> pd.Series:
    """The part of `original` whose characters, case and spaces aside, spell `predicted`;
    `original` itself if there is none."""

    def one(p, o):
        if p is None or o is None:
            return o
        kept = [(k, c.lower()) for k, c in enumerate(o) if not c.isspace()]
        at = "".join(c for _, c in kept).find(want := "".join(p.lower().split()))
        return o if at < 0 or not want else o[kept[at][0] : kept[at + len(want) - 1][0] + 1]

    return pd.Series([one(p, o) for p, o in zip(predicted, original, strict=True)])
