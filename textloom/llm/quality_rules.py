"""Quality rules by distribution divergence, with DataFrame functions alone.

One pass over the texts counts each document's words, repeats, character classes and
common words; those counts (a few numbers a document) are a table in the shared folder.
Their means by language, over the typical half of all documents, are the language
references: one row a language, so the join back is small whatever the input. A document
whose histograms lie too far from the reference by Jensen-Shannon distance is rejected, if
it is long enough for its histogram to mean something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, Shelf, words_of

# The most common function words of each reference language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del"],
}
CLASSES = ("letter", "upper", "digit", "mark", "symbol", "space", "wide")
SYMBOLS = "#*$%&|<>"
#: Distances beyond which a document is rejected, and the least length at which each counts.
MAX_CHAR_DISTANCE, MIN_CHARS = 0.33, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.42, 50
WINDOW, MIN_DOC_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20


def text_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """(doc_id, text_hash, lang, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, chars: counts by CLASSES, bare: words that are one symbol, common: counts
    of the language's words)."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws} | set(SYMBOLS))
    lists = F.create_map(*[x for lang, ws in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, ws)))])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), lang.alias("lang"))
    n = F.size("words")
    d = d.select("*", words_of(F.col("t")).alias("words"), F.xxhash64("t").alias("text_hash"))
    d = d.select(
        "*",
        n.cast("long").alias("n_words"),
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<long>")).alias("windows"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        F.filter("words", lambda w: w.isin(*every)).alias("hits"),
        F.length("t").cast("long").alias("n_chars"),
        F.length(F.translate("t", WORD_SEPARATORS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).cast("long").alias("upper"),
        F.length(F.regexp_replace("t", "[^0-9]+", "")).cast("long").alias("digit"),
        F.length(F.regexp_replace("t", "[^!?.,:;'\"()\\[\\]{}=/_+-]+", "")).cast("long").alias("mark"),
        (F.octet_length("t") - F.length("t")).cast("long").alias("wide"),
    )
    # Only texts in which a window comes twice pay for sorting; each array is a column of its
    # own, so that no lambda computes it again.
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select(
        "*",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered)
        .otherwise(F.array().cast("array<struct<h:long,i:int>>")).alias("pairs"),
    )
    d = d.select("*", F.transform("pairs", lambda p: p["h"]).alias("sorted"))
    twice = F.filter(
        "pairs",
        lambda p, k: F.coalesce((F.get("sorted", k - 1) == p["h"]) | (F.get("sorted", k + 1) == p["h"]), F.get("sorted", k + 1) == p["h"], F.get("sorted", k - 1) == p["h"]),
    )
    d = d.select("*", F.array_sort(F.transform(twice, lambda p: p["i"])).alias("starts"))
    covered = F.aggregate(
        F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, x: total + x,
    )
    space = F.col("n_chars") - F.col("word_chars")
    letters = F.greatest(F.lit(0).cast("long"), F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("mark") - F.col("n_symbols") - F.col("wide"))
    return d.select(
        "doc_id", "text_hash", "lang", "n_words", "n_chars", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.filter("hits", lambda h: h.isin(*SYMBOLS))).cast("long").alias("bare"),
        F.array(letters, "upper", "digit", "mark", "n_symbols", space, "wide").alias("chars"),
        F.transform(lists[F.col("lang")], lambda w: F.size(F.filter("hits", lambda h: h == w)).cast("long")).alias("common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares; null if either is."""
    def term(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _shares(counts: Column, total: Column) -> Column:
    return F.when(total > 0, F.transform(counts, lambda c: c / total))


def _with_rest(common: Column, bare: Column, n_words: Column) -> Column:
    """Common words, words that are one symbol, and all other words."""
    return F.concat(common, F.array(bare, n_words - bare - F.aggregate(common, F.lit(0).cast("long"), lambda s, x: s + x)))


def _means(rows: DataFrame, chars_in: Column, words_in: Column) -> DataFrame:
    """(key, ref_chars, ref_common): mean shares by key, so that no long document dominates."""
    n_common = len(next(iter(COMMON_WORDS.values()))) + 2
    sums = rows.groupBy("key").agg(
        *[F.avg(F.when(chars_in, F.col("own_chars")[k])).alias(f"c{k}") for k in range(len(CLASSES))],
        *[F.avg(F.when(words_in, F.col("own_common")[k])).alias(f"w{k}") for k in range(n_common)],
    )
    return sums.select(
        "key",
        F.when(F.col("c0").isNotNull(), F.array(*[F.col(f"c{k}") for k in range(len(CLASSES))])).alias("ref_chars"),
        F.when(F.col("w0").isNotNull() & (F.col("key") != ""), F.array(*[F.col(f"w{k}") for k in range(n_common)])).alias("ref_common"),
    )


def _distances(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Adds char_distance and word_distance; references has a row for each language at most."""
    joined = rows.join(F.broadcast(references), "key", "left")
    return joined.withColumns({
        "char_distance": js_distance(F.col("own_chars"), F.col("ref_chars")), "word_distance": js_distance(F.col("own_common"), F.col("ref_common")),
    }).drop("ref_chars", "ref_common")


def _middle(rows: DataFrame, distance: str, out: str) -> DataFrame:
    """(key, out): the step of 0.01 up to which half of the key's distances lie, from exact counts."""
    steps = rows.filter(F.col(distance).isNotNull()).groupBy("key", F.floor(F.col(distance) * 100).alias("step")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("step"))
    steps = steps.select("key", "step", upto.alias("upto"), F.sum("n").over(Window.partitionBy("key")).alias("all"))
    return steps.filter(2 * F.col("upto") >= F.col("all")).groupBy("key").agg(F.min("step").alias(out))


def references(rows: DataFrame, shelf: Shelf) -> DataFrame:
    """(key, ref_chars, ref_common) of each language and, with an empty key, of all documents:
    the mean histograms of that half of the documents that lies nearest to the mean of all, so
    that junk, however much there is of it below a half, does not shift what it is held against."""
    typical = rows.filter((F.col("n_chars") >= MIN_CHARS) & ~F.col("base_failed"))
    typical = typical.withColumn("key", F.explode(F.array_distinct(F.array("key", F.lit("")))))
    long_enough = F.col("n_words") >= MIN_WORDS
    first = shelf.put(_means(typical, F.lit(True), long_enough), "first")
    placed = _distances(typical, first).withColumn("word_distance", F.when(long_enough, F.col("word_distance")))
    middles = shelf.put(_middle(placed, "char_distance", "chars_to").join(_middle(placed, "word_distance", "words_to"), "key", "left"), "middles")
    placed = placed.join(F.broadcast(middles), "key")
    return shelf.put(_means(placed, F.floor(F.col("char_distance") * 100) <= F.col("chars_to"), F.floor(F.col("word_distance") * 100) <= F.col("words_to")), "references")


def judge(counts: DataFrame, shelf: Shelf) -> DataFrame:
    """Adds char_distance, word_distance, base_failed and kept to text_counts()."""
    own_total = F.aggregate("chars", F.lit(0).cast("long"), lambda s, x: s + x)
    rows = counts.withColumns({
        "key": F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(""),
        "own_chars": _shares(F.col("chars"), own_total),
        "own_common": _shares(_with_rest(F.col("common"), F.col("bare"), F.col("n_words")), F.col("n_words")),
        "base_failed": (F.col("n_words") < MIN_DOC_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    out = _distances(rows, references(rows, shelf))
    far = ((F.col("n_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | (
        (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    )
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).drop("key", "own_chars", "own_common")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """A row for each row of docs: doc_id, text_hash (of the text, to tell rows of one id
    apart), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance, kept.

    Null and empty texts: all counts 0, base_failed. A language that is null or not in
    COMMON_WORDS: characters are compared with all documents together, words not at all.
    Null ids and repeated rows are judged like others. Other columns are not read. An
    empty table gives no rows."""
    shelf = Shelf(docs.sparkSession, "rules")
    counts = shelf.put(text_counts(docs, id_col, text_col, lang_col), "counts")
    return judge(counts, shelf).select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "char_distance", "word_distance", "kept",
    )
