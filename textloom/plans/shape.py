"""Queries that shape token sequences: padding, truncation, spans, blocks, batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.text import words
from ..operators import order
from .base import query
from .corpus import PAIRS, WORD_ROWS, WORDS, pairs

#: Token ids of the shaping queries: the lengths of the words.
IDS = f"list_transform({WORDS}, lambda w: length(w))"
RN = "(row_number() OVER (ORDER BY conv_id, turn) - 1)"


def lengths(c="text"):
    return F.transform(words(F.col(c)), lambda w: F.char_length(w))


def joined(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), " ")


def turns(t):
    """Conversations with their ids and a unique ordering number."""
    return t("conversations").select("conv_id", "turn", lengths().alias("ids"), (F.shiftleft("conv_id", 20) + F.col("turn")).alias("key"))


@query(f"SELECT conv_id, turn, array_to_string(list_concat(list_concat([1], {IDS}), [2]), ' ') AS ids FROM conversations")
def bos_eos_wrap(t):
    return turns(t).select("conv_id", "turn", joined(arrays.wrap("ids", 1, 2)).alias("ids"))


def _batch_sql(width):
    return f"""WITH c AS (SELECT conv_id, turn, len({WORDS}) AS n, {RN} // 16 AS batch FROM conversations)
SELECT conv_id, turn, batch, CAST({width} AS BIGINT) AS padded, CAST({width} - n AS BIGINT) AS pads FROM (SELECT *, max(n) OVER (PARTITION BY batch) AS m FROM c)"""


def _padded(t, eights):
    d = order.batches(turns(t), "key", 16)
    most = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    d = d.withColumn("m", arrays.pad_to(most, 8) if eights else most)
    full = arrays.pad_right("ids", F.col("m"), 0)
    return d.select("conv_id", "turn", "batch", F.size(full).cast("long").alias("padded"), (F.size(full) - F.size("ids")).cast("long").alias("pads"))


@query(_batch_sql("m"))
def batch_pad(t):
    return _padded(t, False)


@query(_batch_sql("(m + 7) // 8 * 8"))
def batch_pad8(t):
    return _padded(t, True)


@query(f"""SELECT doc_id, CAST(len(x) AS BIGINT) AS n, array_to_string(CASE WHEN len(x) > 32 THEN list_concat(['[CLS]'], x[-31:]) ELSE x END, ' ') AS tokens
FROM (SELECT doc_id, list_concat(list_concat(['[CLS]'], {WORDS}), ['[SEP]']) AS x FROM documents)""")
def clf_truncate_tail(t):
    ws = words(F.col("text"))
    return t("documents").select("doc_id", (F.size(ws) + 2).cast("long").alias("n"), F.array_join(arrays.classifier_tokens(ws, 32), " ").alias("tokens"))


_SIDES = f"(SELECT conv_id, turn, {WORDS.replace('text', 'src')} AS s, {WORDS.replace('text', 'tgt')} AS g FROM {PAIRS})"
_KEEP = f"(SELECT *, CASE WHEN len(s) + len(g) <= 29 THEN len(s) ELSE least(len(s), greatest(29 - len(g), 15)) END AS a FROM {_SIDES})"
_KEPT = f"(SELECT *, CASE WHEN len(s) + len(g) <= 29 THEN len(g) ELSE 29 - a END AS b FROM {_KEEP})"


def _kept(t):
    d = pairs(t).select("conv_id", "turn", words(F.col("src")).alias("s"), words(F.col("tgt")).alias("g"))
    a, b = arrays.pair_keep(F.size("s"), F.size("g"), 29)
    return d.select("*", a.cast("int").alias("a"), b.cast("int").alias("b"))


@query(f"SELECT conv_id, turn, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM {_KEPT}")
def pair_truncate(t):
    return _kept(t).select("conv_id", "turn", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query(f"""SELECT conv_id, turn, array_to_string(list_concat(list_concat(list_concat(list_concat(['[CLS]'], s[1:a]), ['[SEP]']), g[1:b]), ['[SEP]']), ' ') AS tokens,
CAST(a + b + 3 AS BIGINT) AS mask, repeat('0', CAST(a + 2 AS INT)) || repeat('1', CAST(b + 1 AS INT)) AS segments FROM {_KEPT}""")
def pair_encode(t):
    sep = F.array(F.lit("[SEP]"))
    d = _kept(t)
    tokens = F.concat(F.array(F.lit("[CLS]")), F.slice("s", F.lit(1), F.col("a")), sep, F.slice("g", F.lit(1), F.col("b")), sep)
    segments = F.concat(F.array_repeat(F.lit("0"), F.col("a") + 2), F.array_repeat(F.lit("1"), F.col("b") + 1))
    return d.select("conv_id", "turn", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("long").alias("mask"), F.array_join(segments, "").alias("segments"))


_SPANS = f"""(SELECT doc_id, n, unnest(range(0, CAST(CASE WHEN n = 0 THEN 0 ELSE ceil(greatest(n - 64, 0) / 32.0) + 1 END AS BIGINT))) * 32 AS start
FROM (SELECT doc_id, len({WORDS}) AS n FROM documents))"""


def _spans(t):
    n = F.size(words(F.col("text")))
    d = t("documents").select("doc_id", n.alias("n"))
    d = d.select("doc_id", "n", F.explode(arrays.span_starts(F.col("n"), 64, 32)).alias("start"))
    return d.select("doc_id", F.col("start").cast("long").alias("start"), F.least(F.lit(64), F.col("n") - F.col("start")).cast("long").alias("length"))


@query(f"SELECT doc_id, start, CAST(least(64, n - start) AS BIGINT) AS length FROM {_SPANS}")
def doc_spans(t):
    return _spans(t)


@query(f"""WITH s AS (SELECT doc_id, start, least(64, n - start) AS length FROM {_SPANS}), p AS (SELECT doc_id, start, length, unnest(range(start, start + length)) AS pos FROM s)
SELECT doc_id, pos, start FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY least(pos - start, start + length - 1 - pos) + 0.01 * length DESC, start) = 1""")
def max_context(t):
    # A place lies in two spans at most, so its best one is found in its row, without a shuffle.
    n = F.size(words(F.col("text")))
    d = t("documents").select("doc_id", n.alias("n")).filter("n > 0")
    d = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    last = (F.ceil(F.greatest(F.col("n") - 64, F.lit(0)) / 32) * 32).cast("int")
    late = F.least(F.floor(F.col("pos") / 32).cast("int") * 32, last)
    early = F.greatest(late - 32, F.lit(0))

    def score(start):  # in hundredths, so that equal contexts are equal numbers
        stop = F.least(start + 64, F.col("n"))
        return 100 * F.least(F.col("pos") - start, stop - 1 - F.col("pos")) + stop - start

    held = F.col("pos") < early + 64
    best = F.when(held & (score(early) >= score(late)), early).otherwise(late)
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), best.cast("long").alias("start"))


@query(f"""WITH b AS (SELECT item_id, pos, substr(text, pos, 1) AS c, CASE WHEN pos = 1 THEN ' ' ELSE substr(text, pos - 1, 1) END AS p
FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS pos FROM benchmark))
SELECT item_id, pos - 1 AS pos, CAST(sum(CASE WHEN c NOT IN (' ', chr(10)) AND p IN (' ', chr(10)) THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY pos) AS BIGINT) - 1 AS word FROM b""")
def char_to_word(t):
    # Runs of spaces and of letters by turns: each place's word is its run's, so work grows with the text alone.
    d = t("benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[ \t\r\n\u202f]+|[^ \t\r\n\u202f]+"), F.lit(0)).alias("runs"))
    first_letters = (~F.get("runs", F.lit(0)).rlike("^[ \t\r\n\u202f]")).cast("int")
    per_run = F.flatten(F.transform("runs", lambda r, i: F.array_repeat(F.floor((i + first_letters + 1) / 2).cast("long") - 1, F.char_length(r))))
    return d.select("item_id", F.posexplode(per_run).alias("pos", "word")).select("item_id", F.col("pos").cast("long").alias("pos"), "word")


@query(f"""WITH w AS (SELECT word, row_number() OVER (ORDER BY doc_id, pos) - 1 AS k, count(*) OVER () AS total FROM {WORD_ROWS})
SELECT k // 256 AS block, count(*) AS n, min_by(word, k) AS first, max_by(word, k) AS last FROM w WHERE k // 256 < (total - 256) // 256 + 1 GROUP BY 1""")
def lm_blocks(t):
    size = 256
    d = t("documents").select("doc_id", words(F.col("text")).alias("ws"))
    placed = order.running_total(d, "doc_id", F.size("ws").cast("long"))
    tokens = placed.select("before", F.posexplode("ws").alias("pos", "word")).select((F.col("before") + F.col("pos")).alias("at"), "word")
    blocks = tokens.groupBy(F.floor(F.col("at") / size).alias("block")).agg(F.count("*").alias("n"), F.min_by("word", "at").alias("first"), F.max_by("word", "at").alias("last"))
    return blocks.filter(F.col("n") == size)


@query(f"SELECT conv_id, turn, array_to_string(x[1:len(x) - 1], ' ') AS inputs, array_to_string(x[2:], ' ') AS labels FROM (SELECT conv_id, turn, {IDS} AS x FROM conversations) WHERE len(x) > 1")
def next_token_shift(t):
    d = turns(t).filter(F.size("ids") > 1)
    n = F.size("ids") - 1
    return d.select("conv_id", "turn", joined(F.slice("ids", F.lit(1), n)).alias("inputs"), joined(F.slice("ids", F.lit(2), n)).alias("labels"))


@query("""SELECT vec_id, 80::BIGINT AS wide, round(list_sum(embedding::DOUBLE[]), 5) AS wide_sum, 48::BIGINT AS narrow, round(list_sum(embedding[1:48]::DOUBLE[]), 5) AS narrow_sum FROM embeddings""")
def crop_or_pad(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    wide, narrow = arrays.crop_or_pad(v, 80), arrays.crop_or_pad(v, 48)
    return t("embeddings").select(
        "vec_id", F.size(wide).cast("long").alias("wide"), F.round(arrays.total(wide), 5).alias("wide_sum"),
        F.size(narrow).cast("long").alias("narrow"), F.round(arrays.total(narrow), 5).alias("narrow_sum"),
    )


@query("SELECT vec_id, r.i AS copy, label FROM embeddings, range(3) r(i)")
def batch_replicate(t):
    return t("embeddings").select("vec_id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("copy"), "label")


@query("""SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE i % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 4 END)) AS BIGINT) AS frames,
round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * (CASE i % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 4 END))), 5) AS total FROM embeddings""")
def length_regulate(t):
    # Durations 1.5, 2.5, 3.5, 0.5: halves go to the even number.
    v = F.transform("embedding", lambda x: x.cast("double"))
    d = F.transform("embedding", lambda x, i: (i % 4) + F.when(i % 4 == 3, -2.5).otherwise(1.5))
    out = arrays.regulate(v, d)
    return t("embeddings").select("vec_id", F.size(out).cast("long").alias("frames"), F.round(arrays.total(out), 5).alias("total"))


@query(f"""SELECT doc_id, CAST(sum((length(word) + 3) // 4) AS BIGINT) AS pieces, count(*) AS firsts,
md5(string_agg('1' || repeat('0', CAST((length(word) + 3) // 4 - 1 AS INT)), '' ORDER BY pos)) AS mask FROM {WORD_ROWS} GROUP BY doc_id""")
def subword_mask(t):
    # A word is cut into pieces of four characters; its label counts at the first alone.
    ws = words(F.col("text"))
    pieces = F.transform(ws, lambda w: F.floor((F.char_length(w) + 3) / 4).cast("int"))
    d = t("documents").select("doc_id", pieces.alias("p")).filter(F.size("p") > 0)
    mask = F.transform("p", lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), n - 1)))
    every = F.aggregate("p", F.lit(0).cast("long"), lambda s, n: s + n)
    return d.select("doc_id", every.alias("pieces"), F.size("p").cast("long").alias("firsts"), F.md5(F.array_join(mask, "")).alias("mask"))


@query(f"""WITH d AS (SELECT conv_id, turn, len({WORDS.replace('text', 'src')}) AS s, len({WORDS.replace('text', 'tgt')}) AS g FROM {PAIRS}),
b AS (SELECT *, CAST(floor(log2(greatest(s, g) + 1)) AS INT) AS band FROM d)
SELECT conv_id * 1048576 + turn AS key, CAST(s AS BIGINT) AS s, CAST(g AS BIGINT) AS g, band || '-' || CAST(floor((sum(greatest(s, g)) OVER (PARTITION BY band ORDER BY greatest(s, g), s, conv_id, turn ROWS UNBOUNDED PRECEDING) - greatest(s, g)) / 512) AS BIGINT) AS batch FROM b""")
def token_budget_batches(t):
    d = pairs(t).select((F.shiftleft("conv_id", 20) + F.col("turn")).alias("key"), F.size(words(F.col("src"))).alias("s"), F.size(words(F.col("tgt"))).alias("g"))
    return order.token_budget_batches(d, "key", "s", "g", 512)


@query("""SELECT conv_id, turn, trim(string_agg(role || ': ' || text || ' ; ', '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), ' ') AS history
FROM conversations""")
def dialogue_history(t):
    text = F.concat("role", F.lit(": "), "text", F.lit(" ; "))
    return order.history(t("conversations"), "conv_id", "turn", text).select("conv_id", "turn", "history")
