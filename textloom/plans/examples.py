"""Queries over labels of pieces, predictions of examples, dialogue batches, signals and score lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, labels
from ..functions.moses import tokenise_moses
from ..functions.text import words
from ..operators import examples
from ..operators.order import ranked
from .base import query
from .corpus import PAIRS, WORDS, pairs

#: Words cut into pieces of four characters.
_PIECES = f"SELECT conv_id, turn, ws, list_transform(ws, lambda w: list_transform(range((length(w) + 3) // 4), lambda k: substr(w, k * 4 + 1, 4))) AS ps FROM (SELECT conv_id, turn, {WORDS} AS ws FROM conversations)"


def _pieces(t):
    def cut(w):
        starts = F.sequence(F.lit(0), F.greatest(F.char_length(w) - 1, F.lit(0)), F.lit(4))
        return F.transform(starts, lambda k: F.substr(w, k + 1, F.lit(4)))

    d = t("conversations").select("conv_id", "turn", words(F.col("text")).alias("ws"))
    return d.withColumn("ps", F.transform("ws", cut))


def _text(a, by=" "):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), by)


@query(f"""WITH p AS ({_PIECES}), b AS (SELECT *, (SELECT least(24, max(len(flatten(ps)) + 2)) FROM p) AS lim FROM p),
r AS (SELECT conv_id, turn, lim, flatten(ps) || ['[SEP]'] AS tok, flatten(list_transform(ps, lambda x: list_transform(x, lambda y, k: CASE k WHEN 1 THEN 1 ELSE 0 END))) || [0] AS fst,
flatten(list_transform(ps, lambda x: list_transform(x, lambda y, k: CASE k WHEN 1 THEN 1 ELSE 0 END))) || [1] AS los,
flatten(list_transform(ws, lambda w: list_transform(range((length(w) + 3) // 4), lambda k: length(w) % 5))) || [128] AS lab FROM b)
SELECT conv_id, turn, array_to_string(list_resize(['[CLS]'] || tok[greatest(len(tok) - lim + 2, 1):], lim, '[PAD]'), ' ') AS tokens,
array_to_string(list_resize([0] || fst[greatest(len(fst) - lim + 2, 1):], lim, 0), '') AS first_mask,
array_to_string(list_resize([1] || los[greatest(len(los) - lim + 2, 1):], lim, 0), '') AS loss_mask,
array_to_string(list_resize([128] || lab[greatest(len(lab) - lim + 2, 1):], lim, 128), ' ') AS slots FROM r""")
def slot_features(t):
    d = _pieces(t)
    limit = d.agg(F.least(F.lit(24), F.max(F.size(F.flatten("ps")) + 2)).alias("limit"))
    rows = labels.piece_rows(F.col("ps"), F.col("limit"), extra=False)
    of_word = F.transform("ws", lambda w: F.char_length(w) % 5)
    slots = labels.piece_labels(F.col("ps"), of_word, F.col("limit"), F.lit(128))
    d = d.join(F.broadcast(limit))  # one row
    return d.select(
        "conv_id", "turn", F.array_join(rows["tokens"], " ").alias("tokens"), _text(rows["first_mask"], "").alias("first_mask"),
        _text(rows["loss_mask"], "").alias("loss_mask"), _text(slots).alias("slots"),
    )


@query(f"""SELECT conv_id, turn, array_to_string(list_transform(ws, lambda w: CASE WHEN w[-1] IN ('.', ',', '?') THEN w[-1] ELSE 'O' END), '') AS marks,
array_to_string(list_transform(ws, lambda w: CASE WHEN w[1] BETWEEN 'A' AND 'Z' THEN 'U' ELSE 'O' END), '') AS capitals FROM (SELECT conv_id, turn, {WORDS} AS ws FROM conversations)""")
def mark_and_capital_tracks(t):
    def label(w):
        last = F.right(w, F.lit(1))
        return F.concat(F.when(last.isin(".", ",", "?"), last).otherwise("O"), F.when(w.rlike("^[A-Z]"), "U").otherwise("O"))

    d = t("conversations").select("conv_id", "turn", F.transform(words(F.col("text")), label).alias("tokens"))
    marks, capitals = labels.label_tracks(F.col("tokens"))
    return d.select("conv_id", "turn", F.array_join(marks, "").alias("marks"), F.array_join(capitals, "").alias("capitals"))


@query(f"""SELECT conv_id, turn, array_to_string(list_transform({WORDS}, lambda w: w || '/' || length(w) % 7), ' ') AS readout FROM conversations""")
def slot_readout(t):
    d = _pieces(t).withColumn("limit", F.size(F.flatten("ps")) + 4)
    predicted = labels.piece_labels(F.col("ps"), F.transform("ws", lambda w: F.char_length(w) % 7), F.col("limit"), F.lit(9))
    mask = labels.piece_rows(F.col("ps"), F.col("limit"))["first_mask"]
    d = d.select("conv_id", "turn", labels.first_piece_readout(F.col("ws"), predicted, mask).alias("r"))
    pair = F.transform("r", lambda x: F.concat(x["word"], F.lit("/"), x["label"].cast("string")))
    return d.select("conv_id", "turn", F.array_join(pair, " ").alias("readout"))


@query("""WITH s AS (SELECT vec_id // 4 AS example, vec_id % 4 AS feature, embedding[33]::DOUBLE + embedding[41]::DOUBLE AS score FROM embeddings)
SELECT example, count(*) AS features, arg_min(feature, (score, feature)) AS feature, round(min(score), 6) AS null_score FROM s GROUP BY example""")
def null_answers(t):
    # Two outputs of each feature: the second replaces the first.
    e = t("embeddings")
    features = e.select(F.col("vec_id").alias("unique_id"), F.floor(F.col("vec_id") / 4).alias("example"), (F.col("vec_id") % 4).alias("feature"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    copies = e.select(F.col("vec_id").alias("unique_id"), v.alias("v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    outputs = copies.select("unique_id", "position", F.slice("v", F.col("position") * 32 + 1, 8).alias("start"), F.slice("v", F.col("position") * 32 + 9, 8).alias("end"))
    return examples.null_answers(features, outputs).withColumn("null_score", F.round("null_score", 6))


@query(f"""WITH d AS (SELECT conv_id, turn, list_transform({WORDS}, lambda w: length(w)) AS c, list_transform({WORDS}[1:3], lambda w: list_transform(range(length(w) % 4), lambda i: length(w))) AS r FROM conversations),
m AS (SELECT *, greatest(max(len(c)) OVER (PARTITION BY conv_id), 1) AS mc, max(coalesce(list_max(list_transform(r, lambda x: len(x))), 0)) OVER (PARTITION BY conv_id) AS mr FROM d)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY len(c) DESC, turn) - 1 AS place, array_to_string(list_resize(c, mc, 1), ' ') AS context,
array_to_string(list_transform(r, lambda x: array_to_string(list_resize(x, mr, 0), ' ')), '|') AS responses FROM m""")
def dialogue_batches(t):
    w = words(F.col("text"))
    context = F.transform(w, F.char_length)
    responses = F.transform(F.slice(w, 1, 3), lambda x: F.array_repeat(F.char_length(x), F.char_length(x) % 4))
    d = t("conversations").select("conv_id", "turn", context.alias("context"), responses.alias("responses"))
    out = examples.dialogue_batches(d, "conv_id", "turn", "context", "responses", 0)
    return out.select(
        "conv_id", "turn", F.col("place").cast("long").alias("place"), _text(F.col("context")).alias("context"),
        F.array_join(F.transform("responses", lambda r: _text(r)), "|").alias("responses"),
    )


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) AS rn, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line FROM (SELECT DISTINCT source, doc_id FROM documents WHERE source IS NOT NULL)),
e AS (SELECT source AS last FROM r WHERE rn = 50) SELECT source, doc_id FROM r WHERE rn <= 50 OR (line = 1 AND source > (SELECT last FROM e))""")
def capped_files(t):
    d = t("documents").filter("source is not null").select("source", "doc_id").distinct()
    return examples.capped_files(d, "source", "doc_id", 50)


@query("""SELECT i AS id, token FROM (SELECT unnest(['[PAD]', '[UNK]', '[CLS]']) AS token, unnest(range(3)) AS i)
UNION ALL SELECT i + 2, CASE WHEN i % 3 = 0 THEN word ELSE '##' || word END FROM (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word FROM benchmark)) WHERE i > 0""")
def piece_vocabulary(t):
    listed = t("benchmark").select(F.explode(words(F.col("text"))).alias("word")).distinct()
    d = ranked(listed, "word", "id")
    piece = F.concat(F.when(F.col("id") % 3 == 0, "▁").otherwise(""), "word")
    return examples.piece_vocabulary(d.select("id", piece.alias("piece")), "piece", "id", ["[PAD]", "[UNK]", "[CLS]"])


def _kept(side: str, keep: str) -> str:
    gone = f"(len({side}) - {keep})"
    front = f"len(list_filter(range({gone}), lambda k: substr(md5('3:' || key || ':{side}:' || k), 1, 1) < '8'))"
    return f"array_to_string({side}[{front} + 1:{front} + {keep}], ' ')"


@query(f"""WITH d AS (SELECT conv_id, turn, conv_id || '-' || turn AS key, {WORDS.replace('text', 'src')} AS a, {WORDS.replace('text', 'tgt')} AS b FROM {PAIRS}),
k AS (SELECT *, CASE WHEN len(a) + len(b) <= 12 THEN len(a) ELSE least(len(a), greatest(12 - len(b), 6)) END AS na, CASE WHEN len(a) + len(b) <= 12 THEN len(b) ELSE 12 - least(len(a), greatest(12 - len(b), 6)) END AS nb FROM d)
SELECT conv_id, turn, {_kept('a', 'na')} AS one, {_kept('b', 'nb')} AS two FROM k""")
def random_end_truncation(t):
    d = pairs(t).select("conv_id", "turn", words(F.col("src")).alias("a"), words(F.col("tgt")).alias("b"))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    one, two = labels.truncate_at_random_ends(F.col("a"), F.col("b"), 12, key, seed=3)
    return d.select("conv_id", "turn", F.array_join(one, " ").alias("one"), F.array_join(two, " ").alias("two"))


def _weighed(expr: str) -> str:
    return f"round(coalesce(list_sum(list_transform({expr}, lambda x, i: x * i)), 0), 4)"


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CAST(trunc(((vec_id % 3)::DOUBLE * 0.5::DOUBLE + 0.03::DOUBLE) * 16) AS BIGINT) AS s,
CASE WHEN vec_id % 4 = 0 THEN 64 ELSE CAST(trunc((vec_id % 4)::DOUBLE * 0.7::DOUBLE * 16) AS BIGINT) END AS n,
('0x' || substr(md5('5:' || vec_id), 1, 8))::BIGINT % 55 AS r, vec_id % 9 - 4 AS h FROM embeddings)
SELECT vec_id, {_weighed('v[s + 1:s + n]')} AS part, {_weighed('v[r + 1:r + 10]')} AS drawn,
{_weighed('list_transform(range(64), lambda i: CASE WHEN i + h BETWEEN 0 AND 63 THEN v[i + h + 1] ELSE 0 END)')} AS shifted FROM e""")
def signal_parts(t):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    offset, seconds = (F.col("vec_id") % 3) * F.lit(0.5) + F.lit(0.03), (F.col("vec_id") % 4) * F.lit(0.7)

    def weighed(a):
        return F.round(arrays.total(F.transform(a, lambda x, i: x * (i + 1))), 4)

    v = F.col("v")
    return e.select(
        "vec_id", weighed(labels.signal_part(v, 16, offset, seconds)).alias("part"), weighed(labels.random_part(v, 10, F.col("vec_id"), seed=5)).alias("drawn"),
        weighed(labels.shift_signal(v, (F.col("vec_id") % 9 - 4).cast("int"))).alias("shifted"),
    )


@query(f"""WITH s AS (SELECT role, count(*) AS n, CAST(sum(len({WORDS})) AS BIGINT) AS w, CAST(sum(length(text)) AS BIGINT) AS c FROM conversations GROUP BY role)
SELECT role, printf('BLEU = %.2f %s(BP = %.3f ratio = %.3f hyp_len = %d ref_len = %d)', round(100.0::DOUBLE * n / w, 2), printf('%.1f', round(100.0::DOUBLE * w / c, 1)) || '/' || printf('%.1f', round(100.0::DOUBLE * n / c, 1)), round(n::DOUBLE / w, 3), round(w::DOUBLE / c, 3), w, c) AS line,
'c.lc+#.1+s.exp+tok.13a+v.1' AS signature, round(ln(n), 6) AS log_n, -9999999999.0::DOUBLE AS log_zero FROM s""")
def score_lines(t):
    d = t("conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.sum(F.size(words(F.col("text")))).alias("w"), F.sum(F.char_length("text")).alias("c")
    )
    n, w, c = F.col("n"), F.col("w"), F.col("c")
    line = labels.score_line(100.0 * n / w, [100.0 * w / c, 100.0 * n / c], n / w, w, c)
    signature = labels.score_signature({"tok": "13a", "version": "1", "smooth": "exp", "numrefs": "1", "case": "lc"}, short=True)
    return d.select("role", line.alias("line"), F.lit(signature).alias("signature"), F.round(labels.floor_log(n), 6).alias("log_n"), labels.floor_log(n - n).alias("log_zero"))


def _moses_sql(text: str) -> str:
    letters = "\\p{L}\\p{N}_"
    other = "[^\\p{L}\\p{Nl}\\p{No}_]"

    def sub(pattern, to):
        nonlocal text
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"

    def swap(a, b):
        nonlocal text
        text = f"replace({text}, '{a}', '{b}')"

    sub("[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+", " ")
    sub("[\\x00-\\x1f]", "")
    sub(" +", " ")
    text = f"trim({text}, ' ')"
    sub(f"([^\\s.''`,\\-{letters}]|[_\\p{{No}}])", " \\1 ")
    for _ in range(2):  # letters between two hyphens belong to both
        sub(f"([{letters}])-([{letters}])", "\\1 @-@ \\2")
    swap("..", "\ue000\ue000")
    swap("\ue000.", "\ue000\ue000")
    sub("(\ue000+)", " \\1 ")
    sub("(\\P{Nd}),", "\\1 , ")
    sub(",(\\P{Nd})", " , \\1")
    sub("(\\p{Nd}),$", "\\1 ,")
    sub(f"({other})''({other})", "\\1 \\\\'' \\2")
    sub(f"([^{letters}])''(.)", "\\1 \\\\'' \\2")
    sub(f"(.)''({other})", "\\1 \\\\'' \\2")
    sub("(.)''(.)", "\\1 \\\\''\\2")
    sub(f"({other})''(s)", "\\1 \\\\''\\2")
    sub(" +", " ")
    text = f"trim({text}, ' ')"
    sub("(\\S)\\.( |$)", "\\1 .\\2")
    sub("\\.'' ?$", " . \\\\'' ")
    swap("\ue000", ".")
    for a, b in (("&", "&amp;"), ("|", "&#124;"), ("<", "&lt;"), (">", "&gt;"), ("''", "&apos;"), ('"', "&quot;"), ("[", "&#91;"), ("]", "&#93;")):
        swap(a, b)
    return text


#: Puts hyphens, runs of dots and contractions into the texts.
_MARKED = "replace(replace(replace(text, 'ti', 'a-b-c'), 'o ', '... '), 'th', '''s&')"


@query(f"SELECT doc_id, md5({_moses_sql(_MARKED)}) AS tokens FROM documents")
def tokenise_moses_english(t):
    text = F.col("text")
    for a, b in (("ti", "a-b-c"), ("o ", "... "), ("th", "'s&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return t("documents").select("doc_id", F.md5(tokenise_moses(text)).alias("tokens"))
