"""Queries of batches, decoders and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import softmax
from ..functions.text import words
from ..operators import batching, decoding, generation, language
from .base import query
from .corpus import PAIRS, WORDS, pairs

_WIDTHS = f"SELECT conv_id * 1048576 + turn AS key, len({WORDS.replace('text', 'src')}) AS s, len({WORDS.replace('text', 'tgt')}) AS g FROM {PAIRS}"


@query(f"""WITH RECURSIVE x AS (SELECT key, s, g, dense_rank() OVER (ORDER BY s) - 1 AS i, row_number() OVER (PARTITION BY s ORDER BY g, key) - 1 AS k FROM ({_WIDTHS})),
z AS (SELECT i, count(*) AS n FROM x GROUP BY i),
walk AS (SELECT 0::BIGINT AS step, NULL::BIGINT AS key, 0::BIGINT AS i, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS src, 0::BIGINT AS tgt, 0::BIGINT AS n, []::STRUCT(s BIGINT, g BIGINT)[] AS latest, NULL::BIGINT AS cut
UNION ALL SELECT step + 1, key, CASE WHEN used < size THEN i WHEN coalesce(next_size > b2, true) THEN i + 1 ELSE i + 2 END, CASE WHEN used < size THEN used WHEN coalesce(next_size > b2, true) THEN b2 ELSE 0 END, CASE WHEN used < size THEN b2 ELSE 0 END,
CASE WHEN n2 * (src2 + tgt2) <= 512 THEN src2 ELSE coalesce(list_max(list_transform(kept, lambda p: p.s)), 0) END, CASE WHEN n2 * (src2 + tgt2) <= 512 THEN tgt2 ELSE coalesce(list_max(list_transform(kept, lambda p: p.g)), 0) END,
CASE WHEN n2 * (src2 + tgt2) <= 512 THEN n2 ELSE rest END, latest, CASE WHEN n2 * (src2 + tgt2) > 512 THEN step + 1 - rest END
FROM (SELECT *, latest[len(latest) - rest + 1:] AS kept FROM (SELECT *, CASE WHEN n2 <= 8 THEN 0 ELSE n2 - 8 * ((n2 - 1) // 8) END AS rest, list_append(older, {{'s': ps, 'g': pg}})[-8:] AS latest, greatest(src, ps) AS src2, greatest(tgt, pg) AS tgt2 FROM (
SELECT step, i, src, tgt, n + 1 AS n2, older, size, next_size, CASE WHEN ahead THEN a ELSE a + 1 END AS used, CASE WHEN ahead THEN b + 1 ELSE b END AS b2, CASE WHEN ahead THEN fkey ELSE hkey END AS key, CASE WHEN ahead THEN fs ELSE hs END AS ps, CASE WHEN ahead THEN fg ELSE hg END AS pg FROM (
SELECT w.step, w.i, w.a, w.b, w.src, w.tgt, w.n, w.latest AS older, zi.n AS size, zn.n AS next_size, h.key AS hkey, h.s AS hs, h.g AS hg, f.key AS fkey, f.s AS fs, f.g AS fg,
f.s IS NOT NULL AND greatest(w.src, h.s) + greatest(w.tgt, h.g) > greatest(w.src, f.s) + greatest(w.tgt, f.g) AS ahead
FROM walk w JOIN x h ON h.i = w.i AND h.k = w.a JOIN z zi ON zi.i = w.i LEFT JOIN z zn ON zn.i = w.i + 1 LEFT JOIN x f ON f.i = w.i + 1 AND f.k = w.b))))),
c AS (SELECT cut FROM walk WHERE cut IS NOT NULL), p AS (SELECT key, step FROM walk WHERE key IS NOT NULL)
SELECT x.key, CAST(x.s AS BIGINT) AS s, CAST(x.g AS BIGINT) AS g, (SELECT count(*) FROM c WHERE cut < p.step) AS batch FROM x JOIN p USING (key)""")
def greedy_batches(t):
    d = pairs(t).select((F.shiftleft("conv_id", 20) + F.col("turn")).alias("key"), F.size(words(F.col("src"))).cast("long").alias("s"), F.size(words(F.col("tgt"))).cast("long").alias("g"))
    return batching.greedy_batches(d, "key", "s", "g", 512)


# ---- language model and decoder ---------------------------------------------------

SYMBOLS = " aehnot"
#: Of each embedding, eight frames: probabilities of the seven symbols and the blank.
FRAMES, SHARP = 8, 12.0

_GRAMS = f"""q AS (SELECT list_filter(string_split(regexp_replace(lower(text), '[^{SYMBOLS}]', '', 'g'), ''), lambda c: c <> '') AS a FROM benchmark),
g AS (SELECT array_to_string(a[i:i + k - 2], chr(31)) AS context, a[i + k - 1] AS symbol, k AS size, count(*) AS n FROM (SELECT a, k, unnest(range(1, len(a) - k + 2)) AS i FROM q, range(1, 4) r(k)) GROUP BY ALL),
s AS (SELECT context, size, sum(n) AS total, 0.5 * count(*) / sum(n) AS weight FROM g GROUP BY ALL),
p1 AS (SELECT context, symbol, size, (n - 0.5) / total + weight / {len(SYMBOLS)} AS p FROM g JOIN s USING (context, size) WHERE size = 1),
p2 AS (SELECT g.context, g.symbol, g.size, (n - 0.5) / total + weight * p1.p AS p FROM g JOIN s USING (context, size) JOIN p1 ON p1.symbol = g.symbol WHERE g.size = 2),
p3 AS (SELECT g.context, g.symbol, g.size, (n - 0.5) / total + weight * p2.p AS p FROM g JOIN s USING (context, size) JOIN p2 ON p2.symbol = g.symbol AND p2.context = right(g.context, 1) WHERE g.size = 3)"""


def _model(t):
    letters = F.split(F.regexp_replace(F.lower("text"), f"[^{SYMBOLS}]", ""), "")
    texts = t("benchmark").select(F.filter(letters, lambda c: c != "").alias("letters"))
    return language.backoff_model(language.ngram_counts(texts, "letters", 3), len(SYMBOLS), 3)


@query(f"""WITH {_GRAMS} SELECT replace(context, chr(31), '') AS context, symbol, round(p, 9) AS p, NULL::DOUBLE AS weight FROM (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3)
UNION ALL SELECT replace(context, chr(31), ''), NULL, NULL, round(weight, 9) FROM s""")
def ngram_model(t):
    return _model(t).select(F.replace("context", F.lit(language.MARK), F.lit("")).alias("context"), "symbol", F.round("p", 9).alias("p"), F.round("weight", 9).alias("weight"))


_BEAM = f"""WITH RECURSIVE {_GRAMS},
v AS (SELECT unnest(range({len(SYMBOLS)})) AS k, unnest(string_split('{SYMBOLS}', '')) AS symbol),
l1 AS (SELECT '' AS context, symbol, coalesce(p, (SELECT weight FROM s WHERE size = 1) / {len(SYMBOLS)}) AS p FROM v LEFT JOIN p1 USING (symbol)),
l2 AS (SELECT c.symbol AS context, l1.symbol, coalesce(p2.p, coalesce(s.weight, 1) * l1.p) AS p FROM v c, l1 LEFT JOIN p2 ON p2.context = c.symbol AND p2.symbol = l1.symbol LEFT JOIN s ON s.size = 2 AND s.context = c.symbol),
l3 AS (SELECT c.symbol || l2.context AS context, l2.symbol, coalesce(p3.p, coalesce(s.weight, 1) * l2.p) AS p FROM v c, l2 LEFT JOIN p3 ON p3.context = c.symbol || chr(31) || l2.context AND p3.symbol = l2.symbol LEFT JOIN s ON s.size = 3 AND s.context = c.symbol || chr(31) || l2.context),
lm AS (SELECT context, k, symbol, ln(p) AS logp FROM (FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) JOIN v USING (symbol)),
e AS (SELECT vec_id, f, list_transform(range(8), lambda k: exp({SHARP} * embedding[8 * f + k + 1]::DOUBLE)) AS x FROM embeddings, range({FRAMES}) r(f)),
frames AS (SELECT vec_id, f, list_transform(x, lambda y: y / list_sum(x)) AS p FROM e),
b AS (SELECT vec_id, 0::BIGINT AS f, '' AS prefix, 1.0::DOUBLE AS pb, 0.0::DOUBLE AS pn, 0.0::DOUBLE AS lm FROM embeddings
UNION ALL SELECT vec_id, f + 1, longer, sum(pb2), sum(pn2), any_value(lm2) FROM (
SELECT b.vec_id, b.f, CASE WHEN a.k = 7 THEN prefix ELSE prefix || v.symbol END AS longer, CASE WHEN a.k = 7 THEN (pb + pn) * p[8] ELSE 0 END AS pb2,
CASE WHEN a.k < 7 THEN CASE WHEN right(prefix, 1) = v.symbol THEN pb ELSE pb + pn END * p[a.k + 1] WHEN prefix = '' THEN 0 ELSE pn * p[strpos('{SYMBOLS}', right(prefix, 1))] END AS pn2,
b.lm + CASE WHEN a.k = 7 THEN 0 ELSE lm.logp END AS lm2
FROM b JOIN frames f ON f.vec_id = b.vec_id AND f.f = b.f, range(8) a(k) LEFT JOIN v ON v.k = a.k LEFT JOIN lm ON lm.k = a.k AND lm.context = right(prefix, 2)) WHERE pb2 + pn2 > 0
GROUP BY vec_id, f, longer QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ln(sum(pb2) + sum(pn2)) + 0.5 * any_value(lm2) + 0.3 * length(longer) DESC, longer) <= 20)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY ln(pb + pn) + 0.5 * lm + 0.3 * length(prefix) DESC, prefix) - 1 AS INT) AS rank, prefix AS text, round(ln(pb + pn) + 0.5 * lm + 0.3 * length(prefix), 6) AS score, round(ln(pb + pn), 6) AS acoustic, round(lm, 6) AS language
FROM b WHERE f = {FRAMES} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ln(pb + pn) + 0.5 * lm + 0.3 * length(prefix) DESC, prefix) <= 3"""


def frames_of_embeddings(t):
    """(vec_id, frames): runs of eight values as log probabilities."""
    runs = F.transform(F.sequence(F.lit(0), F.lit(FRAMES - 1)), lambda f: F.transform(F.slice("embedding", 8 * f + 1, F.lit(8)), lambda x: SHARP * x.cast("double")))
    return t("embeddings").select("vec_id", F.transform(runs, lambda r: F.transform(softmax(r), lambda p: F.log(p))).alias("frames"))


@query(_BEAM)
def ctc_beam_search(t):
    model = language.collected(_model(t), len(SYMBOLS), 3)
    found = decoding.ctc_beam_search(frames_of_embeddings(t), "frames", list(SYMBOLS), width=20, model=model, alpha=0.5, beta=0.3, n_best=3, keys=("vec_id",))
    return found.select("vec_id", "rank", "text", *[F.round(c, 6).alias(c) for c in ("score", "acoustic", "language")])


# ---- generators --------------------------------------------------------------------

#: Bigrams of all documents; each conversation's first turn is continued from its last word.
END, STEPS, WIDTH, PENALTY = "</s>", 5, 4, 0.6

_CHAIN = f"""w AS (SELECT {WORDS} AS a FROM documents),
n AS (SELECT a[i] AS state, coalesce(a[i + 1], '{END}') AS token, count(*) AS n FROM (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM w) GROUP BY ALL),
tr AS (SELECT state, token, round(ln(n / sum(n) OVER (PARTITION BY state)), 9) AS logp FROM n),
best AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY state ORDER BY logp DESC, token) <= {{k}}),
prompts AS (SELECT conv_id, ws[len(ws)] AS word FROM (SELECT conv_id, {WORDS} AS ws FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) WHERE len(ws) > 0)"""

_SEARCH = f"""WITH RECURSIVE {_CHAIN},
b AS (SELECT conv_id, 0 AS step, [word] AS tokens, 0.0::DOUBLE AS logp, false AS done FROM prompts
UNION ALL SELECT conv_id, step + 1, longer, logp2, done2 FROM (
SELECT conv_id, step, CASE WHEN done OR token IS NULL THEN tokens ELSE list_append(tokens, token) END AS longer, CASE WHEN done OR token IS NULL THEN b.logp ELSE b.logp + best.logp END AS logp2, done OR token IS NULL OR token = '{END}' AS done2,
1 + len(list_filter(tokens, lambda x: x <> '{END}')) AS n FROM b LEFT JOIN best ON NOT done AND state = tokens[len(tokens)] WHERE step < {STEPS})
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(logp2 / pow(n, {{pen}}), 9) DESC, longer) <= {{k}})
SELECT conv_id, array_to_string(tokens, ' ') AS text, round(logp / pow(1 + len(list_filter(tokens, lambda x: x <> '{END}')), {{pen}}), 6) AS score FROM b WHERE step = {STEPS}
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(logp / pow(1 + len(list_filter(tokens, lambda x: x <> '{END}')), {{pen}}), 9) DESC, tokens) = 1"""


def _counts(t):
    return generation.pair_counts(t("documents").select(words(F.col("text")).alias("a")), "a", END)


def _prompts(t):
    first = t("conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.element_at(words(F.col("text")), -1).alias("word")).filter("word is not null")


@query(_SEARCH.format(k=1, pen="0.0"))
def generate_greedy(t):
    found = generation.beam_search(_prompts(t), "conv_id", "word", _counts(t), width=1, steps=STEPS, end=END)
    return found.select("conv_id", F.array_join("tokens", " ").alias("text"), F.round("score", 6).alias("score"))


@query(_SEARCH.format(k=WIDTH, pen=PENALTY))
def generate_beam(t):
    found = generation.beam_search(_prompts(t), "conv_id", "word", _counts(t), width=WIDTH, steps=STEPS, end=END, penalty=PENALTY)
    return found.select("conv_id", F.array_join("tokens", " ").alias("text"), F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_CHAIN.format(k=10)},
b AS (SELECT conv_id, 0 AS step, [word] AS tokens, 0.0::DOUBLE AS logp FROM prompts
UNION ALL SELECT conv_id, step + 1, CASE WHEN token IS NULL THEN tokens ELSE list_append(tokens, token) END, b.logp + coalesce(best.logp, 0) FROM b LEFT JOIN best ON state = tokens[len(tokens)] AND (step = 0 OR state <> '{END}') WHERE step < {STEPS}
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY round(best.logp / 0.7 - ln(-ln((('0x' || substr(md5('3:' || conv_id || ':' || step || ':' || token), 1, 12))::BIGINT + 0.5) / 281474976710656.0)), 9) DESC, token DESC) = 1)
SELECT conv_id, array_to_string(tokens, ' ') AS text, round(logp, 6) AS logp FROM b WHERE step = {STEPS}""")
def generate_sampled(t):
    found = generation.sampled(_prompts(t), "conv_id", "word", _counts(t), k=10, steps=STEPS, end=END, temperature=0.7, seed=3)
    return found.select("conv_id", F.array_join("tokens", " ").alias("text"), F.round("logp", 6).alias("logp"))
