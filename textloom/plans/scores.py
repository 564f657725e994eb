"""Queries that score: error rates, translation scores, answers, classes, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.text import normalise_answer, words
from ..operators import aggregates, dialogue, metrics, sets
from .base import query
from .corpus import PAIRS, WORDS, pairs
from .texts import normal_sql

WS, WT = WORDS.replace("text", "src"), WORDS.replace("text", "tgt")
#: DuckDB's distance counts bytes: each character or word of both sides becomes its place among
#: those, as one byte; one of a single side matches nothing and is 1 or 2.
_CODED = """SELECT *, list_aggregate(list_transform(a, lambda c: chr(coalesce(nullif(list_position(d, c), 0) + 2, 1)::INT)), 'string_agg', '') AS h,
list_aggregate(list_transform(b, lambda c: chr(coalesce(nullif(list_position(d, c), 0) + 2, 2)::INT)), 'string_agg', '') AS r
FROM (SELECT role, a, b, list_intersect(a, b) AS d FROM ({0}))"""
_EDITS = "CASE WHEN len(a) = 0 THEN len(b) WHEN len(b) = 0 THEN len(a) ELSE levenshtein(h, r) END"


@query(f"""SELECT role, count(*) AS n, round(sum({_EDITS}) / sum(len(b)), 6) AS cer
FROM ({_CODED.format(f"SELECT role, regexp_extract_all(src, '(?s).') AS a, regexp_extract_all(tgt, '(?s).') AS b FROM {PAIRS}")}) GROUP BY role""")
def cer_by_role(t):
    d = pairs(t).select("role", "src", "tgt")
    return d.groupBy("role").agg(F.count("*").alias("n"), F.round(metrics.character_error_rate(F.col("src"), F.col("tgt")), 6).alias("cer"))


def _wer_sql(reference):
    return f"""SELECT role, CAST(sum({_EDITS}) AS BIGINT) AS edits, CAST(sum(len({reference})) AS BIGINT) AS words, round(sum({_EDITS}) / sum(len({reference})), 6) AS wer
FROM ({_CODED.format(f"SELECT role, {WS} AS a, {WT} AS b FROM {PAIRS}")}) GROUP BY role"""


def _wer(t, reference):
    d = pairs(t).select("role", words(F.col("src")).alias("h"), words(F.col("tgt")).alias("r"))
    d = d.select("role", F.size(reference).alias("n"), arrays.edit_distance("h", "r").alias("e"))
    return d.groupBy("role").agg(F.sum("e").alias("edits"), F.sum("n").cast("long").alias("words"), F.round(F.sum("e") / F.sum("n"), 6).alias("wer"))


@query(_wer_sql("b"))
def wer_by_role(t):
    return _wer(t, "r")


@query(_wer_sql("a"))
def wer_of_system_words(t):
    # The rate of translation scores: edits by the words of the hypothesis.
    return _wer(t, "h")


@query("""WITH e AS (SELECT vec_id, label % 10 AS target, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS z FROM embeddings),
r AS (SELECT 1 + len(list_filter(range(1, 11), lambda i: z[i] > z[target + 1] OR (z[i] = z[target + 1] AND i < target + 1))) AS rank FROM e)
SELECT k.k, round(avg(CASE WHEN rank <= k.k THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM r, (VALUES (1::BIGINT), (3::BIGINT), (5::BIGINT)) k(k) GROUP BY k.k""")
def topk_accuracy(t):
    e = t("embeddings").select(F.pmod("label", F.lit(10)).alias("target"), F.slice("embedding", 1, 10).alias("z"))
    own = F.get("z", F.col("target"))
    ahead = F.filter(F.transform("z", lambda x, i: (x > own) | ((x == own) & (i < F.col("target")))), lambda b: b)
    ranked = e.select((F.size(ahead) + 1).alias("rank"), F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 3, 5)])).alias("k"))
    return ranked.groupBy("k").agg(F.round(F.avg((F.col("rank") <= F.col("k")).cast("double")), 6).alias("accuracy"))


@query("""SELECT vec_id, round(pow(2, list_sum(list_transform(embedding[1:16], lambda x: abs(x::DOUBLE))) / 16), 6) AS ppl,
round(list_sum(list_transform(embedding[1:16], lambda x: abs(x::DOUBLE))) / 16, 6) AS bpc FROM embeddings""")
def bits_per_char(t):
    nll = F.transform(F.slice("embedding", 1, 16), lambda x: F.abs(x.cast("double")))
    bpc = arrays.total(nll) / 16
    return t("embeddings").select("vec_id", F.round(F.pow(F.lit(2.0), bpc), 6).alias("ppl"), F.round(bpc, 6).alias("bpc"))


@query("SELECT label, round(exp(avg(abs(embedding[1]::DOUBLE))), 6) AS ppl FROM embeddings GROUP BY label")
def perplexity(t):
    loss = F.abs(F.get("embedding", F.lit(0)).cast("double"))
    return t("embeddings").groupBy("label").agg(F.round(aggregates.perplexity(loss), 6).alias("ppl"))


@query("SELECT label, round(sum(abs(embedding[1]::DOUBLE) * (vec_id % 7 + 1)) / sum(vec_id % 7 + 1), 6) AS loss FROM embeddings GROUP BY label")
def weighted_mean_loss(t):
    loss, n = F.abs(F.get("embedding", F.lit(0)).cast("double")), F.col("vec_id") % 7 + 1
    return t("embeddings").groupBy("label").agg(F.round(aggregates.weighted_mean(loss, n), 6).alias("loss"))


def _gram_sql(table, key, col, low, high):
    parts = [
        f"SELECT {key}, {k} AS o, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM (SELECT {key}, {col} AS w FROM {table}) WHERE len(w) >= {k}"
        for k in range(low, high + 1)
    ]
    return "(" + " UNION ALL ".join(parts) + ")"


def _stats_sql(low, high, h, r):
    key = "conv_id, turn"
    return f"""h AS (SELECT {key}, o, g, count(*) AS n FROM {_gram_sql('p', key, h, low, high)} GROUP BY ALL),
r AS (SELECT {key}, o, g, count(*) AS n FROM {_gram_sql('p', key, r, low, high)} GROUP BY ALL),
c AS (SELECT o, sum(least(h.n, r.n)) AS correct FROM h JOIN r USING (conv_id, turn, o, g) GROUP BY o),
x AS (SELECT o, sum(n) AS total FROM h GROUP BY o), y AS (SELECT o, sum(n) AS reference FROM r GROUP BY o)"""


@query(f"""WITH p AS (SELECT conv_id, turn, {WS} AS a, {WT} AS b FROM {PAIRS}), {_stats_sql(1, 4, 'a', 'b')}
SELECT CAST(o AS BIGINT) AS "order", CAST(coalesce(correct, 0) AS BIGINT) AS correct, CAST(total AS BIGINT) AS total FROM x LEFT JOIN c USING (o)""")
def bleu_multi_ref(t):
    p = pairs(t).select("conv_id", "turn", words(F.col("src")).alias("a"), words(F.col("tgt")).alias("b"))
    m = metrics.matched_ngrams(p, ["conv_id", "turn"], "a", "b", 1, 4)
    return m.groupBy("order").agg(F.sum("correct").alias("correct"), F.sum("hypothesis_total").alias("total")).select(F.col("order").cast("long").alias("order"), "correct", "total")


@query(f"""WITH p AS (SELECT conv_id, turn, {WS} AS a, {WT} AS b FROM {PAIRS}), {_stats_sql(1, 4, 'a', 'b')},
s AS (SELECT max(coalesce(correct, 0)) FILTER (WHERE o = 1) c1, max(coalesce(correct, 0)) FILTER (WHERE o = 2) c2, max(coalesce(correct, 0)) FILTER (WHERE o = 3) c3, max(coalesce(correct, 0)) FILTER (WHERE o = 4) c4,
max(total) FILTER (WHERE o = 1) t1, max(total) FILTER (WHERE o = 2) t2, max(total) FILTER (WHERE o = 3) t3, max(total) FILTER (WHERE o = 4) t4 FROM x LEFT JOIN c USING (o)),
l AS (SELECT sum(len(a)) AS hl, sum(len(b)) AS rl FROM p)
SELECT CAST(hl AS BIGINT) AS hypothesis_length, CAST(rl AS BIGINT) AS reference_length,
round(100 * CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1 END * exp((ln(c1 / t1) + ln(c2 / t2) + ln((c3 + 1) / (t3 + 1)) + ln((c4 + 1) / (t4 + 1))) / 4), 6) AS bleu FROM s, l""")
def bleu_closest_ref(t):
    p = pairs(t).select("conv_id", "turn", words(F.col("src")).alias("a"), words(F.col("tgt")).alias("b"))
    m = metrics.matched_ngrams(p, ["conv_id", "turn"], "a", "b", 1, 4)
    sums = m.agg(*[F.sum(F.when(F.col("order") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, 5) for c in ("correct", "hypothesis_total")])
    lengths = p.agg(F.sum(F.size("a")).alias("hypothesis_length"), F.sum(F.size("b")).alias("reference_length"))
    score = metrics.bleu(
        [F.col(f"correct{k}") for k in range(1, 5)], [F.col(f"hypothesis_total{k}") for k in range(1, 5)],
        F.col("hypothesis_length"), F.col("reference_length"), smoothing="add-k",
    )
    return sums.crossJoin(lengths).select("hypothesis_length", "reference_length", F.round(score, 6).alias("bleu"))  # one row each


_THREE = f"""(SELECT a.conv_id, a.turn, {WORDS.replace('text', 'a.text')} AS a, {WORDS.replace('text', 'b.text')} AS b, {WORDS.replace('text', 'c.text')} AS c FROM conversations a
JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2)"""


def _three(t):
    """Each turn with the next and, where there is one, the turn after."""
    later = t("conversations").select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("third"))
    return pairs(t).join(later, ["conv_id", "turn"], "left")


@query(f"""WITH p AS {_THREE}, h AS (SELECT conv_id, turn, o, g, count(*) AS n FROM {_gram_sql('p', 'conv_id, turn', 'a', 1, 4)} GROUP BY ALL),
r AS (SELECT conv_id, turn, o, g, max(n) AS n FROM (SELECT conv_id, turn, o, g, count(*) AS n FROM {_gram_sql('p', 'conv_id, turn', 'b', 1, 4)} GROUP BY ALL
UNION ALL SELECT conv_id, turn, o, g, count(*) AS n FROM {_gram_sql('p', 'conv_id, turn', 'c', 1, 4)} GROUP BY ALL) GROUP BY ALL),
x AS (SELECT h.o, sum(h.n) AS total, sum(least(h.n, coalesce(r.n, 0))) AS correct FROM h LEFT JOIN r USING (conv_id, turn, o, g) GROUP BY h.o),
l AS (SELECT sum(len(a)) AS hl, sum(least(len(b), coalesce(len(c), len(b)))) AS rl FROM p),
s AS (SELECT exp(avg(ln((correct + 1) / (total + 1)))) AS smooth, CASE WHEN min(correct) > 0 THEN exp(avg(CASE WHEN correct > 0 THEN ln(correct / total) END)) ELSE 0 END AS plain, sum(correct) AS correct FROM x)
SELECT CAST(correct AS BIGINT) AS correct, CAST(hl AS BIGINT) AS hypothesis_length, CAST(rl AS BIGINT) AS reference_length,
round(100 * plain * CASE WHEN hl > rl THEN 1 ELSE exp(1 - 1 / (hl / rl + 1e-6)) END, 6)::DOUBLE AS bleu, round(100 * smooth * CASE WHEN hl > rl THEN 1 ELSE exp(1 - 1 / (hl / rl + 1e-6)) END, 6)::DOUBLE AS smoothed FROM s, l""")
def bleu_two_refs(t):
    p = _three(t).select("conv_id", "turn", words(F.col("src")).alias("a"), words(F.col("tgt")).alias("b"), words(F.col("third")).alias("c"))
    m = metrics.matched_ngrams(p, ["conv_id", "turn"], "a", ["b", "c"], 1, 4)
    sums = m.agg(*[F.sum(F.when(F.col("order") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, 5) for c in ("correct", "hypothesis_total")])
    lengths = p.agg(F.sum(F.size("a")).alias("hypothesis_length"), F.sum(F.least(F.size("b"), F.when(F.col("c").isNotNull(), F.size("c")))).alias("reference_length"))
    args = [F.col(f"correct{k}") for k in range(1, 5)], [F.col(f"hypothesis_total{k}") for k in range(1, 5)], F.col("hypothesis_length"), F.col("reference_length")
    every = F.col("correct1") + F.col("correct2") + F.col("correct3") + F.col("correct4")
    return sums.crossJoin(lengths).select(  # one row each
        every.alias("correct"), "hypothesis_length", "reference_length",
        F.round(metrics.bleu_of_least(*args), 6).alias("bleu"), F.round(metrics.bleu_of_least(*args, smooth=True), 6).alias("smoothed"),
    )


def _chars_sql(c):
    return f"list_filter(regexp_split_to_array(regexp_replace({c}, '\\s', '', 'g'), ''), lambda q: q <> '')"


@query(f"""WITH p AS (SELECT conv_id, turn, {_chars_sql('src')} AS a, {_chars_sql('tgt')} AS b FROM {PAIRS}), {_stats_sql(1, 6, 'a', 'b')},
s AS (SELECT coalesce(correct, 0) / total AS pr, coalesce(correct, 0) / reference AS rc FROM x JOIN y USING (o) LEFT JOIN c USING (o)), m AS (SELECT avg(pr) AS p, avg(rc) AS r FROM s)
SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM m""")
def chrf(t):
    letters = [F.regexp_replace(c, "\\s", "").alias(n) for c, n in (("src", "a"), ("tgt", "b"))]  # a string's tokens are its characters
    m = metrics.matched_ngrams(pairs(t).select("conv_id", "turn", *letters), ["conv_id", "turn"], "a", "b", 1, 6)
    orders = m.groupBy("order").agg(*[F.sum(c).alias(c) for c in ("correct", "hypothesis_total", "reference_total")])
    means = orders.filter("hypothesis_total > 0 and reference_total > 0").agg(
        F.avg(F.col("correct") / F.col("hypothesis_total")).alias("p"), F.avg(F.col("correct") / F.col("reference_total")).alias("r")
    )
    return means.select(F.round(100 * metrics.f_score(F.col("p"), F.col("r"), 2.0), 6).alias("chrf"))


_ANSWER = "list_filter(string_split({0}, ' '), lambda w: w <> '')"


def _answers(t):
    def tokens(c):
        return F.filter(F.split(normalise_answer(F.col(c)), " "), lambda w: w != "")

    return pairs(t).select("conv_id", "turn", tokens("src").alias("p"), tokens("tgt").alias("g"))


_QA = f"""p AS (SELECT conv_id, turn, {_ANSWER.format(normal_sql("src"))} AS a, {_ANSWER.format(normal_sql("tgt"))} AS b FROM {PAIRS}),
h AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS w FROM p) GROUP BY ALL), r AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS w FROM p) GROUP BY ALL),
c AS (SELECT conv_id, turn, sum(least(h.n, r.n)) AS same FROM h JOIN r USING (conv_id, turn, w) GROUP BY ALL),
q AS (SELECT conv_id, turn, CAST(a = b AS INT) AS exact, CASE WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN len(a) = len(b) THEN 1.0 ELSE 0.0 END
ELSE 2 * coalesce(same, 0) / (len(a) + len(b)) END AS f1 FROM p LEFT JOIN c USING (conv_id, turn))"""


@query(f"WITH {_QA} SELECT conv_id, turn, exact, round(f1::DOUBLE, 6) AS f1 FROM q")
def qa_em_f1(t):
    return metrics.token_f1(_answers(t), ["conv_id", "turn"], "p", "g").select("conv_id", "turn", "exact", F.round("f1", 6).alias("f1"))


@query(f"""WITH g AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS tgt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn + 1 AND a.turn + 2
WHERE EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = a.conv_id AND n.turn = a.turn + 1)),
p AS (SELECT conv_id, turn, row_number() OVER () AS k, {_ANSWER.format(normal_sql("src"))} AS a, {_ANSWER.format(normal_sql("tgt"))} AS b FROM g),
h AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(a) AS w FROM p) GROUP BY ALL), r AS (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(b) AS w FROM p) GROUP BY ALL),
c AS (SELECT k, sum(least(h.n, r.n)) AS same FROM h JOIN r USING (k, w) GROUP BY ALL)
SELECT conv_id, turn, max(CAST(a = b AS INT)) AS exact, round(max(CASE WHEN len(a) = 0 OR len(b) = 0 THEN CASE WHEN len(a) = len(b) THEN 1.0 ELSE 0.0 END
ELSE 2 * coalesce(same, 0) / (len(a) + len(b)) END)::DOUBLE, 6) AS f1 FROM p LEFT JOIN c USING (k) GROUP BY conv_id, turn""")
def qa_best_of_golds(t):
    def tokens(c):
        return F.filter(F.split(normalise_answer(F.col(c)), " "), lambda w: w != "").alias(c)

    d = _three(t).select("conv_id", "turn", *map(tokens, ("src", "tgt", "third")))
    return metrics.token_f1(d, ["conv_id", "turn"], "src", ["tgt", "third"]).select("conv_id", "turn", "exact", F.round("f1", 6).alias("f1"))


@query("""SELECT toxic AS flag, round(avg(quality) * 100, 6) AS score, count(*) AS n FROM labels GROUP BY GROUPING SETS ((), (toxic))""")
def eval_split_groupsets(t):
    d = aggregates.split_averages(t("labels"), "toxic", "quality")
    return d.select(F.col("toxic").alias("flag"), F.round("score", 6).alias("score"), "n")


_THRESHOLD = """d AS (SELECT (doc_id % 97) / 97 AS p, quality = 1 AS has, (doc_id % 5) / 4 AS score FROM labels),
s AS (SELECT p, sum(CASE WHEN has THEN score ELSE -1 END) AS gain FROM d GROUP BY p), z AS (SELECT count(*) FILTER (WHERE NOT has) AS start FROM d),
w AS (SELECT p AS threshold, start + sum(gain) OVER (ORDER BY p) AS best FROM s, z UNION ALL SELECT 0.0, start FROM z)"""


@query(f"WITH {_THRESHOLD} SELECT round(threshold, 6) AS threshold, round(best, 6)::DOUBLE AS best FROM w ORDER BY w.best DESC, threshold LIMIT 1")
def best_threshold(t):
    d = t("labels").select(((F.col("doc_id") % 97) / 97).alias("p"), (F.col("quality") == 1).alias("has"), ((F.col("doc_id") % 5) / 4).alias("score"))
    return metrics.best_threshold(d, "p", "score", "has").select(F.round("threshold", 6).alias("threshold"), F.round("best", 6).alias("best"))


@query("""WITH c AS (SELECT sum(quality * toxic)::DOUBLE tp, sum((1 - quality) * toxic)::DOUBLE fp, sum(quality * (1 - toxic))::DOUBLE fn, sum((1 - quality) * (1 - toxic))::DOUBLE tn FROM labels)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def accuracy_f1_mcc(t):
    return metrics.binary_scores(t("labels"), "quality", "toxic").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "mcc")])


@query("""WITH e AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM e)
SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r""")
def pearson_spearman(t):
    e = t("embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))
    r = metrics.average_ranks(metrics.average_ranks(e, "a", "ra"), "b", "rb")
    return r.agg(F.round(F.corr("a", "b"), 6).alias("pearson"), F.round(F.corr("ra", "rb"), 6).alias("spearman"))


_CLASSES = """c AS (SELECT label, count(*) FILTER (WHERE a = label AND b = label) AS tp, count(*) FILTER (WHERE a <> label AND b = label) AS fp, count(*) FILTER (WHERE a = label AND b <> label) AS fn
FROM (SELECT label % 10 AS a, (label + vec_id % 3) % 10 AS b FROM embeddings), (SELECT DISTINCT label % 10 AS label FROM embeddings) GROUP BY label),
m AS (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, tp + fn AS support, tp, fp FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)"""


def _predicted(t):
    return t("embeddings").select((F.col("label") % 10).cast("long").alias("a"), ((F.col("label") + F.col("vec_id") % 3) % 10).cast("long").alias("b"))


@query(f"WITH {_CLASSES} SELECT round(avg(f1) * 100, 6) AS macro, round(sum(f1 * support) / sum(support) * 100, 6) AS weighted, round(sum(tp) / (sum(tp) + sum(fp)) * 100, 6) AS micro FROM f")
def f1_averages(t):
    return metrics.f1_averages(_predicted(t), "a", "b").select(*[F.round(c, 6).alias(c) for c in ("macro", "weighted", "micro")])


@query(f"WITH {_CLASSES} SELECT CAST(label AS BIGINT) AS label, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, CAST(support AS BIGINT) AS support FROM f")
def class_report(t):
    r = metrics.class_report(_predicted(t), "a", "b")
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("""SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS share
FROM (SELECT label % 10 AS a, (label + vec_id % 3) % 10 AS b FROM embeddings) GROUP BY a, b""")
def confusion_normalised(t):
    return metrics.confusion(_predicted(t), "a", "b").select("a", "b", "n", F.round("share", 6).alias("share"))


@query("""WITH s AS (SELECT conv_id, turn, s.s, (length(text) + s.s) % 5 <> 0 AS ok FROM conversations, (VALUES (0), (1), (2)) s(s)),
j AS (SELECT conv_id, turn, bool_and(ok) AS joint, count(*) FILTER (WHERE ok) AS r, count(*) AS n FROM s GROUP BY ALL)
SELECT round(avg(CASE WHEN joint THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS joint, round(sum(r) / sum(n), 6) AS slot FROM j""")
def joint_goal(t):
    s = t("conversations").select("conv_id", "turn", F.length("text").alias("n_chars"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("s"))
    out = dialogue.joint_accuracy(s, ["conv_id", "turn"], (F.col("n_chars") + F.col("s")) % 5 != 0)
    return out.select(F.round("joint", 6).alias("joint"), F.round("slot", 6).alias("slot"))


@query(f"""SELECT CAST(o AS BIGINT) AS "order", g AS gram, count(*) AS n FROM {_gram_sql('benchmark', 'item_id', WORDS, 1, 4)} GROUP BY ALL""")
def ngram_counts(t):
    b = t("benchmark").select("item_id", words(F.col("text")).alias("w"))
    g = sets.ngrams(b, ["item_id"], "w", 1, 4)
    return g.groupBy(F.col("order").cast("long").alias("order"), "gram").agg(F.sum("n").alias("n"))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs((x::DOUBLE - m) / (s + 1e-5)))), 3) AS total FROM (
SELECT vec_id, embedding, list_avg(embedding::DOUBLE[]) AS m, list_aggregate(embedding::DOUBLE[], 'stddev_samp') AS s FROM embeddings)""")
def frame_normalise(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    d = t("embeddings").select("vec_id", v.alias("v")).select("vec_id", arrays.normalise("v").alias("z"))
    return d.select("vec_id", F.round(arrays.total(F.transform("z", lambda x: F.abs(x))), 3).alias("total"))


_BUCKET = "list_transform(embedding, lambda x: CAST(floor(abs(x::DOUBLE) * 20) AS BIGINT) % 4)"


@query(f"""WITH b AS (SELECT vec_id, {_BUCKET} AS s FROM embeddings), u AS (SELECT vec_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM b),
p AS (SELECT vec_id, i, x, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS y FROM u)
SELECT vec_id, coalesce(string_agg(CAST(x AS VARCHAR), ' ' ORDER BY i) FILTER (WHERE x <> 0 AND (y IS NULL OR x <> y)), '') AS ids FROM p GROUP BY vec_id""")
def ctc_collapse(t):
    s = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 20) % 4).cast("int"))
    d = t("embeddings").select("vec_id", s.alias("s"))
    return d.select("vec_id", F.array_join(F.transform(arrays.collapse_ctc("s", 0), lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS place FROM embeddings")
def greedy_argmax(t):
    return t("embeddings").select("vec_id", arrays.argmax("embedding").alias("place"))


@query("""SELECT vec_id, CASE WHEN embedding[1]::DOUBLE - list_max(embedding[2:10])::DOUBLE > -0.1 THEN '' ELSE CAST(list_position(embedding[2:10], list_max(embedding[2:10])) AS VARCHAR) END AS answer FROM embeddings""")
def null_threshold(t):
    rest = F.slice("embedding", 2, 9)
    diff = F.get("embedding", F.lit(0)).cast("double") - F.array_max(rest).cast("double")
    return t("embeddings").select("vec_id", F.when(diff > -0.1, "").otherwise((arrays.argmax(rest) + 1).cast("string")).alias("answer"))


@query("""WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY x DESC, i) AS best FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 5) GROUP BY vec_id""")
def n_best_indices(t):
    return t("embeddings").select("vec_id", F.array_join(F.transform(arrays.best_places("embedding", 5), lambda i: i.cast("string")), " ").alias("best"))


@query("""WITH x AS (SELECT conv_id, lower(substr(text, 1, 8)) AS answer, max(length(text) / 100) AS score FROM conversations GROUP BY ALL),
n AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, answer) <= 3)
SELECT conv_id, answer, round(exp(score - max(score) OVER (PARTITION BY conv_id)) / sum(exp(score)) OVER (PARTITION BY conv_id) * exp(max(score) OVER (PARTITION BY conv_id)), 6) AS p FROM n""")
def n_best_dedupe(t):
    x = t("conversations").groupBy("conv_id", F.lower(F.substring("text", 1, 8)).alias("answer")).agg(F.max(F.length("text") / 100).alias("score"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "answer"))
    best = x.withColumn("rank", rank).filter("rank <= 3")
    w = Window.partitionBy("conv_id")
    up = F.exp(F.col("score") - F.max("score").over(w))
    return best.withColumn("up", up).select("conv_id", "answer", F.round(F.col("up") / F.sum("up").over(w), 6).alias("p"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)
SELECT vec_id, round(e[1] / list_sum(e), 6) AS first, round(list_max(e) / list_sum(e), 6) AS most FROM u""")
def softmax(t):
    d = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).select("vec_id", arrays.softmax("v").alias("p"))
    return d.select("vec_id", F.round(F.get("p", F.lit(0)), 6).alias("first"), F.round(F.array_max("p"), 6).alias("most"))


@query("""SELECT vec_id, round(10 * log10(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64), 5) AS db,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * pow(10.0, 6.0 / 20))), 5) AS louder FROM embeddings""")
def rms_gain(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t("embeddings").select("vec_id", F.round(arrays.rms_db(v), 5).alias("db"), F.round(arrays.total(arrays.gain(v, F.lit(6.0))), 5).alias("louder"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i - 1 >= vec_id % 50 AND i - 1 < vec_id % 50 + 8 THEN 0 ELSE embedding[i]::DOUBLE END)), 5) AS total FROM embeddings""")
def spec_mask(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return t("embeddings").select("vec_id", F.round(arrays.total(arrays.mask_band(v, F.col("vec_id") % 50, 8)), 5).alias("total"))


@query("""SELECT event_id, s.i AS step, round(CASE WHEN s.i < 100 THEN 0.1 * (s.i + 1) / 101 ELSE 0.5 * 0.1 * (1 + cos(pi() * s.i / 1000)) END, 8) AS cosine,
round(CASE WHEN s.i < 100 THEN 0.1 * (s.i + 1) / 101 ELSE 0.1 * sqrt(100.0::DOUBLE / s.i) END, 8) AS inverse_square_root,
round(CASE WHEN s.i < 100 THEN 0.1 * (s.i + 1) / 101 ELSE 0.1 * (1000 - s.i) / 900 END, 8) AS poly FROM (SELECT event_id, event_id % 1000 AS i FROM events) s""")
def lr_schedules(t):
    steps = t("events").select("event_id", (F.col("event_id") % 1000).alias("step"))

    def rate(kind):
        return F.round(arrays.learning_rate(kind, F.col("step"), base=0.1, warmup=100, steps=1000), 8).alias(kind)

    return steps.select("event_id", "step", rate("cosine"), rate("inverse_square_root"), rate("poly"))
