"""Queries of evaluation epochs, data set descriptors, collated batches and vocabulary tokenisers."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import arrays
from ..functions import text as tx
from ..functions.text import words
from ..operators import dialogue, epochs, filters, metrics
from ..shared import new_path
from ..sources import readers
from .base import query
from .corpus import PAIRS, WORDS, pairs
from .scores import _THREE, _gram_sql, _three


@query("""WITH b AS (SELECT conv_id % 50 AS batch, avg(length(text) / 100.0::DOUBLE) AS m, sum(length(text) / 100.0::DOUBLE) AS s, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1)
SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS rows, round(avg(m), 6) AS of_batches, round(sum(s) / sum(n), 6) AS of_rows FROM b""")
def epoch_loss(t):
    d = t("conversations").select((F.col("conv_id") % 50).alias("batch"), (F.length("text") / 100.0).alias("loss"))
    return epochs.batch_means(d, "batch", "loss").select("batches", "rows", F.round("of_batches", 6).alias("of_batches"), F.round("of_rows", 6).alias("of_rows"))


@query("""WITH g AS (SELECT vec_id, f, list_transform(range(8), lambda k: embedding[8 * f + k + 1]) AS x, label % 8 AS y FROM embeddings, range(8) r(f) WHERE f < 3 + vec_id % 6),
p AS (SELECT f, y, list_position(x, list_max(x)) - 1 AS h FROM g)
SELECT CAST(f AS BIGINT) AS place, count(*) AS n, count(*) FILTER (h = y) AS hits FROM p GROUP BY f""")
def gathered_predictions(t):
    """Eight positions of eight logits each, of which a mask keeps three to eight."""
    e = t("embeddings")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", 8 * k + 1, F.lit(8)))
    mask = arrays.length_mask(3 + (F.col("vec_id") % 6).cast("int"), F.lit(8))
    d = e.select("vec_id", rows.alias("logits"), F.array_repeat(F.col("label") % 8, 8).alias("labels"), mask.alias("mask"))
    g = epochs.gathered(d, ["vec_id"], "logits", "labels", "mask")
    return g.groupBy(F.col("place").cast("long").alias("place")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("hits"))


def _f1_sql(task: str, truth: str, predicted: str) -> str:
    return f"""SELECT '{task}' AS task, (SELECT count(*) FROM q WHERE {truth} IS NOT NULL) AS rows, round((SELECT avg(({truth} = {predicted})::INT) FROM q WHERE {truth} IS NOT NULL), 6) AS accuracy,
round(100 * avg(f), 6) AS macro, round(100 * sum(f * s) / sum(s), 6) AS weighted, round(100 * sum(tp) / sum(pp), 6) AS micro FROM (
SELECT l, tp, pp, s, CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (pp + s) END AS f FROM (SELECT l, (SELECT count(*) FROM q WHERE {truth} = l AND {predicted} = l) AS tp, (SELECT count(*) FROM q WHERE {predicted} = l AND {truth} IS NOT NULL) AS pp, (SELECT count(*) FROM q WHERE {truth} = l) AS s
FROM (SELECT {truth} AS l FROM q WHERE {truth} IS NOT NULL UNION SELECT {predicted} FROM q WHERE {truth} IS NOT NULL)))"""


@query(f"""WITH q AS (SELECT length(text) % 5 AS y, n_chars % 7 % 5 AS p, doc_id % 3 AS z, (doc_id + n_chars) % 3 AS r FROM documents) {_f1_sql('length', 'y', 'p')} UNION ALL {_f1_sql('turn', 'z', 'r')}""")
def epoch_report(t):
    d = t("documents").select((F.length("text") % 5).cast("long").alias("y"), (F.col("n_chars") % 7 % 5).alias("p"), (F.col("doc_id") % 3).alias("z"), ((F.col("doc_id") + F.col("n_chars")) % 3).alias("r"))
    found = epochs.epoch_report(d, {"length": ("y", "p"), "turn": ("z", "r")})
    return found.select("task", "rows", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro", "weighted", "micro")])


_KEY = "conv_id, turn"
_SEVERAL = f"""p AS {_THREE}, h AS (SELECT {_KEY}, o, g, count(*) AS n FROM {_gram_sql('p', _KEY, 'a', 1, 4)} GROUP BY ALL),
r AS (SELECT {_KEY}, o, g, max(n) AS n FROM (SELECT {_KEY}, o, g, count(*) AS n FROM {_gram_sql('p', _KEY, 'b', 1, 4)} GROUP BY ALL UNION ALL SELECT {_KEY}, o, g, count(*) AS n FROM {_gram_sql('p', _KEY, 'c', 1, 4)} GROUP BY ALL) GROUP BY ALL),
k AS (SELECT {_KEY}, o, sum(h.n) AS total, sum(least(h.n, coalesce(r.n, 0))) AS correct FROM h LEFT JOIN r USING ({_KEY}, o, g) GROUP BY ALL),
l AS (SELECT {_KEY}, len(a) AS hl, CASE WHEN c IS NULL OR abs(len(b) - len(a)) < abs(len(c) - len(a)) OR abs(len(b) - len(a)) = abs(len(c) - len(a)) AND len(b) < len(c) THEN len(b) ELSE len(c) END AS rl FROM p)"""


def _several(t):
    p = _three(t).select("conv_id", "turn", words(F.col("src")).alias("a"), words(F.col("tgt")).alias("b"), words(F.col("third")).alias("c"))
    lengths = p.select("conv_id", "turn", F.size("a").alias("hypothesis_length"), epochs.closest_length(F.size("a"), [F.size("b"), F.when(F.col("c").isNotNull(), F.size("c"))]).alias("reference_length"))
    return metrics.matched_ngrams(p, ["conv_id", "turn"], "a", ["b", "c"], 1, 4), lengths


@query(f"""WITH {_SEVERAL}, s AS (SELECT o, sum(correct) AS correct, sum(total) AS total FROM k GROUP BY o), z AS (SELECT sum(hl) AS hl, sum(rl) AS rl FROM l)
SELECT CAST(hl AS BIGINT) AS hypothesis_length, CAST(rl AS BIGINT) AS reference_length, round(100 * CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1 END * (SELECT exp(avg(ln(CASE WHEN correct = 0 THEN 0.1 ELSE correct END / total))) FROM s), 6) AS bleu FROM z""")
def bleu_closest_of_several(t):
    """Of two references the one whose length is nearer counts for the brevity; floor smoothing."""
    counts, lengths = _several(t)
    sums = counts.agg(*[F.sum(F.when(F.col("order") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, 5) for c in ("correct", "hypothesis_total")])
    every = lengths.agg(F.sum("hypothesis_length").alias("hypothesis_length"), F.sum("reference_length").alias("reference_length"))
    score = metrics.bleu([F.col(f"correct{k}") for k in range(1, 5)], [F.col(f"hypothesis_total{k}") for k in range(1, 5)], F.col("hypothesis_length"), F.col("reference_length"), smoothing="floor")
    return sums.crossJoin(every).select("hypothesis_length", "reference_length", F.round(score, 6).alias("bleu"))  # one row each


@query(f"""WITH {_SEVERAL}, e AS (SELECT {_KEY}, o, correct, total, sum(CASE WHEN correct = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {_KEY} ORDER BY o) AS zeros FROM k),
s AS (SELECT {_KEY}, exp(avg(ln(CASE WHEN correct = 0 THEN 1.0::DOUBLE / (pow(2, zeros) * total) ELSE correct / total END))) AS mean FROM e GROUP BY {_KEY})
SELECT conv_id, turn, round(coalesce(100 * CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1 END * mean, 0), 6) AS bleu FROM l LEFT JOIN s USING ({_KEY})""")
def sentence_bleu(t):
    counts, lengths = _several(t)
    return epochs.sentence_scores(counts, ["conv_id", "turn"], lengths).select("conv_id", "turn", F.round("bleu", 6).alias("bleu"))


@query("""WITH d AS (SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split, quality AS label FROM labels WHERE quality IS NOT NULL),
c AS (SELECT split, label, count(*) AS n FROM d GROUP BY ALL), w AS (SELECT label, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c WHERE split = 'train')
SELECT split, label, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share, round(coalesce(weight, 1), 6) AS weight, (SELECT CAST(max(label) + 1 AS BIGINT) FROM c) AS classes FROM c LEFT JOIN w USING (label)""")
def split_descriptors(t):
    k = F.col("doc_id") % 10
    d = t("labels").filter("quality is not null").select(F.when(k < 8, "train").when(k == 8, "dev").otherwise("test").alias("split"), F.col("quality").alias("label"))
    return epochs.split_descriptors(d, "split", "label").select("split", "label", "n", F.round("share", 6).alias("share"), F.round("weight", 6).alias("weight"), "classes")


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS id FROM events")
def known_label_ids(t):
    """Every label has its id; one without would fail the job."""
    from ..operators.order import alphabetical_ids

    e = t("events").select("event_id", "event_type")
    ids = F.broadcast(alphabetical_ids(e, "event_type", "").withColumnRenamed("event_type", "label"))  # labels are few
    return epochs.known_ids(e, "event_type", ids).select("event_id", "id")


@query(f"""WITH d AS (SELECT conv_id, turn, len({WORDS.replace('text', 'src')}) AS s, len({WORDS.replace('text', 'tgt')}) AS g FROM {PAIRS}), b AS (SELECT conv_id, max(s) AS ws, max(g) AS wg FROM d GROUP BY conv_id)
SELECT conv_id, turn, CAST(ws AS BIGINT) AS source_width, CAST(wg AS BIGINT) AS target_width, CAST(s AS BIGINT) AS source_sum, CAST(g * (g + 1) // 2 AS BIGINT) AS place_sum FROM d JOIN b USING (conv_id)""")
def padded_pairs(t):
    """Both sides of a conversation's pairs filled to its longest, as ones; targets with their places."""
    d = pairs(t).select("conv_id", "turn", F.size(words(F.col("src"))).alias("s"), F.size(words(F.col("tgt"))).alias("g"))
    widths = d.groupBy("conv_id").agg(F.max("s").alias("ws"), F.max("g").alias("wg"))
    d = d.join(widths, "conv_id")
    source = arrays.pad_right(F.array_repeat(F.lit(1), F.col("s")), F.col("ws"), 0)
    target = arrays.places(F.col("g"), F.col("wg"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    return d.select("conv_id", "turn", F.size(source).cast("long").alias("source_width"), F.size(target).cast("long").alias("target_width"), total(source).alias("source_sum"), total(target).alias("place_sum"))


@query("""SELECT vec_id, CAST(16 * (2 + label % 3 + 4) AS BIGINT) AS cells, round(list_sum(embedding[1:8 * (1 + vec_id % 4)]::DOUBLE[]) + 0.5::DOUBLE * (16 * (2 + label % 3 + 4) - 8 * (1 + vec_id % 4)), 5) AS total FROM embeddings""")
def padded_matrices(t):
    """One to four rows of eight values, filled with a half to sixteen values and six rows or more."""
    rows = F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int")), lambda k: F.transform(F.slice("embedding", 8 * k + 1, F.lit(8)), lambda x: x.cast("double")))
    full = arrays.pad_matrix(rows, (F.col("label") % 3 + 6).cast("int"), F.lit(16), 0.5)
    e = t("embeddings").select("vec_id", F.flatten(full).alias("x"))
    return e.select("vec_id", F.size("x").cast("long").alias("cells"), F.round(arrays.total("x"), 5).alias("total"))


@query("""SELECT event_id, lower(event_type) || '-' || CASE WHEN user_id % 2 = 0 THEN 'book day' ELSE 'pricerange' END AS slot FROM events WHERE event_type IN ('click', 'view', 'error')""")
def ontology_slots(t):
    name = F.concat("event_type", F.lit("-"), F.when(F.col("user_id") % 2 == 0, "Book day").otherwise("Price Range"))
    name = F.when(F.contains(name, F.lit("Book")), F.concat("event_type", F.lit("-book day"))).otherwise(name)
    return dialogue.domain_slots(t("events").select("event_id", name.alias("slot")), "slot", ["click", "view", "error"])


_NORMAL = "trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({0})), '([.!?])', ' \\1', 'g'), '[^a-zA-Z.!?]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT {_NORMAL.format("replace(src, chr(10), ' ')")} AS a, {_NORMAL.format("replace(tgt, chr(10), ' ')")} AS b FROM {PAIRS}), s AS (SELECT a, b FROM p WHERE len(string_split(a, ' ')) < 60 AND len(string_split(b, ' ')) < 60)
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(a, ' ') || string_split(b, ' ')) AS word FROM s) WHERE word <> '' GROUP BY word""")
def loaded_pairs(t):
    """Read, normalised, short ones kept, words counted."""
    p = pairs(t)
    path = new_path(p.sparkSession, "pairs")
    line = lambda c: F.translate(c, "\n", " ")
    p.select(F.concat_ws("\t", line("src"), line("tgt"))).write.text(path)
    found = readers.utterance_pairs(p.sparkSession, path, normalise=True).filter(filters.short_pair("a", "b", 60))
    return found.select(F.explode(F.concat(words(F.col("a")), words(F.col("b")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT unnest({WORDS}) AS word FROM benchmark), v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM (SELECT word FROM w GROUP BY word HAVING count(*) >= 5)), n AS (SELECT count(*) AS n FROM v),
t AS (SELECT item_id, unnest({WORDS}) AS word, unnest(range(len({WORDS}))) AS i FROM benchmark)
SELECT item_id, string_agg(CAST(coalesce(v.id, n.n) AS VARCHAR), ' ' ORDER BY i) AS ids, coalesce(string_agg(v.word, ' ' ORDER BY i), '') AS known FROM t LEFT JOIN v USING (word), n GROUP BY item_id""")
def vocabulary_tokenise(t):
    """Words by a vocabulary of those that occur five times, the unknown one after it, and back without it."""
    b = t("benchmark")
    counts = b.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").count().filter("count >= 5")
    listed = counts.agg(F.sort_array(F.collect_list("word")).alias("words"))  # a vocabulary file's words, in one row
    d = b.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0).crossJoin(F.broadcast(listed))
    n = F.size("words")
    table = F.map_from_arrays(F.array_append("words", F.lit("<UNK>")), F.sequence(F.lit(0), n))
    d = d.withColumn("ids", tx.vocabulary_ids(tx.known_tokens(F.col("ws"), F.col("words")), table))
    return d.select("item_id", F.array_join(F.transform("ids", lambda k: k.cast("string")), " ").alias("ids"), tx.text_of_ids(F.col("ids"), F.col("words"), n).alias("known"))


@query(f"""WITH d AS (SELECT item_id, text, {WORDS} AS ws FROM benchmark WHERE len({WORDS}) > 4),
p AS (SELECT item_id, text, lower(regexp_replace(text, '\\s', '', 'g')) AS packed, lower(array_to_string(ws[3:5], '')) AS want, list_filter(range(1, length(text) + 1), lambda i: NOT regexp_matches(substr(text, i, 1), '\\s')) AS spot FROM d)
SELECT item_id, substr(text, spot[strpos(packed, want)], spot[strpos(packed, want) + length(want) - 1] - spot[strpos(packed, want)] + 1) AS answer FROM p""")
def projected_answers(t):
    """Three words, lower-cased and apart, found again in their text."""
    d = t("benchmark").withColumn("ws", words(F.col("text"))).filter(F.size("ws") > 4)
    predicted = F.lower(F.array_join(F.slice("ws", 3, 3), "  "))
    return d.select("item_id", tx.project_answer(predicted, F.col("text")).alias("answer"))
