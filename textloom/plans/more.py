"""Queries over masking, vocabularies, subword groups, losses, schedules and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..functions import text as tx
from ..functions.text import words
from ..operators import order
from .base import query
from .corpus import WORD_ROWS, WORDS

LETTERS = " abcdefghijklmnopqrstuvwxyz'"


@query(f"""SELECT conv_id, turn, CAST(coalesce(list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = w[len(w) - 1] AND w[i + 2] = w[len(w)])[1], -1) AS BIGINT) AS start
FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations)""")
def answer_refine(t):
    # The first place of a text's last two words.
    d = t("conversations").select("conv_id", "turn", words(F.col("text")).alias("w"))
    last = F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), F.lit(2))
    start = F.when(F.size("w") >= 2, arrays.find_run("w", last)).otherwise(-1)
    return d.select("conv_id", "turn", start.cast("long").alias("start"))


@query(f"""SELECT conv_id, turn, replace(array_to_string(list_transform({WORDS}, lambda w: CASE WHEN length(w) % 2 = 0 THEN '▁' ELSE '' END || w), '|'), '|▁', '▁') AS words FROM conversations""")
def whole_word_groups(t):
    pieces = F.transform(words(F.col("text")), lambda w: F.concat(F.when(F.char_length(w) % 2 == 0, "▁").otherwise(""), w))
    d = t("conversations").select("conv_id", "turn", pieces.alias("p"))
    groups = F.transform(arrays.whole_words("p", "▁"), lambda g: F.array_join(g, ""))
    return d.select("conv_id", "turn", F.array_join(groups, "|").alias("words"))


@query(f"""SELECT conv_id, turn, array_to_string(list_transform(range(len(w)), lambda i: CASE WHEN i > 0 AND i % 7 = 0 THEN length(w[i + 1]) ELSE -1 END), ' ') AS targets
FROM (SELECT conv_id, turn, {WORDS} AS w FROM conversations)""")
def masked_targets(t):
    d = t("conversations").select("conv_id", "turn", words(F.col("text")).alias("w"))
    places = F.filter(F.transform("w", lambda w, i: i), lambda i: (i > 0) & (i % 7 == 0))
    d = d.select("conv_id", "turn", "w", places.alias("p"))
    ids = F.transform("p", lambda i: F.char_length(F.get("w", i)))
    # A zero ends the list of places.
    out = arrays.scatter(F.size("w"), F.concat("p", F.array(F.lit(0), F.lit(1))), F.concat(ids, F.array(F.lit(5), F.lit(5))), -1)
    return d.select("conv_id", "turn", F.array_join(F.transform(out, lambda x: x.cast("string")), " ").alias("targets"))


_LOG_SUM = "ln(list_sum(list_transform(z, lambda x: exp(x))))"


@query(f"""WITH e AS (SELECT vec_id, label, label % 10 AS y, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS z FROM embeddings),
l AS (SELECT label, vec_id % 4 <> 0 AS valid, 1 + y % 3 AS weight, {_LOG_SUM} - 0.9 * z[y + 1] - 0.1 * list_avg(z) AS loss FROM e)
SELECT label, round(sum(CASE WHEN valid THEN loss * weight ELSE 0 END) / greatest(sum(CASE WHEN valid THEN weight ELSE 0 END), 1), 6) AS loss FROM l GROUP BY label""")
def smoothed_masked_loss(t):
    z = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    d = t("embeddings").select("vec_id", "label", (F.col("label") % 10).alias("y"), z.alias("z"))
    loss, weight = arrays.smoothed_cross_entropy("z", F.col("y"), 0.1), (1 + F.col("y") % 3) * (F.col("vec_id") % 4 != 0).cast("int")
    mean = F.sum(loss * weight) / F.greatest(F.sum(weight), F.lit(1))
    return d.groupBy("label").agg(F.round(mean, 6).alias("loss"))


@query("SELECT source AS label, max(doc_id) AS id FROM documents WHERE source IS NOT NULL GROUP BY source")
def line_number_ids(t):
    return order.last_line_ids(t("documents").filter("source is not null"), "source", "doc_id").select(F.col("source").alias("label"), "id")


@query("""SELECT doc_id, row_number() OVER (ORDER BY d, doc_id) AS place FROM (SELECT doc_id, md5('0:' || doc_id) AS d FROM documents) ORDER BY d, doc_id LIMIT 100""")
def shuffled_subset(t):
    from pyspark.sql import Window

    kept = order.shuffled_first(t("documents").select("doc_id"), "doc_id", 100, seed=0)
    w = Window.orderBy(order.shuffle_key("doc_id", 0), "doc_id")  # over the 100 rows asked for
    return kept.select("doc_id", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT doc_id, (((row_number() OVER (ORDER BY doc_id) - 1) * 1000003 + 3 * 7919) % count(*) OVER ()) % 8 AS rank FROM documents""")
def rank_shards(t):
    return order.rank_shards(t("documents").select("doc_id"), "doc_id", 8, epoch=3).select("doc_id", "rank")


@query(f"""SELECT DISTINCT word FROM (SELECT unnest({WORDS}) AS word FROM benchmark) EXCEPT SELECT unnest({WORDS}) FROM conversations""")
def word_difference(t):
    def of(name):
        return t(name).select(F.explode(words(F.col("text"))).alias("word"))

    return of("benchmark").join(of("conversations"), "word", "left_anti").distinct()


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([^\p{Nd}])(\p{P})', '\1 \2 ', 'g'), '(\p{P})([^\p{Nd}])', ' \1 \2', 'g'), '(\p{S})', ' \1 ', 'g'), '\s+', ' ', 'g'))) AS tokens FROM documents""")
def tokenise_international(t):
    return t("documents").select("doc_id", F.md5(tx.tokenise_international(F.col("text"))).alias("tokens"))


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(replace(text, 'e', '漢'), '(漢)', ' \1 ', 'g'))) AS spaced FROM conversations""")
def han_apart(t):
    text = tx.han_apart(F.replace("text", F.lit("e"), F.lit("漢")))
    return t("conversations").select("conv_id", "turn", F.md5(F.trim(text)).alias("spaced"))


@query(r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, ' ([.,!?;:%)\]])', '\1', 'g'), '([(\[]) ', '\1', 'g'), '" ([^"]*) "', '"\1"', 'g'), '(\d) ([.,]) (\d)', '\1\2\3', 'g')) AS text FROM conversations""")
def detokenise(t):
    return t("conversations").select("conv_id", "turn", F.md5(tx.detokenise(F.col("text"))).alias("text"))


@query(f"""SELECT item_id, regexp_replace(lower(trim(text, ' ' || chr(10))), '[^a-z'' ]', '', 'g') AS text FROM benchmark""")
def decode_ids(t):
    return t("benchmark").select("item_id", tx.decode_ids(tx.char_ids(F.col("text"), LETTERS), LETTERS).alias("text"))


@query("""SELECT o_orderkey, s.i AS step, round(CASE WHEN s.i <= 10 THEN 1.0 WHEN s.i <= 50 THEN 1.0 + (s.i - 10) / 40 * 3.0 WHEN s.i <= 200 THEN 4.0 - (s.i - 50) / 150 * 3.5 ELSE 0.5 END::DOUBLE, 8) AS value FROM (SELECT o_orderkey, o_orderkey % 300 AS i FROM orders) s""")
def piecewise_schedule(t):
    steps = t("orders").select("o_orderkey", (F.col("o_orderkey") % 300).alias("step"))
    value = arrays.piecewise(F.col("step"), [(10, 1.0), (50, 4.0), (200, 0.5)])
    return steps.select("o_orderkey", "step", F.round(value, 8).alias("value"))


@query(f"""WITH r AS (SELECT doc_id, pos - 1 AS pos, word, ('0x' || substr(md5(doc_id || ':' || (pos - 1) || ':7'), 1, 6))::BIGINT % 1000 AS u FROM {WORD_ROWS})
SELECT doc_id, count(*) FILTER (WHERE u < 120) AS masked, count(*) FILTER (WHERE u >= 120 AND u < 135) AS other, count(*) FILTER (WHERE u >= 135 AND u < 150) AS kept,
md5(string_agg(CASE WHEN u < 120 THEN '[MASK]' ELSE word END, ' ' ORDER BY pos)) AS digest FROM r GROUP BY doc_id""")
def whole_word_masking(t):
    # By a mark that is no white space, for a filter on "w" would split each text twice.
    d = t("documents").filter(F.col("text").rlike("(?U)\\S")).select("doc_id", words(F.col("text")).alias("w"))
    d = d.select("doc_id", "w", arrays.mask_fates("w", F.col("doc_id"), seed=7).alias("fate"))

    def n(kind):
        return F.size(F.filter("fate", lambda f: f == kind)).cast("long").alias(kind)

    shown = F.zip_with("w", "fate", lambda w, f: F.when(f == "masked", "[MASK]").otherwise(w))
    return d.select("doc_id", n("masked"), n("other"), n("kept"), F.md5(F.array_join(shown, " ")).alias("digest"))


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - CASE WHEN i = 1 THEN 0 ELSE 0.97 * embedding[i - 1]::DOUBLE END) * i)), 4) AS total FROM embeddings""")
def pre_emphasis(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    d = t("embeddings").select("vec_id", arrays.pre_emphasis(v).alias("v"))
    return d.select("vec_id", F.round(arrays.total(F.transform("v", lambda x, i: x * (i + 1))), 4).alias("total"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS whole, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number,
lower(event_type) IN ('click', 'true') AS flag, len(string_split(event_type || ',b', ',')) AS parts, CAST(strftime(ts, '%Y-%m-%d') AS VARCHAR) AS day FROM events""")
def coerce_settings(t):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    named = F.when(kind == "click", "yes").otherwise("no")
    return t("events").select(
        "event_id", tx.coerce(k, "int").alias("whole"), tx.coerce(k, "float").alias("number"), tx.coerce(named, "bool").alias("flag"),
        F.size(tx.coerce(F.concat(kind, F.lit(",b")), "list")).cast("long").alias("parts"),
        tx.coerce(F.date_format("ts", "yyyy-MM-dd"), "date").cast("string").alias("day"),
    )


@query("""WITH s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(t):
    from ..streaming.events import sessions

    return sessions(t("events")).select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS packed, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed FROM conversations")
def white_space(t):
    return t("conversations").select("conv_id", "turn", F.regexp_replace("text", "\\s+", "").alias("packed"), tx.collapse(F.col("text")).alias("collapsed"))


@query("SELECT doc_id, md5(translate(replace(replace(replace(text, '+', ' plus '), '&', ' and '), '%', ' percent '), '!\"#$()*,-./:;<=>?@[\\]^_`{|}~', repeat(' ', 28))) AS digest FROM documents")
def spoken_marks(t):
    return t("documents").select("doc_id", F.md5(tx.spoken_punctuation(F.col("text"))).alias("digest"))


@query(f"""SELECT conv_id, turn, array_to_string(list_transform(flatten(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: string_split(replace(w, 'e', '_'), '_'))), lambda p: coalesce(nullif(list_position(['a', 'th', 'ti'], p), 0) - 1, 9)), ' ') AS ids FROM conversations""")
def phonemes(t):
    text = F.array_join(F.transform(words(F.col("text")), lambda w: F.replace(w, F.lit("e"), F.lit("_"))), " ")
    ids = tx.phoneme_ids(text, ["a", "th", "ti"], unknown=9)
    return t("conversations").select("conv_id", "turn", F.array_join(F.transform(ids, lambda k: k.cast("string")), " ").alias("ids"))


@query("""SELECT vec_id, round(0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x))), 6) AS gelu FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings)""")
def gelu(t):
    return t("embeddings").select("vec_id", F.round(arrays.gelu(F.get("embedding", F.lit(0)).cast("double")), 6).alias("gelu"))


@query("""SELECT vec_id, round(2 * list_sum(embedding::DOUBLE[]), 5) AS total, 128::BIGINT AS n, repeat('1', CAST(vec_id % 9 AS INT)) || repeat('0', CAST(8 - vec_id % 9 AS INT)) AS mask,
array_to_string(list_transform(range(8), lambda i: CASE WHEN i >= vec_id % 9 - 1 THEN 1 ELSE 0 END), '') AS gate FROM embeddings""")
def splice_and_masks(t):
    v = arrays.splice(F.transform("embedding", lambda x: x.cast("double")), 2)
    length = (F.col("vec_id") % 9).cast("int")
    gate = F.transform(arrays.gate_target(length, F.lit(8)), lambda x: x.cast("int").cast("string"))
    mask = F.transform(arrays.length_mask(length, F.lit(8)), lambda x: x.cast("string"))
    return t("embeddings").select("vec_id", F.round(arrays.total(v), 5).alias("total"), F.size(v).cast("long").alias("n"), F.array_join(mask, "").alias("mask"), F.array_join(gate, "").alias("gate"))


@query("""SELECT conv_id, turn, round(sin(s.i), 6) AS first, round(cos(s.i), 6) AS second, round(sin(s.i / pow(10000.0, 0.5)), 6) AS third FROM (SELECT conv_id, turn, turn AS i FROM conversations) s""")
def sinusoids(t):
    row = arrays.sinusoid(F.col("turn"), 4)
    d = t("conversations").select("conv_id", "turn", row.alias("r"))
    return d.select("conv_id", "turn", *[F.round(F.get("r", F.lit(k)), 6).alias(n) for k, n in enumerate(("first", "second", "third"))])


@query("""SELECT event_type, lower(event_type) AS whole, lower(replace(event_type, '_', '')) AS packed, count(*) AS n FROM events GROUP BY event_type""")
def slot_names(t):
    from ..operators.dialogue import slot_name

    spaced = F.replace("event_type", F.lit("_"), F.lit(" "))
    d = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return d.select("event_type", slot_name(F.concat(F.lit("book "), F.initcap("event_type"))).substr(6, 99).alias("whole"), slot_name(F.initcap(spaced)).alias("packed"), "n")


@query("""SELECT doc_id, lang, CASE WHEN lang IN ('en', 'de') THEN CASE lang WHEN 'en' THEN 1 ELSE 0 END ELSE -1 END AS id FROM documents""")
def label_lookup(t):
    d = t("documents").select("doc_id", "lang")
    ids = order.alphabetical_ids(d.filter(F.col("lang").isin("en", "de")), "lang", "")
    return d.join(F.broadcast(ids), "lang", "left").select("doc_id", "lang", F.coalesce("id", F.lit(-1)).cast("int").alias("id"))  # two labels
