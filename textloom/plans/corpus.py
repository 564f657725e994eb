"""Queries over manifests, vocabularies, labels, splits and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import aggregates, filters, order, sets
from .base import query

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
PAIRS = (
    "(SELECT a.conv_id, a.turn, a.role, a.text AS src, b.text AS tgt FROM conversations a "
    "JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
)
WORD_ROWS = f"(SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {WORDS} AS ws FROM documents))"


def pairs(t):
    """Each turn with the next of its conversation."""
    a = t("conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return a.withColumnRenamed("text", "src").join(b, ["conv_id", "turn"])


def timed(t):
    return t("documents").withColumn("duration", F.col("n_chars") / 15.0)


@query("SELECT doc_id, round(n_chars / 15.0, 6) AS duration FROM documents WHERE n_chars / 15.0 BETWEEN 20 AND 300")
def manifest_duration_filter(t):
    d = timed(t)
    return d.filter(filters.within(F.col("duration"), 20, 300)).select("doc_id", F.round("duration", 6).alias("duration"))


@query("""SELECT count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS filtered,
round(coalesce(sum(d) FILTER (WHERE k), 0) / 3600, 6) AS kept_hours, round(coalesce(sum(d) FILTER (WHERE NOT k), 0) / 3600, 6) AS filtered_hours
FROM (SELECT n_chars / 15.0 AS d, n_chars / 15.0 BETWEEN 20 AND 300 AS k FROM documents)""")
def manifest_filter_stats(t):
    return filters.filter_stats(timed(t), F.col("duration"), filters.within(F.col("duration"), 20, 300))


@query("""SELECT doc_id, round(d, 6) AS duration, row_number() OVER (ORDER BY d, doc_id) AS place FROM (
SELECT doc_id, n_chars / 15.0 AS d FROM documents WHERE n_chars / 15.0 BETWEEN 20 AND 300 ORDER BY doc_id LIMIT 200)""")
def manifest_cap_then_sort(t):
    from pyspark.sql import Window

    kept = filters.first_rows(timed(t).filter(filters.within(F.col("duration"), 20, 300)), 200, "doc_id")
    place = F.row_number().over(Window.orderBy("duration", "doc_id"))  # over the 200 that the cap leaves
    return kept.select("doc_id", F.round("duration", 6).alias("duration"), place.cast("long").alias("place"))


@query("SELECT doc_id, lang AS label, round(n_chars / 15.0, 6) AS duration FROM documents WHERE n_chars / 15.0 <= 100 AND lang IS NOT NULL")
def label_manifest_filter(t):
    kept = timed(t).filter(filters.within(F.col("duration"), None, 100) & F.col("lang").isNotNull())
    return kept.select("doc_id", F.col("lang").alias("label"), F.round("duration", 6).alias("duration"))


@query(f"""SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS n_tokens FROM documents WHERE NOT regexp_matches(text, '[^ -~\\n]') AND len({WORDS}) > 0""")
def unparsable_drop(t):
    tokens = F.when(~F.col("text").rlike("[^ -~\n]"), words(F.col("text")))
    return t("documents").select("doc_id", tokens.alias("tokens")).filter(F.size("tokens") > 0).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@query(f"""SELECT conv_id, turn, s AS src_tokens, g AS tgt_tokens FROM (
SELECT conv_id, turn, CAST(len({WORDS.replace('text', 'src')}) AS BIGINT) AS s, CAST(len({WORDS.replace('text', 'tgt')}) AS BIGINT) AS g FROM {PAIRS})
WHERE s BETWEEN 3 AND 128 AND g BETWEEN 3 AND 128 AND abs(s - g) <= 25 AND greatest(s - 2, 1) / greatest(g - 2, 1) BETWEEN 1 / 2.5 AND 2.5""")
def pair_quality_filter(t):
    s, g = (F.size(words(F.col(c))).cast("long") for c in ("src", "tgt"))
    d = pairs(t).select("conv_id", "turn", s.alias("src_tokens"), g.alias("tgt_tokens"))
    return d.filter(filters.good_pair(F.col("src_tokens"), F.col("tgt_tokens")))


@query(f"SELECT conv_id, turn FROM {PAIRS} WHERE len(string_split(src, ' ')) < 10 AND len(string_split(tgt, ' ')) < 10")
def pair_short_filter(t):
    return pairs(t).filter(filters.short_pair("src", "tgt")).select("conv_id", "turn")


_HEADS = "(SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(src, '\\s+'), lambda w: w <> '')[1:1 + turn * 3], ' ') AS src, array_to_string(list_filter(regexp_split_to_array(tgt, '\\s+'), lambda w: w <> '')[1:8], ' ') AS tgt FROM " + PAIRS + ")"


def _heads(t):
    """Pairs of short sentences: the first words of each side."""
    def head(c, n):
        return F.array_join(F.slice(words(F.col(c)), F.lit(1), n), " ")

    return pairs(t).select("conv_id", "turn", head("src", (1 + F.col("turn") * 3).cast("int")).alias("src"), head("tgt", F.lit(8)).alias("tgt"))


@query(f"SELECT conv_id, turn FROM {_HEADS} WHERE len(string_split(src, ' ')) < 10 AND len(string_split(tgt, ' ')) < 10")
def pair_short_heads(t):
    return _heads(t).filter(filters.short_pair("src", "tgt")).select("conv_id", "turn")


@query(f"""WITH p AS (SELECT *, list_filter(string_split(src || ' ' || tgt, ' '), lambda w: w <> '') AS ws FROM {_HEADS}),
v AS (SELECT word FROM (SELECT unnest(ws) AS word FROM p) GROUP BY word HAVING count(*) >= 2)
SELECT conv_id, turn FROM p WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(ws) AS word) u WHERE word NOT IN (SELECT word FROM v))""")
def pair_rare_word_heads(t):
    p = _heads(t)
    used = p.select(F.explode(F.concat(words(F.col("src")), words(F.col("tgt")))).alias("word"))
    vocabulary = used.groupBy("word").count().filter("count >= 2").select("word")
    return filters.known_pairs(p, vocabulary, ["conv_id", "turn"], "src", "tgt").select("conv_id", "turn")


@query(f"""SELECT word, count(*) AS n, row_number() OVER (ORDER BY min(doc_id * 1000000 + pos)) + 3 AS id
FROM {WORD_ROWS} GROUP BY word HAVING count(*) >= 3""")
def vocab_min_count(t):
    d = t("documents").select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    counts = d.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).filter("n >= 3")
    placed = order.ranked(counts.select("word", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos")), "doc_id", "id", then=("pos",))
    return placed.select("word", "n", (F.col("id") + 4).alias("id"))


@query(f"""WITH p AS (SELECT *, list_filter(regexp_split_to_array(src || ' ' || tgt, '\\s+'), lambda w: w <> '') AS ws FROM {PAIRS}),
v AS (SELECT word FROM (SELECT unnest(ws) AS word FROM p) GROUP BY word HAVING count(*) >= 3)
SELECT conv_id, turn FROM p WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(ws) AS word) u WHERE word NOT IN (SELECT word FROM v))""")
def pair_rare_word_filter(t):
    p = pairs(t)
    used = p.select(F.explode(F.concat(words(F.col("src")), words(F.col("tgt")))).alias("word"))
    vocabulary = used.groupBy("word").count().filter("count >= 3").select("word")
    return filters.known_pairs(p, vocabulary, ["conv_id", "turn"], "src", "tgt").select("conv_id", "turn")


@query("""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) WHERE trim(line) <> ''""")
def blank_line_filter(t):
    d = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.filter(F.trim("line") != "").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""SELECT doc_id, pos - 1 AS pos, regexp_matches(word, '^[A-Z]') AS upper FROM {WORD_ROWS} WHERE (pos - 1) % 3 = 0""")
def mask_row_select(t):
    ws = words(F.col("text"))
    zipped = F.arrays_zip(
        F.transform(ws, lambda w: w.rlike("^[A-Z]")).alias("upper"), F.transform(ws, lambda w, i: (i % 3 == 0).cast("double")).alias("mask")
    )
    d = t("documents").select("doc_id", F.posexplode(zipped).alias("pos", "x"))
    return d.filter("x.mask > 0.5").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("x.upper").alias("upper"))


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def id_lookup_inner(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").select("doc_id", "lang", "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_predictions(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query(f"""WITH v AS (SELECT word, row_number() OVER (ORDER BY min(doc_id * 1000000 + pos)) - 1 AS id FROM {WORD_ROWS} GROUP BY word HAVING count(*) >= 5),
c AS (SELECT conv_id, turn, ws, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT conv_id, turn, {WORDS} AS ws FROM conversations))
SELECT conv_id, turn, string_agg(CAST(coalesce(v.id, -1) AS VARCHAR), ' ' ORDER BY pos) AS ids FROM c LEFT JOIN v USING (word) GROUP BY conv_id, turn""")
def token_id_lookup(t):
    d = t("documents").select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    counts = d.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).filter("n >= 5")
    ids = order.first_seen_ids(counts, "word", ["first"])
    c = t("conversations").select("conv_id", "turn", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    placed = c.join(ids, "word", "left").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(-1)).alias("id")))).alias("x"))
    return placed.select("conv_id", "turn", F.array_join(F.transform("x", lambda x: x["id"].cast("string")), " ").alias("ids"))


@query("""SELECT a.vec_id, CAST(s.i AS BIGINT) AS first, CAST(e.i AS BIGINT) AS last, round(a.embedding[s.i + 1]::DOUBLE + a.embedding[e.i + 1]::DOUBLE, 6) AS score
FROM embeddings a, range(10) s(i), range(10) e(i) WHERE e.i >= s.i AND e.i - s.i < 3""")
def span_theta_join(t):
    v = t("embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 10)).alias("i", "x"))
    s, e = v.select("vec_id", F.col("i").alias("first"), F.col("x").cast("double").alias("xs")), v.select("vec_id", F.col("i").alias("last"), F.col("x").cast("double").alias("xe"))
    j = s.join(e, "vec_id").filter("last >= first and last - first < 3")
    return j.select("vec_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.round(F.col("xs") + F.col("xe"), 6).alias("score"))


@query("""SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations
QUALIFY lead(text) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL""")
def next_line_pairs(t):
    from pyspark.sql import Window

    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t("conversations").select("conv_id", "turn", F.col("text").alias("a"), nxt.alias("b")).filter("b is not null")


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def label_stats(t):
    return aggregates.label_stats(t("documents"), "lang").select("lang", "n", F.round("share", 6).alias("share"))


@query("""WITH c AS (SELECT quality AS id, count(*) AS n FROM labels GROUP BY 1), w AS (SELECT id, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c)
SELECT r.i AS id, round(coalesce(weight, 1.0), 6)::DOUBLE AS weight FROM range(4) r(i) LEFT JOIN w ON w.id = r.i""")
def class_weights(t):
    labels = t("labels")
    weights = aggregates.class_weights(labels, "quality")
    return aggregates.dense_weights(labels.sparkSession, weights, "quality", 3).select("id", F.round("weight", 6).alias("weight"))


@query("""SELECT lang, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median,
round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY lang""")
def length_stats(t):
    s = aggregates.length_stats(t("documents"), "n_chars", "lang")
    return s.select("lang", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p75", "p99")])


@query(f"SELECT word, row_number() OVER (ORDER BY min(doc_id * 1000000 + pos)) - 1 + 2 AS id FROM {WORD_ROWS} GROUP BY word")
def vocab_first_seen(t):
    d = t("documents").select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return order.first_seen_ids(d, "word", ["doc_id", "pos"]).select("word", (F.col("id") + 2).alias("id"))


@query("SELECT lang, row_number() OVER (ORDER BY lang <> 'en', lang) - 1 AS id FROM (SELECT DISTINCT lang FROM documents)")
def label_ids_alpha(t):
    return order.alphabetical_ids(t("documents"), "lang", "en")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedupe_first(t):
    return order.first_of(t("events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'dev' END AS split FROM documents""")
def exact_split(t):
    return order.exact_split(t("documents").select("doc_id"), "doc_id", 0.9)


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5('5:' || doc_id), 1, 15))::BIGINT, doc_id) - 1 < floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'dev' END AS split FROM documents""")
def random_split(t):
    return order.random_split(t("documents").select("doc_id"), "doc_id", 0.9, seed=5)


@query(f"""WITH h AS (SELECT conv_id, turn, unnest({WORDS.replace('text', 'src')}) AS word FROM {PAIRS}), r AS (SELECT conv_id, turn, unnest({WORDS.replace('text', 'tgt')}) AS word FROM {PAIRS}),
a AS (SELECT conv_id, turn, word, count(*) AS n FROM h GROUP BY ALL), b AS (SELECT conv_id, turn, word, count(*) AS n FROM r GROUP BY ALL)
SELECT conv_id, turn, CAST(sum(least(a.n, b.n)) AS BIGINT) AS n FROM a JOIN b USING (conv_id, turn, word) GROUP BY ALL""")
def bag_intersection(t):
    p, keys = pairs(t), ["conv_id", "turn"]
    a, b = (sets.bag(p.select(*keys, F.explode(words(F.col(c))).alias("word")), keys, "word") for c in ("src", "tgt"))
    return sets.intersection(a, b, [*keys, "word"]).groupBy(*keys).agg(F.sum("n").alias("n"))


@query(f"""WITH x AS (SELECT conv_id, turn, unnest({WORDS}) AS word FROM conversations), a AS (SELECT conv_id, turn, word, count(*) AS n FROM x GROUP BY ALL)
SELECT conv_id, word, max(n) AS n FROM a GROUP BY ALL""")
def bag_union_max(t):
    x = t("conversations").select("conv_id", "turn", F.explode(words(F.col("text"))).alias("word"))
    a = sets.bag(x, ["conv_id", "turn"], "word")
    even, odd = a.filter("turn % 2 = 0").groupBy("conv_id", "word").agg(F.max("n").alias("n")), a.filter("turn % 2 = 1").groupBy("conv_id", "word").agg(F.max("n").alias("n"))
    return sets.union_max(even, odd, ["conv_id", "word"])


@query("SELECT event_type AS value FROM events UNION SELECT lang FROM documents UNION SELECT role FROM conversations")
def entity_union(t):
    named = [t("events").select(F.col("event_type").alias("value")), t("documents").select("lang"), t("conversations").select("role")]
    return named[0].union(named[1]).union(named[2]).distinct()


@query("SELECT event_type, count(*) AS n, max(len(props)) AS longest FROM events GROUP BY event_type")
def domain_counts(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.length("props")).cast("long").alias("longest"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, lower(event_type) NOT IN ('false', '0', 'no', 'n', 'f', 'none', '') AS flag,
strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events""")
def json_coerce(t):
    e = t("events")
    flag = ~F.lower("event_type").isin("false", "0", "no", "n", "f", "none", "")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), flag.alias("flag"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"))


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS slot, CASE WHEN event_type = 'click' THEN 'press'
WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 = 0 THEN 'none' ELSE event_type END AS value, count(*) AS n FROM events GROUP BY ALL""")
def slot_repair(t):
    from ..operators.dialogue import repair_values

    e = t("events").select("event_type", (F.get_json_object("props", "$.k").cast("long") % 7).alias("slot"))
    fixed = repair_values(F.col("event_type"), {"click": "press"}, [(F.col("slot") == 0, "none")])
    return e.select("event_type", "slot", fixed.alias("value")).groupBy("event_type", "slot", "value").agg(F.count("*").alias("n"))


@query("""SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_tumbling(t):
    from ..streaming.events import hourly

    return hourly(t("events")).select("event_type", F.unix_timestamp("start").alias("hour"), "n", F.round("total", 4).alias("total"))
