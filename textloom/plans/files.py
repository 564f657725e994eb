"""Queries over sources and sinks: each writes files of a format to the shared folder, as a
corpus would come, and reads them by the format's reader; the SQL says what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import filters
from ..shared import new_path
from ..sources import readers, writers
from .base import query
from .corpus import PAIRS, WORDS, pairs


def scratch(t, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return new_path(t("region").sparkSession, name)


def _spark(t):
    return t("region").sparkSession


def _topped(t, top: str, rows):
    """(number, value) of a few rows as lines below a first one, in one file."""
    return _spark(t).createDataFrame([(-1, top)], "number int, value string").union(rows).orderBy("number").coalesce(1).select("value")


def _key(column: str):
    return F.regexp_extract(column, "([0-9]+)\\.wav$", 1).cast("long")


@query("SELECT doc_id, round(n_chars / 15.0, 6) AS duration, md5(text) AS digest, doc_id % 2 = 0 AS named FROM documents")
def source_manifest(t):
    d = t("documents")
    even = F.col("doc_id") % 2 == 0
    wav = F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    rows = d.select(F.when(even, wav).alias("audio_filename"), F.when(~even, wav).otherwise("b/0.wav").alias("audio_filepath"), (F.col("n_chars") / 15.0).alias("duration"), "text", F.lit(1).alias("further"))
    one, two = scratch(t, "even"), scratch(t, "odd")
    rows.filter("audio_filename is not null").write.json(one)
    rows.filter("audio_filename is null").write.json(two)
    found = readers.manifest(_spark(t), one, two)
    return found.select(_key("audio_file").alias("doc_id"), F.round("duration", 6).alias("duration"), F.md5("text").alias("digest"), F.contains("file", F.lit("/even/")).alias("named"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'go' WHEN 1 THEN lang ELSE source END AS label FROM documents WHERE CASE doc_id % 3 WHEN 0 THEN 'go' WHEN 1 THEN lang ELSE source END IS NOT NULL")
def source_label_manifest(t):
    k = F.col("doc_id") % 3
    path = scratch(t, "labels")
    label = F.when(k == 0, "go").when(k == 1, F.col("lang")).otherwise(F.col("source"))
    t("documents").filter(label.isNotNull()).select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio_filename"), (F.col("n_chars") / 15.0).alias("duration"),
        F.when(k == 0, "go").alias("command"), F.when(k < 2, F.col("lang")).alias("target"), F.coalesce("source", F.lit("-")).alias("label"),
    ).write.json(path)
    return readers.label_manifest(_spark(t), path).select(_key("audio_file").alias("doc_id"), "label")


@query("SELECT CAST(n_nationkey AS BIGINT) AS line_no, n_name AS value FROM nation")
def source_numbered_lines(t):
    path = scratch(t, "lines")
    t("nation").orderBy("n_nationkey").coalesce(1).select(F.col("n_name").alias("value")).write.text(path)  # 25 rows
    return readers.numbered_lines(_spark(t), path).select("line_no", "value")


@query("SELECT CAST(n_nationkey AS BIGINT) AS line_no, n_name AS words, CAST(n_regionkey AS VARCHAR) AS labels FROM nation")
def source_zipped_lines(t):
    one, two = scratch(t, "words"), scratch(t, "labels")
    d = t("nation").orderBy("n_nationkey").coalesce(1)
    d.select("n_name").write.text(one)
    d.select(F.col("n_regionkey").cast("string")).write.text(two)
    return readers.zipped_lines(_spark(t), one, two, ("words", "labels"))


@query("SELECT 'csv' AS kind, n_name AS transcript FROM nation UNION ALL SELECT 'json', n_name FROM nation UNION ALL SELECT 'txt', n_name FROM nation")
def source_transcripts(t):
    paths = {kind: scratch(t, f"t.{kind}") for kind in ("csv", "json", "txt")}
    d = t("nation").select("n_nationkey", F.col("n_name").alias("transcript"))
    d.write.csv(paths["csv"], header=True)
    d.select(F.col("transcript").alias("text"), "n_nationkey").write.json(paths["json"])
    d.select("transcript").write.text(paths["txt"])
    found = [readers.transcripts(_spark(t), p).select(F.lit(kind).alias("kind"), "transcript") for kind, p in paths.items()]
    return found[0].union(found[1]).union(found[2])


@query("SELECT p_partkey AS part, p_name AS name, p_brand AS brand FROM part")
def source_csv_rows(t):
    path = scratch(t, "parts")
    t("part").select(F.col("p_partkey").cast("string"), "p_name", "p_brand").write.csv(path)
    c = readers.csv_rows(_spark(t), path)
    return c.select(F.get("cols", F.lit(0)).cast("long").alias("part"), F.get("cols", F.lit(1)).alias("name"), F.get("cols", F.lit(2)).alias("brand"))


@query("SELECT lower(n_name) || ' is a nation' AS sentence, CAST(n_regionkey AS INT) AS label FROM nation")
def source_classification(t):
    path = scratch(t, "tsv")
    rows = t("nation").select("n_nationkey", F.concat(F.lower("n_name"), F.lit(" is a nation "), F.col("n_regionkey").cast("string")).alias("value"))
    _topped(t, "sentence\tlabel", rows).write.text(path)
    return readers.classification(_spark(t), path).select("sentence", "label")


_LINE = "replace({0}, chr(10), ' ')"


def _line(c):
    return F.translate(c, "\n", " ")


@query(f"SELECT 'dev-' || (conv_id * 100 + turn) AS guid, {_LINE.format('src')} AS text_a, {_LINE.format('tgt')} AS text_b, CAST(turn % 2 AS VARCHAR) AS label FROM {PAIRS}")
def source_sentence_pairs(t):
    path = scratch(t, "qqp")
    p = pairs(t)
    rows = p.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.lit("x").alias("qid1"), F.lit("y").alias("qid2"), _line("src").alias("question1"), _line("tgt").alias("question2"), (F.col("turn") % 2).alias("is_duplicate"))
    rows.write.option("header", "true").option("sep", "\t").option("quote", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return readers.sentence_pairs(_spark(t), path, "qqp", "dev")


@query(f"SELECT CAST(item_id AS VARCHAR) AS qas_id, text AS context, ({WORDS})[1] AS answer, item_id % 4 = 0 AS is_impossible FROM benchmark WHERE len({WORDS}) > 0")
def source_questions(t):
    rows = t("benchmark").select("item_id", "text", F.get(words(F.col("text")), F.lit(0)).alias("w")).filter("w is not null")
    answer = F.struct(F.col("w").alias("text"), F.lit(0).alias("answer_start"))
    question = F.struct(F.col("item_id").cast("string").alias("id"), F.lit("?").alias("question"), (F.col("item_id") % 4 == 0).alias("is_impossible"), F.array(answer).alias("answers"))
    paragraph = F.struct(F.col("text").alias("context"), F.array(question).alias("qas"))
    path = scratch(t, "qa")
    rows.select(F.array(F.struct(F.lit("t").alias("title"), F.array(paragraph).alias("paragraphs"))).alias("data")).write.json(path)
    return readers.questions(_spark(t), path, lines=True).select("qas_id", "context", "answer", "is_impossible")


#: Users of one document: its utterances are numbered.
USERS = 20
_INTENTS_SQL = f"SELECT event_type AS intent, user_id, row_number() OVER (PARTITION BY event_type, user_id // {USERS} ORDER BY user_id) - 1 AS k FROM (SELECT DISTINCT event_type, user_id FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL)"


def _intent_file(t):
    """A document for each intent and USERS users, a line each, written by many tasks."""
    pairs_ = t("events").select("event_type", "user_id").filter("event_type is not null and user_id is not null").distinct()
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    part = lambda text, slot: F.struct(text.alias("text"), slot.alias("slot_name"))
    utterance = F.struct(F.array(part(F.concat("event_type", F.lit(" of ")), F.lit(None).cast("string")), part(user, F.lit("who"))).alias("data"))
    value = F.struct(user.alias("value"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("someone")).alias("synonyms"))
    docs = pairs_.groupBy("event_type", F.floor(F.col("user_id") / USERS)).agg(F.array_sort(F.collect_list(F.struct("user_id", utterance.alias("u"), value.alias("v")))).alias("x"))
    utterances = F.struct(F.transform("x", lambda x: x["u"]).alias("utterances"))
    values = F.struct(F.transform("x", lambda x: x["v"]).alias("data"))
    path = scratch(t, "intents")
    docs.select(F.create_map("event_type", utterances).alias("intents"), F.create_map("event_type", values).alias("entities")).write.json(path)
    return path


@query(f"SELECT intent, CAST(k AS INT) AS utterance_no, intent || ' of user ' || user_id AS sentence, 'O O who who' AS slots FROM ({_INTENTS_SQL})")
def source_intents(t):
    found = readers.intents(_spark(t), _intent_file(t), lines=True)
    return found.select("intent", "utterance_no", F.array_join("tokens", " ").alias("sentence"), F.array_join("slots", " ").alias("slots"))


@query(f"SELECT DISTINCT intent AS entity, unnest(['user ' || user_id, 'u' || user_id, 'someone']) AS value FROM ({_INTENTS_SQL})")
def source_entities(t):
    return readers.entities(_spark(t), _intent_file(t), lines=True)


@query("""SELECT CAST(conv_id AS VARCHAR) AS dialogue_idx, CAST(turn AS INT) AS turn_no, text AS "user", CASE WHEN turn % 2 = 0 THEN 'north' END AS area FROM conversations""")
def source_dialogues(t):
    # The whole table as JSON documents, a line each, wrapped as arrays of one dialogue.
    path = scratch(t, "dialogues")
    empty = F.array().cast("array<struct<slots:array<array<string>>>>")
    belief = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.array(F.array(F.lit("hotel-area"), F.lit("north"))).alias("slots")))).otherwise(empty)
    turn = F.struct(F.col("turn").cast("int").alias("turn_idx"), F.col("role").alias("domain"), F.lit("").alias("system_transcript"), F.col("text").alias("transcript"), belief.alias("belief_state"))
    talks = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("dialogue"))
    talks.select(F.col("conv_id").cast("string").alias("dialogue_idx"), F.array(F.lit("hotel")).alias("domains"), "dialogue").write.json(path)
    found = readers.dialogues(_spark(t), path, lines=True)
    return found.select("dialogue_idx", "turn_no", "user", F.element_at("belief", "hotel-area").alias("area"))


@query(f"SELECT {_LINE.format('src')} AS a, {_LINE.format('tgt')} AS b FROM {PAIRS}")
def source_utterance_pairs(t):
    path = scratch(t, "pairs")
    pairs(t).select(F.concat_ws("\t", _line("src"), _line("tgt"))).write.text(path)
    return readers.utterance_pairs(_spark(t), path)


@query("""WITH l AS (SELECT lang, doc_id // 500 AS file, unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang IS NOT NULL)
SELECT lang, line FROM l WHERE trim(line) <> '' QUALIFY count(*) OVER (PARTITION BY lang, file) > 1""")
def source_corpus_lines(t):
    root = scratch(t, "tree")
    d = t("documents").filter("lang is not null").select("lang", F.floor(F.col("doc_id") / 500).alias("file"), "text")
    d.repartition("lang", "file").write.partitionBy("lang", "file").text(root)  # a file for each language and 500 ids
    found = readers.corpus_lines(_spark(t), root)
    return found.select(F.regexp_extract("file", "/lang=([^/]*)/", 1).alias("lang"), F.col("value").alias("line"))


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS line_no, lower(n_name) AS text FROM nation")
def source_segments(t):
    path = scratch(t, "sgm")
    rows = t("nation").select("n_nationkey", F.concat(F.lit('<seg id="1">  '), F.lower("n_name"), F.lit(" </seg>")).alias("value"))
    _topped(t, "<doc>", rows).write.text(path)
    return readers.segments(_spark(t), path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS utt_id, lower(c_name) AS text, round(c_custkey % 50 / 5, 6) AS duration FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 50 / 5 BETWEEN 1 AND 8")
def source_utterance_table(t):
    folder = scratch(t, "kaldi")
    c = t("customer").select(F.col("c_custkey").cast("string").alias("id"), F.lower("c_name").alias("name"), (F.col("c_custkey") % 50 / 5).cast("string").alias("seconds"))
    c.select(F.concat_ws(" ", "id", "name")).write.text(f"{folder}/text")
    c.select(F.concat_ws(" ", "id", "seconds")).write.text(f"{folder}/utt2dur")
    features = t("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("utt_id"), F.array(F.lit(1.0)).alias("features"))
    found = readers.utterance_table(_spark(t), folder, features, low=1, high=8)
    return found.select("utt_id", "text", F.round("duration", 6).alias("duration"))


@query("SELECT DISTINCT event_type AS file, true AS there FROM events WHERE event_type IS NOT NULL UNION ALL SELECT DISTINCT 'no-' || event_type, false FROM events WHERE event_type IS NOT NULL")
def source_files_exist(t):
    """The folder of each type of event is there, others are not."""
    path = scratch(t, "types")
    e = t("events").filter("event_type is not null")
    e.select("event_type", "event_id").write.partitionBy("event_type").parquet(path)
    spark = _spark(t)
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]  # names of types
    rows = [(k, filters.file_exists(spark, f"{path}/event_type={k}")) for k in (*kinds, *(f"no-{k}" for k in kinds))]
    return spark.createDataFrame(rows, "file string, there boolean")


# ---- sinks ---------------------------------------------------------------------

@query(f"SELECT trim({_LINE.format('text')}) AS value FROM conversations")
def sink_lines(t):
    path = scratch(t, "out")
    writers.write_lines(t("conversations"), _line("text"), path)
    return _spark(t).read.text(path)


@query("SELECT doc_id || chr(9) || coalesce(lang, '') || chr(9) || n_chars AS value FROM documents WHERE lang IS NOT NULL")
def sink_tsv(t):
    path = scratch(t, "out")
    writers.write_tsv(t("documents").filter("lang is not null"), path, "doc_id", "lang", "n_chars", order=("doc_id",))
    return _spark(t).read.text(path)


@query(f"SELECT row_number() OVER (ORDER BY word) - 1 AS line_no, word AS value FROM (SELECT DISTINCT unnest({WORDS}) AS word FROM benchmark)")
def sink_vocabulary(t):
    from ..operators.order import ranked

    path = scratch(t, "vocab")
    ids = ranked(t("benchmark").select(F.explode(words(F.col("text"))).alias("word")).distinct(), "word", "id")
    writers.write_vocabulary(ids, "word", path)
    return readers.numbered_lines(_spark(t), path).select("line_no", "value")


@query("SELECT row_number() OVER (ORDER BY n DESC, event_type) - 1 AS line_no, event_type AS label, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def sink_label_stats(t):
    path = scratch(t, "stats")
    writers.write_label_stats(t("events"), "event_type", path)
    cols = F.split("value", "\t")
    return readers.numbered_lines(_spark(t), path).select("line_no", F.get(cols, F.lit(0)).alias("label"), F.round(F.get(cols, F.lit(1)).cast("double"), 6).alias("share"))


@query(f"""WITH i AS (SELECT intent, row_number() OVER (ORDER BY intent) - 1 AS id FROM (SELECT DISTINCT intent FROM ({_INTENTS_SQL})))
SELECT 'sentences' AS file, intent || ' of user ' || user_id || chr(9) || id AS value FROM ({_INTENTS_SQL}) JOIN i USING (intent)
UNION ALL SELECT 'slots', '1 1 0 0' FROM ({_INTENTS_SQL}) UNION ALL SELECT 'dict.intents', intent FROM i UNION ALL SELECT 'dict.slots', unnest(['who', 'O'])""")
def sink_intent_data(t):
    folder = scratch(t, "data")
    writers.write_intent_data(readers.intents(_spark(t), _intent_file(t), lines=True), folder)
    found = None
    for name in ("sentences", "slots", "dict.intents", "dict.slots"):
        own = _spark(t).read.text(f"{folder}/{name}").select(F.lit(name).alias("file"), "value")
        found = own if found is None else found.union(own)
    return found
