"""Readers of corpora as typed tables: manifests, line files, sentence pairs, nested JSON.

All are scans by Spark's own sources with a declared schema; nothing is opened on the driver.
A malformed line of a strict format fails the job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MANIFEST = "audio_filename string, audio_filepath string, duration double, text string, text_filepath string, offset double"
_LABELS = "command string, target string, label string"


def _needed(value: Column, kind: str, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"a line has no {what}")).cast(kind))


def _places(batches):
    """(value, file, block) -> those with a row's place among those of its block; a task reads a block as one run."""
    last, n = None, 0
    for batch in batches:
        places = []
        for part in _runs(batch):
            key = part["file"][0].as_py(), part["block"][0].as_py()
            last, n = key, n if key == last else 0
            places.append(np.arange(n, n + part.num_rows))
            n += part.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*places, np.zeros(0, np.int64)]), pa.int64())], ["value", "file", "block", "place"])


def _runs(batch: pa.RecordBatch):
    """The runs of rows of one block."""
    if batch.num_rows:
        one, two = batch.slice(0, batch.num_rows - 1), batch.slice(1)
        other = pc.or_(pc.not_equal(one["file"], two["file"]), pc.not_equal(one["block"], two["block"]))
        edges = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for k, end in zip(edges, edges[1:], strict=False):
            yield batch.slice(k, end - k)


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line_no from 0, value) of text files, an empty line included.

    A block of a file is numbered by the task that reads it; its first number is the sum of the lines
    of the blocks before it, so that one large file is read by many tasks and no line is shuffled.
    What is broadcast is a row for each block; the driver's list of files is as long."""
    rows = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = F.broadcast(counts.select("file", "block", before.alias("first")))
    placed = rows.mapInArrow(_places, "value string, file string, block long, place long").join(starts, ["file", "block"], "left")
    first = F.coalesce("first", F.raise_error(F.concat(F.lit("blocks changed while read: "), "file")).cast("long"))
    return placed.select("file", (first + F.col("place")).alias("line_no"), "value")


def zipped_lines(spark: SparkSession, one: str, two: str, names: tuple[str, str] = ("source", "target")) -> DataFrame:
    """(line_no, one's line, two's line) of two files read side by side; unequal lengths fail."""
    a = numbered_lines(spark, one).select("line_no", F.col("value").alias(names[0]))
    b = numbered_lines(spark, two).select("line_no", F.col("value").alias(names[1]))
    both = a.join(b, "line_no", "full")
    return both.select("line_no", *[_needed(F.col(n), "string", f"partner in the file of {n}").alias(n) for n in names])


def manifest(spark: SparkSession, *paths: str, transcripts: str | None = None) -> DataFrame:
    """(audio_file, duration, text, offset, file) of JSON-lines manifests.

    audio_filename goes before audio_filepath, a duration is needed. A line without text takes
    the contents, line feeds dropped, of the file under `transcripts` whose name its
    text_filepath ends with."""
    rows = spark.read.schema(_MANIFEST).option("mode", "FAILFAST").json(list(paths)).withColumn("file", F.col("_metadata.file_path"))
    text = F.col("text")
    if transcripts:
        found = spark.read.option("recursiveFileLookup", "true").text(transcripts, wholetext=True).select(
            F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.replace("value", F.lit("\n"), F.lit("")).alias("contents")
        )
        rows = rows.withColumn("name", F.element_at(F.split("text_filepath", "/"), -1)).join(found, "name", "left")
        text = F.coalesce("text", "contents")
    return rows.select(
        F.coalesce("audio_filename", "audio_filepath").alias("audio_file"), _needed(F.col("duration"), "double", "duration").alias("duration"),
        text.alias("text"), "offset", "file",
    )


def label_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """(audio_file, duration, label, offset): command goes before target before label."""
    rows = spark.read.schema(f"{_MANIFEST}, {_LABELS}").option("mode", "FAILFAST").json(list(paths))
    return rows.select(
        F.coalesce("audio_filename", "audio_filepath").alias("audio_file"), _needed(F.col("duration"), "double", "duration").alias("duration"),
        _needed(F.coalesce("command", "target", "label"), "string", "label").alias("label"), "offset",
    )


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(transcript) by the file's ending: column `transcript` of .csv, field `text` of .json, else lines."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True).select("transcript")
    if path.endswith(".json"):
        return spark.read.schema("text string").json(path).select(F.col("text").alias("transcript"))
    return spark.read.text(path).select(F.col("value").alias("transcript"))


def utterance_table(spark: SparkSession, folder: str, features: DataFrame, low: float = 0, high: float = 0) -> DataFrame:
    """(utt_id, text, duration, features) of a folder with `text` and, if there, `utt2dur` (id,
    space, rest); utterances without features go. Bounds of 0 are off."""
    def pairs(name: str, out: str, kind: str) -> DataFrame:
        value = F.col("value")
        return spark.read.text(f"{folder}/{name}").select(F.substring_index(value, " ", 1).alias("utt_id"), F.trim(F.substr(value, F.instr(value, " ") + 1)).cast(kind).alias(out))

    from ..operators.filters import file_exists

    rows = pairs("text", "text", "string").join(features, "utt_id")
    if not file_exists(spark, f"{folder}/utt2dur"):
        return rows.withColumn("duration", F.lit(None).cast("double"))
    rows = rows.join(pairs("utt2dur", "duration", "double"), "utt_id", "left").withColumn("duration", _needed(F.col("duration"), "double", "duration"))
    for bound, keep in ((low, F.col("duration") >= low), (high, F.col("duration") <= high)):
        rows = rows.filter(keep) if bound else rows
    return rows


def ragged_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, cols): rows may differ in width; no quoting; a byte-order mark goes."""
    return numbered_lines(spark, path).select("line_no", F.split(F.regexp_replace("value", "^\\x{FEFF}", ""), "\t").alias("cols"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, cols): the comma-separated values of each line, quoted ones unquoted; widths may differ."""
    rows = numbered_lines(spark, path)
    each = F.regexp_extract_all("value", F.lit('(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = F.transform(each, lambda c: F.when(c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return rows.select("line_no", plain.alias("cols"))


def classification(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, sentence, label) of a file with a header line whose last word is the label."""
    rows = numbered_lines(spark, path).filter("line_no > 0").withColumn("parts", F.split(F.trim("value"), "\\s+"))
    return rows.select("line_no", F.array_join(F.slice("parts", 1, F.size("parts") - 1), " ").alias("sentence"), F.element_at("parts", -1).cast("int").alias("label"))


# Columns of the first and second sentence and of the label; whether the first
# line is a header and whether ids come from column 0 (else from the line).
PAIR_TASKS = {
    "mrpc": (3, 4, 0, True, False), "mnli": (8, 9, -1, True, True), "cola": (3, None, 1, False, False), "sst-2": (0, None, 1, True, False),
    "sts-b": (7, 8, -1, True, True), "qqp": (3, 4, 5, True, True), "qnli": (1, 2, -1, True, True), "rte": (1, 2, -1, True, True),
    "wnli": (1, 2, -1, True, True), "mnli-mm": (8, 9, -1, True, True),
}


def sentence_pairs(spark: SparkSession, path: str, task: str, split: str = "train") -> DataFrame:
    """(guid, text_a, text_b, label) of a sentence or sentence-pair task; rows too short for
    the task's columns go."""
    a, b, label, header, by_column = PAIR_TASKS[task]
    rows = ragged_tsv(spark, path).filter(F.col("line_no") >= int(header)).filter(F.size("cols") > max(a, b or 0, label))

    def at(k):
        return F.element_at("cols", k + 1 if k >= 0 else k)

    key = at(0) if by_column else F.col("line_no").cast("string")
    return rows.select(F.concat(F.lit(f"{split}-"), key).alias("guid"), at(a).alias("text_a"), (at(b) if b is not None else F.lit(None).cast("string")).alias("text_b"), at(label).alias("label"))


_QA = (
    "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,"
    "is_impossible:boolean,answers:array<struct<text:string,answer_start:int>>>>>>>>"
)


def questions(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """(qas_id, title, context, question, is_impossible, answer, answer_start, answers): a row for each question.
    lines: a document on each line, so that a large file is read by many tasks; else a file is one."""
    q = spark.read.schema(_QA).option("multiLine", str(not lines).lower()).json(path).select(F.explode("data").alias("d"))
    q = q.select("d.title", F.explode("d.paragraphs").alias("p")).select("title", "p.context", F.explode("p.qas").alias("q"))
    first = F.get("q.answers", F.lit(0))
    return q.select(
        F.col("q.id").alias("qas_id"), "title", "context", "q.question", F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"),
        first["text"].alias("answer"), first["answer_start"].alias("answer_start"), F.col("q.answers").alias("answers"),
    )


_INTENTS = (
    "intents map<string,struct<utterances:array<struct<data:array<struct<text:string,slot_name:string>>>>>>, "
    "entities map<string,struct<data:array<struct<value:string,synonyms:array<string>>>>>"
)


def intents(spark: SparkSession, *paths: str, lines: bool = False) -> DataFrame:
    """(intent, utterance_no, tokens, slots): each word with the slot of its part, O for none.
    lines: as in questions()."""
    rows = spark.read.schema(_INTENTS).option("multiLine", str(not lines).lower()).json(list(paths)).select(F.explode("intents").alias("intent", "v"))
    rows = rows.select("intent", F.posexplode("v.utterances").alias("utterance_no", "u"))
    parts = F.transform("u.data", lambda d: F.struct(F.filter(F.split(d["text"], "\\s+"), lambda w: w != "").alias("w"), F.coalesce(d["slot_name"], F.lit("O")).alias("s")))
    rows = rows.select("intent", "utterance_no", parts.alias("parts"))
    return rows.select(
        "intent", "utterance_no", F.flatten(F.transform("parts", lambda p: p["w"])).alias("tokens"),
        F.flatten(F.transform("parts", lambda p: F.transform(p["w"], lambda w: p["s"]))).alias("slots"),
    )


def entities(spark: SparkSession, *paths: str, lines: bool = False) -> DataFrame:
    """(entity, value) of all values and synonyms, each once. lines: as in questions()."""
    rows = spark.read.schema(_INTENTS).option("multiLine", str(not lines).lower()).json(list(paths)).select(F.explode("entities").alias("entity", "v"))
    rows = rows.select("entity", F.explode("v.data").alias("d"))
    return rows.select("entity", F.explode(F.array_append(F.coalesce("d.synonyms", F.array().cast("array<string>")), F.col("d.value"))).alias("value")).filter("value is not null").distinct()


_DIALOGUES = (
    "dialogue_idx string, domains array<string>, dialogue array<struct<turn_idx:int,domain:string,system_transcript:string,"
    "transcript:string,belief_state:array<struct<slots:array<array<string>>>>>>"
)


def dialogues(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """(dialogue_idx, domains, turn_no, domain, system, user, belief: map of slot to value): a row for each
    turn. lines: a dialogue on each line, so that a large file is read by many tasks; else one array."""
    rows = spark.read.schema(_DIALOGUES).option("multiLine", str(not lines).lower()).json(path).select("dialogue_idx", "domains", F.posexplode("dialogue").alias("turn_no", "t"))
    firsts = F.transform("t.belief_state", lambda b: F.struct(b["slots"][0][0], b["slots"][0][1]))
    belief = F.map_from_entries(F.array_distinct(firsts))
    return rows.select("dialogue_idx", "domains", "turn_no", "t.domain", F.col("t.system_transcript").alias("system"), F.col("t.transcript").alias("user"), belief.alias("belief"))


def utterance_pairs(spark: SparkSession, path: str, *, normalise: bool = False) -> DataFrame:
    """(a, b) of lines with a tab between; normalise: both by normalise_utterance()."""
    from ..functions.text import normalise_utterance

    parts = F.split("value", "\t")
    each = [F.get(parts, F.lit(k)) for k in (0, 1)]
    if normalise:
        each = [normalise_utterance(F.trim(x)) for x in each]
    return spark.read.text(path).select(each[0].alias("a"), each[1].alias("b"))


def corpus_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, value) of the lines with text of all *.txt files below a folder; files of one line go."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = rows.filter(F.trim("value") != "")
    several = rows.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1").select("file")
    return rows.join(several, "file", "left_semi")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of the <seg ...> elements of a test-set file, white space collapsed."""
    rows = numbered_lines(spark, path).filter(F.col("value").rlike("<seg[^>]*>.*</seg>"))
    return rows.select("line_no", F.trim(F.regexp_replace(F.regexp_extract("value", "<seg[^>]*>(.*)</seg>", 1), "\\s+", " ")).alias("text"))


def audio_files(spark: SparkSession, folder: str, longest: float = 10.0, rate: int | None = None) -> DataFrame:
    """(path, samples, sample_rate) of the .wav files (PCM) below a folder, up to `longest` seconds;
    rate: all at so many samples a second."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(folder).select("path", "content")
    out = files.mapInArrow(_decoded, "path string, samples array<float>, sample_rate int")
    out = out.filter(F.size("samples") <= longest * F.col("sample_rate"))
    if rate is None:
        return out
    from ..operators.signals import resampled

    return out.select("path", resampled(rate)("samples", "sample_rate").cast("array<float>").alias("samples"), F.lit(rate).alias("sample_rate"))


def _decoded(batches):
    import io
    import wave

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        samples, rates = [], []
        for content in batch.column(1).to_pylist():
            with wave.open(io.BytesIO(content)) as w:
                raw, width = w.readframes(w.getnframes()), w.getsampwidth()
                x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
                x = (x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)
                samples.append(x.reshape(-1, w.getnchannels()).mean(axis=1).astype(np.float32))
                rates.append(w.getframerate())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(samples, pa.list_(pa.float32())), pa.array(rates, pa.int32())], ["path", "samples", "sample_rate"])
