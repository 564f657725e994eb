"""Readers and writers on small files of each format."""

import json
import struct
import wave

import pytest
from pyspark.sql import functions as F

from textloom.sources import readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lines_are_numbered_over_many_blocks(spark, tmp_path):
    lines = [f"line {k}" if k % 10 else "" for k in range(5000)]
    path = put(tmp_path / "a.txt", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = {r["line_no"]: r["value"] for r in readers.numbered_lines(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == dict(enumerate(lines))


def test_zipped_lines_need_equal_lengths(spark, tmp_path):
    a, b, c = put(tmp_path / "a", "x\ny\n"), put(tmp_path / "b", "1\n2\n"), put(tmp_path / "c", "1\n")
    assert [tuple(r) for r in readers.zipped_lines(spark, a, b).orderBy("line_no").collect()] == [(0, "x", "1"), (1, "y", "2")]
    with pytest.raises(Exception, match="partner"):
        readers.zipped_lines(spark, a, c).collect()


def test_manifests(spark, tmp_path):
    rows = [
        {"audio_filename": "a.wav", "audio_filepath": "b.wav", "duration": 1.5, "text": "hi", "side": "x"},
        {"audio_filepath": "c.wav", "duration": 2, "text_filepath": "/far/t.txt", "offset": 0.5, "label": "l", "command": "go"},
    ]
    path = put(tmp_path / "m.json", "\n".join(map(json.dumps, rows)))
    put(tmp_path / "texts" / "t.txt", "two\nlines\n")
    found = readers.manifest(spark, path, transcripts=str(tmp_path / "texts")).orderBy("audio_file").collect()
    assert [(r["audio_file"], r["duration"], r["text"], r["offset"]) for r in found] == [("a.wav", 1.5, "hi", None), ("c.wav", 2.0, "twolines", 0.5)]
    with pytest.raises(Exception, match="no label"):
        readers.label_manifest(spark, path).collect()
    with pytest.raises(Exception, match="no duration"):
        readers.manifest(spark, put(tmp_path / "n.json", '{"audio_filename": "a"}')).collect()
    with pytest.raises(Exception):  # noqa: B017  a malformed line fails the job
        readers.manifest(spark, put(tmp_path / "bad.json", "{not json")).collect()


def test_line_formats(spark, tmp_path):
    assert [r[0] for r in readers.transcripts(spark, put(tmp_path / "t.csv", "id,transcript\n1,hello\n")).collect()] == ["hello"]
    assert [r[0] for r in readers.transcripts(spark, put(tmp_path / "t.json", '{"text": "hey"}\n')).collect()] == ["hey"]
    found = readers.classification(spark, put(tmp_path / "c.tsv", "sentence\tlabel\na good film 1\nbad\t0\n")).orderBy("line_no").collect()
    assert [(r["sentence"], r["label"]) for r in found] == [("a good film", 1), ("bad", 0)]
    path = put(tmp_path / "qqp.tsv", "h\n" + "\t".join("7 a b q1 q2 1".split()) + "\nshort\trow\n")
    assert [tuple(r) for r in readers.sentence_pairs(spark, path, "qqp", "dev").collect()] == [("dev-7", "q1", "q2", "1")]
    path = put(tmp_path / "cola.tsv", "x\t1\t\tfirst line\n")
    assert [tuple(r) for r in readers.sentence_pairs(spark, path, "cola").collect()] == [("train-0", "first line", None, "1")]
    assert [tuple(r) for r in readers.utterance_pairs(spark, put(tmp_path / "p.txt", "a b\tc d\n")).collect()] == [("a b", "c d")]
    assert [r["text"] for r in readers.segments(spark, put(tmp_path / "s.sgm", '<doc>\n<seg id="1"> two  words </seg>\n')).collect()] == ["two words"]
    put(tmp_path / "tree" / "x" / "one.txt", "only\n")
    put(tmp_path / "tree" / "two.txt", "l1\n\nl2\n")
    assert sorted(r["value"] for r in readers.corpus_lines(spark, str(tmp_path / "tree")).collect()) == ["l1", "l2"]


def test_nested_json(spark, tmp_path):
    qa = {"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q?", "answers": [{"text": "a", "answer_start": 3}]}, {"id": "2", "question": "r?", "is_impossible": True, "answers": []}]}]}]}
    found = readers.questions(spark, put(tmp_path / "qa.json", json.dumps(qa))).orderBy("qas_id").collect()
    assert [(r["qas_id"], r["answer"], r["answer_start"], r["is_impossible"]) for r in found] == [("1", "a", 3, False), ("2", None, None, True)]
    data = {"intents": {"book": {"utterances": [{"data": [{"text": "fly to "}, {"text": "New York", "slot_name": "city"}]}]}}, "entities": {"city": {"data": [{"value": "NYC", "synonyms": ["New York"]}]}}}
    path = put(tmp_path / "i.json", json.dumps(data))
    row = readers.intents(spark, path).first()
    assert (row["intent"], row["tokens"], row["slots"]) == ("book", ["fly", "to", "New", "York"], ["O", "O", "city", "city"])
    assert sorted(r["value"] for r in readers.entities(spark, path).collect()) == ["NYC", "New York"]
    talk = [{"dialogue_idx": "d", "domains": ["hotel"], "dialogue": [{"turn_idx": 0, "domain": "hotel", "system_transcript": "", "transcript": "hi", "belief_state": [{"slots": [["hotel-area", "north"]]}]}]}]
    row = readers.dialogues(spark, put(tmp_path / "d.json", json.dumps(talk))).first()
    assert (row["turn_no"], row["user"], row["belief"]) == (0, "hi", {"hotel-area": "north"})


def test_utterances_and_audio(spark, tmp_path):
    put(tmp_path / "k" / "text", "u1 hello there\nu2 bye\nu3 x\n")
    put(tmp_path / "k" / "utt2dur", "u1 2.5\nu2 9\nu3 1\n")
    features = spark.createDataFrame([("u1", [1.0]), ("u2", [2.0])], "utt_id string, feats array<double>")
    found = readers.utterance_table(spark, str(tmp_path / "k"), features, high=5).collect()
    assert [(r["utt_id"], r["text"], r["duration"]) for r in found] == [("u1", "hello there", 2.5)]
    (tmp_path / "wav").mkdir()
    for name, seconds in (("a", 1), ("b", 20)):
        with wave.open(str(tmp_path / "wav" / f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(100)
            w.writeframes(struct.pack("<h", 16384) * 100 * seconds)
    found = readers.audio_files(spark, str(tmp_path / "wav")).collect()
    assert len(found) == 1 and found[0]["sample_rate"] == 100 and found[0]["samples"] == [0.5] * 100


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", " x "), ("a", "y"), ("b", "z")], "label string, text string")
    writers.write_lines(df, F.col("text"), f"{tmp_path}/lines", "text")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/lines").collect()) == ["x", "y", "z"]
    writers.write_label_stats(df, "label", f"{tmp_path}/stats")
    assert [r[0].split("\t")[0] for r in spark.read.text(f"{tmp_path}/stats").collect()] == ["b", "a"]
    rows = spark.createDataFrame([("go", ["To", "Rome"], ["O", "city"]), ("ask", ["when"], ["O"])], "intent string, tokens array<string>, slots array<string>")
    writers.write_intent_data(rows, f"{tmp_path}/data", lower=True)
    assert [r[0] for r in spark.read.text(f"{tmp_path}/data/dict.slots").collect()] == ["city", "O"]
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/data/sentences").collect()) == ["to rome\t1", "when\t0"]
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/data/slots").collect()) == ["1", "1 0"]


def test_numbered_lines_are_not_shuffled(spark, tmp_path):
    texts = {"a.txt": [f"line {k} é" for k in range(400)], "b.txt": ["", "x", ""], "c.txt": []}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "700")  # several blocks a file
    try:
        rows = readers.numbered_lines(spark, str(tmp_path))
        got = sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in rows.collect())
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    assert got == sorted((name, k, x) for name, lines in texts.items() for k, x in enumerate(lines))
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan


def test_places_go_on_where_a_block_crosses_batches():
    import pyarrow as pa

    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["value", "file", "block"])

    parts = [batch(("a", "f", 0), ("b", "f", 0)), batch(("c", "f", 0), ("d", "f", 9), ("e", "g", 9)), batch(("h", "g", 9))]
    assert [p["place"].to_pylist() for p in readers._places([*parts, parts[0].slice(2)])] == [[0, 1], [2, 0, 0], [1], []]
