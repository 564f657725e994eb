import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays
from textloom.functions import text as tx
from textloom.operators import dialogue, epochs, metrics


def test_unknown_labels_fail(spark):
    table = spark.createDataFrame([("a", 0), ("b", 1)], "label string, id long")
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "b", "x")], "k long, lab string, label string")
    assert {tuple(r) for r in epochs.known_ids(df, "lab", table, "number").collect()} == {(1, "a", "x", 0), (2, None, "x", None), (3, "b", "x", 1)}
    with pytest.raises(Exception, match="no id for the label c"):
        epochs.known_ids(spark.createDataFrame([(1, "c")], "k long, lab string"), "lab", table).collect()


@pytest.mark.parametrize(("h", "refs", "expected"), [(5, [4, 6], 4), (5, [6, 4], 4), (5, [9, 7, None], 7), (5, [None, None], None), (3, [3, 2], 3)])
def test_closest_length(spark, h, refs, expected):
    row = spark.range(1).select(epochs.closest_length(F.lit(h), [F.lit(r).cast("int") for r in refs])).first()
    assert row[0] == expected


def test_sentence_scores_by_the_orders_that_there_are(spark):
    df = spark.createDataFrame([(1, "a b c d e".split(), "a b c d e".split()), (2, ["a", "b"], ["a", "b"]), (3, [], ["a"]), (4, ["a", "x"], ["a", "b"]), (5, ["x"], ["a"])], "k long, h array<string>, r array<string>")
    lengths = df.select("k", F.size("h").alias("hypothesis_length"), F.size("r").alias("reference_length"))
    got = {r["k"]: r["bleu"] for r in epochs.sentence_scores(metrics.matched_ngrams(df, ["k"], "h", "r", 1, 4), ["k"], lengths).collect()}
    assert got[1] == pytest.approx(100) and got[2] == pytest.approx(100) and got[3] == 0
    assert got[4] == pytest.approx(100 * (0.5 * 0.5) ** 0.5) and got[5] == pytest.approx(50)


def test_batches_splits_and_reports(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 10.0), (3, None)], "b long, x double")
    assert tuple(epochs.batch_means(df, "b", "x").first()) == (2, 3, 6.0, 14 / 3)
    assert tuple(epochs.batch_means(df.limit(0), "b", "x").first()) == (0, 0, None, None)
    d = spark.createDataFrame([("train", 0), ("train", 0), ("train", 1), ("dev", 3)], "s string, y long")
    got = {(r["s"], r["y"]): (r["n"], r["share"], r["weight"], r["classes"]) for r in epochs.split_descriptors(d, "s", "y").collect()}
    assert got == {("train", 0): (2, 2 / 3, 0.75, 4), ("train", 1): (1, 1 / 3, 1.5, 4), ("dev", 3): (1, 1.0, 1.0, 4)}
    r = epochs.epoch_report(spark.createDataFrame([("a", "a"), ("b", "a"), (None, "a"), ("b", None)], "t string, p string"), {"one": ("t", "p")}).first()
    assert r["rows"] == 3 and r["accuracy"] == pytest.approx(1 / 3)
    g = spark.createDataFrame([(1, [[0.0, 1.0], [2.0, 1.0]], [1, 1], [1, 0])], "k long, z array<array<double>>, y array<int>, m array<int>")
    assert [tuple(x) for x in epochs.gathered(g, ["k"], "z", "y", "m").collect()] == [(1, 0, 1, 1)]


def test_padding_and_vocabularies(spark):
    row = spark.range(1).select(arrays.pad_matrix(F.array(F.array(F.lit(1)), F.array().cast("array<int>")), F.lit(3), F.lit(2), 9), arrays.places(F.lit(2), F.lit(4)), arrays.places(F.lit(0), F.lit(0))).first()
    assert list(row) == [[[1, 9], [9, 9], [9, 9]], [1, 2, 0, 0], []]
    words = F.array(F.lit("a"), F.lit("b"))
    table = F.create_map(*[F.lit(x) for x in ("a", 0, "b", 1, "<UNK>", 2)])
    ids = tx.vocabulary_ids(tx.known_tokens(F.split(F.lit("a  c b"), " "), words), table)
    assert list(spark.range(1).select(ids, tx.text_of_ids(ids, words, F.lit(2))).first()) == [[0, 2, 1], "a b"]
    slots = spark.createDataFrame([("hotel-Price Range",), ("hotel-book Day",), ("bus-day",), (None,)], "slot string")
    assert {r[0] for r in dialogue.domain_slots(slots, "slot", ["hotel"]).collect()} == {"hotel-pricerange", "hotel-book day"}


def test_ngrams_of_a_batch_are_counted_a_few_rows_at_a_time():
    import pyarrow as pa

    tokens = [["a", "b", "a", None][: k % 5] for k in range(1001)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1001)), pa.array(tokens), pa.array(tokens[::-1])], ["k", "h", "r"])
    parts = list(metrics._matched([batch], 1, 1, 2))
    assert max(p.num_rows for p in parts) <= 2 * metrics.ROWS < 2 * len(tokens)
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert [r[0] for r in got if r[1] == 1] == [k for k in range(1001) if tokens[k] or tokens[1000 - k]]
    assert all(hyp == max(0, len(tokens[k]) - n + 1) and ref == max(0, len(tokens[1000 - k]) - n + 1) for k, n, _, hyp, ref in got)


def test_ngrams_of_a_string_are_those_of_its_characters(spark):
    df = spark.createDataFrame([(1, "ab𝒳ab", "𝒳abé"), (2, "", "x")], "k int, h string, r string")
    apart = df.select("k", *[F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)).alias(c) for c in ("h", "r")])
    one, two = (sorted(metrics.matched_ngrams(d, ["k"], "h", "r", 1, 3).collect()) for d in (df, apart))
    assert one == two and one[0][2:] == (3, 5, 4)
