"""Labels of pieces, readout, truncation, signal cuts and the Moses-like words, on small cases."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import labels
from textloom.functions.moses import tokenise_moses
from textloom.operators import examples


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It's 5,300, well-known... (ok). Mr. X", r"It \ \&apos;s 5,300 , well @-@ known ... ( ok ) . Mr . X"),
        ("a-b-c", "a @-@ b @-@ c"),
        ("end...", "end ..."),
        ("the end.", "the end ."),
        ("  R&D <x> [y] |  ", "R &amp; D &lt; x &gt; &#91; y &#93; &#124;"),
        ("", ""),
        (None, None),
    ],
)
def test_moses_words(spark, text, want):
    assert one(spark, tokenise_moses(F.lit(text).cast("string"))) == [want]


def test_long_rows_keep_the_start_mark_and_their_end(spark):
    pieces = F.array(F.array(F.lit("ab"), F.lit("c")), F.array(F.lit("d")))
    rows = labels.piece_rows(pieces, F.lit(4))
    slots = labels.piece_labels(pieces, F.array(F.lit(7), F.lit(8)), F.lit(4), F.lit(128))
    assert one(spark, rows["tokens"], rows["first_mask"], slots) == [["[CLS]", "c", "d", "[SEP]"], [0, 0, 1, 0], [128, 7, 8, 128]]
    rows = labels.piece_rows(pieces, F.lit(6), ends=False)
    assert one(spark, rows["loss_mask"], rows["input_mask"]) == [[0, 1, 1, 1, 0, 0], [1, 1, 1, 1, 1, 0]]


def test_readout_of_another_length_is_an_error(spark):
    words, predicted = F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1), F.lit(2))
    right = labels.first_piece_readout(words, predicted, F.array(F.lit(1), F.lit(1)))
    assert [tuple(r) for r in one(spark, right)[0]] == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="differ in number"):
        one(spark, labels.first_piece_readout(words, predicted, F.array(F.lit(1), F.lit(0))))


def test_signal_shifts_and_parts(spark):
    v = F.array(*[F.lit(float(k)) for k in range(1, 5)])
    assert one(spark, labels.shift_signal(v, F.lit(1)), labels.shift_signal(v, F.lit(-1)), labels.shift_signal(v, F.lit(9))) == [
        [2.0, 3.0, 4.0, 0.0], [0.0, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0],
    ]
    assert one(spark, labels.signal_part(v, 2, F.lit(0.5), F.lit(0.0)), labels.signal_part(v, 2, F.lit(0.0), F.lit(1.0))) == [[2.0, 3.0, 4.0], [1.0, 2.0]]


def test_truncation_reaches_the_limit(spark):
    a, b = F.sequence(F.lit(1), F.lit(9)), F.sequence(F.lit(1), F.lit(3))
    x, y = one(spark, *labels.truncate_at_random_ends(a, b, 8, F.lit("k")))
    assert len(x) == 5 and y == [1, 2, 3] and x == list(range(x[0], x[0] + 5))


@pytest.mark.parametrize(("n", "want"), [(2, [("a", 1), ("a", 2), ("b", 1)]), (4, [("a", 1), ("a", 2), ("a", 3), ("b", 1)]), (9, None)])
def test_cap_ends_one_file_only(spark, n, want):
    rows = [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    got = examples.capped_files(spark.createDataFrame(rows, "file string, line int"), "file", "line", n)
    assert sorted(map(tuple, got.collect())) == (want or rows)


def test_empty_tables(spark):
    features = spark.createDataFrame([], "unique_id long, example long, feature int")
    outputs = spark.createDataFrame([], "unique_id long, position int, start array<double>, end array<double>")
    assert examples.null_answers(features, outputs).count() == 0
    assert examples.capped_files(spark.createDataFrame([], "file string, line int"), "file", "line", 3).count() == 0
    turns = spark.createDataFrame([], "b long, k long, c array<int>, r array<array<int>>")
    assert examples.dialogue_batches(turns, "b", "k", "c", "r", 0).count() == 0
