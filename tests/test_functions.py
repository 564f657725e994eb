"""Functions and operators against plain code and worked examples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays, text
from textloom.operators import metrics, order
from textloom.streaming import events


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("out")).first()["out"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_worked_examples(spark):
    assert one(spark, text.char_ids(F.lit("abc"), "abc")) == [0, 1, 2]
    assert one(spark, arrays.pad_to(F.lit(31), 8)) == 32 and one(spark, arrays.pad_to(F.lit(32), 8)) == 32
    assert one(spark, text.project_answer(F.col("p"), F.col("o")), p="steve smith", o="Steve Smith's") == "Steve Smith"
    assert one(spark, text.normalise_answer(F.lit("The  quick, brown fox!"))) == "quick brown fox"
    assert one(spark, text.tokenise_13a(F.lit("It costs 3.50, or so."))) == "It costs 3.50 , or so ."
    assert one(spark, text.normalise_utterance(F.lit("Où est-il?  Ça va!"))) == "ou est il ? ca va !"
    assert one(spark, text.speak_numbers(F.lit("in the 21st hour $5 or 1,204.5"))) == "in the twenty first hour five dollars or one thousand two hundred four point five"
    assert one(spark, text.collapse(F.lit(" a \t b\n"))) == "a b"


def test_edit_distance_of_token_arrays(spark):
    draw = random.Random(1)
    rows = [([draw.choice("abc") for _ in range(draw.randrange(9))], [draw.choice("abc") for _ in range(draw.randrange(9))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[2] for r in df.select("a", "b", arrays.edit_distance("a", "b")).collect()] == [distance(a, b) for a, b in rows]
    rate = df.agg(metrics.word_error_rate(F.col("a"), F.col("b"))).first()[0]
    assert math.isclose(rate, sum(distance(a, b) for a, b in rows) / sum(len(b) for _, b in rows))
    empty = spark.createDataFrame([(["x"], [])], "a array<string>, b array<string>")
    assert empty.agg(metrics.word_error_rate(F.col("a"), F.col("b"))).first()[0] == math.inf


def test_array_shapes(spark):
    values = F.array(*[F.lit(float(x)) for x in (1, 3, 2)])
    assert one(spark, arrays.argmax(values)) == 1
    assert one(spark, arrays.best_places(values, 2)) == [1, 2]
    soft = one(spark, arrays.softmax(values))
    assert math.isclose(sum(soft), 1) and math.isclose(soft[1] / soft[0], math.e**2)
    assert one(spark, arrays.crop_or_pad(values, 6)) == [0, 1, 3, 2, 0, 0]
    assert one(spark, arrays.crop_or_pad(values, 2)) == [1, 3]
    assert one(spark, arrays.collapse_ctc(F.array(*map(F.lit, [1, 1, 0, 1, 2, 2])), 0)) == [1, 1, 2]
    assert one(spark, arrays.wrap(F.array(F.lit(5)), 0, 9)) == [0, 5, 9]
    assert one(spark, arrays.wrap(F.array(F.lit(5)), 0, 9, zero_is_none=True)) == [5, 9]


@pytest.mark.parametrize("limit", [3, 4, 7, 10])
def test_pair_truncation_is_that_of_popping(spark, limit):
    rows = [(a, b) for a in range(9) for b in range(9)]
    keep = arrays.pair_keep(F.col("a"), F.col("b"), limit)
    for r in spark.createDataFrame(rows, "a int, b int").select("a", "b", keep[0].alias("x"), keep[1].alias("y")).collect():
        a, b = r["a"], r["b"]
        while a + b > limit:
            a, b = (a - 1, b) if a > b else (a, b - 1)
        assert (r["x"], r["y"]) == (a, b)


def test_log_mel_shape(spark):
    signal = [math.sin(k / 5) for k in range(1600)]
    out = spark.createDataFrame([(signal,)], "s array<double>").select(arrays.log_mel("s")).first()[0]
    assert len(out) == 11 and all(len(row) == 64 for row in out)


def test_ranks_and_totals_in_two_levels(spark):
    keys = random.Random(2).sample(range(100_000), 3000)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long")
    found = {r["k"]: (r["before"], r["rank"]) for r in order.ranked(order.running_total(df, "k", F.col("v"), width=100), "k", width=1000).collect()}
    total = 0
    for place, k in enumerate(sorted(keys)):
        assert found[k] == (total, place)
        total += k % 7


def test_classification_scores(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(3), draw.randrange(3)) for _ in range(200)]
    report = {r["label"]: r for r in metrics.class_report(spark.createDataFrame(rows, "t int, p int"), "t", "p").collect()}
    for label in range(3):
        tp = sum(t == p == label for t, p in rows)
        assert math.isclose(report[label]["precision"], tp / sum(p == label for _, p in rows))
        assert math.isclose(report[label]["recall"], tp / sum(t == label for t, _ in rows))
    micro = metrics.f1_averages(spark.createDataFrame(rows, "t int, p int"), "t", "p").first()["micro"]
    assert math.isclose(micro, 100 * sum(t == p for t, p in rows) / len(rows))


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "view" if m % 2 else "buy", float(m)) for h in range(3) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").selectExpr("CAST(ts AS timestamp) ts", "event_type", "value")
    df.coalesce(1).write.json(f"{tmp_path}/in")
    stream = events.drop_folder(spark, f"{tmp_path}/in", "ts timestamp, event_type string, value double")
    query = events.hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", f"{tmp_path}/check").start()
    query.processAllAvailable()
    query.stop()
    want = sorted(tuple(r) for r in events.hourly(df).collect())
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM hours").collect()) == want
    query = events.refresh(stream, lambda b: b.groupBy("event_type").count(), f"{tmp_path}/out", f"{tmp_path}/check2").start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("count")).first()[0] == len(rows)


def test_runs_groups_and_places_of_empty_and_null_arrays(spark):
    d = spark.createDataFrame([(1, ["▁a", "b", "▁c"]), (2, []), (3, None)], "id int, p array<string>")
    got = {r["id"]: r for r in d.select(
        "id", arrays.whole_words("p", "▁").alias("g"), arrays.find_run("p", F.array(F.lit("b"), F.lit("▁c"))).alias("at"),
        arrays.scatter(F.size("p"), F.array(F.lit(2), F.lit(0), F.lit(1)), F.array(F.lit(9), F.lit(8), F.lit(7)), -1).alias("s"),
    ).collect()}
    assert (got[1]["g"], got[1]["at"], got[1]["s"]) == ([["▁a"], ["b", "▁c"]], 1, [-1, -1, 9])
    assert (got[2]["g"], got[2]["at"], got[2]["s"]) == ([], -1, [])
    assert (got[3]["g"], got[3]["at"]) == (None, -1)


def test_settings_that_do_not_parse_are_null(spark):
    d = spark.createDataFrame([("7",), ("x",), (" 2024-05-01 ",), (None,)], "v string")
    got = d.select(*[text.coerce(F.col("v"), k).alias(k) for k in ("int", "float", "decimal", "date")], text.coerce(F.col("v"), "int", F.lit(-1)).alias("d")).collect()
    assert [r["int"] for r in got] == [7, None, None, None] and [r["d"] for r in got] == [7, -1, -1, -1]
    assert [str(r["date"]) for r in got][2] == "2024-05-01"
    one = spark.range(1).select(text.coerce(F.lit("a=1,b=2"), "dict").alias("m"), text.coerce(F.lit("No"), "bool").alias("b"), text.coerce(F.lit("p, q"), "list").alias("l")).first()
    assert (one["m"], one["b"], one["l"]) == ({"a": "1", "b": "2"}, False, ["p", "q"])


def test_rank_shards_are_even_and_differ_by_epoch(spark):
    from textloom.operators.order import rank_shards

    d = spark.range(101).withColumnRenamed("id", "k")
    one, two = ({r["k"]: r["rank"] for r in rank_shards(d, "k", 4, epoch).collect()} for epoch in (0, 1))
    assert one != two
    for ranks in (one, two):
        sizes = [list(ranks.values()).count(k) for k in range(4)]
        assert sum(sizes) == 101 and max(sizes) - min(sizes) <= 1


def test_word_edges_beyond_ascii(spark):
    d = spark.createDataFrame([("a élan the the é.a",), ("Mr. émr. x",)], "t string")
    got = d.select(text.normalise_answer(F.col("t")).alias("a"), text.expand_abbreviations(F.col("t")).alias("e")).collect()
    assert got[0]["a"] == "élan éa"
    assert got[1]["e"] == "mister émr. x"


def test_abbreviations_side_by_side_go_in_their_order(spark):
    texts = ["co.ltd. xco.", "Ltd.CO.", "dr.dr.-st.", "_mr. é.mrs.\nMS.", "etc", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r["v"] for r in df.select("k", text.expand_abbreviations(F.col("t")).alias("v")).orderBy("k").collect()]
    assert got == ["companyltd. xco.", "limitedcompany", "doctordoctor-saint", "_mr. é.misess\nmiss", "etc", "", None]
    # One search for all of them: the others run over the runs that it finds.
    plan = df.select(text.expand_abbreviations(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(t#") == 0 and "rlike" not in plan.lower()


def test_a_word_is_drawn_once(spark):
    df = spark.createDataFrame([(7, ["a", None, "c"] * 40)], "k int, w array<string>")
    fates = df.select(arrays.mask_fates("w", F.col("k"), seed=7).alias("f"))
    assert fates._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 1
    assert set(fates.first()["f"]) >= {"masked", None} and len(fates.first()["f"]) == 120
