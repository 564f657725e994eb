"""The corpus pipeline, stage by stage, against plain code on a small corpus."""

import random
import re

import pytest

import corpus_pipeline
from textloom.llm.packing import _encoder, default_vocabulary

from test_near_dedup import brute as near_brute
from test_quality_rules import brute as rules_brute


@pytest.fixture(scope="module")
def corpus(spark, documents, tmp_path_factory):
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(3, 10))) for _ in range(2000)]

    def prose(n):
        return " ".join(draw.choice(["the", "of", "and", *draw.sample(vocabulary, 6)]) for _ in range(n))

    items = [(k, prose(40)) for k in range(5)]
    rows = [(k, prose(draw.choice([15, 90, 300])), draw.choice(["en", "de", None])) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " end", "en") for k in range(0, 60, 7)]
    rows += [(200 + k, rows[3][1], "en") for k in range(30)]
    rows += [(300 + k, f"{prose(50)} {text} {prose(50)}", "en") for k, text in items]
    rows += [(400, f"{prose(30)} write to joe@x.org or +49 30 1234567", "en"), (401, None, None), (402, "short", "en"), (403, "a b c d e f g " * 40, "en"), (None, prose(20), "en"), (404, prose(8000), "en")]
    folder = str(tmp_path_factory.mktemp("tables"))
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, folder


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def keyed(keys):
    return sorted((k is None, k or 0) for k in keys)


def test_stages(spark, corpus):
    rows, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {k: t for k, t, _ in rows}

    first = corpus_pipeline.quality(spark, docs, folder)
    kept = [k for k, t, _ in rows if not rules_brute(t)[-1]]
    assert first.columns == docs.columns and ids(first) == keyed(kept)

    second = corpus_pipeline.deduplicate(spark, first, folder)
    groups = near_brute([(k, texts[k]) for k in kept if k is not None], 5)
    kept = [k for k in kept if k is None or groups[k][2]]
    assert second.columns == docs.columns and ids(second) == keyed(kept)

    third = corpus_pipeline.decontaminate(spark, second, folder)
    kept = [k for k in kept if k is None or not 300 <= k < 305]
    assert third.columns == docs.columns and ids(third) == keyed(kept)

    fourth = corpus_pipeline.personal_data(spark, third, folder)
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in fourth.collect()}
    assert fourth.columns == docs.columns and set(clean) == set(kept)
    for k in kept:
        want = re.sub(r"\+49 30 1234567", "[PHONE]", re.sub(r"joe@x\.org", "[EMAIL]", texts[k]))
        assert clean[k] == (want, len(want))

    fifth = corpus_pipeline.pack(spark, fourth, folder).collect()
    encode = _encoder(*default_vocabulary())
    for k in kept:
        assert sum(r["length"] for r in fifth if r["doc_id"] == k) == len(encode(clean[k][0])) + 1


def test_run_is_its_stages(spark, corpus):
    rows, folder = corpus
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset"} <= set(found.columns)
    assert 401 not in {r["doc_id"] for r in found.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]


def test_stages_take_an_empty_table(spark, documents, corpus):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus[1]).count() == 0


def test_further_columns_and_repeated_rows_stay(spark, documents, corpus):
    docs = documents([(1, corpus[0][0][1], "en"), (1, corpus[0][0][1], "en"), (2, corpus[0][1][1], "en")], extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus[1])
        assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} == {1, 2}


def test_unlike_texts_of_one_id_stay(spark, documents, corpus):
    texts = [t for _, t, _ in corpus[0][:4]]
    rows = [(5, texts[0], "en"), (5, texts[1], "de"), (5, texts[0] + " end", "en"), (9, texts[1] + " end", "en"), (3, texts[2], "en"), (3, texts[2], "en"), (None, texts[3], "en"), (None, texts[3], "en"), (7, " ", "en")]
    out = corpus_pipeline.deduplicate(spark, documents(rows), corpus[1]).collect()
    left = [(r["doc_id"], r["text"]) for r in out]
    assert sorted(k or 0 for k, _ in left) == [0, 0, 3, 5, 5, 7]
    assert (5, texts[1]) in left and (3, texts[2]) in left and len({t for k, t in left if k == 5} & {texts[0], texts[0] + " end"}) == 1
