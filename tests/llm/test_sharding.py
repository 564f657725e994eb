"""Histogram sort: exact splitters against a sorted list, and the laws of the shards."""

import random
import zlib

from textloom.llm.sharding import shard_documents, splitters, write_shards


def corpus():
    draw = random.Random(2)
    rows = [(k, "x" * draw.choice([0, 1, 10, 100, 3000]) + str(draw.randrange(50))) for k in range(900)]
    rows += [(10_000 + k, "the same text") for k in range(500)]
    return [*rows, (20_000, None), (20_001, ""), (-5, "negative"), (20_002, "ü" * 40_000), (None, "a"), (None, None), (7, "x"), (7, "x")]


def test_shards_are_even_gapless_and_whole(documents):
    rows = corpus()
    found = shard_documents(documents(rows, extra=True), shards=40).collect()
    assert len(found) == len(rows)
    want = sorted((-1 if k is None else k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    slots = {}
    weight = [0] * 40
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
        weight[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in found)
    assert all(w <= sum(weight) / 40 + largest for w in weight)


def test_splitters_are_exact(spark):
    draw = random.Random(4)
    rows = [(draw.choice([5, 5, 7, draw.randrange(1 << 60)]), draw.randrange(-(1 << 63), 1 << 63), draw.randrange(1, 1000)) for _ in range(600)]
    found = splitters(spark.createDataFrame(rows, "k1 long, k2 long, size long"), 7)
    total, before, shard_of = sum(r[2] for r in rows), 0, {}
    for r in sorted(rows):
        shard_of[r] = 7 * before // total
        before += r[2]
    for r in rows:
        assert sum((r[0], r[1]) >= cut for cut in found) == shard_of[r]
    assert splitters(spark.createDataFrame([], "k1 long, k2 long, size long"), 7) == []


def test_written_folders_hold_every_row(spark, documents, tmp_path):
    df = documents([(k, "t" * (k % 90)) for k in range(300)])
    write_shards(df, f"{tmp_path}/out", shards=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 300 and {r["shard"] for r in back.select("shard").distinct().collect()} == set(range(5))


def test_empty_table(documents):
    assert shard_documents(documents([])).count() == 0
