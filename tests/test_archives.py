import os
import random
import struct
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import cache
from textloom.sources import line_index, matrices


def test_matrices_round_trip_over_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matrices, "_ROWS", 3)
    rng = random.Random(1)
    rows = [(k, [[rng.random() for _ in range(k % 4 + 1)] for _ in range(k % 5)]) for k in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "k long, m array<array<double>>").repartition(3)
    index = matrices.write_matrices(df, "k", "m", str(tmp_path / "a"), double=True).persist()
    assert index.count() == 40 and index.select("file").distinct().count() == 3
    matrices.write_index(index, str(tmp_path / "feats"))
    got = {int(r["id"]): r["features"] for r in matrices.read_matrices(matrices.matrix_index(spark, str(tmp_path / "feats")), tasks=5).collect()}
    assert got == {k: m for k, m in rows if m is not None}
    some = matrices.matrix_index(spark, str(tmp_path / "feats")).filter("id in ('7', '13')")
    assert {r["id"] for r in matrices.read_matrices(some).collect()} == {"7", "13"}
    with pytest.raises(Exception, match="unlike length|inhomogeneous"):
        matrices.write_matrices(spark.createDataFrame([(1, [[1.0], [1.0, 2.0]])], "k long, m array<array<double>>"), "k", "m", str(tmp_path / "b")).collect()


def test_packed_matrices(tmp_path):
    def at(data: bytes):
        (tmp_path / "x").write_bytes(b"id " + data)
        return matrices.read_matrix(pa.OSFile(str(tmp_path / "x")), 3)

    head = struct.pack("<ffii", -1.0, 2.0, 2, 3)
    assert at(b"\0BCM3 " + head + bytes([0, 51, 102, 153, 204, 255])) == pytest.approx(np.array([[-1, -0.6, -0.2], [0.2, 0.6, 1]]), abs=1e-6)
    assert at(b"\0BCM2 " + head + struct.pack("<6H", 0, 13107, 26214, 39321, 52428, 65535)) == pytest.approx(np.array([[-1, -0.6, -0.2], [0.2, 0.6, 1]]), abs=1e-6)
    marks = struct.pack("<12H", *[0, 16384, 49151, 65535] * 3)
    out = at(b"\0BCM " + head + marks + bytes([0, 64, 128, 192, 255, 32]))
    assert out == pytest.approx(np.array([[-1, 0, 1], [-0.5, 0.5, -0.75]]), abs=1e-3)
    for bad in (b"text", b"\0BXX " + head, b"\0BFM " + struct.pack("<bibi", 4, 2, 4, 2) + bytes(8)):
        with pytest.raises(ValueError):
            at(bad)


def test_lines_of_a_file_in_many_blocks(spark, tmp_path):
    rng = random.Random(2)
    lines = ["".join(rng.choice("aé漢 😀") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    ends = [rng.choice([b"\n", b"\r\n"]) for _ in lines]
    data = b"".join(x.encode() + e for x, e in zip(lines, ends)) + "no end é".encode()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "big.txt").write_bytes(data)
    (tmp_path / "sub" / "empty.txt").write_bytes(b"")
    (tmp_path / "sub" / "other.csv").write_bytes(b"not a text\n")
    index = line_index.line_index(spark, str(tmp_path), blank=True, block=997)
    rows = sorted(tuple(r) for r in index.select("line_no", "offset", "n_bytes").collect())
    expected, at = [], 0
    for k, (x, e) in enumerate(zip([*lines, "no end é"], [*ends, b""])):
        expected.append((k, at, len(x.encode())))
        at += len(x.encode()) + len(e)
    assert rows == expected
    got = {r["line_no"]: r["line"] for r in line_index.lines_at(index, tasks=3).collect()}
    assert got == dict(enumerate([*lines, "no end é"]))
    some = line_index.lines_at(index.filter("line_no % 50 = 7")).collect()
    assert all(r["line"] == lines[r["line_no"]] for r in some) and len(some) == 8
    full = {r["line_no"] for r in line_index.line_index(spark, str(tmp_path)).collect()}
    assert full == {k for k, x in enumerate([*lines, "no end é"]) if x.strip()}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "997"


def test_only_what_changed_is_built_again(spark, tmp_path):
    texts, store = tmp_path / "in", str(tmp_path / "cache")
    texts.mkdir()
    for k in range(3):
        (texts / f"a b+{k}.txt").write_text(f"one {k}\ntwo\n")
    build = lambda lines: lines.groupBy("file").agg(F.count("*").alias("n"))

    def run(settings=None):
        found, n = cache.cached_features(spark, str(texts), settings or {"v": 1}, build, store)
        return sorted((os.path.basename(r["file"]), r["n"]) for r in found.collect()), n

    every = [(f"a b+{k}.txt", 2) for k in range(3)]
    assert run() == (every, 3) and run() == (every, 0)
    time.sleep(0.02)
    (texts / "a b+1.txt").write_text("one\ntwo\nthree\n")
    assert run() == ([every[0], ("a b+1.txt", 3), every[2]], 1)
    assert run({"v": 2})[1] == 3 and run({"v": 2})[1] == 0 and run()[1] == 0
    os.remove(texts / "a b+0.txt")
    assert run() == ([("a b+1.txt", 3), every[2]], 0)
    for part in Path(store, "index").glob("*"):  # as if the driver was lost before the index was written
        part.unlink()
    assert run() == ([("a b+1.txt", 3), every[2]], 2)


def test_epochs_have_orders_of_their_own(spark):
    df = spark.createDataFrame([(k, k % 4) for k in range(40)], "k long, s int")
    orders = [sorted((r["turn"], r["place"], r["k"]) for r in cache.epoch_order(df, "s", "k", epoch).collect()) for epoch in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2]
    for order in orders:
        assert [x[:2] for x in order] == [(s, p) for s in range(4) for p in range(10)]


def test_a_task_reads_many_small_blocks(spark, tmp_path, monkeypatch):
    lines = [f"line {k}" if k % 7 else " \t " for k in range(4000)]
    (tmp_path / "a.txt").write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    seen, keep = [], line_index.kept
    monkeypatch.setattr(line_index, "kept", lambda df, name: seen.append(df.rdd.getNumPartitions()) or keep(df, name))
    found = line_index.line_index(spark, str(tmp_path), block=300)
    assert {r["line_no"] for r in found.collect()} == {k for k in range(4000) if k % 7}
    assert seen == [line_index._tasks(spark)] and (tmp_path / "a.txt").stat().st_size // 300 > 2 * seen[0]
