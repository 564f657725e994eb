import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import prefix_trie as trie
from textloom.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def order(turn, role, text):
    role, text = role or "", text or ""
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())


def brute(rows, splice=False):
    """Nodes by whole sequences of turns, member by member."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], order(*r[1:]))):
        own.setdefault(c, []).append((role or "", text or ""))
    convs = own
    if splice:
        convs = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            convs[c] = own.get(c - int(c - 20 * int(c / 20)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].translate(dict.fromkeys(range(9, 14), " ")).replace("\t", " ").split()) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def found(df):
    return [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


ROWS = [
    (1, 0, "u", "hello  there"), (1, 1, "a", "one two three"), (1, 2, "u", "bye"), (2, 0, "u", "hello  there"), (2, 1, "a", "one two three"), (3, 5, "u", "hello  there"),
    (4, None, "u", None), (4, 0, None, "x"), (4, 0, "a", "x"), (5, 0, "u", ""), (6, 0, "u", "hello  there"), (6, 1, "a", "one two three"), (6, 2, "u", "bye"), (None, 0, "u", "lost"),
    (20, 0, "u", "alone"), (20, 1, "u", "alone"), (20, 1, "u", "alone"), (-7, 0, "u", "below zero"), (21, 0, "u", "words\tand\nlines"), (25, 0, "u", "é ü"), (40, 3, "u", "z"), (44, 3, "u", "z"),
]


@pytest.mark.parametrize("splice", [False, True])
def test_nodes_equal_brute_force(spark, splice):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' AS node", "'y' AS depth", "'z' AS rank")
    rule = (lambda c: c - c % 20, lambda c: F.crc32(c.cast("string").cast("binary")) % 4, 3) if splice else None
    got = found(trie.conversation_trie(df, rule))
    assert len(got) == len(set(got))
    assert set(got) == brute(ROWS, splice)


def test_one_none_and_deep(spark):
    assert found(trie.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    one = [(7, k, "u", f"t {k}") for k in range(5)]
    assert set(found(trie.conversation_trie(spark.createDataFrame(one, SCHEMA)))) == brute(one)
    deep = [(c, k, "u", f"w{k} w") for c in (1, 2, 3) for k in range(12 if c < 3 else 7)]
    assert set(found(trie.conversation_trie(spark.createDataFrame(deep, SCHEMA)))) == brute(deep)


def test_many_members_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    rows = [(c, k, "u", f"t{k if c % 3 else c}") for c in range(-40, 400, 3) for k in range(c % 4)]
    assert set(found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


def test_registered_query_has_one_row_a_node(spark):
    got = op13_prefix_trie(spark, "/root/testdata/sf0.001")
    assert got.count() == got.select("conv_id", "depth").distinct().count() > 0
