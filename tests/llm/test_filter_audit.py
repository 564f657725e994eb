from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.filter_audit import audit_cells, interaction_audit, swaps


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_swaps_visit_every_order_once_by_neighbours(k):
    seen = list(swaps(k))
    assert sorted(tuple(o) for o, _ in seen) == sorted(permutations(range(k)))
    for (a, _), (b, at) in zip(seen, seen[1:]):
        b = list(b)
        b[at], b[at + 1] = b[at + 1], b[at]
        assert a == b


def brute(masks, names):
    """Every order applied filter by filter to (mask, good, toxic) of each row."""
    out, total = [], dict.fromkeys(names, 0)
    for order in permutations(range(len(names))):
        left = list(masks)
        for step, f in enumerate(order):
            bad = [m for m in left if m[0] >> f & 1]
            left = [m for m in left if not m[0] >> f & 1]
            fails = sum(m[0] >> f & 1 for m in masks)
            total[names[f]] += len(bad)
            out.append(("".join(names[g] for g in order), step + 1, names[f], len(left), len(bad), fails - len(bad), sum(m[0] == 1 << f for m in masks), sum(m[1] for m in bad), sum(m[2] for m in bad)))
    return {(*r, total[r[2]]) for r in out}


FIELDS = ("filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("k", [1, 3, 5])
def test_cells_equal_filtering_one_by_one(k):
    rng = np.random.default_rng(k)
    masks = [(int(m), int(g), int(t)) for m, g, t in zip(rng.integers(0, 1 << k, 200), rng.integers(0, 2, 200), rng.integers(0, 2, 200))]
    cells = np.zeros((1 << k, 3), np.int64)
    for m, g, t in masks:
        cells[m] += (1, g, t)
    assert {tuple(r[f] for f in FIELDS) for r in audit_cells(cells, "ABCDE"[:k])} == brute(masks, "ABCDE"[:k])


def plain_mask(text, copy):
    ws = [w for w in text.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    tests = (len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * capitals > 10 * len(text), any(c in "#$%&*|" for c in text), copy)
    return sum(1 << k for k, x in enumerate(tests) if x)


def test_edges(spark, documents):
    many = " ".join(f"w{i}" for i in range(120))
    texts = [
        (1, many, "en"), (2, many, "en"), (3, many, None), (3, many, "en"), (1, many, "en"), (None, many, "fr"), (None, many, "fr"), (4, None, "fr"), (5, "", None),
        (6, "ABC # d", ""), (7, "a " * 4000, "en"), (8, many + " #", "fr"), (9, "É x " * 60, "fr"), (10, None, None),
    ]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (3, None, 1), (4, 1, 1), (99, 1, 1), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    got = interaction_audit(documents(texts, extra=True), labels).collect()
    good, toxic = {1, 4}, {3, 4, 8}
    first = {}
    for d, text, _ in texts:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    parts = {}
    for d, text, lang in texts:
        mask = plain_mask(text or "", d is not None and d > first[text or ""])
        parts.setdefault(lang or "", []).append((mask, int(d in good), int(d in toxic)))
    for part, masks in parts.items():
        assert {tuple(r[f] for f in FIELDS) for r in got if r["part"] == part} == brute(masks, "ABCDE")
    assert {r["part"] for r in got} == set(parts)
    assert interaction_audit(documents([]), labels).count() == 0


def test_own_filters(spark, documents):
    docs = documents([(1, "x", "a"), (2, "xx", "a"), (3, "xx", "b")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = interaction_audit(docs, labels, {"L": F.length("text") > 1}, copies=None).collect()
    assert {(r["part"], r["kept"], r["removed"], r["shapley"]) for r in got} == {("a", 1, 1, 1), ("b", 0, 1, 1)}
    with pytest.raises(ValueError):
        interaction_audit(docs, labels, {}, copies=None)
