import random

import pytest

from textloom.operators import batching


def plain(pairs, budget):
    """The pass pair by pair: (key, source, target) -> list of batches of keys."""
    rest = {}
    for key, s, t in sorted(pairs, key=lambda p: (p[1], p[2], p[0])):
        rest.setdefault(s, []).append((t, key))
    done, now, lengths = [], [], {k: (s, t) for k, s, t in pairs}
    widest = lambda keys: (max((lengths[k][0] for k in keys), default=0), max((lengths[k][1] for k in keys), default=0))
    order = sorted(rest)
    for at, s in enumerate(order):
        while rest[s]:
            ws, wt = widest(now)
            own = max(ws, s) + max(wt, rest[s][0][0])
            nxt = order[at + 1] if at + 1 < len(order) and rest[order[at + 1]] else None
            use = s if nxt is None or own <= max(ws, nxt) + max(wt, rest[nxt][0][0]) else nxt
            now.append(rest[use].pop(0)[1])
            if len(now) * sum(widest(now)) > budget:
                n = 8 * ((len(now) - 1) // 8) or len(now)
                done.append(now[:n])
                now = now[n:]
    return done + [now] * bool(now)


def runs(pairs, budget):
    counts = {}
    for _, s, t in pairs:
        counts[s, t] = counts.get((s, t), 0) + 1
    return batching._pass(sorted((*c, n) for c, n in counts.items()), budget)


@pytest.mark.parametrize("seed", range(300))
def test_pass_over_counts_equals_pass_over_pairs(seed):
    rng = random.Random(seed)
    high, n = rng.choice([2, 4, 9, 30]), rng.choice([1, 7, 40, 300])
    hot = (rng.randint(0, high), rng.randint(0, high))
    pairs = [(k, *(hot if rng.random() < 0.4 else (rng.randint(0, high), rng.randint(0, high)))) for k in range(n)]
    budget = rng.choice([1, 10, 40, 150, 600])
    found, place = [None] * n, {}
    for s, t, rank, stop, shift, first, size, batch in batching._ranges(runs(pairs, budget)):
        for r in range(rank, stop):
            place[s, t, r] = batch + (r + shift - first) // size
    ranks = {}
    for key, s, t in sorted(pairs):
        r = ranks[s, t] = ranks.get((s, t), -1) + 1
        found[key] = place[s, t, r]
    assert len(place) == n
    expected = [None] * n
    for b, keys in enumerate(plain(pairs, budget)):
        for k in keys:
            expected[k] = b
    assert found == expected


def test_many_pairs_of_one_length_are_a_few_ranges():
    walk = batching._pass([(5, 5, 10**9), (5, 6, 3), (6, 2, 10**9)], 1000)
    assert len(walk.runs) < 20 and len(walk.spans) < 20 and walk.taken == 2 * 10**9 + 3


def test_batches_of_a_table(spark):
    rng = random.Random(1)
    pairs = [(k * 7 % 1009, *((4, 4) if rng.random() < 0.5 else (rng.randint(1, 12), rng.randint(1, 12)))) for k in range(1009)]
    df = spark.createDataFrame([(*p, "x") for p in pairs], "key long, s int, t int, batches string").repartition(5)
    got = batching.greedy_batches(df, "key", "s", "t", 256)
    assert got.columns == ["key", "s", "t", "batches", "batch"]
    expected = {k: b for b, keys in enumerate(plain(pairs, 256)) for k in keys}
    assert {r["key"]: r["batch"] for r in got.collect()} == expected
    assert batching.greedy_batches(df.limit(0), "key", "s", "t", 256).count() == 0


def test_too_many_lengths_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(batching, "MOST_CELLS", 3)
    df = spark.createDataFrame([(k, k, 1) for k in range(4)], "key long, s int, t int")
    with pytest.raises(ValueError, match="pairs of lengths"):
        batching.greedy_batches(df, "key", "s", "t", 10)
