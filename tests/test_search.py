import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import decoding, generation, language


def exhaustive(frames, symbols, model, alpha, beta):
    """Every path, collapsed."""
    mass = {}
    for path in itertools.product(range(len(symbols) + 1), repeat=len(frames)):
        p = math.exp(sum(f[k] for f, k in zip(frames, path)))
        text = tuple(symbols[k] for k, _ in itertools.groupby(path) if k < len(symbols))
        mass[text] = mass.get(text, 0) + p
    out = []
    for text, p in mass.items():
        lm = sum(model.log(text[:k], text[k]) for k in range(len(text))) if model else 0.0
        out.append((text, math.log(p) + alpha * lm + beta * len(text)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def random_frames(rng, n, size):
    frames = []
    for _ in range(n):
        x = [rng.random() ** 3 + 1e-6 for _ in range(size)]
        frames.append([math.log(y / sum(x)) for y in x])
    return frames


@pytest.fixture(scope="module")
def small_model(spark):
    texts = spark.createDataFrame([(list("abcabcaab"),), (list("ab"),), ([],), (None,), (list("c"),)], "a array<string>")
    return language.backoff_model(language.ngram_counts(texts, "a", 3), 4, 3)


def test_model_sums_to_one(small_model):
    model = language.collected(small_model, 4, 3)
    for before in [(), ("a",), ("a", "b"), ("c", "c"), ("d",), ("b", "c", "a")]:
        total = sum(math.exp(model.log(before, s)) for s in "abcd")
        seen = {"a", "b", "c"}
        assert total == pytest.approx(1) and all(model.log(before, s) <= 0 for s in "abcd")
        assert model.log(before, "d") < min(model.log((), s) for s in seen)
    assert sum(math.exp(model.log((), s)) for s in "abcd") == pytest.approx(1)
    # counts by hand: a 5, b 4, c 3 of 12; after a: a once, b four times; the discount is a half
    first = (5 - 0.5) / 12 + 0.5 * 3 / 12 / 4
    assert math.exp(model.log((), "a")) == pytest.approx(first)
    assert math.exp(model.log(("a",), "a")) == pytest.approx(0.5 / 5 + 0.5 * 2 / 5 * first)
    assert math.exp(model.log(("a",), "c")) == pytest.approx(0.5 * 2 / 5 * ((3 - 0.5) / 12 + 0.5 * 3 / 12 / 4))


@pytest.mark.parametrize("seed", range(12))
def test_wide_search_equals_all_paths(small_model, seed):
    rng = random.Random(seed)
    model = language.collected(small_model, 4, 3) if seed % 2 else None
    frames = random_frames(rng, rng.randint(1, 6), 4)
    found = decoding.prefix_beam_search(frames, list("abc"), 10_000, model, 0.7, 0.2)
    expected = exhaustive(frames, "abc", model, 0.7, 0.2)
    assert [f[0] for f in found] == [e[0] for e in expected]
    assert [f[1] for f in found] == pytest.approx([e[1] for e in expected])


def test_a_narrow_search_keeps_its_width_and_repeats_need_a_blank():
    frames = [[math.log(x) for x in f] for f in ([0.9, 0.1], [0.1, 0.9], [0.9, 0.1])]
    assert decoding.prefix_beam_search(frames, ["a"], 1)[0][0] == ("a", "a")
    assert len(decoding.prefix_beam_search(frames, ["a"], 2)) == 2
    assert decoding.prefix_beam_search([], ["a"], 3) == [((), 0.0, 0.0, 0.0)]
    sure = [[0.0, -math.inf], [0.0, -math.inf]]
    assert decoding.prefix_beam_search(sure, ["a"], 5)[0][:2] == (("a",), 0.0)


def test_rows_of_frames(spark, small_model):
    model = language.collected(small_model, 4, 3)
    rng = random.Random(3)
    rows = [(k, random_frames(rng, k, 5), "x") for k in range(1, 9)] + [(20, [], "x"), (21, None, "x")]
    df = spark.createDataFrame(rows, "k long, frames array<array<double>>, text string")
    got = decoding.ctc_beam_search(df, "frames", list("abcd"), width=6, model=model, n_best=2, keys=("k",)).collect()
    for k, frames, _ in rows:
        expected = decoding.prefix_beam_search(frames or [], list("abcd"), 6, model, 0.5, 0.0)[:2]
        assert [(r["rank"], r["text"]) for r in sorted(got, key=lambda r: r["rank"]) if r["k"] == k] == [(n, "".join(e[0])) for n, e in enumerate(expected)]
    with pytest.raises(Exception, match="a frame has not"):
        decoding.ctc_beam_search(df, "frames", list("abc"), keys=("k",)).collect()
    with pytest.raises(ValueError, match="more than 2"):
        language.collected(small_model, 4, 3, most=2)


TEXTS = [(["a", "b", "c"],), (["a", "b", "d"],), (["b", "c"],), (["a", "c"],), ([],), (None,), (["d", "d", "a"],)]


@pytest.fixture(scope="module")
def chain(spark):
    return generation.transitions(spark.createDataFrame(TEXTS, "w array<string>"), "w", "</s>")


def table(chain):
    out = {}
    for r in chain.collect():
        out.setdefault(r["state"], []).append((-r["logp"], r["token"]))
    return {s: [(t, -p) for p, t in sorted(x)] for s, x in out.items()}


def test_transitions(chain):
    assert {t: round(math.exp(p), 6) for t, p in table(chain)["a"]} == {"b": 0.5, "c": 0.25, "</s>": 0.25}
    assert table(chain)["c"] == [("</s>", 0.0)]


def plain_beam(next_of, start, width, steps, penalty):
    length = lambda ts: 1 + sum(t != "</s>" for t in ts)
    beams = [([start], 0.0, False)]
    for _ in range(steps):
        new = []
        for tokens, p, done in beams:
            n = length(tokens)
            if done or tokens[-1] not in next_of:
                new.append((round(p / n**penalty, 9), tokens, p, True))
            else:
                new += [(round((p + q) / n**penalty, 9), [*tokens, t], p + q, t == "</s>") for t, q in next_of[tokens[-1]][:width]]
        beams = [x[1:] for x in sorted(new, key=lambda x: (-x[0], x[1]))[:width]]
    return min(beams, key=lambda b: (-round(b[1] / length(b[0]) ** penalty, 9), b[0]))[0]


@pytest.mark.parametrize(("width", "penalty", "broadcast"), [(1, 0.0, True), (3, 0.0, True), (3, 0.8, False), (2, 1.5, True)])
def test_beam_search_equals_a_plain_loop(spark, chain, monkeypatch, width, penalty, broadcast):
    if not broadcast:
        monkeypatch.setattr(generation, "BROADCAST_STATES", 0)
    prompts = spark.createDataFrame([(k, w) for k, w in enumerate(["a", "b", "c", "d", "nowhere"])], "k long, w string")
    got = {r["k"]: r["tokens"] for r in generation.beam_search(prompts, "k", "w", chain, width=width, steps=5, end="</s>", penalty=penalty).collect()}
    assert got == {k: plain_beam(table(chain), w, width, 5, penalty) for k, w in enumerate(["a", "b", "c", "d", "nowhere"])}


def test_width_one_is_greedy(spark, chain):
    prompts = spark.createDataFrame([(1, "a"), (2, "d")], "k long, w string")
    got = {r["k"]: r["tokens"] for r in generation.beam_search(prompts, "k", "w", chain, width=1, steps=4, end="</s>").collect()}
    for k, w in ((1, "a"), (2, "d")):
        tokens = [w]
        while tokens[-1] != "</s>" and len(tokens) < 5:
            tokens.append(table(chain)[tokens[-1]][0][0])
        assert got[k] == tokens


def test_sampling_repeats_by_seed_and_follows_the_shares(spark, chain):
    prompts = spark.range(4000).select(F.col("id").alias("k"), F.lit("a").alias("w"))
    draw = lambda **more: {r["k"]: tuple(r["tokens"]) for r in generation.sampled(prompts, "k", "w", chain, end="</s>", **more).collect()}
    once = draw(k=3, steps=1, seed=1)
    assert once == draw(k=3, steps=1, seed=1) and once != draw(k=3, steps=1, seed=2)
    share = sum(t[1] == "b" for t in once.values()) / 4000
    assert share == pytest.approx(0.5, abs=0.04)
    assert {t[1] for t in draw(k=1, steps=1, seed=1).values()} == {"b"}  # the likeliest alone
    cold = sum(t[1] == "b" for t in draw(k=3, steps=1, seed=1, temperature=0.25).values()) / 4000
    assert cold == pytest.approx(0.5**4 / (0.5**4 + 2 * 0.25**4), abs=0.04)
    assert all("</s>" not in t[:-1] for t in draw(k=3, steps=6, seed=1).values())
    assert generation.sampled(prompts.limit(0), "k", "w", chain, k=2, steps=2, end="</s>").count() == 0


@pytest.fixture(scope="module")
def pair_counts(spark):
    return generation.pair_counts(spark.createDataFrame(TEXTS, "w array<string>"), "w", "</s>")


@pytest.mark.parametrize("few", [True, False])
def test_sampling_from_counts_equals_that_from_transitions(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(generation, "BROADCAST_STATES", 0)
        monkeypatch.setattr(generation, "BROADCAST_KEYS", 0)
    # Of state x: counts on both sides of floors, ties across the third place; y has fewer tokens than are drawn from.
    counts = [("x", t, n) for t, n in zip("abcdefgh", (40, 9, 8, 8, 8, 3, 2, 1))] + [("y", "x", 5), ("y", "</s>", 1)] + [(t, "y", 2) for t in "abcdef"]
    pairs = spark.createDataFrame(counts, "state string, token string, n long")
    totals = pairs.groupBy("state").agg(F.sum("n").alias("total"))
    shares = pairs.join(totals, "state").select("state", "token", F.round(F.log(F.col("n") / F.col("total")), 9).alias("logp"))
    prompts = spark.range(300).select(F.col("id").alias("k"), F.element_at(F.array(*map(F.lit, ["x", "y", "nowhere", "</s>"])), (F.col("id") % 4 + 1).cast("int")).alias("w"))
    for k in (3, 10) if few else (3,):
        draw = lambda table: sorted(map(tuple, generation.sampled(prompts, "k", "w", table, k=k, steps=6, end="</s>", seed=5).collect()))  # noqa: B023, E731
        assert draw(pairs) == draw(shares)


def test_only_states_that_the_prompts_reach_are_ranked(spark, pair_counts, monkeypatch):
    ranked, plain = [], generation.likeliest

    def spied(table, k):
        ranked.append(sorted(r[0] for r in table.select("state").distinct().collect()))
        return plain(table, k)

    monkeypatch.setattr(generation, "likeliest", spied)
    prompts = spark.createDataFrame([(1, "b"), (2, "b"), (3, "c")], "k long, w string")
    got = generation.sampled(prompts, "k", "w", pair_counts, k=2, steps=5, end="</s>", seed=1).collect()
    assert len(got) == 3 and all(r["tokens"][-1] in ("</s>", "d", "a", "b", "c") for r in got)
    # Each state once, when it is first met; all states were ranked before, at the start.
    assert ranked[0] == ["b", "c"] and len(sum(ranked, [])) == len(set(sum(ranked, [])))
    assert generation.sampled(prompts.limit(0), "k", "w", pair_counts, k=2, steps=2, end="</s>").count() == 0


@pytest.mark.parametrize(("width", "penalty"), [(1, 0.0), (2, 1.5)])
def test_beam_search_from_counts_equals_a_plain_loop(spark, chain, pair_counts, width, penalty):
    starts = ["a", "b", "c", "d", "nowhere"]
    prompts = spark.createDataFrame(list(enumerate(starts)), "k long, w string")
    got = {r["k"]: r["tokens"] for r in generation.beam_search(prompts, "k", "w", pair_counts, width=width, steps=4, end="</s>", penalty=penalty).collect()}
    assert got == {k: plain_beam(table(chain), w, width, 4, penalty) for k, w in enumerate(starts)}
