"""Decontamination: alignment against a plain table, planted copies and clean documents."""

import random

import numpy as np

from textloom.llm import decontaminate as module
from textloom.llm.decontaminate import GAP, MATCH, MISMATCH, Items, benchmark_matches, decontaminate, local_alignment


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(max(0, row[k] + (MATCH if x == y else MISMATCH), row[k + 1] + GAP, new[k] + GAP))
        row, best = new, max(best, *new)
    return best


def test_alignment_is_that_of_the_plain_table():
    draw = random.Random(3)
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randrange(1, 30))] for _ in range(2))
        assert local_alignment(np.array(a, np.uint64), np.array(b, np.uint64)) == plain_alignment(a, b)


def corpus():
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(2, 9))) for _ in range(3000)]

    def prose(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    items = [(k, prose(draw.randrange(25, 60))) for k in range(20)]
    docs, want = [], {}
    for k in range(150):
        docs.append([k, prose(draw.choice([5, 100, 600]))])
    for k, (item, words) in enumerate(items):
        copy = list(words)
        if k % 3 == 1:  # edited: each sixth word replaced
            for j in range(0, len(copy), 6):
                copy[j] = draw.choice(vocabulary)
        if k % 3 == 2:  # words added and left out
            copy = [w for j, w in enumerate(copy) if j % 9 != 4]
            copy[len(copy) // 2 : len(copy) // 2] = prose(3)
        text = prose(200) + copy + prose(200)
        docs.append([1000 + k, [w.upper() if k % 2 else w for w in text]])
        want[1000 + k] = item
    docs = [(k, " ".join(words)) for k, words in docs]
    docs += [(5000, None), (5001, ""), (5002, " ".join(prose(40_000) + items[0][1]))]
    want[5002] = 0
    return docs, [(k, ", ".join(words) + ".") for k, words in items], want


def test_copies_are_found_and_clean_documents_left(spark, documents):
    docs, items, want = corpus()
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (92, "a b")], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate(documents(docs, extra=True), benchmark).collect()}
    assert len(found) == len(docs)
    assert {k: r["item_id"] for k, r in found.items() if not r["kept"]} == want
    assert all(r["score"] == 0 and r["n_items"] == 0 for r in found.values() if r["kept"])


def test_a_seed_that_many_documents_share_is_still_found(spark, documents):
    docs, items, _ = corpus()
    copies = [(k, f"doc {k} says " + items[3][1]) for k in range(300)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = benchmark_matches(documents(copies), benchmark).collect()
    assert len(found) == 300 and all(r["item_id"] == 3 and r["score"] > 0.9 for r in found)


def test_edges(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two three four five six seven")] * 2, "item_id long, text string")
    docs = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "one two three four five six seven"), (2, None)]
    assert decontaminate(documents([]), some).count() == 0
    assert all(r["kept"] for r in decontaminate(documents(docs), none).collect())
    found = decontaminate(documents(docs), some).collect()
    assert len(found) == 4 and sorted((r["doc_id"] or 0, r["kept"]) for r in found) == [(0, False), (1, False), (1, False), (2, True)]


def test_every_pair_that_reaches_the_score_is_found(spark, documents):
    draw = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, [draw.choice(vocabulary) for _ in range(draw.choice([4, 5, 9, 30, 50]))]) for k in range(12)]
    docs = []
    for k in range(240):
        words = list(items[k % 12][1])
        edit = k // 12 % 6
        if edit == 1:  # every fourth word replaced
            words[3::4] = [draw.choice(vocabulary) for _ in words[3::4]]
        if edit == 2:  # every third
            words[2::3] = [draw.choice(vocabulary) for _ in words[2::3]]
        if edit == 3:  # a word between any two
            words = [w for word in words for w in (word, draw.choice(vocabulary))]
        if edit == 4:  # one short run is left
            words = words[: len(words) // 2 + 1]
        if edit == 5:
            words = [w for w in words if draw.random() < 0.7]
        around = [[draw.choice(vocabulary) for _ in range(draw.randrange(60))] for _ in range(2)]
        docs.append((k, around[0] + words + around[1]))
    want = {}
    for k, words in docs:
        for item, own in items:
            score = plain_alignment(own, words) / (MATCH * len(own))
            if score >= 0.45:
                want[k, item] = score
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = benchmark_matches(documents([(k, " ".join(w)) for k, w in docs]), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found} == want


def test_short_items_in_many_documents(spark, documents):
    items = [(1, "purple lanterns sing tonight"), (2, "never trust a sleepy otter"), (3, "which of these rivers runs north")]
    docs = [(3 * k + j, f"doc {k} begins here {text.upper() if k % 2 else text} and it goes on {k}") for k in range(700) for j, (_, text) in enumerate(items)]
    found = benchmark_matches(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(3 * k + j, j + 1) for k in range(700) for j in range(3)}


def test_edited_copies(spark, documents):
    """Copies with a tenth and a fifth of the words replaced are found, of those with three tenths all that
    reach the least score (about three quarters do)."""
    draw = random.Random(4)
    vocabulary = [f"v{k}" for k in range(5000)]
    items = [(k, [draw.choice(vocabulary) for _ in range(draw.randrange(12, 60))]) for k in range(60)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    docs, by_share, want = [], {}, set()
    for k, words in items:
        for j, share in enumerate((0.1, 0.2, 0.3)):
            copy = [draw.choice(vocabulary) if draw.random() < share else w for w in words]
            around = [[draw.choice(vocabulary) for _ in range(80)] for _ in range(2)]
            docs.append((10 * k + j, " ".join(around[0] + copy + around[1])))
            by_share.setdefault(share, set()).add(10 * k + j)
            if plain_alignment(words, docs[-1][1].split()) >= 0.45 * MATCH * len(words):
                want.add(10 * k + j)
    found = {r["doc_id"] for r in benchmark_matches(documents(docs), benchmark).collect()}
    assert found == want
    assert [len(found & own) / len(own) >= least for own, least in zip(by_share.values(), (1, 0.9, 0.7), strict=True)] == [True] * 3


def test_a_phrase_of_many_items_aligns_with_short_ones_alone(monkeypatch):
    draw = random.Random(5)
    phrase = "which of the following statements is".split()
    rows = [(k, " ".join(phrase + [f"x{draw.randrange(10**6)}" for _ in range(30)])) for k in range(300)]
    items, calls = Items(rows), []
    monkeypatch.setattr(module, "local_alignment", lambda a, b: calls.append(1) or local_alignment(a, b))
    words = module.WordHasher(plain=True).words(" ".join(["y"] * 50 + phrase + ["z"] * 50).encode())
    assert not [s for _, item, at, covered in items.sharing(words, np.zeros(len(words), np.int64)) if (s := items.score(item, words, at, covered))]
    assert not calls


def test_rare_seeds_lose_no_pair():
    """Common words, insertions, swaps and cuts: every pair that reaches the score is a candidate."""
    draw = random.Random(21)
    weights = [1 / (k + 1) for k in range(300)]
    prose = lambda n: [f"w{k}" for k in draw.choices(range(300), weights, k=n)]
    rows = [(k, prose(draw.choice([4, 6, 12, 25, 40, 60]))) for k in range(150)]
    items = Items([(k, " ".join(w)) for k, w in rows])
    assert sum(len(items.all_seeds[a:b]) for a, b in zip(items.bounds, items.bounds[1:])) > 1.1 * len(items.place)  # some are left out
    hasher, reached = module.WordHasher(plain=True), 0
    for k in range(60):
        words = []
        for w in rows[draw.randrange(150)][1]:
            roll = draw.random()
            words += [] if roll < 0.1 else [w, *prose(1)] if roll < 0.3 else prose(1) if roll < 0.4 else [w]
        text = prose(draw.randrange(80)) + words + prose(draw.randrange(80))
        own = hasher.words(" ".join(text).encode())
        found = {(item, items.score(item, own, at, covered)) for _, item, at, covered in items.sharing(own, np.zeros(len(own), np.int64))}
        found = {(item, score) for item, score in found if score}
        want = {(i, s) for i, (_, w) in enumerate(rows) if (s := plain_alignment(w, text) / (MATCH * len(w))) >= 0.45}
        assert found == want
        reached += len(want)
    assert reached > 60


def test_items_of_few_words_are_copied_by_whole_documents(spark, documents):
    items = spark.createDataFrame([(1, "Yes."), (2, "to be"), (3, "to be or"), (4, "yes"), (5, "...")], "item_id long, text string")
    docs = [(1, "yes"), (2, "YES!"), (3, "oh yes"), (4, "To be, or"), (5, "be to"), (6, "..."), (7, None)]
    found = {(r["doc_id"], r["item_id"], r["score"]) for r in benchmark_matches(documents(docs), items).collect()}
    assert found == {(1, 1, 1.0), (1, 4, 1.0), (2, 1, 1.0), (2, 4, 1.0), (4, 3, 1.0)}


def test_several_blocks_of_items(spark, documents, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_CHARS", 500)
    docs, items, want = corpus()
    found = decontaminate(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item_id"] for r in found if not r["kept"]} == want
