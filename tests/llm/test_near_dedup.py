"""Near-duplicates against all pairs of full shingle sets."""

import random
import re

import pytest

from textloom.llm.components import components
from textloom.llm.common import Shelf
from textloom.llm.near_dedup import near_duplicates


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def brute(rows, n, percent=80):
    sets = [(k, shingles(t, n)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(s), find(k), find(k) == k) for k, s in sets}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def corpus(seed, n_words):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, key = [], 0
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.choice([3, 20, 80, 300]))]
        for _ in range(draw.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 3, len(base) // 20])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((key, draw.choice([" ", "\n", " \t "]).join(copy)))
            key += 1
    rows += [(key, ""), (key + 1, None), (key + 2, " \n "), (key + 3, "one"), (key + 4, "ONE"), (key + 5, "one two"), (key + 6, "Ünï ünï Ünï x y z")]
    rows.append((key + 7, " ".join(draw.choice(words) for _ in range(30_000))))
    return rows


def test_links_and_components_are_those_of_all_pairs(documents):
    for seed, words in ((1, 2), (2, 5)):
        rows = corpus(seed, words)
        assert got(near_duplicates(documents(rows, extra=True), words=words)) == brute(rows, words)


def test_chains_and_large_groups(documents):
    draw = random.Random(5)
    base = [f"a{k}" for k in range(100)]
    rows = []
    for k in range(60):  # each near the one before, the ends far apart
        base[k] = f"b{k}"
        rows.append((1000 - k, " ".join(base)))
    other = [f"c{k}" for k in range(50)]
    for k in range(300):
        copy = list(other)
        copy[draw.randrange(50)] = f"d{k}"
        rows.append((2000 + k, " ".join(copy)))
    rows += [(5000 + k, "the same text for all of these documents here") for k in range(200)]
    assert got(near_duplicates(documents(rows), words=2)) == brute(rows, 2)


def test_empty_table_nulls_and_repeated_rows(documents):
    assert near_duplicates(documents([])).count() == 0
    found = near_duplicates(documents([(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")])).collect()
    assert len(found) == 5
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None) == [(3, 3, True), (3, 3, True), (4, 3, False)]
    assert all(r["component_id"] is None and r["kept"] for r in found if r["doc_id"] is None)


def test_components_of_random_graphs(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(7, 7), (3, 4), (4, 3)]
    edges += [(300 + k, 301 + k) for k in range(40)] + [(900, 400 + k) for k in range(50)]
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    want = {k: find(k) for a, b in edges if a != b for k in (a, b)}
    found = components(spark.createDataFrame(edges, "a long, b long"), Shelf(spark, "test"))
    assert {r["node"]: r["component"] for r in found.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long"), Shelf(spark, "test")).count() == 0


def by_text(rows, n, percent=80):
    """Brute force over texts: [(id, shingles, id of the component, its texts)] of each row, in order."""
    texts = sorted({t for k, t in rows if k is not None and shingles(t, n)})
    sets = [shingles(t, n) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, t in rows:
        if k is not None and t in texts:
            c = find(texts.index(t))
            least[c] = min(least.get(c, k), k)
    return [(k, len(shingles(t, n)), k if k is None or t not in texts else least[find(texts.index(t))]) for k, t in rows]


def test_links_are_between_texts_whatever_their_ids(documents):
    draw = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    bases = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(8)]
    rows = []
    for _ in range(120):
        text = draw.choice(bases).split()
        for _ in range(draw.randrange(3)):
            text[draw.randrange(60)] = draw.choice(words)
        rows.append((draw.choice([None, *range(12)]), " ".join(text)))
    rows += [(5, bases[0]), (5, bases[1]), (9, bases[0] + " x"), (3, bases[1] + " y"), (4, None), (4, ""), (4, bases[2])]
    found = [tuple(r)[:3] for r in near_duplicates(documents(rows), words=2).select("doc_id", "n_shingles", "component_id").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(found, key=key) == sorted(by_text(rows, 2), key=key)
    firsts = [r["component_key"] for r in near_duplicates(documents(rows), words=2).filter("first and component_key is not null").dropDuplicates(["doc_id", "component_key"]).collect()]
    assert len(firsts) == len(set(firsts))


def test_a_hub_with_many_partners(documents, monkeypatch):
    from textloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "PARTNERS", 7)
    draw = random.Random(3)
    base = [f"a{k}" for k in range(50)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        copy = list(base)
        copy[draw.randrange(50)] = f"b{k}"
        rows.append((k, " ".join(copy)))
    assert got(near_duplicates(documents(rows), words=2)) == brute(rows, 2)


def test_no_private_folder_on_a_cluster():
    import types

    import pytest

    from textloom.llm.common import shared_dir

    far = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="yarn", getConf=lambda: {}))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(far)


def linked(edges):
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {k: find(k) for a, b in edges if a != b for k in (a, b)}


@pytest.mark.parametrize("most", [1_000_000, -1])
def test_components_after_further_edges(spark, monkeypatch, most):
    from textloom.llm import components as c

    monkeypatch.setattr(c, "BROADCAST_IDS", most)
    draw = random.Random(11)
    old = [(draw.randrange(150), draw.randrange(150)) for _ in range(60)] + [(5, 5), (400, 399), (399, 398)]
    new = [(draw.randrange(300), draw.randrange(300)) for _ in range(60)] + [(9, 9), (398, 400), (500, 501), (501, 500)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    shelf = Shelf(spark, "test")
    found = components(frame(old), shelf)
    assert {r["node"]: r["component"] for r in found.collect()} == linked(old)
    more = c.joined(found, frame(new), shelf, "more")
    loops = {(a, b) for a, b in new if a == b}
    assert sorted(map(tuple, more.collect())) == sorted(linked(old + [e for e in new if e not in loops]).items())
    assert sorted(map(tuple, c.joined(found, frame([]), shelf, "none").collect())) == sorted(linked(old).items())
    assert sorted(map(tuple, c.joined(components(frame([]), shelf, "cc9"), frame(new), shelf, "first").collect())) == sorted(linked(new).items())


def groups(seed):
    """One group of near copies, one of exact ones, chains, and texts alone."""
    draw = random.Random(seed)
    base, chain, rows = [f"a{k}" for k in range(40)], [f"c{k}" for k in range(60)], []
    for k in range(40):
        copy = list(base)
        for _ in range(draw.randrange(5)):
            copy[draw.randrange(40)] = f"b{draw.randrange(900)}"
        rows.append((k, " ".join(copy)))
        chain[k] = f"d{k}"
        rows.append((900 - k, " ".join(chain)))
        rows.append((100 + k, "one text that many rows hold as it is"))
        rows.append((200 + k, " ".join(f"e{draw.randrange(9000)}" for _ in range(20))))
    return rows


def test_tables_too_large_to_be_sent(documents, monkeypatch):
    from textloom.llm import components as c
    from textloom.llm import near_dedup

    for module in (c, near_dedup):
        monkeypatch.setattr(module, "BROADCAST_IDS", -1)
    assert got(near_duplicates(documents(groups(1)), words=2)) == brute(groups(1), 2)


def test_few_shuffles(spark, documents):
    """Each exchange costs as many tasks as there are shuffle partitions."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    docs = documents(groups(2))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few_shuffles", "")
        assert got(near_duplicates(docs, words=2)) == brute(groups(2), 2)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few_shuffles") for s in tracker.getJobInfo(j).stageIds}
        infos = [i for i in map(tracker.getStageInfo, stages) if i]
        # of 16 tasks: an exchange's reading side
        assert sum(i.numCompletedTasks >= 16 for i in infos) <= 50
    finally:
        spark.sparkContext.setJobGroup("", "")
        for k, v in before.items():
            spark.conf.set(k, v)
