"""Quality rules against plain counts, and the divergence verdict on planted junk."""

import math
import random
import re

from textloom.llm.quality_rules import js_distance, quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = {}
    for w in windows:
        often[w] = often.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def texts():
    draw = random.Random(3)
    words = ["a", "b", "c", "dd", "é", "💡x", "#", "<b>", "$5", "E"]
    rows = ["".join(draw.choice(words) + draw.choice([" ", "  ", "\n", "\n\n", "\t", "\x0b", " ", "\r\n"]) for _ in range(draw.randrange(60))) for _ in range(200)]
    rows += ["one two three four five six seven\n" * 20, " ".join(f"w{k}" for k in range(20_000)), "x y z u v " * 4000, "a\n\n \na\n", "", None, " \n\t "]
    return rows


def test_counts_are_those_of_plain_code(documents):
    rows = [(k, t, "en") for k, t in enumerate(texts())]
    found = quality_rules(documents(rows, extra=True)).collect()
    assert len(found) == len(rows)
    for r in found:
        want = brute(rows[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])


def test_junk_is_far_from_the_reference(documents):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(3, 10))) for _ in range(500)]

    def prose():
        return " ".join(draw.choice(["the", "of", "and", "in", "to", *draw.sample(vocabulary, 8)]) for _ in range(150)) + "."

    clean = [(k, prose(), draw.choice(["en", None, "xx"])) for k in range(60)]
    junk = [(100 + k, " ".join(draw.choice("#*$%&|<>0123456789") * draw.randrange(1, 9) for _ in range(150)), "en") for k in range(4)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(documents(clean + junk)).collect()}
    assert all(kept[k] for k, *_ in clean)
    assert not any(kept[k] for k, *_ in junk)


def test_distance_and_edges(spark, documents):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    want = math.sqrt(sum(a * math.log2(a / c) for x in (p, q) for a, c in zip(x, m, strict=True) if a) / 2)
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(js_distance(F.col("p"), F.col("q")).alias("d"), js_distance(F.col("p"), F.col("p")).alias("z")).first()
    assert abs(row["d"] - want) < 1e-12 and row["z"] == 0
    assert quality_rules(documents([])).count() == 0
    found = quality_rules(documents([(None, None), (None, "x"), (1, "x"), (1, "x")])).collect()
    assert len(found) == 4 and not any(r["kept"] for r in found)
