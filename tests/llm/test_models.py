"""Language identification and the quality classifier: held-out accuracy on generated data."""

import random
import zlib

from textloom.llm.langid import UNKNOWN, identify_languages
from textloom.llm.quality_model import score_quality

SOUNDS = {"aa": "the of and with ing sh th ou ea", "bb": "der die und ein sch cht ß ü ung", "cc": "les des une é è eau oi aux", "dd": "los las una ñ ó ción ue ie"}


def sentence(draw, lang, n):
    parts = SOUNDS[lang].split()
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randrange(1, 4))) for _ in range(n))


def test_held_out_languages(documents):
    draw = random.Random(1)
    rows = [(k, sentence(draw, lang := draw.choice(list(SOUNDS)), draw.randrange(3, 60)), lang) for k in range(900)]
    # The labels of held-out rows are wrong on purpose: nothing may be learned from them.
    given = [(k, t, "aa" if zlib.crc32(str(k).encode()) % 3 == 1 else lang) for k, t, lang in rows]
    given += [(2000, None, "aa"), (2001, "", "bb"), (2002, "123 !?", "aa"), (2003, sentence(draw, "bb", 20_000), None)]
    found = {r["doc_id"]: r for r in identify_languages(documents(given, extra=True)).collect()}
    assert len(found) == len(given)
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for k, r in found.items())
    held = [(found[k]["lang_pred"], lang) for k, _, lang in rows if found[k]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert [found[k]["lang_pred"] for k in (2000, 2001, 2002)] == [UNKNOWN] * 3
    assert found[2003]["lang_pred"] == "bb"


def test_languages_without_labels(documents):
    assert identify_languages(documents([])).count() == 0
    found = identify_languages(documents([(1, "some text"), (None, "text"), (1, "some text")])).collect()
    assert len(found) == 3 and all(r["lang_pred"] == UNKNOWN and not r["accepted"] for r in found)


def test_cotraining_scores_what_has_no_label(spark, documents):
    draw = random.Random(2)
    rows, truth = [], {}
    for k in range(1200):
        good = draw.random() < 0.7
        words = ["alpha", "beta", "gamma", "delta", "story", "house"] if good else ["buy", "now", "!!!", "CLICK", "win", "story"]
        source = draw.choice(["site1", "site2", "mixed"] if good else ["spam1", "mixed"])
        rows.append((k, " ".join(draw.choice(words) for _ in range(draw.randrange(20, 80))), "en", source))
        truth[k] = good
    rows += [(5000, None, None, None), (5001, "", "en", "site1"), (None, "alpha beta", "en", "site1")]
    labels = spark.createDataFrame([(k, int(truth[k]), 0) for k in range(0, 1200, 4)] + [(0, None, 0), (1, 7, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = score_quality(documents(rows, extra=True), labels).collect()
    assert len(found) == len(rows)
    own = [(r["score"], truth[r["doc_id"]], r["kept"]) for r in found if r["doc_id"] in truth and r["doc_id"] % 4]
    assert sum((s > 0.5) == t for s, t, _ in own) >= 0.95 * len(own)
    assert sum(k for _, t, k in own if t) >= 0.95 * sum(t for _, t, _ in own)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_cotraining_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score_quality(documents([]), none).count() == 0
    found = score_quality(documents([(1, "a"), (1, "a"), (None, None)]), none).collect()
    assert len(found) == 3 and all(r["kept"] and r["score"] is None for r in found)


def test_a_long_text_is_summed_in_blocks(documents):
    """The score of a text is the same whether its n-grams are gathered at once or by blocks."""
    import numpy as np

    from textloom.llm import langid

    draw = np.random.default_rng(0)
    model = langid.LanguageModel(["x", "y", "z"], draw.normal(size=(1 << langid.BUCKET_BITS, 3)).astype(np.float32), 0.7, 0.0)
    for size in (1, langid._LONG - 1, langid._LONG, 3 * langid._LONG + 17):
        text = bytes(draw.integers(97, 123, size, dtype=np.uint8))
        ids, counts = langid.subwords([text])
        logits = model.table[ids].astype(float).sum(axis=0) / counts[0] / 0.7
        want = np.exp(logits - logits.max())
        assert np.allclose(model.probabilities([text])[0], want / want.sum(), atol=1e-6)
        assert np.allclose(model.probabilities([text, b"q"])[0], want / want.sum(), atol=1e-3)


def test_language_fit_is_that_of_plain_gradient_steps():
    """Brute force: the softmax regression without hashing tricks, one piece at a time, gives the same model."""
    import numpy as np

    from textloom.llm import langid

    pieces, labels = [b"der die das", b"the of and", b"und oder", b"with this"], ["de", "en", "de", "en"]
    found = langid.train(pieces, labels, epochs=2, batch=1)
    draw = np.random.default_rng(3)
    embed = draw.normal(0, 0.1, (1 << langid.BUCKET_BITS, langid.DIMENSIONS)).astype(np.float32)
    weights = draw.normal(0, 0.3, (langid.DIMENSIONS, 2)).astype(np.float32)
    for epoch in range(2):
        for (k,) in np.array_split(draw.permutation(4), 4):
            own = langid.subwords([pieces[k]])[0]
            mean = sum(embed[i] for i in own) / len(own)
            z = np.exp(mean @ weights)
            error = z / z.sum() - np.array([labels[k] == "de", labels[k] == "en"])
            back, rate = weights @ error / len(own), 0.5 * (1 - epoch / 2) * 8
            weights = weights - rate * np.outer(mean, error)
            for i in own:
                embed[i] -= rate * back
    assert np.allclose(found.table, embed @ weights, atol=1e-4)


def test_logistic_is_that_of_plain_descent():
    import numpy as np

    from textloom.llm.quality_model import Logistic

    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(40, 3)), (draw.random(40) < 0.4).astype(int)
    model = Logistic(x, y, steps=50)
    z = [[(v - m) / (s + 1e-2) for v, m, s in zip(row, x.mean(axis=0), x.std(axis=0))] for row in x]
    w, b, move, move_b, rate = [0.0] * 3, 0.0, [0.0] * 3, 0.0, 0.5 / 3**0.5
    for _ in range(50):
        errors = []
        for row, t in zip(z, y):
            p = 1 / (1 + np.exp(-(sum(a * v for a, v in zip(w, row)) + b)))
            errors.append((p - t) * 0.5 / (y.mean() if t else 1 - y.mean()) / 40)
        move = [0.9 * m - rate * (sum(e * row[j] for e, row in zip(errors, z)) + 1e-3 * w[j]) for j, m in enumerate(move)]
        move_b = 0.9 * move_b - rate * sum(errors)
        w, b = [a + m for a, m in zip(w, move)], b + move_b
    assert np.allclose(model.w, w) and np.isclose(model.b, b)
