"""Language identification: averaged hashed subword embeddings with a linear softmax,
trained by stochastic gradient descent in numpy, with calibrated rejection.

The fit sees a bounded sample of labelled documents (`docs_per_language`, drawn by a hash
of the id), of each a few pieces of chance length, so that short texts are learned too.
Prediction reads every whole text: because the softmax is linear, the score of a text is
the mean over its byte n-grams of one row of a small table, which goes with the task."""

from __future__ import annotations

import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, blocks_of

BUCKET_BITS, SIZES, DIMENSIONS = 15, (2, 3, 4), 16
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b"   "
#: Bytes of a long text whose n-grams are in memory at once.
_LONG = 1 << 18
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[9:14] = 32


def _buckets(padded: bytes) -> np.ndarray:
    """[place, n-gram size] bucket ids of the n-grams that begin at each place but the last len(_PAD)."""
    raw = _FOLD[np.frombuffer(padded, np.uint8)].astype(np.uint32)
    hashed, ids = raw[: len(raw) - 3].copy(), []
    for n in range(2, max(SIZES) + 1):
        hashed = hashed * np.uint32(0x01000193) + raw[n - 1 : len(raw) - 4 + n]
        if n in SIZES:
            mixed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            ids.append(mixed >> np.uint32(32 - BUCKET_BITS))
    return np.stack(ids, axis=1)


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the byte n-grams of all texts, by text, and how many each has (>= 1)."""
    ids = _buckets(b"".join(b" " + t + _PAD for t in texts))
    lengths = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(lengths + len(_PAD)) - lengths - len(_PAD)
    inside = np.ones(len(ids), bool)
    for k in range(len(_PAD)):
        at = starts[1:] - 1 - k
        inside[at[at < len(inside)]] = False
    return ids[inside].ravel(), lengths * len(SIZES)


def _clean(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _snippets(batches, per_doc: int):
    """(lang, text) -> (lang, piece, doc): of each text up to per_doc pieces of 10 to 500 bytes, with a
    digest of the text."""
    for batch in batches:
        langs, pieces, docs = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = _clean(text)
            draw = np.random.default_rng(len(data) * 31 + sum(data[:64]))
            for _ in range(per_doc):
                size = int(np.exp(draw.uniform(np.log(10), np.log(500))))
                at = int(draw.integers(0, max(1, len(data) - size + 1)))
                piece = data[at : at + size]
                if _LETTER.search(piece.decode("utf-8", "ignore")):
                    langs.append(lang)
                    pieces.append(piece)
                    docs.append(zlib.crc32(data))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary()), pa.array(docs, pa.int64())], ["lang", "piece", "doc"])


class LanguageModel:
    """Scores per bucket and language, a temperature and the least score accepted."""

    def __init__(self, languages: list[str], table: np.ndarray, temperature: float, least: float):
        self.languages, self.table, self.temperature, self.least = languages, table, temperature, least

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """[text, language]; texts are of moderate size together, but one alone may be of any size."""
        if len(texts) == 1:
            padded, total = b" " + texts[0] + _PAD, np.zeros(len(self.languages))
            for at in range(0, len(texts[0]) + 1, _LONG):
                total += self.table[_buckets(padded[at : at + _LONG + len(_PAD)]).ravel()].sum(axis=0, dtype=np.float64)
            logits = total[None, :] / ((len(texts[0]) + 1) * len(SIZES))
        else:
            ids, counts = subwords(texts)
            first = np.cumsum(counts) - counts
            logits = np.add.reduceat(self.table[ids], first, axis=0) / counts[:, None]
        logits = logits / self.temperature
        logits = np.exp(logits - logits.max(axis=1, keepdims=True))
        return logits / logits.sum(axis=1, keepdims=True)


def train(
    pieces: list[bytes], labels: list[str], docs: list[int] | None = None, *, epochs: int = 4, rate: float = 0.5, batch: int = 64, seed: int = 3, precision: float = 0.99,
) -> LanguageModel:
    """A tenth of the documents (docs: each piece's; without, of the pieces) is held out: it sets the
    temperature (least log loss) and the score from which on predictions reach `precision`."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    turn = np.arange(len(y)) if docs is None else np.array(docs)
    held = turn % 10 == 9 if len(y) >= 50 else np.zeros(len(y), bool)
    if held.all():
        held[:] = False
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights = draw.normal(0, 0.3, (DIMENSIONS, len(languages))).astype(np.float32)
    use = np.flatnonzero(~held)
    ids, counts = subwords(pieces)
    at = np.cumsum(counts) - counts
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(draw.permutation(use), max(1, len(use) // batch)):
            own = np.concatenate([ids[at[k] : at[k] + counts[k]] for k in part])
            n = counts[part]
            mean = np.add.reduceat(embed[own], np.cumsum(n) - n, axis=0) / n[:, None]
            p = np.exp((z := mean @ weights) - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = (p @ weights.T) / n[:, None]
            weights -= step * (mean.T @ p) / len(part) * 8
            np.add.at(embed, own, (-step * np.repeat(back, n, axis=0) * 8).astype(np.float32))
    model = LanguageModel(languages, (embed @ weights).astype(np.float32), 1.0, 0.0)
    test = np.flatnonzero(held)
    if len(test):
        raw, truth = [pieces[k] for k in test], y[test]
        losses = {}
        for model.temperature in np.geomspace(0.05, 5, 25):
            losses[model.temperature] = -np.log(model.probabilities(raw)[np.arange(len(test)), truth] + 1e-9).mean()
        model.temperature = min(losses, key=losses.get)
        p = model.probabilities(raw)
        order = np.argsort(-p.max(axis=1))
        right = np.cumsum(p.argmax(axis=1)[order] == truth[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= precision)
        model.least = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def _predict(batches, model: LanguageModel | None):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        known = [k for k, t in enumerate(texts) if model and t and _LETTER.search(t)]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        data = [_clean(texts[k]) for k in known]
        for lo, hi in blocks_of(data, 1 << 18):
            p = model.probabilities(data[lo:hi])
            for k, row in zip(known[lo:hi], p, strict=True):
                lang[k], score[k] = model.languages[int(row.argmax())], float(row.max())
        accepted = [bool(model) and s > 0 and s >= model.least for s in score]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
            ["doc_id", "lang_pred", "score", "accepted"],
        )


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, *, docs_per_language: int = 2000, pieces_per_doc: int = 4) -> LanguageModel | None:
    """From the rows of docs whose text and language are known: about docs_per_language of
    each language by a hash of the id. None if there are none."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(1e6 * min(1.0, docs_per_language / n)))])
    sample = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < share[F.col("lang")])
    pieces = sample.select("lang", "text").mapInArrow(partial(_snippets, per_doc=pieces_per_doc), "lang string, piece binary, doc long")
    got = sorted((bytes(r["piece"]), r["lang"], r["doc"]) for r in pieces.collect())
    draw = np.random.default_rng(1).permutation(len(got))
    return train(*([got[k][c] for k in draw] for c in range(3))) if got else None


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) for each row of docs.

    The fit uses rows whose crc32(id as text) mod 3 is not 1, and of them text and language
    alone; a prediction reads the text alone. Null texts and texts without a letter: und, 0,
    not accepted; so is every text if no row has a language. accepted says that the score
    reaches the calibrated least one. A null id counts as held out. Repeated rows are each
    returned; other columns are not read; an empty table gives no rows."""
    arrow_rows(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))
    model = fit(docs.filter(~held), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(partial(_predict, model=model), "doc_id long, lang_pred string, score double, accepted boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
