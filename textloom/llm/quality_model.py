"""A quality classifier by co-training: one classifier reads the text, another the page's
metadata; over rounds each hands the documents of which it is most sure, with its labels,
to the other; calibrated on held-out labels, both are then combined to score all documents.

Every document's text becomes a small vector of counts (hashed words and hashed word
shapes) once, as a table in the shared folder; rounds read that table alone. The fit sees
at most `labelled` labelled documents and `handed` documents a round, view and class."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, WordHasher, arrow_rows, blocks_of

WORD_BINS, SHAPE_BINS, META_BINS = 256, 256, 64
#: Bytes -> shape: lower case and non-ASCII letters a, upper case A, digits 9, else itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[list(range(97, 123)) + list(range(128, 256))] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("9")


def _shaped(text: bytes) -> bytes:
    """Runs of one class shrink to one character, except at white space."""
    shape = _SHAPE[np.frombuffer(text, np.uint8)]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    return shape[keep].tobytes()


def _shares(hashes: np.ndarray, bins: int) -> np.ndarray:
    counts = np.bincount((hashes % np.uint64(bins)).astype(np.int64), minlength=bins)
    return np.minimum(255, np.round(255 * np.sqrt(counts / max(1, counts.sum())))).astype(np.uint8)


def _vectors(batches):
    """(id, hash, text, ...) -> the same with the text's vector in its place."""
    hasher = WordHasher()
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        vectors = []
        for lo, hi in blocks_of(texts):
            if hi - lo == 1:
                split = [hasher.words(texts[lo])]
            else:
                words, counts = hasher.many(texts[lo:hi])
                split = np.split(words, np.cumsum(counts)[:-1])
            for text, words in zip(texts[lo:hi], split, strict=True):
                distinct = 255 * len(np.unique(words)) // max(1, len(words))
                size = min(255, int(16 * np.log1p(len(words))))
                vectors.append(np.concatenate([_shares(words, WORD_BINS), _shares(hasher.words(_shaped(text)), SHAPE_BINS), np.array([distinct, size], np.uint8)]).tobytes())
        columns = [batch.column(0), batch.column(1), pa.array(vectors, pa.binary()), *(batch.column(k) for k in range(3, batch.num_columns))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "vector", "meta", "length"])


def text_view(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), -1).astype(np.float32) / 255


def meta_view(meta: list[list[int]], lengths: list[float]) -> np.ndarray:
    out = np.zeros((len(meta), META_BINS + 2), np.float32)
    for k, bins in enumerate(meta):
        out[k, bins] = 1
    out[:, -2] = np.array(lengths) / 12
    out[:, -1] = out[:, -2] ** 2
    return out


class Logistic:
    """L2-regularised logistic regression, classes weighted alike, by full-batch descent
    with momentum; calibrated by two more numbers fitted on held-out rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 300):
        self.mean = x.mean(axis=0)
        self.scale = x.std(axis=0) + 1e-2
        z = (x - self.mean) / self.scale
        share = y.mean()
        weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) / len(y)
        self.w, self.b, self.slope, self.shift = np.zeros(x.shape[1]), 0.0, 1.0, 0.0
        move, move_b, rate = np.zeros_like(self.w), 0.0, 0.5 / np.sqrt(x.shape[1])
        for _ in range(steps):
            error = (1 / (1 + np.exp(-np.clip(z @ self.w + self.b, -30, 30))) - y) * weight
            move = 0.9 * move - rate * (z.T @ error + penalty * self.w)
            move_b = 0.9 * move_b - rate * error.sum()
            self.w, self.b = self.w + move, self.b + move_b

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (((x - self.mean) / self.scale) @ self.w + self.b) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.slope, self.shift = 1.0, 0.0
        raw = np.clip(self.logit(x), -15, 15)
        slope, shift = 1.0, 0.0
        for _ in range(400):
            error = 1 / (1 + np.exp(-(slope * raw + shift))) - y
            slope, shift = slope - 0.05 * ((error * raw).mean() + 1e-3 * (slope - 1)), shift - 0.1 * error.mean()
        self.slope, self.shift = max(0.0, slope), shift


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _scored(batches, text_model: Logistic, meta_model: Logistic, top: Logistic | None):
    for batch in batches:
        if not batch.num_rows:
            continue
        t = text_model.logit(text_view(batch.column("vector").to_pylist()))
        m = meta_model.logit(meta_view(batch.column("meta").to_pylist(), batch.column("length").to_pylist()))
        columns = [_probability(t), _probability(m)]
        if top is not None:
            columns.append(_probability(top.logit(np.stack([t, m], axis=1))))
        names = ["p_text", "p_meta", "score"][: len(columns)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "hash")), *(pa.array(c, pa.float64()) for c in columns)], ["id", "hash", *names])


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source"),
    label_id: str = "doc_id", label_col: str = "quality", *, rounds: int = 3, labelled: int = 6000, handed: int = 400, lost: float = 0.01,
) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) for each row of docs.

    score is the calibrated probability of label 1; kept says that it reaches the threshold
    below which a share `lost` of the good held-out documents lies. Of the labelled documents a
    fifth calibrates both views and fits their combination, another fifth calibrates that and
    sets the threshold; neither trains a view (one part for both, where labels are too few). Without labels of both kinds
    scores are null and every row is kept. Null and empty texts are an empty vector; null
    metadata is a value of its own; labels that are null or not 0 and 1 are not used. Repeated
    rows are each returned; an empty table gives no rows."""
    spark = docs.sparkSession
    arrow_rows(spark)
    shelf = Shelf(spark, "quality")
    text = F.col(text_col).cast("string")
    meta = F.array(*[F.pmod(F.xxhash64(F.lit(c), F.col(c).cast("string")), F.lit(META_BINS)).cast("int") for c in meta_cols])
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"), meta.alias("meta"),
        F.log1p(F.coalesce(F.length(text), F.lit(0))).alias("length"),
    )
    base = shelf.put(rows.mapInArrow(_vectors, "id long, hash long, vector binary, meta array<int>, length double"), "vectors")
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    n = known.count()
    # A bounded sample by a hash of the id: about `labelled`, and never more.
    sample = known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(1e6 * min(1.0, labelled / max(1, n))))).orderBy(F.xxhash64("id"), "id").limit(labelled)
    got = base.join(F.broadcast(sample), "id").orderBy("id", "hash").limit(labelled).collect()
    y = np.array([r["y"] for r in got])
    if len(got) < 20 or y.min() == y.max():
        null = F.lit(None).cast("double")
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), null.alias("p_text"), null.alias("p_meta"), null.alias("score"), F.lit(True).alias("kept"))
    xt, xm = text_view([r["vector"] for r in got]), meta_view([r["meta"] for r in got], [r["length"] for r in got])
    turn = np.arange(len(y)) % 5
    held, last = turn == 3, turn == 4
    if not all(0 < y[part].sum() < part.sum() for part in (held, last)):  # too few labels for two parts
        held = last = turn >= 3
    fit = turn < 3
    views = {"text": xt[fit], "meta": xm[fit]}
    targets = {"text": y[fit], "meta": y[fit]}
    taken = [r["id"] for r in got]
    for turn in range(rounds + 1):
        models = {v: Logistic(views[v], targets[v]) for v in views}
        models["text"].calibrate(xt[held], y[held])
        models["meta"].calibrate(xm[held], y[held])
        if turn == rounds:
            break
        scored = base.mapInArrow(partial(_scored, text_model=models["text"], meta_model=models["meta"], top=None), "id long, hash long, p_text double, p_meta double")
        scored = scored.join(F.broadcast(spark.createDataFrame([(i,) for i in taken], "id long")), "id", "left_anti")
        share = {1: y.mean(), 0: 1 - y.mean()}
        picks = None
        for view, other in (("text", "meta"), ("meta", "text")):
            p = F.col(f"p_{view}")
            for label in (0, 1):
                sure = p >= 0.95 if label else p <= 0.05
                part = scored.filter(sure).orderBy(p.desc() if label else p.asc(), "id").limit(int(handed * share[label]) + 1)
                part = part.select("id", "hash", F.lit(other).alias("view"), F.lit(label).alias("label"))
                picks = part if picks is None else picks.union(part)
        picks = shelf.put(picks, f"picks{turn}")  # at most 4 * (handed + 1) rows
        more = base.join(F.broadcast(picks), ["id", "hash"]).orderBy("id", "hash", "view", "label").limit(8 * (handed + 1)).collect()
        for view in views:
            own = [r for r in more if r["view"] == view]
            if own:
                x = text_view([r["vector"] for r in own]) if view == "text" else meta_view([r["meta"] for r in own], [r["length"] for r in own])
                views[view] = np.concatenate([views[view], x])
                targets[view] = np.concatenate([targets[view], [r["label"] for r in own]])
        taken += [r["id"] for r in more if r["id"] is not None]
    both = np.stack([models["text"].logit(xt), models["meta"].logit(xm)], axis=1)
    top = Logistic(both[held], y[held])
    top.calibrate(both[last], y[last])
    cut = float(np.quantile(_probability(top.logit(both[last]))[y[last] == 1], lost)) if (y[last] == 1).any() else 0.0
    final = base.mapInArrow(
        partial(_scored, text_model=models["text"], meta_model=models["meta"], top=top), "id long, hash long, p_text double, p_meta double, score double"
    )
    return final.select(F.col("id").alias("doc_id"), "p_text", "p_meta", "score", (F.col("score") >= F.lit(cut)).alias("kept"))
