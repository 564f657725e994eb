"""Decoders of frames of symbol probabilities: prefix beam search with an n-gram language model."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import Backoff


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def prefix_beam_search(frames: list[list[float]], symbols: list[str], width: int, model: Backoff | None = None, alpha: float = 0.0, beta: float = 0.0) -> list[tuple]:
    """[(symbols, score, acoustic, language)], the best first, of frames of log probabilities, the
    blank's the last. Of a prefix the mass of paths that end in a blank and of those that end in
    its last symbol are kept apart, since only the former lets that symbol come again; paths to
    one prefix are added up. Score: acoustic + alpha * language + beta * length; ties by symbols."""
    beams: dict[tuple, tuple[float, float, float]] = {(): (0.0, -math.inf, 0.0)}  # blank, symbol, language
    none = (-math.inf, -math.inf)
    for frame in frames:
        found: dict[tuple, list[float]] = {}
        blank = frame[len(symbols)]
        for prefix, (in_blank, in_symbol, language) in beams.items():
            every = _add(in_blank, in_symbol)
            stay = found.setdefault(prefix, [*none, language])
            stay[0] = _add(stay[0], every + blank)
            for k, symbol in enumerate(symbols):
                p = frame[k]
                if p == -math.inf:
                    continue
                again = bool(prefix) and prefix[-1] == symbol
                if again:
                    stay[1] = _add(stay[1], in_symbol + p)
                mass = (in_blank if again else every) + p
                if mass == -math.inf:
                    continue
                longer = (*prefix, symbol)
                new = found.get(longer)
                if new is None:
                    new = found[longer] = [*none, language + (model.log(prefix, symbol) if model else 0.0)]
                new[1] = _add(new[1], mass)
        ranked = sorted(((_add(b, s) + alpha * lm + beta * len(p), p) for p, (b, s, lm) in found.items()), key=lambda x: (-x[0], x[1]))
        beams = {p: tuple(found[p]) for _, p in ranked[:width]}
    scored = [(p, _add(b, s) + alpha * lm + beta * len(p), _add(b, s), lm) for p, (b, s, lm) in beams.items()]
    return sorted(scored, key=lambda x: (-x[1], x[0]))


def ctc_beam_search(
    df: DataFrame, frames: str, symbols: list[str], *, width: int = 20, model: Backoff | None = None, alpha: float = 0.5, beta: float = 0.0, n_best: int = 1, keys: tuple[str, ...] = ()
) -> DataFrame:
    """(keys, rank from 0, text, score, acoustic, language): of each row's frames, an array of arrays of
    log probabilities (the blank's the last), the n_best texts of prefix_beam_search().

    A row is searched by itself, in the task that has it; the model, if any, is broadcast. Without
    frames, or with null ones, the text is empty and the score 0. A frame of another length than
    the symbols and the blank is an error."""
    held = df.sparkSession.sparkContext.broadcast(model)
    fields = [f"{k} {t}" for k, t in df.select(*keys).dtypes] if keys else []
    schema = ", ".join([*fields, "rank int", "text string", "score double", "acoustic double", "language double"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for row, frame in enumerate(batch.column("__frames").to_pylist()):
                if any(len(x) != len(symbols) + 1 for x in frame or []):
                    raise ValueError(f"a frame has not {len(symbols) + 1} values")
                for rank, (prefix, *scores) in enumerate(prefix_beam_search(frame or [], symbols, width, held.value, alpha, beta)[:n_best]):
                    at.append(row)
                    out.append((rank, "".join(prefix), *scores))
            found = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            types = (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*found, *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], [*keys, "rank", "text", "score", "acoustic", "language"])

    return df.select(*keys, F.col(frames).cast("array<array<double>>").alias("__frames")).mapInArrow(search, schema)
