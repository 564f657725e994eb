"""Perturbations of signals, arrays of samples: gain, shift, noise, impulse responses, another rate or
speed. What is drawn at random is a function of a seed and a key, the same on any cluster."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import gain, rms_db
from ..functions.labels import shift_signal
from .order import ranked

_SAMPLES = T.ArrayType(T.DoubleType())
#: So many rows of noises are sent to all tasks; beyond it the join shuffles.
BROADCAST_NOISES = 10_000
#: A prime below 2 ** 31; products of numbers below it fit in a long.
_PRIME = 2_147_483_647


def key_hash(seed: int, key: Column) -> Column:
    """A number below 2 ** 28 from a digest of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 7), 16, 10).cast("long")


def share(seed: int, key: Column) -> Column:
    """A number inside (0, 1) of a row."""
    return (key_hash(seed, key) + 0.5) / float(1 << 28)


def between(low: float, high: float, seed: int, key: Column) -> Column:
    return low + (high - low) * share(seed, key)


def _scrambled(x: Column) -> Column:
    """A number inside (0, 1) from one below the prime: shifts and products, as cheap as any."""
    for _ in range(3):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * 73_244_475) % _PRIME
    return (x + 0.5) / float(_PRIME + 1)


def white_noise(samples: Column, level_db: Column, seed: int, key: Column) -> Column:
    """samples plus normal noise of the level, drawn for each place from the row's hash."""
    amplitude = F.pow(F.lit(10.0), level_db / 20)
    base = key_hash(seed, key)

    def noisy(x, i):
        place = F.pmod(base + i.cast("long") * 7919, F.lit(_PRIME))
        one, two = _scrambled(place), _scrambled((place + 104_729) % _PRIME)
        return x + amplitude * F.sqrt(-2 * F.log(one)) * F.cos(2 * math.pi * two)

    return F.transform(samples, noisy)


def augmented(df: DataFrame, column: str, key: str, steps: list[tuple[float, Callable[[Column, Column, int], Column]]], seed: int = 0) -> DataFrame:
    """df with the steps (share of rows, (samples, key, seed) -> samples) applied in order, each to rows
    drawn by (seed, step, key). A null signal stays null."""
    for k, (probability, change) in enumerate(steps):
        own = 1000 * seed + 2 * k
        df = df.withColumn(column, F.when(share(own, F.col(key)) < probability, change(F.col(column), F.col(key), own + 1)).otherwise(F.col(column)))
    return df


def gain_step(low: float, high: float):
    return lambda x, key, seed: gain(x, between(low, high, seed, key))


def shift_step(low_ms: float, high_ms: float, rate: int):
    return lambda x, key, seed: shift_signal(x, F.floor(between(low_ms, high_ms, seed, key) * rate / 1000).cast("int"))


def white_noise_step(low_db: int, high_db: int):
    """Whole decibels from low_db, below high_db."""
    return lambda x, key, seed: white_noise(x, F.floor(between(low_db, high_db, seed, key)), seed + 500_000, key)


STEPS = {"gain": gain_step, "shift": shift_step, "white_noise": white_noise_step}


def with_drawn(df: DataFrame, key: str, others: DataFrame, order: str, seed: int = 0) -> DataFrame:
    """Each row of df with one row of `others` (unique order), drawn evenly by (seed, key): others are
    numbered, and joined by the drawn number. Without others, or a key, no row stays."""
    n = others.count()
    if not n:
        return df.join(others.limit(0), F.lit(False), "inner")
    placed = ranked(others, order, "__place")
    placed = F.broadcast(placed) if n <= BROADCAST_NOISES else placed
    drawn = F.least(F.floor(share(seed, F.col(key)) * n).cast("long"), F.lit(n - 1))
    drawn = F.when(F.col(key).isNotNull(), drawn)  # least() passes over nulls
    return df.withColumn("__place", drawn).join(placed, "__place").drop("__place")


def with_noise(df: DataFrame, key: str, column: str, noises: DataFrame, order: str, noise: str, *, low_db: float = 40.0, high_db: float = 50.0, most_gain: float = 300.0, seed: int = 0) -> DataFrame:
    """df with a drawn noise added to `column`, so many decibels below it: the ratio is drawn between
    low_db and high_db, the gain is most_gain at most. Of a longer noise a part is taken, from a
    drawn place; a shorter one covers the beginning. noises: (order, noise) with other names than df's."""
    both = with_drawn(df, key, noises.select(order, noise), order, seed)
    x, y = F.col(column), F.col(noise)
    start = F.floor(share(seed + 1, F.col(key)) * F.greatest(F.size(y) - F.size(x) + 1, F.lit(1))).cast("int")
    db = F.least(rms_db(x) - rms_db(y) - between(low_db, high_db, seed + 2, F.col(key)), F.lit(most_gain))
    mixed = both.withColumn("__start", start).withColumn("__scale", F.pow(F.lit(10.0), db / 20))
    total = F.transform(x, lambda v, i: v + F.col("__scale") * F.coalesce(F.get(y, F.col("__start") + i), F.lit(0.0)))
    return mixed.withColumn(column, total).select(*df.columns)


@F.pandas_udf(_SAMPLES)
def convolved(signal: pd.Series, response: pd.Series) -> pd.Series:
    """The full convolution of a signal with an impulse response, by Fourier transforms; null if
    either is null, empty if either is empty."""
    def one(a, b):
        if a is None or b is None:
            return None
        if not len(a) or not len(b):
            return []
        n = len(a) + len(b) - 1
        size = 1 << (n - 1).bit_length()
        return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n]

    return pd.Series([one(a, b) for a, b in zip(signal, response, strict=True)], dtype=object)


def _weights(up: int, down: int, zeros: int) -> tuple[np.ndarray, int]:
    """Of each phase of new samples between old ones, the weights of the old ones within reach."""
    cut = min(1.0, up / down)
    reach = math.ceil(zeros / cut)
    distance = ((np.arange(up) * down % up) / up)[:, None] - np.arange(-reach, reach + 2)
    inside = np.abs(distance) * cut < zeros
    return cut * np.sinc(cut * distance) * np.where(inside, 0.5 + 0.5 * np.cos(np.pi * distance * cut / zeros), 0.0), reach


def resampled(target: int, *, zeros: int = 16):
    """Columns (samples, their rate) -> samples at `target` a second: each is the sum of those within
    `zeros` zero crossings of a sinc, cut by a Hann window; below the source's rate the sinc is
    as wide as the target's. n samples become ceil(n * target / rate); null for a null."""
    @F.pandas_udf(_SAMPLES)
    def resample(signal: pd.Series, rate: pd.Series) -> pd.Series:
        tables: dict[tuple[int, int], tuple[np.ndarray, int]] = {}

        def one(x, source):
            if x is None or source is None or not source > 0:
                return None
            common = math.gcd(int(source), target)
            up, down = target // common, int(source) // common
            if not len(x) or up == down:
                return np.asarray(x, float)
            if (up, down) not in tables:
                tables[up, down] = _weights(up, down, zeros)
            weights, reach = tables[up, down]
            n = -(-len(x) * up // down)
            padded = np.concatenate([np.zeros(reach), np.asarray(x, float), np.zeros(reach + 2)])
            views, out = np.lib.stride_tricks.sliding_window_view(padded, weights.shape[1]), np.empty(n)
            block = max(1, (1 << 22) // weights.shape[1])  # bounds what is multiplied at once
            for at in range(0, n, block):
                k = np.arange(at, min(at + block, n))
                out[k] = (views[k * down // up] * weights[k % up]).sum(axis=1)
            return out

        return pd.Series([one(x, r) for x, r in zip(signal, rate, strict=True)], dtype=object)

    return resample


def stretched(*, n_fft: int = 2048, hop: int | None = None):
    """Columns (samples, rate) -> samples `rate` times as fast at the same pitch: magnitudes of a spectrogram
    are read at steps of `rate` frames, phases go on by each frequency's measured advance, and the
    frames are put together again. n samples become round(n / rate)."""
    step = hop or n_fft // 4
    shape = np.hanning(n_fft + 1)[:-1]

    def transform(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "constant")
        return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::step] * shape, axis=1)

    def back(frames: np.ndarray, n: int) -> np.ndarray:
        out, weight = np.zeros(n_fft + step * (len(frames) - 1)), np.zeros(n_fft + step * (len(frames) - 1))
        for k, frame in enumerate(np.fft.irfft(frames, n_fft, axis=1) * shape):
            out[k * step : k * step + n_fft] += frame
            weight[k * step : k * step + n_fft] += shape**2
        out = np.where(weight > 1e-10, out / np.maximum(weight, 1e-10), out)[n_fft // 2 :][:n]
        return np.pad(out, (0, n - len(out)))

    def one(x, rate):
        if x is None or rate is None or not rate > 0:
            return None
        x = np.asarray(x, float)
        n = round(len(x) / rate)
        if not len(x) or not n:
            return np.zeros(n)
        frames = np.concatenate([transform(x), np.zeros((2, n_fft // 2 + 1), complex)])
        own = np.linspace(0, np.pi * step, n_fft // 2 + 1)  # advance of each frequency in a hop
        at = np.arange(0, len(frames) - 2, rate)
        left = at.astype(int)
        part = (at - left)[:, None]
        size = (1 - part) * np.abs(frames[left]) + part * np.abs(frames[left + 1])
        turn = np.angle(frames[left + 1]) - np.angle(frames[left]) - own
        turn -= 2 * np.pi * np.round(turn / (2 * np.pi))
        phase = np.angle(frames[0]) + np.concatenate([np.zeros((1, len(own))), np.cumsum(own + turn, axis=0)[:-1]])
        return back(size * np.exp(1j * phase), n)

    @F.pandas_udf(_SAMPLES)
    def stretch(signal: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([one(x, r) for x, r in zip(signal, rate, strict=True)], dtype=object)

    return stretch
