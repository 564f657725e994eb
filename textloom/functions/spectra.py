"""Spectra of signals: power spectrograms, log-mel bands and cepstra of framed Fourier transforms.

The frames of all signals of a batch are one matrix, transformed at once; a signal's frames lie in
one task. Frames are centred on multiples of the hop; the signal is reflected at its ends, or,
where it is not longer than half a frame, followed and led by zeros. A null or empty signal has no
spectrum (null)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
#: Values of frames that are transformed at once.
BLOCK = 1 << 19


def window(kind: str | None, n: int, *, periodic: bool) -> np.ndarray:
    """hann, hamming, blackman, bartlett; ones (or None) for none."""
    if kind in (None, "ones", "none"):
        return np.ones(n)
    shapes = {"hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman, "bartlett": np.bartlett}
    if kind not in shapes:
        raise ValueError(f"no window {kind!r}")
    return shapes[kind](n + 1)[:-1] if periodic else shapes[kind](n)


# The auditory scale is linear to 1000 Hz (200/3 Hz a mel), then 27 mels for each factor of 6.4.
_LINEAR, _BREAK, _STEP = 200 / 3, 1000.0, math.log(6.4) / 27


def _to_mel(f: float, scale: str) -> float:
    if scale == "htk":
        return 2595 * math.log10(1 + f / 700)
    return f / _LINEAR if f < _BREAK else _BREAK / _LINEAR + math.log(f / _BREAK) / _STEP


def _from_mel(m: np.ndarray, scale: str) -> np.ndarray:
    if scale == "htk":
        return 700 * (10 ** (m / 2595) - 1)
    return np.where(m < _BREAK / _LINEAR, m * _LINEAR, _BREAK * np.exp(_STEP * (m - _BREAK / _LINEAR)))


def mel_filters(rate: float, n_fft: int, bands: int, low: float = 0.0, high: float | None = None, *, scale: str = "slaney", equal_area: bool = True) -> np.ndarray:
    """(bands, n_fft // 2 + 1): triangles whose corners are even steps of a mel scale, slaney or htk;
    equal_area: each is divided by half its width in Hz."""
    high = high or rate / 2
    edges = _from_mel(np.linspace(_to_mel(low, scale), _to_mel(high, scale), bands + 2), scale)
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    rise = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    out = np.maximum(0, np.minimum(rise, fall))
    return out * (2 / (edges[2:] - edges[:-2]))[:, None] if equal_area else out


def cosines(n_out: int, n_in: int) -> np.ndarray:
    """(n_out, n_in): the orthonormal cosine transform of the second kind."""
    k, n = np.arange(n_out)[:, None], np.arange(n_in)
    out = np.cos(np.pi / n_in * (n + 0.5) * k) * math.sqrt(2 / n_in)
    out[0] /= math.sqrt(2)
    return out


def frame_count(length: Column, hop: int) -> Column:
    """Frames that count as a signal's own: its length by hops, rounded up."""
    return F.ceil(length / hop).cast("long")


def _frames(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    half = n_fft // 2
    padded = np.pad(x, half, mode="reflect" if len(x) > half else "constant")
    return np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]


def _spectra(signals: Iterable[np.ndarray], n_fft: int, hop: int, shape: np.ndarray) -> Iterator[np.ndarray]:
    """(frames, n_fft // 2 + 1) power of each signal; several signals are one transform."""
    held: list[np.ndarray] = []

    def flush() -> Iterator[np.ndarray]:
        if held:
            power = np.abs(np.fft.rfft(np.concatenate(held) * shape, axis=1)) ** 2
            yield from np.split(power, np.cumsum([len(f) for f in held])[:-1])
            held.clear()

    for x in signals:
        held.append(_frames(x, n_fft, hop))
        if sum(f.size for f in held) >= BLOCK:
            yield from flush()
    yield from flush()


def _udf(before: Callable[[np.ndarray], np.ndarray], after: Callable[[np.ndarray, int], np.ndarray], n_fft: int, hop: int, shape: np.ndarray):
    """Samples and matrices stay Arrow's flat values, never Python numbers; one block's frames are held at once."""
    @F.arrow_udf(_MATRIX)
    def spectra(signal: pa.Array) -> pa.Array:
        values = signal.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = signal.offsets.to_numpy()
        there = np.flatnonzero((np.diff(starts) > 0) & signal.is_valid().to_numpy(zero_copy_only=False))
        found = [np.zeros(0)]
        rows, widths = np.zeros(len(signal), np.int64), np.zeros(len(signal), np.int64)
        for k, power in zip(there, _spectra((before(values[starts[k] : starts[k + 1]]) for k in there), n_fft, hop, shape), strict=True):
            matrix = after(power, int(starts[k + 1] - starts[k]))
            rows[k], widths[k] = matrix.shape
            found.append(matrix.ravel())
        inner = pa.ListArray.from_arrays(pa.array(_bounds(np.repeat(widths, rows)), pa.int32()), pa.array(np.concatenate(found)))
        missing = np.ones(len(signal), bool)
        missing[there] = False
        return pa.ListArray.from_arrays(pa.array(_bounds(rows), pa.int32()), inner, mask=pa.array(missing))

    return spectra


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _padded_window(kind: str | None, n_window: int, n_fft: int, *, periodic: bool) -> np.ndarray:
    left = (n_fft - n_window) // 2
    return np.pad(window(kind, n_window, periodic=periodic), (left, n_fft - n_window - left))


def _size(n_window: int, n_fft: int | None) -> int:
    n_fft = n_fft or 2 ** math.ceil(math.log2(n_window))
    if n_fft < n_window:
        raise ValueError("a window is longer than its transform")
    return n_fft


def spectrogram(*, n_window: int = 320, hop: int = 160, n_fft: int | None = None, kind: str | None = "hann", normalised: bool = True):
    """Column of samples -> frames of the power at each frequency; normalised: the window has unit power."""
    n_fft = _size(n_window, n_fft)
    shape = _padded_window(kind, n_window, n_fft, periodic=True)
    return _udf(lambda x: x, lambda p, _: p / (shape @ shape) if normalised else p, n_fft, hop, shape)


def cepstra(*, rate: int = 16000, n_window: int = 320, hop: int = 160, n_fft: int | None = None, kind: str | None = "hann", bands: int = 64, n_out: int = 64, low: float = 0.0, high: float | None = None, log: bool = True):
    """Column of samples -> frames of the cosine transform of the logarithms of mel bands (1e-6 is
    added; log=False: of 10 * log10, at least 80 below the signal's greatest)."""
    n_fft = _size(n_window, n_fft)
    filters, turn = mel_filters(rate, n_fft, bands, low, high, scale="htk", equal_area=False), cosines(n_out, bands)

    def after(power: np.ndarray, _: int) -> np.ndarray:
        mel = power @ filters.T
        if log:
            return np.log(mel + 1e-6) @ turn.T
        level = 10 * np.log10(np.maximum(mel, 1e-10))
        return np.maximum(level, level.max() - 80) @ turn.T

    return _udf(lambda x: x, after, n_fft, hop, _padded_window(kind, n_window, n_fft, periodic=True))


def mel_features(
    *, rate: int = 16000, n_window: int = 320, hop: int = 160, n_fft: int | None = None, kind: str | None = "hann", emphasis: float | None = 0.97, bands: int = 64, low: float = 0.0, high: float | None = None,
    log: bool = True, guard: str = "add", floor: float = 2.0**-24, splice: int = 1, normalise: str | None = None, mask: bool = False, pad_to: int = 0, pad_value: float = 0.0, magnitude: float = 2.0,
):
    """Column of samples -> frames of mel bands: pre-emphasis, power (or another magnitude of the
    spectrum), triangles of equal area, logarithm of what is raised by `floor` (guard "add") or to it
    ("clamp"). splice repeats a frame's bands; normalise: "per_feature" or "all_features" over the
    frames that count (frame_count()), by the unbiased deviation; mask fills the others with
    pad_value, and pad_to adds such frames up to a multiple."""
    if guard not in ("add", "clamp"):
        raise ValueError(f"no guard {guard!r}")
    n_fft = _size(n_window, n_fft)
    filters = mel_filters(rate, n_fft, bands, low, high)

    def before(x: np.ndarray) -> np.ndarray:
        return x if emphasis is None else np.concatenate([x[:1], x[1:] - emphasis * x[:-1]])

    def after(power: np.ndarray, length: int) -> np.ndarray:
        own = -(-length // hop)
        x = (power if magnitude == 2.0 else power ** (magnitude / 2)) @ filters.T
        if log:
            x = np.log(x + floor if guard == "add" else np.maximum(x, floor))
        x = np.tile(x, (1, splice))
        if normalise:
            axis = 0 if normalise == "per_feature" else None
            valid = x[:own]
            spread = valid.std(axis=axis, ddof=1) if (len(valid) if axis == 0 else valid.size) > 1 else 0.0
            x = (x - valid.mean(axis=axis)) / (spread + 1e-5)
        if mask:
            x[own:] = pad_value
        if pad_to and len(x) % pad_to:
            x = np.concatenate([x, np.full((pad_to - len(x) % pad_to, x.shape[1]), pad_value)])
        return x

    return _udf(before, after, n_fft, hop, _padded_window(kind, n_window, n_fft, periodic=False))
