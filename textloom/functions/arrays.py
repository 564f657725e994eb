"""Array and number functions, Column -> Column: shaping of token sequences, masks, softmax,
signals, schedules. Higher-order functions, so they stay inside the JVM."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spectra import mel_features


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def wrap(ids, begin: int | None, end: int | None, *, zero_is_none: bool = False) -> Column:
    """Begin and end ids around a sequence; zero_is_none: an id of 0 counts as none."""
    def use(x):
        return [F.array(F.lit(x))] if x is not None and not (zero_is_none and x == 0) else []

    return F.concat(*use(begin), _c(ids), *use(end))


def pad_right(a, length, value) -> Column:
    a = _c(a)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(0), length - F.size(a))))


def pad_matrix(rows, height, width, value) -> Column:
    """An array of arrays with each row filled to `width` and rows of `value` up to `height`."""
    filled = F.transform(_c(rows), lambda r: pad_right(r, width, value))
    return F.concat(filled, F.array_repeat(F.array_repeat(F.lit(value), width), F.greatest(F.lit(0), height - F.size(_c(rows)))))


def places(length: Column, size: Column) -> Column:
    """1 to length, then zeros up to size."""
    return F.transform(F.array_repeat(F.lit(0), size), lambda _, i: F.when(i < length, i + 1).otherwise(0))


def pad_to(x: Column, k: int) -> Column:
    """The next multiple of k."""
    return x + F.pmod(k - x % k, F.lit(k))


def length_mask(length: Column, size: Column) -> Column:
    """size ones and zeros: ones for the first `length`."""
    return F.concat(F.array_repeat(F.lit(1), F.least(length, size)), F.array_repeat(F.lit(0), F.greatest(F.lit(0), size - length)))


def classifier_tokens(tokens, limit: int, start: str = "[CLS]", stop: str = "[SEP]") -> Column:
    """[CLS] tokens [SEP]; if too long, [CLS] and the last limit - 1."""
    full = F.concat(F.array(F.lit(start)), _c(tokens), F.array(F.lit(stop)))
    return F.when(F.size(full) > limit, F.concat(F.array(F.lit(start)), F.slice(full, -(limit - 1), limit - 1))).otherwise(full)


def pair_keep(a: Column, b: Column, limit: int) -> tuple[Column, Column]:
    """How many tokens of each side stay when the longer loses one at a time (ties: the second)."""
    keep_a = F.when(a + b <= limit, a).otherwise(F.least(a, F.greatest(limit - b, F.lit(math.ceil(limit / 2)))))
    return keep_a, F.when(a + b <= limit, b).otherwise(limit - keep_a)


def span_starts(n: Column, window: int, stride: int) -> Column:
    """Starts of sliding windows over n tokens until the tail is covered; none for n = 0."""
    step = min(window, stride)
    last = F.ceil(F.greatest(n - window, F.lit(0)) / step).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def crop_or_pad(a, length: int, value=0.0) -> Column:
    """The first `length`, or zeros on both sides (an odd one on the right)."""
    a = _c(a)
    lack = F.lit(length) - F.size(a)
    left = F.floor(lack / 2).cast("int")
    padded = F.concat(F.array_repeat(F.lit(value), left), a, F.array_repeat(F.lit(value), lack - left))
    return F.when(lack > 0, padded).otherwise(F.slice(a, 1, length))


def regulate(a, durations: Column, alpha: float = 1.0) -> Column:
    """Element i repeated round-half-even(duration * alpha) times."""
    return F.flatten(F.zip_with(_c(a), durations, lambda x, d: F.array_repeat(x, F.rint(d * alpha).cast("int"))))


def collapse_ctc(ids, blank: int) -> Column:
    """Without blanks and without repeats of the symbol before."""
    ids = _c(ids)
    marked = F.transform(ids, lambda x, i: F.when((x != blank) & ((i == 0) | (x != F.get(ids, i - 1))), x))
    return F.filter(marked, lambda x: x.isNotNull())


def argmax(a) -> Column:
    """Place of the first greatest element, from 0."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def best_places(a, n: int) -> Column:
    """Places of the n greatest elements, greatest first, ties in order."""
    ranked = F.array_sort(F.transform(_c(a), lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, n), lambda r: r["i"])


def softmax(a) -> Column:
    def shares(up):
        return let(total(up), lambda s: F.transform(up, lambda x: x / s))

    return let(F.array_max(_c(a)), lambda most: let(F.transform(_c(a), lambda x: F.exp(x - most)), shares))


def gelu(x: Column) -> Column:
    """x * Phi(x), by the tanh form."""
    return 0.5 * x * (1 + F.tanh(F.lit(math.sqrt(2 / math.pi)) * (x + 0.044715 * x * x * x)))


def rms_db(a) -> Column:
    a = _c(a)
    return 10 * F.log10(total(F.transform(a, lambda x: x * x)) / F.size(a))


def gain(a, db: Column) -> Column:
    return F.transform(_c(a), lambda x: x * F.pow(F.lit(10.0), db / 20))


def pre_emphasis(a, k: float = 0.97) -> Column:
    a = _c(a)
    return F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(x - k * F.get(a, i - 1)))


def splice(a, times: int) -> Column:
    """The frames repeated, unshifted."""
    return F.flatten(F.array_repeat(_c(a), times))


def mask_band(a, start: Column, width: int, value: float = 0.0) -> Column:
    return F.transform(_c(a), lambda x, i: F.when((i >= start) & (i < start + width), F.lit(value)).otherwise(x))


def normalise(a, eps: float = 1e-5) -> Column:
    """(x - mean) / (unbiased standard deviation + eps)."""
    a = _c(a)

    def centred(mean):
        spread = F.sqrt(total(F.transform(a, lambda x: (x - mean) * (x - mean))) / (F.size(a) - 1))
        return let(spread, lambda sd: F.transform(a, lambda x: (x - mean) / (sd + eps)))

    return let(total(a) / F.size(a), centred)


def sinusoid(position: Column, dimensions: int) -> Column:
    """A row of the positional table: sin and cos by turns."""
    def one(i):
        angle = position / F.pow(F.lit(10000.0), 2 * F.floor(i / 2) / F.lit(float(dimensions)))
        return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), one)


def gate_target(length: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i >= length - 1, 1.0).otherwise(0.0))


def find_run(a, run) -> Column:
    """The first place (from 0) where `run`, not empty, stands inside `a`; -1 if nowhere."""
    a, n = _c(a), F.size(run)
    starts = F.when(F.size(a) >= n, F.sequence(F.lit(0), F.size(a) - n)).otherwise(F.array().cast("array<int>"))
    found = F.filter(starts, lambda i: F.slice(a, i + 1, n) == run)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(-1))


def whole_words(pieces, mark: str) -> Column:
    """array<array<string>>: pieces that start with `mark` join the group before them."""
    pieces = _c(pieces)
    begins = F.filter(F.transform(pieces, lambda p, i: F.when((i == 0) | ~p.startswith(mark), i)), lambda i: i.isNotNull())
    return F.transform(begins, lambda i, k: F.slice(pieces, i + 1, F.coalesce(F.get(begins, k + 1), F.size(pieces)) - i))


def scatter(length: Column, places, values, fill) -> Column:
    """An array of `length` with values at their places and `fill` elsewhere; the first place
    that is zero ends the list."""
    places = _c(places)
    zero = F.array_position(places, F.lit(0).cast("int"))
    used = F.when(zero > 0, F.slice(places, F.lit(1), (zero - 1).cast("int"))).otherwise(places)
    at = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.when(F.array_contains(used, i), F.get(values, (F.array_position(used, i) - 1).cast("int"))).otherwise(fill))


def smoothed_cross_entropy(logits, target: Column, smoothing: float = 0.0) -> Column:
    """-log softmax at the target (from 0), the share `smoothing` of it spread over all classes."""
    z = _c(logits)
    top = F.array_max(z)
    log_sum = top + F.log(total(F.transform(z, lambda x: F.exp(x - top))))
    return log_sum - (1 - smoothing) * F.get(z, target.cast("int")) - smoothing * total(z) / F.size(z)


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Straight lines between the points (sorted by x), flat beyond the ends."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0)).otherwise(out)
    return F.when(x <= points[0][0], points[0][1]).otherwise(out)


def mask_fates(a, key: Column, *, seed: int = 0, share: float = 0.15) -> Column:
    """array<string>: what masked-word training does with each element: 'masked' (80 % of
    `share`), 'other' (10 %: to be replaced), 'kept' (10 %: to be predicted) or null. The draw
    is a digest of key, place and seed, so a rerun of a lost task draws the same."""
    first, second, last = (round(1000 * share * x) for x in (0.8, 0.9, 1.0))

    def draw(_, i):
        digest = F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(str(seed))))
        return F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % 1000

    # Draws are an array of their own: a lambda that names one three times makes it three times.
    return F.transform(F.transform(_c(a), draw), lambda u: F.when(u < first, "masked").when(u < second, "other").when(u < last, "kept"))


def learning_rate(kind: str, step: Column, *, base: float, warmup: int, steps: int, least: float = 0.0, power: float = 1.0) -> Column:
    """Closed forms of the usual schedules at a step, after a linear warm-up."""
    x = step.cast("double")
    left = F.greatest(F.lit(0.0), (steps - x) / F.lit(float(steps - warmup)))
    shapes = {
        "constant": F.lit(base),
        "square": F.greatest(F.lit(least), base * (1 - x / steps) * (1 - x / steps)),
        "square_root": F.greatest(F.lit(least), base * F.sqrt(F.greatest(F.lit(0.0), 1 - x / steps))),
        "cosine": least + (base - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(F.lit(1.0), x / steps))),
        "poly": (base - least) * F.pow(F.least(F.lit(1.0), left), F.lit(power)) + least,
        "inverse_square_root": base * F.sqrt(F.lit(float(warmup)) / F.greatest(x, F.lit(float(warmup)))),
    }
    return F.when(x < warmup, base * (x + 1) / (warmup + 1)).otherwise(shapes[kind])


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of two arrays (of tokens), a row of the table at a time. Spark's own
    levenshtein() is for strings; coding tokens as characters would bound how many a row may hold."""

    def one(x, y):
        x, y = ([] if v is None else list(v) for v in (x, y))
        codes = {t: k for k, t in enumerate(dict.fromkeys([*x, *y]))}
        y_codes = np.array([codes[t] for t in y], np.int64)
        steps = np.arange(len(y) + 1)
        row = steps.copy()
        for k, t in enumerate(x, 1):
            new = np.minimum(row + 1, np.concatenate([[k], row[:-1] + (y_codes != codes[t])]))
            row = np.minimum.accumulate(new - steps) + steps
        return int(row[-1])

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


#: Log-mel frames of signals at 16 kHz: pre-emphasis 0.97, 20 ms Hann windows, 10 ms hop,
#: 512-point power spectrum, 64 triangular mel filters, log with a floor of 2^-24.
log_mel = mel_features()
