"""Labels of words on subword pieces, their readout, pair truncation at random ends, and
cuts of a signal. Null arrays give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import pad_right, pair_keep


def _framed(first: Column, body: Column, last: Column, limit: Column, fill: Column) -> Column:
    """first, body, last; if longer than `limit`, first and the end of the rest; if shorter, filled."""
    rest = F.concat(body, F.array(last))
    rest = F.slice(rest, F.greatest(F.size(rest) - limit + 2, F.lit(1)), F.greatest(limit - 1, F.lit(0)))
    return pad_right(F.concat(F.array(first), rest), limit, fill)


def piece_rows(pieces: Column, limit: Column, *, extra: bool = True, ends: bool = True) -> dict[str, Column]:
    """array<array<string>> of the pieces of each word -> tokens, loss mask, mask of first
    pieces and input mask, each of `limit` entries. `extra` and `ends` say whether the loss
    counts later pieces of a word, and [CLS] and [SEP]."""
    zero, one, end = F.lit(0), F.lit(1), F.lit(int(ends))

    def marks(later: int):
        return F.flatten(F.transform(pieces, lambda p: F.transform(p, lambda _, k: F.when(k == 0, 1).otherwise(later))))

    return {
        "tokens": _framed(F.lit("[CLS]"), F.flatten(pieces), F.lit("[SEP]"), limit, F.lit("[PAD]")),
        "loss_mask": _framed(end, marks(int(extra)), end, limit, zero),
        "first_mask": _framed(zero, marks(0), zero, limit, zero),
        "input_mask": _framed(one, marks(1), one, limit, zero),
    }


def piece_labels(pieces: Column, labels: Column, limit: Column, pad: Column) -> Column:
    """The label of each word at all its pieces, `pad` at [CLS], [SEP] and the filling."""
    spread = F.flatten(F.zip_with(pieces, labels, lambda p, v: F.transform(p, lambda _: v)))
    return _framed(pad, spread, pad, limit, pad)


def label_tracks(tokens: Column) -> tuple[Column, Column]:
    """Two-character labels -> the list of first and the list of second characters."""
    return F.transform(tokens, lambda v: F.substring(v, 1, 1)), F.transform(tokens, lambda v: F.substring(v, 2, 1))


def first_piece_readout(words: Column, predicted: Column, mask: Column) -> Column:
    """array of (word, label): the predictions where the mask is above 0.5. Another number
    of them than of words is an error."""
    kept = F.filter(F.arrays_zip(predicted.alias("label"), mask.alias("mask")), lambda x: x["mask"] > 0.5)
    even = F.zip_with(words, kept, lambda w, x: F.struct(w.alias("word"), x["label"].alias("label")))
    wrong = F.raise_error(F.lit("predicted slots and words differ in number"))
    return F.when(F.size(words) == F.size(kept), even).otherwise(wrong)


def truncate_at_random_ends(a: Column, b: Column, limit: int, key: Column, seed: int = 0) -> tuple[Column, Column]:
    """Drops from the longer (ties: the second) until both hold `limit` together; each entry
    goes from the front or the back by a digest of seed, key, side and its number."""
    keep = pair_keep(F.size(a), F.size(b), limit)

    def cut(x, n, side):
        def front(k):
            return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(side), k.cast("string"))), 1, 1) < "8"

        gone = F.size(x) - n
        numbers = F.filter(F.sequence(F.lit(0), F.greatest(gone, F.lit(0))), lambda k: (k < gone) & front(k))
        return F.slice(x, F.size(numbers) + 1, n)

    return cut(a, keep[0], "a"), cut(b, keep[1], "b")


def signal_part(samples: Column, rate: int, offset: Column, seconds: Column) -> Column:
    """From `offset` seconds on for `seconds`, both cut to whole samples; 0 seconds: to the end."""
    start = (F.greatest(offset, F.lit(0.0)) * rate).cast("int")
    n = F.when(seconds > 0, (seconds * rate).cast("int")).otherwise(F.size(samples))
    return F.slice(samples, start + 1, n)


def random_part(samples: Column, n: int, key: Column, seed: int = 0) -> Column:
    """n samples from a place that seed and key decide; shorter signals stay whole."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    start = F.pmod(draw, F.greatest(F.size(samples) - n + 1, F.lit(1))).cast("int")
    return F.when(F.size(samples) > n, F.slice(samples, start + 1, n)).otherwise(samples)


def shift_signal(samples: Column, by: Column) -> Column:
    """Moved by so many samples to the left (below 0: to the right), zeros in the gap; a shift
    beyond the length leaves the signal as it is."""
    inside = (by <= F.size(samples)) & (by >= -F.size(samples))

    def moved(_, i):
        return F.when((i + by >= 0) & (i + by < F.size(samples)), F.get(samples, i + by)).otherwise(0.0)

    return F.when(inside, F.transform(samples, moved)).otherwise(samples)


def floor_log(x: Column) -> Column:
    """Natural logarithm; of 0, a number below all others."""
    return F.when(x == 0, F.lit(-9999999999.0)).otherwise(F.ln(x))


def score_line(score: Column, precisions: list[Column], brevity: Column, hypothesis: Column, reference: Column) -> Column:
    """One line of a corpus score: precisions of each order, brevity penalty, ratio and lengths."""
    parts = F.concat_ws("/", *[F.format_string("%.1f", F.round(p, 1)) for p in precisions])
    ratio = F.round(hypothesis / reference, 3)
    # Fixed value: the line's format.
    return F.format_string(
        "BLEU = %.2f %s(BP = %.3f ratio = %.3f hyp_len = %d ref_len = %d)",
        F.round(score, 2), parts, F.round(brevity, 3), ratio, hypothesis, reference,
    )


def score_signature(settings: dict[str, str], *, short: bool = False) -> str:
    """The settings of a score in the order of their names, joined by `+`."""
    # Names of settings and their short forms.
    brief = {"test": "t", "lang": "l", "smooth": "s", "case": "c", "tok": "tok", "numrefs": "#", "version": "v"}
    return "+".join(f"{brief[k] if short else k}.{settings[k]}" for k in sorted(settings))
