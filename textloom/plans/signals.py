"""Queries of signals: each embedding is one of 64 samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spectra
from ..operators import signals
from .base import query

RATE, WINDOW, FFT, HOP, BANDS, CEPSTRA = 1600, 20, 32, 8, 6, 5


def _signal(t):
    return t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _plain(value, digits: int = 6):
    """Rounded, without a zero's sign."""
    value = F.round(value, digits)
    return F.when(value == 0, 0.0).otherwise(value).alias("value")


def _plain_sql(value: str, digits: int = 6) -> str:
    return f"CASE WHEN round({value}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({value}, {digits}) END AS value"


def _cells(df, column: str, names: tuple[str, str], digits: int = 6):
    """A row for each value of an array of arrays."""
    rows = df.select("vec_id", F.posexplode(column).alias(names[0], "__row")).select("vec_id", names[0], F.posexplode("__row").alias(names[1], "value"))
    return rows.select("vec_id", *[F.col(n).cast("long").alias(n) for n in names], _plain("value", digits))


def _spectra_sql(samples: str, over: int) -> str:
    """(vec_id, frame, bin, power): the transform written out; over: 20 for a periodic window, 19 for a symmetric one."""
    place = f"{HOP} * f + j - {FFT // 2}"
    return f"""x AS (SELECT vec_id, {samples} AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
w AS (SELECT list_transform(range({FFT}), lambda j: CASE WHEN j BETWEEN 6 AND 25 THEN 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (j - 6) / {over}) ELSE 0 END) AS w),
y AS (SELECT vec_id, f AS frame, list_transform(range({FFT}), lambda j: w[j + 1] * v[1 + CASE WHEN {place} < 0 THEN -({place}) WHEN {place} > 63 THEN 126 - ({place}) ELSE {place} END]) AS y FROM x, w, range(9) r(f)),
p AS (SELECT vec_id, frame, k AS bin, pow(list_sum(list_transform(range({FFT}), lambda j: y[j + 1] * cos(2 * pi() * k * j / {FFT}))), 2) + pow(list_sum(list_transform(range({FFT}), lambda j: y[j + 1] * sin(2 * pi() * k * j / {FFT}))), 2) AS power FROM y, range({FFT // 2 + 1}) b(k))"""


def _filters_sql(to_hz: str, top: str, area: str) -> str:
    """(band, bin, h): triangles over `m`, steps of a mel scale."""
    edge = lambda i: to_hz.format(m=f"(({i}) * ({top}) / {BANDS + 1})")
    return f"""g AS (SELECT band, {edge('band')} AS lo, {edge('band + 1')} AS mid, {edge('band + 2')} AS hi FROM range({BANDS}) r(band)),
h AS (SELECT band, bin, greatest(0, least((hz - lo) / (mid - lo), (hi - hz) / (hi - mid))) * {area} AS h FROM g, (SELECT bin, bin * {RATE / 2}::DOUBLE / {FFT // 2} AS hz FROM range({FFT // 2 + 1}) r(bin)))"""


_HTK = _filters_sql("700.0::DOUBLE * (pow(10.0::DOUBLE, {m} / 2595) - 1)", f"2595.0::DOUBLE * log10(1 + {RATE / 2}::DOUBLE / 700)", "1")
_SLANEY = _filters_sql("CASE WHEN {m} < 15 THEN {m} * 200.0::DOUBLE / 3 ELSE 1000.0::DOUBLE * exp(ln(6.4::DOUBLE) / 27 * ({m} - 15)) END", f"{RATE / 2}::DOUBLE * 3 / 200", "2 / (hi - lo)")


@query(f"WITH {_spectra_sql('e', 20)} SELECT vec_id, frame, bin, round(power / (SELECT list_sum(list_transform(w, lambda z: z * z)) FROM w), 6) AS value FROM p")
def spectrogram(t):
    power = spectra.spectrogram(n_window=WINDOW, hop=HOP)
    return _cells(_signal(t).select("vec_id", power("v").alias("s")), "s", ("frame", "bin"))


@query(f"""WITH {_spectra_sql('e', 20)}, {_HTK}, l AS (SELECT vec_id, frame, band, ln(sum(power * h) + 1e-6) AS l FROM p JOIN h USING (bin) GROUP BY ALL)
SELECT vec_id, frame, c AS cepstrum, {_plain_sql('sum(l * cos(pi() / %d * (band + 0.5) * c) * sqrt(2.0 / %d) * CASE WHEN c = 0 THEN sqrt(0.5) ELSE 1 END)' % (BANDS, BANDS))} FROM l, range({CEPSTRA}) r(c) GROUP BY ALL""")
def cepstra(t):
    found = spectra.cepstra(rate=RATE, n_window=WINDOW, hop=HOP, bands=BANDS, n_out=CEPSTRA)
    return _cells(_signal(t).select("vec_id", found("v").alias("s")), "s", ("frame", "cepstrum"))


@query(f"""WITH {_spectra_sql('list_transform(e, lambda z, i: CASE WHEN i = 1 THEN z ELSE z - 0.97::DOUBLE * e[i - 1] END)', 19)}, {_SLANEY},
l AS (SELECT vec_id, frame, band, ln(sum(power * h) + pow(2.0::DOUBLE, -24)) AS l FROM p JOIN h USING (bin) GROUP BY ALL),
s AS (SELECT vec_id, band, avg(l) AS mean, stddev_samp(l) AS spread FROM l WHERE frame < 8 GROUP BY ALL)
SELECT vec_id, frame, band, {_plain_sql('(l - mean) / (spread + 1e-5)', 5)} FROM l JOIN s USING (vec_id, band) WHERE frame < 8
UNION ALL SELECT vec_id, f, b, 0 FROM embeddings, range(8, 16) r(f), range({BANDS}) q(b)""")
def mel_features(t):
    """Normalised bands of the frames that count, then zeros to a multiple of sixteen frames."""
    found = spectra.mel_features(rate=RATE, n_window=WINDOW, hop=HOP, bands=BANDS, normalise="per_feature", mask=True, pad_to=16)
    return _cells(_signal(t).select("vec_id", found("v").alias("s")), "s", ("frame", "band"), 5)


@query("SELECT vec_id, CAST(ceil(len(embedding[:vec_id % 64 + 1]) / 8.0) AS BIGINT) AS frames FROM embeddings")
def frame_counts(t):
    part = F.slice("embedding", 1, (F.col("vec_id") % 64 + 1).cast("int"))
    return t("embeddings").select("vec_id", spectra.frame_count(F.size(part), HOP).alias("frames"))


# ---- perturbations -----------------------------------------------------------------

@query(f"""WITH n AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, embedding::DOUBLE[] AS y, count(*) OVER () AS n FROM embeddings),
d AS (SELECT vec_id, embedding::DOUBLE[] AS x, least(CAST(floor((('0x' || substr(md5('7:' || vec_id), 1, 7))::BIGINT + 0.5::DOUBLE) / 268435456 * (SELECT max(n) FROM n)) AS BIGINT), (SELECT max(n) FROM n) - 1) AS k FROM embeddings)
SELECT vec_id, CAST(i AS BIGINT) AS place, {_plain_sql('list_sum(list_transform(range(greatest(0, i - 63), least(i, 63) + 1), lambda j: x[j + 1] * y[i - j + 1]))')} FROM d JOIN n USING (k), range(127) r(i)""")
def impulse_responses(t):
    """Each signal convolved with a drawn one."""
    responses = _signal(t).select(F.col("vec_id").alias("other"), F.col("v").alias("y"))
    both = signals.with_drawn(_signal(t), "vec_id", responses, "other", seed=7).select("vec_id", signals.convolved("v", "y").alias("c"))
    return both.select("vec_id", F.posexplode("c").alias("place", "value")).select("vec_id", F.col("place").cast("long").alias("place"), _plain("value"))


def _share(seed: str, key: str = "vec_id") -> str:
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 7))::BIGINT + 0.5::DOUBLE) / 268435456)"


@query(f"""WITH n AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, list_concat(embedding::DOUBLE[], embedding::DOUBLE[]) AS y, count(*) OVER () AS n FROM embeddings),
d AS (SELECT vec_id, embedding::DOUBLE[] AS x, least(CAST(floor({_share('11')} * (SELECT max(n) FROM n)) AS BIGINT), (SELECT max(n) FROM n) - 1) AS k, CAST(floor({_share('12')} * 65) AS BIGINT) AS s, 10 + 20 * {_share('13')} AS snr FROM embeddings),
m AS (SELECT vec_id, x, y, s, 10 * log10(list_sum(list_transform(x, lambda z: z * z)) / 64) - 10 * log10(list_sum(list_transform(y, lambda z: z * z)) / 128) - snr AS db FROM d JOIN n USING (k))
SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: (i + 1) * (x[i + 1] + pow(10.0::DOUBLE, db / 20) * y[s + i + 1]))), 5) AS weighed, round(db, 5) AS db,
round(list_max(list_transform(range(64), lambda i: x[i + 1] + pow(10.0::DOUBLE, db / 20) * y[s + i + 1])), 6) AS most FROM m""")
def noisy_signals(t):
    """A noise of twice the length drawn for each signal, 10 to 30 decibels below it."""
    noises = _signal(t).select(F.col("vec_id").alias("other"), F.concat("v", "v").alias("y"))
    mixed = signals.with_noise(_signal(t), "vec_id", "v", noises, "other", "y", low_db=10, high_db=30, seed=11)
    both = signals.with_drawn(_signal(t).withColumnRenamed("v", "x"), "vec_id", noises, "other", 11)
    db = signals.rms_db(F.col("x")) - signals.rms_db(F.col("y")) - signals.between(10, 30, 13, F.col("vec_id"))
    weighed = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return mixed.join(both.select("vec_id", F.round(db, 5).alias("db")), "vec_id").select("vec_id", F.round(weighed, 5).alias("weighed"), "db", F.round(F.array_max("v"), 6).alias("most"))


def _scramble(x: str) -> str:
    for _ in range(3):
        x = f"(xor({x}, ({x}) >> 16) * 73244475 % 2147483647)"
    return f"(({x} + 0.5::DOUBLE) / 2147483648)"


@query(f"""WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS x, ('0x' || substr(md5('21:' || vec_id), 1, 7))::BIGINT AS b FROM embeddings)
SELECT vec_id, i AS place, {_plain_sql(f"x[i + 1] + 0.01::DOUBLE * sqrt(-2 * ln({_scramble('p')})) * cos(2 * pi() * {_scramble('(p + 104729) % 2147483647')})")} FROM (SELECT vec_id, x, i, (b + i * 7919) % 2147483647 AS p FROM d, range(64) r(i))""")
def white_noise(t):
    noisy = _signal(t).select("vec_id", F.posexplode(signals.white_noise(F.col("v"), F.lit(-40.0), 21, F.col("vec_id"))).alias("place", "value"))
    return noisy.select("vec_id", F.col("place").cast("long").alias("place"), _plain("value"))


@query(f"""WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS x, {_share('3000')} < 0.5 AS louder, -10 + 20 * {_share('3001')} AS db, {_share('3002')} < 0.7 AS moved, CAST(floor((-5 + 10 * {_share('3003')}) * 1600 / 1000) AS INT) AS h FROM embeddings),
g AS (SELECT vec_id, CASE WHEN louder THEN list_transform(x, lambda z: z * pow(10.0::DOUBLE, db / 20)) ELSE x END AS x, CASE WHEN moved THEN h ELSE 0 END AS h FROM d)
SELECT vec_id, i AS place, {_plain_sql('CASE WHEN i + h BETWEEN 0 AND 63 THEN x[i + h + 1] ELSE 0 END')} FROM g, range(64) r(i)""")
def augmented_signals(t):
    """Half of the signals louder or softer, then seven in ten moved."""
    out = signals.augmented(_signal(t), "v", "vec_id", [(0.5, signals.gain_step(-10, 10)), (0.7, signals.shift_step(-5, 5, RATE))], seed=3)
    return out.select("vec_id", F.posexplode("v").alias("place", "value")).select("vec_id", F.col("place").cast("long").alias("place"), _plain("value"))


_SINC = "list_sum(list_transform(list_filter(range(64), lambda k: abs(u - k) * 2 / 3 < 16), lambda k: x[k + 1] * 2 / 3 * CASE WHEN u = k THEN 1 ELSE sin(pi() * (u - k) * 2 / 3) / (pi() * (u - k) * 2 / 3) END * (0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * (u - k) * 2 / 3 / 16))))"


@query(f"""WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT vec_id, x, n, n * 3 / 2.0::DOUBLE AS u FROM d, range(43) r(n))
SELECT vec_id, n AS place, {_plain_sql(_SINC)} FROM q""")
def resampled_signals(t):
    """From 24 samples to 16 a second."""
    out = _signal(t).select("vec_id", F.posexplode(signals.resampled(16)("v", F.lit(24))).alias("place", "value"))
    return out.select("vec_id", F.col("place").cast("long").alias("place"), _plain("value"))


@query("SELECT vec_id, CAST(round_even(64 / (0.85 + 0.3 * (vec_id % 7) / 6.0::DOUBLE), 0) AS BIGINT) AS length, true AS bounded FROM embeddings")
def stretched_signals(t):
    """Speeds from 0.85 to 1.15; the samples themselves are held against a plain computation in the tests."""
    speed = F.lit(0.85) + 0.3 * (F.col("vec_id") % 7) / 6.0
    out = _signal(t).select("vec_id", "v", signals.stretched(n_fft=16)("v", speed).alias("s"))
    most = lambda c: F.array_max(F.transform(c, F.abs))
    return out.select("vec_id", F.size("s").cast("long").alias("length"), (most("s") <= 4 * most("v")).alias("bounded"))
