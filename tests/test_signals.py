import cmath
import math
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import spectra
from textloom.operators import signals
from textloom.sources import readers


def tone(n, f, rate=1.0):
    return [math.sin(2 * math.pi * f * k / rate) for k in range(n)]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v array<double>").select(column(F.col("v"))).first()[0]


def test_a_tone_stands_at_its_frequency(spark):
    found = one(spark, tone(640, 4 / 32), spectra.spectrogram(n_window=32, hop=16, n_fft=32))
    assert len(found) == 1 + 640 // 16 and {max(range(17), key=row.__getitem__) for row in found[2:-2]} == {4}


@pytest.mark.parametrize("n", [1, 5, 15, 16, 17, 40])
def test_spectrum_equals_the_sum_written_out(spark, n):
    rng = random.Random(n)
    x = [rng.gauss(0, 1) for _ in range(n)]
    found = one(spark, x, spectra.spectrogram(n_window=20, hop=8, n_fft=32, kind="hamming", normalised=False))
    shape = [0.0] * 6 + [0.54 - 0.46 * math.cos(2 * math.pi * k / 20) for k in range(20)] + [0.0] * 6

    def sample(p):
        if n > 16:
            p = -p if p < 0 else 2 * (n - 1) - p if p >= n else p
        return x[p] if 0 <= p < n else 0.0

    assert len(found) == 1 + n // 8
    for f, row in enumerate(found):
        for k, power in enumerate(row):
            z = sum(shape[j] * sample(8 * f + j - 16) * cmath.exp(-2j * math.pi * k * j / 32) for j in range(32))
            assert power == pytest.approx(abs(z) ** 2, abs=1e-9)


def test_filters_and_cosines():
    f = spectra.mel_filters(16000, 512, 64)
    assert f.shape == (64, 257) and (f >= 0).all()
    assert (f.sum(axis=1) * 16000 / 512)[20:] == pytest.approx(1, abs=0.1)  # equal areas
    htk = spectra.mel_filters(16000, 512, 10, scale="htk", equal_area=False)
    assert htk.max() <= 1 and [int(r.argmax()) for r in htk] == sorted(int(r.argmax()) for r in htk)
    assert spectra._to_mel(1000, "slaney") == pytest.approx(15) and spectra._to_mel(6400, "slaney") == pytest.approx(42)
    d = spectra.cosines(8, 8)
    assert d @ d.T == pytest.approx(np.eye(8))
    with pytest.raises(ValueError, match="no window"):
        spectra.window("square", 4, periodic=True)


def test_features_mask_pad_and_edges(spark):
    df = spark.createDataFrame([(1, tone(100, 0.1)), (2, []), (3, None), (4, [1.0])], "k int, v array<double>")
    column = spectra.mel_features(rate=1600, n_window=20, hop=8, bands=4, splice=2, normalise="all_features", mask=True, pad_to=16, pad_value=-1.0)
    got = {r["k"]: r["m"] for r in df.select("k", column("v").alias("m")).collect()}
    assert got[2] is None and got[3] is None
    assert len(got[1]) == 16 and all(len(row) == 8 and row[:4] == row[4:] for row in got[1])
    assert got[1][13:] == [[-1.0] * 8] * 3 and got[4][1:] == [[-1.0] * 8] * 15
    own = np.array(got[1][:13])
    assert own.mean() == pytest.approx(0, abs=1e-9) and own.std(ddof=1) == pytest.approx(1, abs=1e-3)
    clamp = one(spark, [0.0] * 64, spectra.mel_features(rate=1600, n_window=20, hop=8, bands=4, guard="clamp"))
    assert clamp[0] == pytest.approx([math.log(2.0**-24)] * 4)
    quiet = one(spark, tone(200, 0.1), spectra.cepstra(rate=1600, n_window=20, hop=8, bands=6, n_out=6, log=False))
    assert len(quiet[0]) == 6
    with pytest.raises(ValueError, match="guard"):
        spectra.mel_features(guard="none")


def test_resampling_keeps_a_slow_tone(spark):
    x = tone(400, 0.02)
    up = one(spark, x, lambda v: signals.resampled(32)(v, F.lit(16)))
    assert len(up) == 800 and up[100:700] == pytest.approx([math.sin(2 * math.pi * 0.01 * k) for k in range(100, 700)], abs=2e-3)
    down = one(spark, up, lambda v: signals.resampled(16)(v, F.lit(32)))
    assert down[50:350] == pytest.approx(x[50:350], abs=5e-3)
    assert max(map(abs, one(spark, tone(400, 0.45), lambda v: signals.resampled(8)(v, F.lit(16)))[30:170])) < 0.01  # too fast for the new rate
    assert one(spark, x, lambda v: signals.resampled(16)(v, F.lit(16))) == x
    assert one(spark, [], lambda v: signals.resampled(8)(v, F.lit(16))) == [] and one(spark, None, lambda v: signals.resampled(8)(v, F.lit(16))) is None


def plain_stretch(x, rate, n_fft):
    """Frame by frame and frequency by frequency."""
    step, half = n_fft // 4, n_fft // 2
    shape = [0.5 - 0.5 * math.cos(2 * math.pi * k / n_fft) for k in range(n_fft)]
    n = len(x)
    get = lambda p: x[-p if p < 0 else 2 * (n - 1) - p if p >= n else p]
    frames = [[sum(shape[j] * get(t * step + j - half) * cmath.exp(-2j * math.pi * k * j / n_fft) for j in range(n_fft)) for k in range(half + 1)] for t in range(1 + n // step)]
    frames += [[0j] * (half + 1)] * 2
    out, phase, at = [], [cmath.phase(z) if z else 0.0 for z in frames[0]], 0.0
    k_at = 0
    while (at := k_at * rate) < len(frames) - 2:
        left, part = int(at), at - int(at)
        out.append([((1 - part) * abs(a) + part * abs(b)) * cmath.exp(1j * p) for a, b, p in zip(frames[left], frames[left + 1], phase)])
        for k in range(half + 1):
            own = math.pi * step * k / half
            turn = cmath.phase(frames[left + 1][k]) - cmath.phase(frames[left][k]) - own
            phase[k] += own + turn - 2 * math.pi * round(turn / (2 * math.pi))
        k_at += 1
    size = n_fft + step * (len(out) - 1)
    y, w = [0.0] * size, [0.0] * size
    for t, row in enumerate(out):
        full = row + [z.conjugate() for z in row[-2:0:-1]]
        for j in range(n_fft):
            value = sum((z if 0 < k < half or k > half else z.real) * cmath.exp(2j * math.pi * k * j / n_fft) for k, z in enumerate(full)).real / n_fft
            y[t * step + j] += value * shape[j]
            w[t * step + j] += shape[j] ** 2
    y = [a / b if b > 1e-10 else a for a, b in zip(y, w)][half:]
    n = round(len(x) / rate)
    return (y + [0.0] * n)[:n]


@pytest.mark.parametrize("rate", [0.85, 1.0, 1.15, 1.5])
def test_stretching_equals_a_plain_computation(spark, rate):
    rng = random.Random(5)
    x = [v + 0.1 * rng.gauss(0, 1) for v in tone(90, 0.1)]
    found = one(spark, x, lambda v: signals.stretched(n_fft=16)(v, F.lit(rate)))
    assert found == pytest.approx(plain_stretch(x, rate, 16), abs=1e-6)
    if rate == 1.0:
        assert found == pytest.approx(x, abs=1e-6)


def test_stretching_keeps_the_pitch(spark):
    found = np.array(one(spark, tone(4000, 0.05), lambda v: signals.stretched(n_fft=256)(v, F.lit(1.25))))
    assert len(found) == 3200 and abs(np.argmax(np.abs(np.fft.rfft(found[400:2400]))) / 2000 - 0.05) < 0.001
    assert one(spark, [], lambda v: signals.stretched(n_fft=16)(v, F.lit(1.2))) == [] and one(spark, [1.0], lambda v: signals.stretched(n_fft=16)(v, F.lit(0.0))) is None


def test_convolution_and_edges(spark):
    rng = random.Random(1)
    rows = [([rng.gauss(0, 1) for _ in range(n)], [rng.gauss(0, 1) for _ in range(m)]) for n, m in ((1, 1), (5, 3), (3, 9), (0, 3), (40, 17))] + [(None, [1.0])]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select("a", "b", signals.convolved("a", "b").alias("c")).collect()
    for r in got:
        expected = None if r["a"] is None else [sum(r["a"][j] * r["b"][i - j] for j in range(len(r["a"])) if 0 <= i - j < len(r["b"])) for i in range(len(r["a"]) + len(r["b"]) - 1)] if r["a"] else []
        assert r["c"] == (expected if expected is None else pytest.approx(expected, abs=1e-9))


def test_drawn_rows_and_noise(spark):
    df = spark.createDataFrame([(k, tone(30, 0.1)) for k in range(200)] + [(None, [1.0])], "k long, v array<double>")
    noises = spark.createDataFrame([(n, [0.1 * (n + 1)] * (20 + 10 * n)) for n in range(4)], "n long, y array<double>")
    drawn = [(r["k"], r["n"]) for r in signals.with_drawn(df, "k", noises, "n", 3).collect()]
    assert sorted(drawn) == sorted((r["k"], r["n"]) for r in signals.with_drawn(df.repartition(7), "k", noises, "n", 3).collect())
    assert len(drawn) == 200 and min(sum(n == m for _, n in drawn) for m in range(4)) > 25
    mixed = signals.with_noise(df, "k", "v", noises, "n", "y", low_db=20, high_db=20, seed=3)
    assert mixed.columns == ["k", "v"]
    for r in mixed.collect():
        added = np.array(r["v"]) - tone(30, 0.1)
        n = dict(drawn)[r["k"]]
        assert (abs(added) > 1e-12).sum() == min(30, 20 + 10 * n)
        level = 10 * np.log10(np.mean(np.square(tone(30, 0.1)))) - 20
        assert 10 * np.log10(np.mean(np.square(added[:20]))) == pytest.approx(level, abs=1e-6)
    assert signals.with_drawn(df, "k", noises.limit(0), "n").count() == 0


def test_white_noise_and_steps(spark):
    df = spark.range(300).select(F.col("id").alias("k"), F.array_repeat(F.lit(0.0), 100).alias("v"))
    found = df.select(signals.white_noise(F.col("v"), F.lit(-20.0), 4, F.col("k")).alias("v"))
    x = np.array([r["v"] for r in found.collect()]).ravel()
    assert abs(x.mean()) < 0.003 and x.std() == pytest.approx(0.1, abs=0.002) and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.02
    assert np.mean(np.abs(x) > 0.196) == pytest.approx(0.05, abs=0.005)
    ones = df.withColumn("v", F.array_repeat(F.lit(1.0), 10))
    louder = signals.augmented(ones, "v", "k", [(0.3, signals.STEPS["gain"](6, 6))], seed=2).collect()
    assert sum(r["v"][0] != 1.0 for r in louder) == pytest.approx(90, abs=25)
    assert {round(r["v"][0], 6) for r in louder} == {1.0, round(10**0.3, 6)}
    again = signals.augmented(ones, "v", "k", [(0.3, signals.STEPS["gain"](6, 6))], seed=2).collect()
    assert sorted(map(str, louder)) == sorted(map(str, again))
    nothing = signals.augmented(spark.createDataFrame([(1, None)], "k long, v array<double>"), "v", "k", [(1.0, signals.STEPS["shift"](-5, 5, 16000)), (1.0, signals.STEPS["white_noise"](-90, -46))])
    assert nothing.first()["v"] is None


def test_audio_files_at_another_rate(spark, tmp_path):
    for name, rate in (("a", 8000), ("b", 16000)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes((10000 * np.sin(2 * np.pi * 200 * np.arange(rate // 10) / rate)).astype("<i2").tobytes())
    got = {r["path"][-5]: r for r in readers.audio_files(spark, str(tmp_path), rate=16000).collect()}
    assert {len(r["samples"]) for r in got.values()} == {1600} and {r["sample_rate"] for r in got.values()} == {16000}
    assert got["a"]["samples"][100:1500] == pytest.approx(got["b"]["samples"][100:1500], abs=0.002)


def test_a_batch_of_signals_stays_flat():
    import tracemalloc

    import pyarrow as pa

    udf = spectra.cepstra(rate=1000, n_window=20, hop=8, n_fft=32, bands=8, n_out=8).func
    rows = pa.array([[0.5] * 64, None, [], [1.0, None]] * 2000, pa.list_(pa.float64())).slice(4)
    tracemalloc.start()
    found = udf(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x is None for x in found[:4].to_pylist()] == [False, True, True, False] and len(found) == len(rows)
    assert [len(found[0].as_py()), len(found[0].as_py()[0])] == [9, 8]
    assert most < 30e6  # 4,000 matrices of 72 numbers, and one block's frames
