"""db4 transform: NumPy convolution form, perfect reconstruction, denoise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadspeed.functions import wavelet as W
from roadspeed.operators import denoise as D


def _np_dwt(x):
    """Half-sample symmetric padding by 7, full convolution, keep every
    second sample starting at 8."""
    n = len(x)
    k = (n + 7) // 2
    ext = np.pad(x, (7, 7), mode="symmetric") if n >= 7 else _sym_pad(x, 7)
    lo = np.convolve(ext, W.DB4_LOW)[8:8 + 2 * k:2]
    hi = np.convolve(ext, W.DB4_HIGH)[8:8 + 2 * k:2]
    return lo, hi


def _sym_pad(x, p):
    n = len(x)
    idx = np.arange(-p, n + p)
    m = np.mod(idx, 2 * n)
    return x[np.where(m < n, m, 2 * n - 1 - m)]


@pytest.mark.parametrize("n", [1, 4, 9, 40, 95, 96])
def test_dwt_and_reconstruction(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(10, 3, n)
    df = spark.createDataFrame([(x.tolist(),)], "s array<double>")
    ca, cd = W.dwt(F.col("s"))
    row = df.select(ca.alias("ca"), cd.alias("cd")).first()
    lo, hi = _np_dwt(x)
    assert np.allclose(row.ca, lo, atol=1e-12) and np.allclose(row.cd, hi, atol=1e-12)
    back = df.select(ca.alias("ca"), cd.alias("cd")).select(
        W.idwt(F.col("ca"), F.col("cd"), F.lit(n)).alias("y")).first().y
    assert np.allclose(back, x, atol=1e-10)


def test_denoise_zero_threshold_is_identity(spark):
    x = [5.0] * 40            # constant: all details vanish, threshold 0
    df = spark.createDataFrame([(1, x)], "segment_index long, series array<double>")
    y = D.denoise(df, "series", scale=None).first().denoised
    assert np.allclose(y, x, atol=1e-10)


def test_denoise_shrinks_noise(spark):
    rng = np.random.default_rng(0)
    t = np.arange(96)
    clean = 30 + 5 * np.sin(t / 10)
    noisy = clean + rng.normal(0, 2, 96)
    df = spark.createDataFrame([(1, noisy.tolist())], "segment_index long, series array<double>")
    y = np.array(D.denoise(df, "series", scale=None).first().denoised)
    assert np.mean((y - clean) ** 2) < np.mean((noisy - clean) ** 2)


def test_denoise_empty_series_is_null(spark):
    df = spark.createDataFrame([(1, []), (2, [1.0, 2.0, 3.0])], "segment_index long, series array<double>")
    got = {r.segment_index: r.denoised for r in D.denoise(df, "series", scale=None).collect()}
    assert got[1] is None and len(got[2]) == 3


def _np_level(x, low):
    f = len(low)
    high = [v * (1 if j % 2 else -1) for j, v in enumerate(reversed(low))]
    ext = _sym_pad(x, f - 1)
    k = (len(x) + f - 1) // 2
    return np.convolve(ext, low)[f:f + 2 * k:2], np.convolve(ext, high)[f:f + 2 * k:2]


@pytest.mark.parametrize("wavelet", ["haar", "db2", "db4"])
def test_levels_equal_numpy_and_come_back(spark, wavelet):
    rng = np.random.default_rng(3)
    rows = [(n, rng.normal(20, 5, n).tolist()) for n in (1, 2, 5, 17, 40, 96)]
    df = spark.createDataFrame(rows + [(0, []), (-1, None)], "segment_index long, series array<double>")
    got = {r.segment_index: r for r in D.synthesise(D.analyse(df, "series", wavelet, 3), "series", "back", wavelet, 3).collect()}
    assert got[0].back is None and got[-1].d2 is None
    for n, x in rows:
        a = np.array(x)
        for k in (1, 2, 3):
            a, d = _np_level(a, W.LOW[wavelet])
            assert np.allclose(got[n][f"a{k}"], a, atol=1e-9) and np.allclose(got[n][f"d{k}"], d, atol=1e-9)
        assert np.allclose(got[n].back, x, atol=1e-9)  # threshold 0: perfect reconstruction


@pytest.mark.parametrize("mode", W.MODES)
def test_modes_and_defaults(spark, mode):
    rng = np.random.default_rng(9)
    x = 30 + 5 * np.sin(np.arange(64) / 9) + rng.normal(0, 2, 64)
    df = spark.createDataFrame([(1, x.tolist())], "segment_index long, series array<double>")
    a, details = x, []
    for _ in range(2):
        a, d = _np_level(a, W.DB4_LOW)
        details.append(d)
    t = np.median(np.abs(details[0])) / W.MAD_SCALE * np.sqrt(2 * np.log(64))
    kept = {"soft": lambda d: np.sign(d) * np.maximum(np.abs(d) - t, 0), "hard": lambda d: np.where(np.abs(d) < t, 0, d),
            "garrote": lambda d: np.where(np.abs(d) <= t, 0, d - t * t / d)}[mode]
    shrunk = spark.createDataFrame([(x.tolist(), a.tolist(), *[kept(d).tolist() for d in details])],
                                   "series array<double>, a2 array<double>, d1 array<double>, d2 array<double>")
    want = D.synthesise(shrunk, "series", "back", "db4", 2).first().back
    got = D.denoise(df, "series", scale=None, level=2, mode=mode).first().denoised
    assert np.allclose(got, want, atol=1e-9)
    assert D.denoise(df).columns == ["segment_index", "series", "denoised"]


def test_unknown_parameters_raise(spark):
    df = spark.createDataFrame([(1, [1.0])], "segment_index long, series array<double>")
    for how in {"wavelet": "db9"}, {"mode": "firm"}, {"level": 0}:
        with pytest.raises(ValueError):
            D.denoise(df, **how)
