"""Wavelet transforms of one or more levels as array expressions; db4 unless told otherwise.

The series is one ``array<double>`` per row; analysis and synthesis are
``transform`` expressions with the eight taps unrolled, so a whole
denoise stays inside one projection (no explode, no shuffle).

Edges use half-sample symmetric extension: for a series of length n the
index i maps to ``m = i mod 2n`` then ``m if m < n else 2n-1-m``. A filter of f taps
gives ``K = floor((n+f-1)/2)`` coefficients per band. Further levels transform the
approximation of the level before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published db4 decomposition filters.
DB4_LOW = [-0.010597401785069032, 0.0328830116668852, 0.030841381835560764,
           -0.18703481171909309, -0.027983769416859854, 0.6308807679298589,
           0.7148465705529157, 0.2303778133088965]
DB4_HIGH = [-0.2303778133088965, 0.7148465705529157, -0.6308807679298589,
            -0.027983769416859854, 0.18703481171909309, 0.030841381835560764,
            -0.0328830116668852, -0.010597401785069032]
FILTER_LEN = 8
MAD_SCALE = 0.6745
_R3, _UNIT = math.sqrt(3), 4 * math.sqrt(2)
#: Decomposition low-pass filters by name.
LOW = {"haar": [math.sqrt(0.5)] * 2, "db2": [(1 - _R3) / _UNIT, (3 - _R3) / _UNIT, (3 + _R3) / _UNIT, (1 + _R3) / _UNIT], "db4": DB4_LOW}
MODES = ("soft", "hard", "garrote")


def filters(wavelet: str) -> tuple[list[float], list[float]]:
    """(low, high) decomposition filters; the high one is the low one backwards with every other sign changed."""
    if wavelet not in LOW:
        raise ValueError(f"wavelet is one of {', '.join(LOW)}")
    low = LOW[wavelet]
    return low, DB4_HIGH if wavelet == "db4" else [-x if k % 2 == 0 else x for k, x in enumerate(reversed(low))]


def n_coeffs(n: Column, taps: int = FILTER_LEN) -> Column:
    return F.floor((n + F.lit(taps - 1)) / 2).cast("int")


def _ext(i: Column, n: Column) -> Column:
    m = F.pmod(i, n * 2)
    return F.least(m, n * 2 - 1 - m)


def _analysis(x: Column, n: Column, taps: list[float]) -> Column:
    def coeff(k):
        terms = [F.lit(taps[j]) * x[_ext(k * 2 + (1 - j), n)] for j in range(len(taps))]
        acc = terms[0]
        for t in terms[1:]:
            acc = acc + t
        return acc
    return F.transform(F.sequence(F.lit(0), n_coeffs(n, len(taps)) - 1), coeff)


def dwt(x: Column, n: Column | None = None, wavelet: str = "db4") -> tuple[Column, Column]:
    """Approximation and detail coefficients of ``x`` (length n >= 1)."""
    n = F.size(x) if n is None else n
    low, high = filters(wavelet)
    return _analysis(x, n, low), _analysis(x, n, high)


def explode_positions(arr: Column, pos: str = "pos", value: str = "value"):
    """(pos, value) per element of a computed array.

    ``posexplode`` makes the optimizer infer ``size(arr) > 0`` and push it
    below the projections that build ``arr``, inlining the whole array
    computation into joins or filters; the outer variant infers nothing.
    Callers drop the null ``pos`` row that an empty array yields.
    """
    return F.posexplode_outer(arr).alias(pos, value)


def map_with(arr: Column, scalar: Column, fn) -> Column:
    """``transform(arr, v -> fn(v, scalar))`` with ``scalar`` evaluated once.

    A scalar referenced inside a lambda is inlined there by the optimizer
    and re-evaluated per element; repeating it into an array first keeps
    it a single evaluation per row.
    """
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), fn)


def sorted_abs(c: Column) -> Column:
    return F.array_sort(F.transform(c, lambda v: F.abs(v)))


def median_sorted(s: Column) -> Column:
    """Median of an ascending array (mean of the two middle values when even)."""
    k = F.size(s)
    mid = F.floor(k / 2).cast("int")
    return F.when(k % 2 == 1, s[mid]).otherwise((s[mid - 1] + s[mid]) / 2)


def soft(cd: Column, thr: Column) -> Column:
    return map_with(cd, thr, lambda c, t: F.signum(c) * F.greatest(F.abs(c) - t, F.lit(0.0)))


def shrunk(cd: Column, thr: Column, mode: str = "soft") -> Column:
    """Thresholded coefficients: moved towards 0 (soft), kept or dropped (hard), or between the two (garrote)."""
    if mode == "soft":
        return soft(cd, thr)
    if mode == "hard":
        return map_with(cd, thr, lambda c, t: F.when(F.abs(c) < t, F.lit(0.0)).otherwise(c))
    if mode == "garrote":
        return map_with(cd, thr, lambda c, t: F.when(F.abs(c) <= t, F.lit(0.0)).otherwise(c - t * t / c))
    raise ValueError(f"mode is one of {', '.join(MODES)}")


def idwt(ca: Column, cd: Column, n: Column, wavelet: str = "db4") -> Column:
    """Inverse transform cut to the original length n."""
    k_max = F.size(ca) - 1
    low, high = filters(wavelet)

    def sample(t):
        acc = None
        for j in range(len(low)):
            twice_k = t + (j - 1)
            k = F.floor(twice_k / 2).cast("int")
            ok = (twice_k % 2 == 0) & (twice_k >= 0) & (k <= k_max)
            term = F.when(ok, ca[F.when(ok, k).otherwise(0)] * F.lit(low[j])
                          + cd[F.when(ok, k).otherwise(0)] * F.lit(high[j])).otherwise(F.lit(0.0))
            acc = term if acc is None else acc + term
        return acc
    return F.transform(F.sequence(F.lit(0), n - 1), sample)
