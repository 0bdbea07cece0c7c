"""Tail probabilities for test statistics.

Spark SQL has neither ``erf`` nor the incomplete beta function, so these are pandas
UDFs over NumPy arrays. Both arguments of the beta function's odds are passed (x and
1 - x), and its normalisation uses Stirling differences: nothing cancels at degrees of
freedom of 1e12 and more. A continued fraction that does not converge is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HALF_LOG_2PI = 0.9189385332046727
_EPS = 1e-15


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """lgamma(z) minus its leading Stirling terms, for z of 10 or more."""
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z


def log_gamma(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, dtype=float)
    lift, product = z.copy(), np.ones_like(z)
    for _ in range(10):  # up to 10, where the series is exact to double precision
        low = lift < 10.0
        product = np.where(low, product * np.where(low, lift, 1.0), product)
        lift = np.where(low, lift + 1.0, lift)
    return (lift - 0.5) * np.log(lift) - lift + _HALF_LOG_2PI + _stirling_rest(lift) - np.log(product)


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log B(a, b) without the difference of large log-gammas."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    both = np.maximum(small, 10.0)
    safe = np.maximum(large, 10.0)
    share = small / (small + large)
    rest = _stirling_rest(safe) - _stirling_rest(small + safe)
    one = log_gamma(small) + rest + small - small * np.log(small + large) + (large - 0.5) * np.log1p(-share)
    two = -0.5 * np.log(large) + _HALF_LOG_2PI + _stirling_rest(both) + rest + (small - 0.5) * np.log(share) + large * np.log1p(-share)
    plain = log_gamma(small) + log_gamma(large) - log_gamma(small + large)
    return np.where(small >= 10.0, two, np.where(large >= 10.0, one, plain))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """I_x(a, b) B(a, b) / (x^a y^b), as a continued fraction in the distance from the mean.

    Both x and y = 1 - x enter, and the distance a - (a + b) x = (a + b) y - b is taken
    from the smaller one. All elements advance at once.
    """
    if not len(x):
        return x
    shift = 1.0 + np.where(x < 0.5, a - (a + b) * x, (a + b) * y - b)
    first = 1.0 + 1.0 / a
    above, below = np.ones_like(x), shift / first
    above_before, below_before = np.zeros_like(x), np.ones_like(x)
    ratio = above / below
    limit = 500 + 20 * int(np.sqrt(np.max(np.maximum(a, b))))
    for n in range(1, limit):
        w = n * (b - n) * x
        e = a / (a + 2 * n - 1)
        scale = (1.0 + (n - 1) / a) * (1.0 + (n - 1 + b) / a) * e * e * w * x
        step = n + w / (a + 2 * n - 1) + (1.0 + n / a) / (first + 2 * n / a) * (shift + n * (1.0 + y))
        above, above_before = scale * above_before + step * above, above
        below, below_before = scale * below_before + step * below, below
        above_before, below_before, before = above_before / below, below_before / below, ratio
        ratio = above / below
        above, below = ratio.copy(), np.ones_like(x)
        if np.all(np.abs(ratio - before) <= 4 * _EPS * np.abs(ratio)):
            return ratio
    raise ArithmeticError("the incomplete beta function did not converge")


def incomplete_beta(a, b, x, y=None):
    """Regularised I_x(a, b); ``y`` is 1 - x where the caller knows it better than the difference does."""
    scalar = not any(np.ndim(v) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, dtype=float)) for v in (a, b, x)))
    y = 1.0 - x if y is None else np.broadcast_to(np.atleast_1d(np.asarray(y, dtype=float)), x.shape)
    out = np.full(x.shape, np.nan)
    valid = (a > 0) & (b > 0) & ~np.isnan(x)
    out[valid & (x <= 0)] = 0.0
    out[valid & (y <= 0)] = 1.0
    inside = valid & (x > 0) & (y > 0)
    # The fraction converges fast below the mean; above it the other tail is computed.
    turn = inside & (x >= (a + 1.0) / (a + b + 2.0))
    for mine, p, q, u, v in ((inside & ~turn, a, b, x, y), (turn, b, a, y, x)):
        p, q, u, v = p[mine], q[mine], u[mine], v[mine]
        logs = p * np.where(u > 0.5, np.log1p(-v), np.log(u)) + q * np.where(v > 0.5, np.log1p(-u), np.log(v))
        tail = np.exp(logs - log_beta(p, q)) * _beta_fraction(p, q, u, v)
        out[mine] = 1.0 - tail if mine is turn else tail
    return float(out[0]) if scalar else out


def t_cdf(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    square = np.where(np.isnan(t), np.nan, t * t)
    tail = 0.5 * incomplete_beta(df / 2.0, 0.5, df / (df + square), square / (df + square))
    out = np.where(t > 0, 1.0 - tail, tail)
    return float(out) if out.ndim == 0 else out


def f_sf(f, d1, d2):
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, d1, d2)))
    g = np.where(f > 0, f, np.where(np.isnan(f), np.nan, 0.0))
    out = np.asarray(incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * g), d1 * g / (d2 + d1 * g)))
    return float(out) if out.ndim == 0 else out


def normal_cdf(z):
    """By the incomplete gamma function of z squared over two: a series inside, a continued fraction in the tails."""
    scalar = np.ndim(z) == 0
    z = np.atleast_1d(np.asarray(z, dtype=float))
    half = np.where(np.isnan(z), 0.0, z * z / 2.0)
    tail = np.zeros_like(z)  # P(|Z| > |z|)
    near = half < 1.5
    x = half[near]
    term = total = np.full_like(x, 2.0)
    for n in range(1, 60):
        term = term * x / (n + 0.5)
        total = total + term
    tail[near] = 1.0 - np.sqrt(x) * np.exp(-x) * total / np.sqrt(np.pi)
    x = np.minimum(half[~near], 800.0)
    fraction = np.zeros_like(x)
    for n in range(120, 0, -1):
        fraction = n * (n - 0.5) / (x + 2 * n + 0.5 - fraction)
    tail[~near] = np.exp(-x) * np.sqrt(x / np.pi) / (x + 0.5 - fraction)
    out = np.where(z > 0, 1.0 - tail / 2.0, tail / 2.0)
    out[np.isnan(z)] = np.nan
    return float(out[0]) if scalar else out


# Rational approximation of the normal quantile, relative error 1e-9 (centre, tails).
_CENTRE = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
)
_TAILS = (
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0),
)


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """Quantile of the standard normal distribution, good to nine digits: a place to start from."""
    u = np.asarray(u, dtype=float)
    low = np.minimum(u, 1.0 - u)
    q, r = 0.5 - low, (0.5 - low) ** 2
    centre = q * np.polyval(_CENTRE[0], r) / np.polyval(_CENTRE[1], r)
    t = np.sqrt(-2.0 * np.log(np.maximum(low, 1e-300)))
    tail = -np.polyval(_TAILS[0], t) / np.polyval(_TAILS[1], t)
    return np.copysign(np.where(low < 0.02425, tail, centre), u - 0.5)


_NODES, _NODE_WEIGHTS = np.polynomial.legendre.leggauss(40)
_QUADRATURE = 3_000  # both parameters of the beta function from which the integral is summed at nodes


def _log1p_rest(d: np.ndarray) -> np.ndarray:
    """log(1 + d) - d without cancellation for small d."""
    small = np.where(np.abs(d) < 0.02, d, 0.0)
    series = np.zeros_like(small)
    for i in range(11, 1, -1):
        series = small * series + (-1.0) ** (i + 1) / i
    return np.where(np.abs(d) < 0.02, small * small * series, np.log1p(d) - d)


def _beta_by_nodes(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """I_x(a, b) for large a and b: the density is integrated over 8.5 deviations of the tail, at a fixed number of nodes.

    The density is taken relative to its mode, where the linear terms of both logarithms
    cancel, so the cost and the error do not grow with a and b.
    """
    mode = (a - 1.0) / (a + b - 2.0)
    deviation = np.sqrt(mode * (1.0 - mode) / (a + b - 2.0))
    # The distance from the mode, from the smaller of x and y.
    far = np.where(x < 0.5, x - mode, (b - 1.0) / (a + b - 2.0) - y)
    side = np.where(far < 0, -1.0, 1.0)  # integrate the tail on x's side of the mode
    start = np.minimum(np.abs(far), 13.0 * deviation)
    stop = np.minimum(start + 8.5 * deviation, np.where(side < 0, mode, 1.0 - mode))
    half = (stop - start) / 2.0
    t = side[:, None] * ((start + stop)[:, None] / 2.0 + half[:, None] * _NODES[None, :])
    t = np.clip(t, -mode[:, None] * (1 - 1e-15), (1.0 - mode)[:, None] * (1 - 1e-15))
    shape = (a - 1.0)[:, None] * _log1p_rest(t / mode[:, None]) + (b - 1.0)[:, None] * _log1p_rest(-t / (1.0 - mode)[:, None])
    area = half * (np.exp(shape) @ _NODE_WEIGHTS)
    # log of the density at the mode, by Stirling differences.
    n, k = a + b - 2.0, a - 1.0
    rest = _stirling_rest(n + 1.0) - _stirling_rest(k + 1.0) - _stirling_rest(n - k + 1.0)
    # Stirling's leading terms at z + 1 less those at z: (z + 1/2) log1p(1/z) - 1.
    lift = lambda z: (z + 0.5) * np.log1p(1.0 / z) - 1.0
    top = rest + lift(n) - lift(k) - lift(n - k) + np.log(n + 1.0) + 0.5 * np.log(n / (k * (n - k))) - _HALF_LOG_2PI
    tail = area * np.exp(top)
    return np.where(side < 0, tail, 1.0 - tail)


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """P(X <= k) for X binomial(n, p), 0 < p < 1, per pair of ``k`` and ``n``."""
    k, n = np.asarray(k, dtype=float), np.asarray(n, dtype=float)
    out = np.where(k >= n, 1.0, 0.0)
    inside = (k >= 0) & (k < n)
    a, b = (n - k)[inside], k[inside] + 1.0
    values = np.empty(len(a))
    large = np.minimum(a, b) > _QUADRATURE
    x, y = np.full(len(a), 1.0 - p), np.full(len(a), p)
    values[large] = _beta_by_nodes(a[large], b[large], x[large], y[large])
    values[~large] = incomplete_beta(a[~large], b[~large], x[~large], y[~large]) if (~large).any() else 0.0
    out[inside] = values
    return out


_FEW = 500  # trials up to which summed probabilities are cheaper


def _few_trials(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """``binomial_quantile`` from one table of summed probabilities per distinct ``n``."""
    trials, row = np.unique(n, return_inverse=True)
    logs = log_gamma(np.arange(trials[-1] + 1) + 1.0)
    k, some = np.arange(trials[-1] + 1)[None, :], trials[:, None]
    rest = np.maximum(some - k, 0)
    mass = np.exp(logs[some] - logs[k] - logs[rest] + k * np.log(p) + rest * np.log1p(-p))
    upto = np.cumsum(np.where(k <= some, mass, 0.0), axis=1)
    out = np.empty(len(n), np.int64)
    for r in range(len(trials)):
        mine = row == r
        out[mine] = np.minimum(np.searchsorted(upto[r], u[mine], "left"), trials[r])
    return out


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Smallest k with P(X <= k) >= u for X binomial(n, p), per pair of ``u`` and ``n``.

    The normal quantile with its skewness term names a k; the distribution function is
    evaluated there once; from there the sum walks by the ratio of neighbouring
    probabilities, some steps at most. So the cost does not grow with ``n``.
    """
    n, u = np.asarray(n, dtype=np.int64), np.asarray(u, dtype=float)
    if p <= 0.0 or p >= 1.0:
        return n * int(p >= 1.0)
    if n.max(initial=0) <= _FEW:
        return _few_trials(u, n, p) if len(n) else n
    q = 1.0 - p
    z = normal_quantile(u)
    guess = n * p + z * np.sqrt(n * p * q) + (q - p) * (z * z - 1.0) / 6.0 - 0.5
    k = np.clip(np.rint(guess), 0, n).astype(np.int64)
    upto = binomial_cdf(k, n, p)
    mass = np.exp(k * np.log(p) + (n - k) * np.log1p(-p) - np.log(n + 1.0) - log_beta(k + 1.0, n - k + 1.0))
    rising = upto < u
    while True:
        up = np.flatnonzero(rising & (upto < u) & (k < n))
        if not len(up):
            break
        mass[up] *= (n[up] - k[up]) / (k[up] + 1.0) * (p / q)
        k[up] += 1
        upto[up] += mass[up]
    while True:
        down = np.flatnonzero(~rising & (k > 0) & (upto - mass >= u))
        if not len(down):
            break
        upto[down] -= mass[down]
        mass[down] *= k[down] / (n[down] - k[down] + 1.0) * (q / p)
        k[down] -= 1
    return k


@F.pandas_udf(T.DoubleType())
def _normal_cdf_udf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(z.to_numpy(float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def _t_cdf_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_cdf(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)))


def normal_cdf_col(z: Column) -> Column:
    return _normal_cdf_udf(z.cast("double"))


def t_cdf_col(t: Column, df: Column) -> Column:
    return _t_cdf_udf(t.cast("double"), df.cast("double"))


def two_sided_normal(z: Column) -> Column:
    return 2.0 * normal_cdf_col(-F.abs(z))


def one_sided(two_sided: Column, in_direction: Column) -> Column:
    """Halve a two-sided p-value in the hypothesised direction."""
    return F.when(in_direction, two_sided / 2.0).otherwise(1.0 - two_sided / 2.0)
