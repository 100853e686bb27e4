"""Special functions and distribution tails (NumPy has none of them).

Array versions run inside Arrow batches; the scalar tail functions are for
p-values of finished test statistics.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_TINY = 1e-300
_EPS = 1e-15


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _lift(x, floor=10.0):
    """Shift every argument above ``floor``; returns (shifted, list of visited arguments)."""
    z = np.array(x, dtype=float, ndmin=1)
    visited = []
    while np.any(z < floor):
        low = z < floor
        visited.append((low, z.copy()))
        z = np.where(low, z + 1.0, z)
    return z, visited


def lgamma(x):
    z, visited = _lift(x)
    r = 1.0 / (z * z)
    out = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi)
    out += (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z
    for low, at in visited:
        out -= np.where(low, np.log(at), 0.0)
    return out.reshape(np.shape(x))


def digamma(x):
    z, visited = _lift(x)
    r = 1.0 / (z * z)
    out = np.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    for low, at in visited:
        out -= np.where(low, 1.0 / at, 0.0)
    return out.reshape(np.shape(x))


def trigamma(x):
    z, visited = _lift(x)
    r = 1.0 / (z * z)
    out = 1 / z + 0.5 * r + r / z * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))
    for low, at in visited:
        out += np.where(low, 1.0 / (at * at), 0.0)
    return out.reshape(np.shape(x))


def gamma_cdf(a, x):
    """Regularised lower incomplete gamma P(a, x), elementwise."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    shape = a.shape
    a, x = a.ravel(), np.maximum(x.ravel(), 0.0)
    out = np.zeros(a.shape)
    front = np.exp(a * np.log(np.maximum(x, _TINY)) - x - lgamma(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        al, xl = a[low], x[low]
        term = 1.0 / al
        total, k = term.copy(), al.copy()
        for _ in range(100_000):
            k += 1
            term = term * xl / k
            total += term
            if np.all(term < total * _EPS):
                break
        out[low] = front[low] * total
    high = x >= a + 1
    if high.any():
        ah, xh = a[high], x[high]
        b = xh + 1 - ah
        c = np.full(b.shape, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, 100_000):
            step = -i * (i - ah)
            b = b + 2
            d = 1 / _nonzero(step * d + b)
            c = _nonzero(b + step / c)
            ratio = c * d
            h *= ratio
            if np.all(np.abs(ratio - 1) < _EPS * 4):
                break
        out[high] = 1 - front[high] * h
    return np.clip(out, 0, 1).reshape(shape)


def _nonzero(v):
    return np.where(np.abs(v) < _TINY, _TINY, v)


def beta_cdf(x, a, b):
    """Regularised incomplete beta I_x(a, b), elementwise."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    shape = x.shape
    x, a, b = (v.ravel() for v in (x, a, b))
    mirror = x > (a + 1) / (a + b + 2)
    xx = np.where(mirror, 1 - x, x)
    aa, bb = np.where(mirror, b, a), np.where(mirror, a, b)
    inside = (xx > 0) & (xx < 1)
    safe = np.where(inside, xx, 0.5)
    front = np.exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * np.log(safe) + bb * np.log1p(-safe)) / aa
    c = np.ones(x.shape)
    d = 1 / _nonzero(1 - (aa + bb) * safe / (aa + 1))
    h = d.copy()
    for m in range(1, 100_000):
        even = m * (bb - m) * safe / ((aa + 2 * m - 1) * (aa + 2 * m))
        d = 1 / _nonzero(1 + even * d)
        c = _nonzero(1 + even / c)
        h *= d * c
        odd = -(aa + m) * (aa + bb + m) * safe / ((aa + 2 * m) * (aa + 2 * m + 1))
        d = 1 / _nonzero(1 + odd * d)
        c = _nonzero(1 + odd / c)
        h *= d * c
        if np.all(np.abs(d * c - 1) < _EPS * 4):
            break
    part = np.where(inside, front * h, np.where(xx <= 0, 0.0, 1.0))
    return np.clip(np.where(mirror, 1 - part, part), 0, 1).reshape(shape)


def normal_cdf(z):
    z = np.asarray(z, float)
    half = 0.5 * gamma_cdf(0.5, 0.5 * z * z)
    return np.where(z >= 0, 0.5 + half, 0.5 - half)


def negbin_cdf(y, mu, size):
    """P(Y <= y) of a negative binomial with mean mu and size k, a Poisson one if k is infinite; 0 for y < 0."""
    if np.isinf(size):
        return poisson_cdf(y, mu)
    y = np.floor(np.asarray(y, float))
    p = beta_cdf(size / (size + mu), size, np.maximum(y, 0) + 1)
    return np.where(y < 0, 0.0, p)


def poisson_cdf(y, mu):
    y = np.floor(np.asarray(y, float))
    return np.where(y < 0, 0.0, 1 - gamma_cdf(np.maximum(y, 0) + 1, mu))


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for X ~ chi-squared(df), by the finite sums for integer df."""
    if df <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, df // 2):
            term *= h / k
            total += term
        return math.exp(-h) * total
    total = 0.0
    term = 2 * math.sqrt(h / math.pi)
    for k in range((df - 1) // 2):
        total += term
        term *= h / (k + 1.5)
    return math.erfc(math.sqrt(h)) + math.exp(-h) * total


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_two_sided(t: float, df: float) -> float:
    return float(beta_cdf(df / (df + t * t), df / 2, 0.5))


def f_tail(f: float, df1: float, df2: float) -> float:
    if f <= 0:
        return 1.0
    return float(beta_cdf(df2 / (df2 + df1 * f), df2 / 2, df1 / 2))


def ks_tail(d: float, n: float) -> float:
    """Asymptotic P(D_n > d) of the one-sample Kolmogorov-Smirnov statistic."""
    root = math.sqrt(n)
    lam = (root + 0.12 + 0.11 / root) * d
    if lam < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Exact binomial test: probability of all counts that are not likelier than k. Tails are beta integrals, so n may be large."""
    if not 0 < p < 1:
        return 1.0 if k == (n if p >= 1 else 0) else 0.0

    def log_pmf(j: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)

    def upto(j: int) -> float:
        return 0.0 if j < 0 else 1.0 if j >= n else float(beta_cdf(1 - p, n - j, j + 1))

    def beyond(j: int) -> float:
        return 1.0 if j <= 0 else 0.0 if j > n else float(beta_cdf(p, j, n - j + 1))

    mode, bar = min(int((n + 1) * p), n), log_pmf(k) + 1e-7
    low, high = (mode, n + 1) if k < mode else (-1, mode)
    while high - low > 1:                            # the first unlikely count beyond the mode, on the other side
        middle = (low + high) // 2
        if (log_pmf(middle) <= bar) == (k < mode):
            high = middle
        else:
            low = middle
    if log_pmf(mode) <= bar:
        return 1.0
    return min(1.0, upto(k) + beyond(high) if k < mode else upto(low) + beyond(k))


def uniform_variance_p(variance: float, n: int) -> float:
    """Two-sided p-value of the sample variance of n independent uniforms, by its normal limit."""
    if n < 4:
        return math.nan
    spread = math.sqrt((1 / 80 - (n - 3) / (n - 1) / 144) / n)
    return normal_two_sided((variance - 1 / 12) / spread)
