"""Tail probabilities that the finishing steps of the tests need; a few numbers each, no data."""

from __future__ import annotations

import math


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Closed form for integer degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = 1.0
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) / math.sqrt(math.pi * half)
    for k in range(1, (df + 1) // 2):
        term *= half / (k - 0.5)
        total += term
    return total


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    out = d
    for m in range(1, 500_000):  # about the root of the larger parameter suffices
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_tail(t: float, df: float) -> float:
    """P(T > t)."""
    p = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return p if t >= 0 else 1 - p


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k), by the incomplete beta function."""
    if k <= 0 or k > n:
        return float(k <= 0)
    return beta_inc(k, n - k + 1, p)


def sign_p(positive: int, negative: int) -> float:
    """Two-sided exact sign test without ties."""
    n = positive + negative
    return 1.0 if n == 0 else min(1.0, 2 * (1 - binomial_tail(min(positive, negative) + 1, n)))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: tables no likelier than the one seen."""
    row, col, n = a + b, a + c, a + b + c + d
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    log = lambda x: choose(row, x) + choose(n - row, col - x) - choose(n, col)
    seen = log(a)
    return min(1.0, math.fsum(math.exp(v) for x in range(max(0, col + row - n), min(row, col) + 1) if (v := log(x)) <= seen + 1e-9))


def binomial_greater(k: int, n: int, p: float) -> float:
    """P(X >= k) of the one-sided test."""
    return binomial_tail(k, n, p)


def finished(rows, schema: str, **columns):
    """``rows``, a few result rows, with further columns: each a function of a row as a dict, giving a double."""
    import pandas as pd

    def run(frames):
        for f in frames:
            records = f.to_dict("records")
            for name, value in columns.items():
                f[name] = pd.Series([value(r) for r in records], dtype="float64", index=f.index)
            yield f

    kinds = ", ".join([schema, *(f"{c} double" for c in columns)])
    return rows.mapInPandas(run, kinds)


def normal_quantile(p: float) -> float:
    """The z with P(Z <= z) = p, by Newton steps from the middle or the tail's leading term."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    if p > 0.5:
        return -normal_quantile(1 - p)
    z = 0.0 if p > 0.05 else -math.sqrt(-2 * math.log(p))
    for _ in range(60):
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        step = (normal_tail(-z) - p) / density
        step /= max(0.5, 1 + z * step / 2)  # the curvature, kept from turning the step round
        z -= step
        if abs(step) < 1e-14 * max(1.0, abs(z)):
            break
    return z


# Royston's polynomials (1995) for the coefficients of the two extremes and for the distribution of W.
_EXTREME = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
_SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
_SMALL_GAMMA = (-2.273, 0.459)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
_SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(values) -> tuple[float, float]:
    """W and p of Shapiro and Wilk's test for 3 to 5,000 values."""
    x = sorted(map(float, values))
    n = len(x)
    if not 3 <= n <= 5000 or x[0] == x[-1]:
        return math.nan, math.nan
    m = [normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    square, root = math.fsum(v * v for v in m), math.sqrt(n)
    poly = lambda c, u, top: sum(v * u ** (top - k) for k, v in enumerate(c))
    last = poly(_EXTREME, 1 / root, 5) + m[-1] / math.sqrt(square)
    if n == 3:
        a = [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    elif n <= 5:
        scale = math.sqrt((square - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a = [-last, *(v / scale for v in m[1:-1]), last]
    else:
        second = poly(_SECOND, 1 / root, 5) + m[-2] / math.sqrt(square)
        scale = math.sqrt((square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        a = [-last, -second, *(v / scale for v in m[2:-2]), second, last]
    mean = math.fsum(x) / n
    w = min(1.0, math.fsum(c * v for c, v in zip(a, x, strict=True)) ** 2 / math.fsum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    rising = lambda c, u: sum(v * u**k for k, v in enumerate(c))
    log = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = rising(_SMALL_GAMMA, n)
        if log >= gamma:
            return w, 0.0
        z = (-math.log(gamma - log) - rising(_SMALL_MEAN, n)) / math.exp(rising(_SMALL_LOG_SD, n))
    else:
        z = (log - rising(_LARGE_MEAN, math.log(n))) / math.exp(rising(_LARGE_LOG_SD, math.log(n)))
    return w, normal_tail(z)
