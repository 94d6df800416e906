"""Distribution functions in plain Python, for rows that are already aggregated (dozens, never data rows)."""

from __future__ import annotations

import math


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t > 0 else 1 - tail


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the tail."""
    if not 0 < p < 1 or df <= 0:
        return math.nan
    if p < 0.5:
        return -t_ppf(1 - p, df)
    lo, hi = 0.0, 1.0
    while t_sf(hi, df) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_sf(mid, df) > 1 - p else (lo, mid)
        if hi - lo <= 1e-15 * hi:
            break
    return (lo + hi) / 2


def wilcoxon_exact(n: int, w: float) -> float:
    """Two-sided p of the signed-rank sum ``w`` of ``n`` differences without ties or zeros."""
    ways = [1]
    for k in range(1, n + 1):
        ways = [(ways[i] if i < len(ways) else 0) + (ways[i - k] if 0 <= i - k < len(ways) else 0) for i in range(len(ways) + k)]
    total = n * (n + 1) // 2
    low = sum(ways[: int(min(w, total - w)) + 1])
    return min(1.0, 2 * low / 2**n)


def wilcoxon_normal(n: int, w: float, ties: float) -> float:
    """Two-sided p by the normal approximation; ``ties`` is the sum of t**3 - t over groups of equal ranks."""
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 2 * norm_sf(abs(w - n * (n + 1) / 4) / math.sqrt(var)) if var > 0 else math.nan
