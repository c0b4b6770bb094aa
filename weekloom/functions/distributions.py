"""Distribution functions for p-values, in plain Python; they run on tens of rows."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def student_two_sided(t: float | None, df: float | None) -> float | None:
    if t is None or df is None or df <= 0 or math.isnan(t):
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi_square_tail(x: float | None, df: float | None) -> float | None:
    """Upper tail of the chi-square distribution (regularised upper incomplete gamma function)."""
    if x is None or df is None or df <= 0:
        return None
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    front = math.exp(a * math.log(y) - y - math.lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= y / n
            total += term
        return 1 - front * total
    b, c = y + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def signed_rank_exact(statistic: float, n: int) -> float:
    """Two-sided p of the smaller rank sum when n differences have no ties and no zeros."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for k in range(1, n + 1):
        for s in range(len(ways) - 1, k - 1, -1):
            ways[s] += ways[s - k]
    return min(1.0, 2 * sum(ways[: int(statistic) + 1]) / 2**n)


def range_quantile(alpha: float, k: int) -> float:
    """Upper quantile of the range of k standard normals over the square root of 2 (infinite degrees of freedom)."""
    pdf, cdf = NORMAL.pdf, NORMAL.cdf

    def below(q: float, steps: int = 4000) -> float:
        low, high = -8.5, 8.5
        width = (high - low) / steps
        return k * width * math.fsum(pdf(low + (i + 0.5) * width) * (cdf(low + (i + 0.5) * width) - cdf(low + (i + 0.5) * width - q)) ** (k - 1) for i in range(steps))

    low, high = 0.0, 12.0
    while high - low > 1e-10:
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < 1 - alpha else (low, middle)
    return low / math.sqrt(2)
