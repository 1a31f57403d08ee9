"""Tail probabilities by series and continued fractions; used on result rows only."""

from __future__ import annotations

import math

_TINY = 1e-300


def _lentz(terms, first: float) -> float:
    """Modified Lentz evaluation of ``first + a1 / (b1 + a2 / (b2 + ...))``."""
    f = first or _TINY
    c, d = f, 0.0
    for a, b in terms:
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        step = c * d
        f *= step
        if abs(step - 1.0) < 1e-15:
            break
    return f


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def terms():
        yield 1.0, 1.0
        for m in range(0, 20000):
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return min(1.0, front * _lentz(terms(), 0.0))


def gamma_tail(s: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)

    def terms():
        yield 1.0, x + 1.0 - s
        for i in range(1, 20000):
            yield -i * (i - s), x + 2 * i + 1.0 - s

    return scale * _lentz(terms(), 0.0)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    """By bisection on the tail; exact to rounding."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1.0 - normal_tail(mid) < p else (lo, mid)
    return (lo + hi) / 2


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return gamma_tail(df / 2.0, x / 2.0)


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p without ties: subsets are counted by size and rank sum."""
    ways = [[0] * (n1 * n2 + 1) for _ in range(n1 + 1)]
    ways[0][0] = 1
    for item in range(n1 + n2):
        for k in range(min(n1, item + 1), 0, -1):
            gain = item - (k - 1)  # rank above the k-1 smaller members
            if gain > n2:
                continue
            for s in range(n1 * n2, gain - 1, -1):
                ways[k][s] += ways[k - 1][s - gain]
    most = max(u, n1 * n2 - u)
    tail = sum(ways[n1][math.ceil(most - 1e-9):])
    return min(1.0, 2.0 * tail / math.comb(n1 + n2, n1))


def approximate_power(effect: float, n: float, alpha: float = 0.05, mann_whitney: bool = False) -> float:
    """Normal approximation for two groups of ``n``; a rank test counts 0.955 of it."""
    n = n * 0.955 if mann_whitney else n
    shift, z = effect / math.sqrt(2.0 / n), normal_quantile(1.0 - alpha / 2.0)
    return normal_tail(z - shift) + normal_tail(z + shift)


def sample_size(effect: float, power: float = 0.8, alpha: float = 0.05, mann_whitney: bool = False) -> int:
    """Smallest n from 5 that reaches the power, 10000 where none below does."""
    lo, hi = 5, 10_000
    while lo < hi:  # power grows with n
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if approximate_power(effect, mid, alpha, mann_whitney) >= power else (mid + 1, hi)
    return lo


def kendall_two_sided(n: int, num: float, x0: float, x1: float, x2: float, y0: float, y1: float, y2: float) -> float | None:
    """p of concordant minus discordant pairs ``num``; tie sums t(t-1)/2, t(t-1)(t-2), t(t-1)(2t+5) of both columns.

    Exact without ties up to 33 rows (or with at most one pair out of order), else normal.
    """
    pairs = n * (n - 1) / 2
    if n < 2 or x0 == pairs or y0 == pairs:
        return None
    least = round((pairs - abs(num)) / 2)
    if x0 == 0 and y0 == 0 and (n <= 33 or least <= 1):
        if n > 170:
            return 0.0
        ways = [1]  # permutations by inversions
        for j in range(2, n + 1):
            ways = [sum(ways[max(0, i - j + 1) : i + 1]) for i in range(min(least, len(ways) + j - 2) + 1)]
        return min(1.0, 2 * sum(ways) / math.factorial(n))
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - x2 - y2) / 18 + 2 * x0 * y0 / m + (x1 * y1 / (9 * m * (n - 2)) if n > 2 else 0.0)
    return min(1.0, 2 * normal_tail(abs(num) / math.sqrt(var))) if var > 0 else 1.0
