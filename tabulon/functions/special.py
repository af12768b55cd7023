"""Tail probabilities. Applied to finished test statistics only, never to data rows."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import cache

# The smaller group of an exact test, at most; 840 is the least common multiple of 1..8.
EXACT_GROUP = 8
PERIOD = 840


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _lentz(term, tiny: float = 1e-300, limit: int = 20_000) -> float:
    """Value of b0 + a1/(b1 + a2/(b2 + ...)) with term(i) -> (a_i, b_i)."""
    _, value = term(0)
    value = value or tiny
    c, d = value, 0.0
    for i in range(1, limit):
        a, b = term(i)
        d = 1.0 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        step = c * d
        value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def chi_square_tail(x: float, dof: float) -> float:
    """P(X >= x) for a chi-square variable."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, h = dof / 2.0, x / 2.0
    scale = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1.0:
        total = term = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1.0
            term *= h / k
            total += term
        return max(0.0, 1.0 - scale * total)
    fraction = _lentz(
        lambda i: (0.0, h + 1.0 - a) if i == 0 else (i * (a - i), h + 2.0 * i + 1.0 - a)
    )
    return scale / fraction


def _beta_fraction(a: float, b: float, x: float) -> float:
    def term(i):
        if i == 0:
            return 0.0, 1.0
        m, odd = divmod(i, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return 1.0 / _lentz(term)


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    if dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    if dof > 1e7:
        return normal_two_sided(t)
    return regularised_beta(dof / 2.0, 0.5, dof / (dof + t * t))


@cache
def _partitions_up_to(parts: int) -> list[int]:
    """How many ways sums of 1..parts (each any number of times) give at most k, for small k."""
    counts = [1] * (PERIOD * (parts + 2))  # one free part makes the counts running ones
    for part in range(1, parts + 1):
        for k in range(part, len(counts)):
            counts[k] += counts[k - part]
    return counts


def _running_partitions(parts: int, k: int) -> int:
    """The same for any k: for k = PERIOD * a + r it is a polynomial in a of degree ``parts``."""
    if k < 0:
        return 0
    known = _partitions_up_to(parts)
    if k < len(known):
        return known[k]
    a, r = divmod(k, PERIOD)
    total = Fraction(0)
    for i in range(parts + 1):
        term = Fraction(known[PERIOD * i + r])
        for j in range(parts + 1):
            if j != i:
                term *= Fraction(a - j, i - j)
        total += term
    return int(total)


def rank_sum_tail(m: int, n: int, u: int) -> int:
    """Orderings of m and n distinct values whose U is at most u; m is at most 8, n any size.

    The coefficients are those of the product of (1 - q^(n + i)) / (1 - q^i): at most 2^m
    terms above, running partition counts below.
    """
    m, n = min(m, n), max(m, n)
    above = {0: 1}
    for i in range(1, m + 1):
        grown = dict(above)
        for shift, sign in above.items():
            grown[shift + n + i] = grown.get(shift + n + i, 0) - sign
        above = grown
    return sum(sign * _running_partitions(m, u - shift) for shift, sign in above.items() if shift <= u)


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> tuple[float, str]:
    """Two-sided p-value and the way it was found ("exact" or "normal")."""
    top = max(u, n1 * n2 - u)
    if min(n1, n2) <= EXACT_GROUP and ties == 0:
        tail = rank_sum_tail(n1, n2, n1 * n2 - int(math.ceil(top)))
        return min(1.0, 2 * tail / math.comb(n1 + n2, n1)), "exact"
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))
    if variance <= 0:
        return 1.0, "normal"
    z = (top - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)
    return min(1.0, math.erfc(z / math.sqrt(2.0))), "normal"
