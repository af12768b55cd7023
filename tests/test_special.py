import itertools
import math

import pytest

from tabulon.functions import special


def test_chi_square_closed_forms():
    for x in (0.1, 1.0, 3.0, 10.0, 60.0):
        assert special.chi_square_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert special.chi_square_tail(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-12)
        assert special.chi_square_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
    assert special.chi_square_tail(0, 3) == 1.0


def test_t_closed_forms():
    for t in (0.2, 1.0, 4.0, 30.0):
        assert special.t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)
        assert special.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
    assert special.t_two_sided(1.96, 1e9) == pytest.approx(special.normal_two_sided(1.96), rel=1e-6)
    assert special.t_two_sided(1.3, 9.9e6) == pytest.approx(special.normal_two_sided(1.3), rel=1e-5)


@pytest.mark.parametrize("m,n", [(1, 1), (2, 3), (4, 5)])
def test_rank_sum_tail_by_enumeration(m, n):
    seen = [0] * (m * n + 1)
    for places in itertools.combinations(range(1, m + n + 1), m):
        seen[sum(places) - m * (m + 1) // 2] += 1
    assert [special.rank_sum_tail(m, n, u) for u in range(m * n + 1)] == list(itertools.accumulate(seen))
    assert sum(seen) == math.comb(m + n, m)


@pytest.mark.parametrize("m,n", [(2, 5000), (3, 4001), (8, 3000), (8, 10**7)])
def test_rank_sum_tail_of_large_groups(m, n):
    """The whole, and the half that symmetry gives."""
    assert special.rank_sum_tail(m, n, m * n) == math.comb(m + n, m)
    middle = m * n // 2
    low = special.rank_sum_tail(m, n, middle - 1)
    rest = special.rank_sum_tail(m, n, m * n - middle)
    assert low + rest == math.comb(m + n, m)


def test_exact_or_normal():
    assert special.mann_whitney_p(0, 5, 5, 0) == (pytest.approx(2 / 252), "exact")
    assert special.mann_whitney_p(0, 5, 5, 6)[1] == "normal"
    assert special.mann_whitney_p(50, 10, 10, 0)[1] == "normal"
    p, method = special.mann_whitney_p(5 * 10**6, 8, 10**6, 0)
    assert method == "exact" and p == pytest.approx(special.mann_whitney_p(5 * 10**6, 8, 10**6, 6)[0], rel=0.05)
    assert special.mann_whitney_p(12.5, 5, 5, 990)[0] == 1.0
