import math

import numpy as np
import pytest

from cohortloom.functions import tails as T


def t_sf_closed(t, df):
    """Closed forms for one and two degrees of freedom."""
    if df == 1:
        return 0.5 - math.atan(t) / math.pi
    return 0.5 - t / (2 * math.sqrt(2 + t * t))


@pytest.mark.parametrize("df", [1, 2])
@pytest.mark.parametrize("t", [-3.0, -0.2, 0.0, 0.7, 5.0])
def test_t_closed_forms(t, df):
    assert T.t_sf(t, df) == pytest.approx(t_sf_closed(t, df), abs=1e-13)


def test_t_tends_to_normal():
    assert T.t_sf(1.96, 1e7) == pytest.approx(T.normal_sf(1.96), abs=1e-7)


def test_f_is_squared_t():
    assert T.f_sf(2.3**2, 1, 17) == pytest.approx(2 * T.t_sf(2.3, 17), abs=1e-13)


@pytest.mark.parametrize("k", [2, 4, 6])
def test_chi2_even_degrees(k):
    x = 3.7
    want = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))
    assert T.chi2_sf(x, k) == pytest.approx(want, abs=1e-13)


def test_chi2_one_degree_and_far_tail():
    assert T.chi2_sf(3.84, 1) == pytest.approx(math.erfc(math.sqrt(3.84 / 2)), abs=1e-13)
    assert T.chi2_sf(500.0, 2) == pytest.approx(math.exp(-250), rel=1e-9)


def test_binomial():
    want = sum(math.comb(12, i) for i in range(4)) / 2**12 * 2
    assert T.binomial_two_sided([3], [12])[0] == pytest.approx(want)
    assert T.binomial_two_sided([6], [12])[0] == 1.0
    assert T.binomial_sf([9], [12])[0] == pytest.approx(sum(math.comb(12, i) for i in range(9, 13)) / 2**12)


def test_fisher_tea_table():
    assert T.fisher_two_sided([3], [1], [1], [3])[0] == pytest.approx(34 / 70)


def test_wilcoxon_exact_small():
    # Six positive differences: only one of the 64 sign patterns is as large.
    assert T.wilcoxon_p([21], [6], [False], [0.0])[0] == pytest.approx(2 / 64)
    assert T.wilcoxon_p([21], [6], [False], [0.0], "greater")[0] == pytest.approx(1 / 64)


def test_studentised_range_of_two_groups_is_t():
    q = 3.1
    assert T.studentized_range_sf([q], [2], [14])[0] == pytest.approx(2 * T.t_sf(q / math.sqrt(2), 14), abs=1e-6)


def test_studentised_range_table_value():
    # 5 % point for three groups and ten degrees of freedom.
    assert T.studentized_range_sf([3.877], [3], [10])[0] == pytest.approx(0.05, abs=2e-4)


def test_beta_symmetry():
    x = np.linspace(0.05, 0.95, 7)
    assert np.allclose(T.beta_cdf(x, 3.5, 3.5), 1 - T.beta_cdf(1 - x, 3.5, 3.5))
