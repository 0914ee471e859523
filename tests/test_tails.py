import itertools
import math

import numpy as np
import pytest

from cohortgrid.functions import tails as T


def test_published_values():
    assert T.student_two_sided([2.0], [10.0])[0] == pytest.approx(0.07338803, abs=1e-8)
    assert T.chi2_upper([37.664], [3.0])[0] == pytest.approx(3.33e-08, rel=1e-3)
    assert T.chi2_upper([8.426], [3.0])[0] == pytest.approx(0.0380, abs=1e-4)
    assert T.normal_two_sided([1.959963984540054])[0] == pytest.approx(0.05, abs=1e-12)


def test_chi2_closed_form_for_two_degrees():
    x = np.array([0.1, 1.0, 5.0, 40.0, 300.0])
    assert np.allclose(T.chi2_upper(x, np.full(5, 2.0)), np.exp(-x / 2), rtol=1e-10)


def test_t_closed_form_for_one_and_two_degrees():
    t = np.array([0.0, 0.3, 1.0, 4.0, 100.0])
    assert np.allclose(T.student_two_sided(t, np.ones(5)), 1 - 2 * np.arctan(t) / np.pi, atol=1e-10)
    assert np.allclose(T.student_two_sided(t, np.full(5, 2.0)), 1 - t / np.sqrt(2 + t * t), atol=1e-10)


def test_normal_quantile_inverts_the_tail():
    p = np.array([1e-12, 1e-6, 0.01, 0.3, 0.5, 0.7, 0.99, 1 - 1e-6])
    z = T.normal_quantile(p)
    back = np.where(z < 0, T.normal_two_sided(z) / 2, 1 - T.normal_two_sided(z) / 2)
    assert np.allclose(back, p, rtol=1e-9)
    assert T.normal_quantile([0.975])[0] == pytest.approx(1.959963984540054, abs=1e-12)


def test_missing_statistics_stay_missing():
    assert np.isnan(T.student_two_sided([np.nan], [5.0])[0])
    assert T.chi2_upper([1.0], [0.0])[0] == 1.0


@pytest.mark.parametrize("m, n", [(1, 1), (3, 3), (3, 7), (4, 5), (2, 9), (6, 6)])
def test_rank_sum_law_counts_all_arrangements(m, n):
    seen = np.zeros(m * n + 1)
    for ranks in itertools.combinations(range(1, m + n + 1), m):
        seen[sum(ranks) - m * (m + 1) // 2] += 1
    assert seen.sum() == math.comb(m + n, m)
    u = np.arange(m * n + 1)
    upper = np.cumsum(seen[::-1])[::-1] / seen.sum()  # P(U >= k)
    want = np.minimum(1.0, 2 * upper[np.maximum(u, m * n - u)])
    assert T.rank_sum_two_sided(np.full(len(u), m), np.full(len(u), n), u) == pytest.approx(want, abs=1e-12)
    assert T.rank_sum_two_sided(np.full(len(u), n), np.full(len(u), m), u) == pytest.approx(want, abs=1e-12)


def test_rank_sum_limit_meets_the_exact_law():
    n = T.MANY_RANKS - 1
    for m in (3, 8):
        for share in (0.02, 0.2, 0.5):
            u = int(share * m * n)
            assert T.rank_sum_two_sided([m], [n], [u])[0] == pytest.approx(T.rank_sum_two_sided([m], [n + 1], [int(share * m * (n + 1))])[0], rel=1e-3)


def test_small_groups_get_the_exact_p(spark):
    from cohortgrid.operators.stats import mann_whitney

    rows = [("a", 0, 1.0), ("a", 0, 2.0), ("a", 0, 3.5), ("a", 1, 3.0), ("a", 1, 4.0), ("a", 1, 5.0), ("a", 1, 6.0)]
    rows += [("b", c, float(round(v))) for _, c, v in rows]
    got = {(r["feature"], r["cluster"]): r for r in mann_whitney(spark.createDataFrame(rows, "feature string, cluster int, value double"), "gene").collect()}
    assert got["a", 0]["u"] == 1 and got["a", 0]["p"] == got["a", 1]["p"] == pytest.approx(2 * 2 / 35)
    assert got["b", 0]["p"] == pytest.approx(float(T.normal_two_sided([got["b", 0]["z"]])[0]))
