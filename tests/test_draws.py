import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortgrid.operators import draws as D
from cohortgrid.operators import stats as T


def law(good, bad, size):
    low, high = max(0, size - bad), min(good, size)
    p = np.array([math.comb(good, k) * math.comb(bad, size - k) / math.comb(good + bad, size) for k in range(low, high + 1)])
    return low, p


@pytest.mark.parametrize("good, bad, size", [(40, 60, 30), (60, 40, 30), (300, 500, 790), (200, 900, 150), (100, 5000, 90), (3000, 4000, 2500), (70, 70, 70)])
def test_ratio_of_uniforms_follows_the_exact_law(good, bad, size):
    n, rng = 40_000, np.random.default_rng(1)
    x = D._by_ratio_of_uniforms(rng, np.full(n, good), np.full(n, bad), np.full(n, size))
    low, p = law(good, bad, size)
    seen = np.bincount(x - low, minlength=len(p))
    keep = p * n > 10
    chi = ((seen - p * n)[keep] ** 2 / (p * n)[keep]).sum()
    assert x.min() >= low and x.max() < low + len(p) and chi < keep.sum() + 5 * math.sqrt(2 * keep.sum())


@pytest.mark.parametrize("good, bad, size", [(1_500_000_000, 600_000_000, 900_000_000), (6 * 10**11, 2 * 10**12, 10**12), (5, 3 * 10**9, 10**9), (2 * 10**9, 3 * 10**9, 7), (3 * 10**9, 4, 15 * 10**8), (2 * 10**9, 90, 10**9), (2 * 10**9, 10**9, 100), (2 * 10**9, 0, 5)])
def test_counts_over_a_billion(good, bad, size):
    rng = np.random.default_rng(2)
    x = D.hypergeometric(rng, np.full(3000, good), bad, size)
    n = good + bad
    mean, var = size * good / n, size * (good / n) * (bad / n) * (n - size) / max(1, n - 1)
    assert x.min() >= max(0, size - bad) and x.max() <= min(good, size)
    assert abs(x.mean() - mean) <= 5 * math.sqrt(var / 3000) + 1e-9 and (var == 0 or 0.85 < x.var() / var < 1.15)


def test_billions_of_rows_in_two_cells(spark):
    cells = spark.createDataFrame([(0, 1_500_000_000), (1, 600_000_000)], "c int, n long")
    got = D.shuffled_counts(cells, ["c"], [10**9, 11 * 10**8], 60, seed=4).toPandas()
    assert (got[["_c0", "_c1"]].sum(axis=1) == got["c"].map({0: 1_500_000_000, 1: 600_000_000})).all()
    assert (got.groupby("perm")["_c0"].sum() == 10**9).all() and got["_c0"].nunique() > 100


def test_tree_keeps_margins_and_independence_of_its_depth(spark, monkeypatch):
    cells = spark.createDataFrame([(i, 1 + i % 5) for i in range(300)], "c int, n long")
    spread = {}
    for chunk in (1000, 20):
        monkeypatch.setattr(D, "CHUNK", chunk)
        got = D.shuffled_counts(cells, ["c"], [500, 250, 150], 100, seed=1).toPandas()
        assert len(got) == 300 * 100 and (got[["_c0", "_c1", "_c2"]].sum(axis=1) == 1 + got["c"] % 5).all()
        assert got.groupby("perm")[["_c0", "_c1", "_c2"]].sum().drop_duplicates().to_numpy().tolist() == [[500, 250, 150]]
        spread[chunk] = got[got["c"] % 5 == 4].groupby("c")["_c0"].agg(["mean", "var"]).mean()
    for s in spread.values():
        assert s["mean"] == pytest.approx(5 * 500 / 900, abs=0.08) and s["var"] == pytest.approx(5 * (5 / 9) * (4 / 9) * 895 / 899, rel=0.15)


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_shuffled_positions_are_orders(n):
    for perm in range(1, 6):
        assert sorted(D.shuffled_positions(np.arange(n), n, perm, 3)) == list(range(n))


def test_all_orders_of_few_rows_are_as_likely():
    seen = Counter(tuple(D.shuffled_positions(np.arange(4), 4, p, 9)) for p in range(2_400))
    assert len(seen) == 24 and sum((c - 100) ** 2 / 100 for c in seen.values()) < 60


def test_one_null_whatever_the_plan_and_the_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(30)) if i % 3 else 7.0, float(rng.normal())) for i in range(900)]
    d = spark.createDataFrame(rows, "id int, x double, y double")
    want = T.spearman_null(d, "id", "x", "y", 30, seed=3).first()
    assert want["null_sd"] == pytest.approx(899**-0.5, rel=0.4)
    monkeypatch.setattr(D, "PART", 16)
    monkeypatch.setattr(D, "AT_ONCE", 100)
    for shared in (1,):
        monkeypatch.setattr(D, "SHARED_RANKS", shared)
        got = T.spearman_null(d, "id", "x", "y", 30, seed=3).first()
        assert all(got[c] == pytest.approx(want[c], abs=1e-12) for c in ("null_mean", "null_sd", "p", "rho"))


def test_a_side_that_does_not_vary_has_no_null(spark):
    d = spark.range(50).select("id", F.lit(1.0).alias("x"), F.col("id").cast("double").alias("y"))
    got = T.spearman_null(d, "id", "x", "y", 20).first()
    assert got["null_mean"] is None
