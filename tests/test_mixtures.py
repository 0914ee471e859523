import math

import numpy as np
import pytest

from cohortgrid.operators import mixtures as M


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [9, 0, 3], [0, 9, -3]])
    truth = np.repeat([0, 1, 2], [150, 100, 50])
    x = centres[truth] + rng.normal(size=(300, 3)) * [1, 0.5, 2] + 1000
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, latent array<double>")
    return x, truth, df


@pytest.fixture(scope="module")
def fits(blobs):
    return M.fit_all(blobs[2], [2, 3], M.KINDS, n_boot=6)


def density(x, mean, cov):
    y = x - mean
    return np.exp(-0.5 * (y @ np.linalg.inv(cov) * y).sum(1)) / math.sqrt((2 * math.pi) ** x.shape[1] * np.linalg.det(cov))


def test_bic_follows_from_the_returned_parameters(blobs, fits):
    x, _, _ = blobs
    told = {(r["kind"], r["k"]): r for r in fits.selection().collect()}
    parts = fits.parameters().toPandas()
    free = {"full": lambda k: k * 6, "diag": lambda k: k * 3, "tied": lambda k: 6}
    for (kind, k), p in parts.groupby(["kind", "k"]):
        total = 0
        for _, c in p.iterrows():
            cov = np.diag(c["covariance"]) if kind == "diag" else np.array(c["covariance"]).reshape(3, 3)
            total = total + c["weight"] * density(x, np.array(c["mean"]), cov)
        loglik = np.log(total).sum()
        r = told[kind, k]
        assert r["n"] == 300 and r["loglik"] == pytest.approx(loglik, abs=1e-6)
        assert r["bic"] == pytest.approx(-2 * loglik + (k - 1 + 3 * k + free[kind](k)) * math.log(300), abs=1e-6)
        assert p["weight"].sum() == pytest.approx(1)
    assert told["full", 3]["bic"] < told["full", 2]["bic"] and told["kmeans", 3]["bic"] is None


def test_groups_are_found_and_memberships_add_up(blobs, fits):
    _, truth, _ = blobs
    a = fits.assignments().toPandas()
    assert len(a) == 300 * 2 * 4
    for kind in M.KINDS:
        of = a[(a["kind"] == kind) & (a["k"] == 3)].sort_values("id")
        pairs = set(zip(truth, of["cluster"]))
        assert len(pairs) == 3 and np.allclose([sum(m) for m in of["membership"]], 1)


def test_resamples_are_fitted_and_compared(fits):
    s = {r["k"]: r for r in fits.stability().collect()}
    assert s[3]["n_boot"] == 6 and s[3]["stability"] == pytest.approx(1.0)
    sizes = {m.n for m in fits.models.values() if m.rep}
    assert len(sizes) > 1 and all(190 < n < 280 for n in sizes) and all(m.n == 300 for m in fits.base())


def test_jobs_do_not_grow_with_the_models(spark, blobs, fits):
    few = M.fit_all(blobs[2], [3], n_boot=0, max_iter=2)
    many = M.fit_all(blobs[2], [2, 3, 4], M.KINDS, n_boot=5, max_iter=2)
    assert few.steps == many.steps == 2 or few.steps <= many.steps <= 2


def test_each_step_is_expectation_maximisation():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2)) @ [[2, 1], [0, 1]]
    for kind in M.KINDS:
        m, last = M.started(x, M.Model(kind, 3), 0), -np.inf
        for _ in range(30):
            m = M.updated(m, M.statistics(x[:70], m) + M.statistics(x[70:], m), 2)
            assert m.fit >= last - 1e-4
            last = m.fit


def test_few_or_odd_rows(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, float("nan")]), (3, None), (4, [1.0, 0.0])], "id int, latent array<double>")
    fits = M.fit_all(df, [2], M.KINDS)
    assert {r["n"] for r in fits.selection().collect()} == {3} and fits.assignments().count() == 12
    with pytest.raises(ValueError, match="no rows"):
        M.fit_all(df.where("id = 3"), [2])
