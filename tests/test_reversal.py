import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortgrid.operators import blocks as B
from cohortgrid.operators import signatures as S


def long(spark, key, m, kind="int"):
    rows = [(i, f"g{j}", float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if v == v]
    return spark.createDataFrame(rows, f"{key} {kind}, feature string, value double")


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    q, p = rng.normal(size=(7, 40)) + 5, rng.normal(size=(30, 40)) * 100 - 1000
    q[rng.random(q.shape) < 0.5] = np.nan
    p[rng.random(p.shape) < 0.3] = np.nan
    p[4], p[5, 3:], q[2] = -7.25, np.nan, np.where(np.isnan(q[2]), np.nan, 1.5)
    signature = long(spark, "profile", q).withColumnRenamed("value", "effect").withColumn("set", F.lit("a"))
    return q, p, signature, long(spark, "sig_id", p, "long")


@pytest.mark.parametrize("shared, tile", [(8_000_000, 1), (1, 50), (1, 2_000_000)])
def test_connectivity_of_blocks_is_pearson_on_shared_features(spark, monkeypatch, tables, shared, tile):
    q, p, signature, perturbations = tables
    monkeypatch.setattr(B, "SHARED_VALUES", shared)
    monkeypatch.setattr(B, "TILE_VALUES", tile)
    monkeypatch.setattr(S, "DENSE_VALUES", 200)
    got = {(r["profile"], r["sig_id"]): (r["reversal_score"], r["n_shared"]) for r in S.connectivity(signature, perturbations, ["set", "profile"]).collect()}
    want = {}
    for i, x in enumerate(q):
        for j, y in enumerate(p):
            both = ~np.isnan(x) & ~np.isnan(y)
            if both.sum() >= 5 and np.std(x[both]) > 0 and np.std(y[both]) > 0:
                want[i, j] = (-np.corrcoef(x[both], y[both])[0, 1], both.sum())
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("shared", [8_000_000, 1])
def test_set_difference_of_blocks(spark, monkeypatch, tables, shared):
    q, p, signature, perturbations = tables
    monkeypatch.setattr(B, "SHARED_VALUES", shared)
    monkeypatch.setattr(B, "TILE_VALUES", 100)
    sides = signature.withColumn("direction", F.when(F.col("effect") > 5, "up").otherwise("down"))
    got = {(r["profile"], r["sig_id"]): r["reversal_score"] for r in S.set_difference(sides, perturbations, ["profile"], 4).collect()}
    want = {}
    for i, x in enumerate(q):
        for j, y in enumerate(p):
            up, down = y[(x > 5) & ~np.isnan(y)], y[(x <= 5) & ~np.isnan(y)]
            if len(up) >= 4 and len(down) >= 4:
                want[i, j] = down.mean() - up.mean()
    assert got == pytest.approx(want) and len(want) > 50


def test_no_row_per_profile_signature_and_feature(spark, tables):
    _, _, signature, perturbations = tables
    plan = S.connectivity(signature, perturbations, ["profile"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_empty_sides_and_repeats(spark, tables):
    _, _, signature, perturbations = tables
    assert S.connectivity(signature.where("false"), perturbations, ["profile"]).count() == 0
    assert S.connectivity(signature, perturbations.where("false"), ["profile"]).count() == 0
    one = S.connectivity(signature, perturbations, ["profile"])
    twice = S.connectivity(signature, perturbations.union(perturbations), ["profile"])
    assert one.exceptAll(twice).count() == 0
