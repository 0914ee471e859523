"""F2 of the fourth round (job_05): scores are summed up by whole runs of rows, in single precision where that is sure."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortgrid.operators import aggregates as A
from cohortgrid.operators import blocks as B
from cohortgrid.operators import signatures as S


def matrix(values):
    width = values.shape[1]
    kept = [np.flatnonzero(~np.isnan(r)) for r in values]
    return S.Matrix(pd.DataFrame({"at": kept, "vec": [r[k] for r, k in zip(values, kept)]}), width)


def sides(rng, n, width, each):
    out = np.full((n, width), np.nan)
    for row in out:
        at = rng.permutation(width)
        row[at[:each]], row[at[each : 2 * each]] = 1.0, -1.0
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-42, 1e36])
@pytest.mark.parametrize("missing", [0.0, 0.05])
def test_f2_best_and_counts_are_those_of_every_pair(scale, missing):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24)) * scale
    x[300:340], x[17] = x[2], 0.0
    x[400:500] = x[399] * (1 + 1e-9 * rng.normal(size=(100, 24)))
    x[rng.random(900) < missing, 3] = np.nan
    q = sides(rng, 40, 24, 6)
    q[5, q[5] > 0] = np.nan
    m, asked = matrix(x), matrix(q)
    score, keep = S._differ(m, asked, 5)
    for starts in (np.array([0, 1, 130, 500]), np.arange(0, 900, 3), np.array([0, *range(850, 900)])):
        best, n, positive = S.best_and_counts(m, starts, asked, 5)
        assert np.array_equal(n, np.add.reduceat(keep, starts, axis=0, dtype=np.int64))
        sure = np.abs(score - S.POSITIVE) > 1e-15
        least, most = (np.add.reduceat(f & keep, starts, axis=0, dtype=np.int64) for f in ((score >= S.POSITIVE) & sure, (score >= S.POSITIVE) | ~sure))
        assert ((least <= positive) & (positive <= most)).all()
        want = np.maximum.reduceat(np.where(keep, score, -np.inf), starts, axis=0)
        assert np.allclose(best[n > 0], want[n > 0], rtol=0, atol=1e-14 * max(scale, 1.0))


def tables(spark, n):
    rng = np.random.default_rng(1)
    rows = [(i, f"g{j:02d}", float(v)) for i, r in enumerate(rng.normal(size=(n, 12))) for j, v in enumerate(r)]
    perturbations = spark.createDataFrame(rows, "sig_id long, feature string, value double")
    arms = perturbations.withColumnsRenamed({"sig_id": "profile_id", "value": "effect"}).withColumn("direction", F.when(F.col("effect") > 0, "up").otherwise("down"))
    ids = perturbations.select("sig_id").distinct()
    return arms, perturbations, ids.select("sig_id", F.concat(F.lit("drug "), (F.col("sig_id") % 2).cast("string")).alias("drug"), (F.col("sig_id") % 2).alias("cell_id"))


def test_f2_a_tile_hands_on_one_row_per_kind_and_profile(spark, monkeypatch):
    arms, perturbations, meta = tables(spark, 6_000)
    few = arms.where("profile_id < 40")
    got = S.set_difference_counts(few, perturbations, meta, ["profile_id"], 1).toPandas()
    monkeypatch.setattr(B, "SHARED_VALUES", 1)
    tiled = S.set_difference_counts(few, perturbations, meta, ["profile_id"], 1).toPandas()
    # One tile holds all 6,000 rows of two kinds; parts of 2,048 rows had made four rows a profile.
    assert len(tiled) == tiled.groupby(["profile_id", "drug"]).ngroups
    whole = [t.groupby(["profile_id", "drug"]).agg(best=("best", "max"), n=("n", "sum"), n_positive=("n_positive", "sum")) for t in (got, tiled)]
    pd.testing.assert_frame_equal(*whole)


def test_f2_compounds_of_a_profile_are_ranked_where_they_are(spark):
    arms, perturbations, meta = tables(spark, 60)
    counts = S.set_difference_counts(arms, perturbations, meta, ["profile_id"], 1)
    in_place = A.compound_rollup_counts(counts.repartition("profile_id"), ["profile_id"], at_most=2)
    plan = in_place._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert in_place.exceptAll(A.compound_rollup_counts(counts, ["profile_id"])).count() == 0
