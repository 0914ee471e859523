"""F1 of the fourth round (job_01): errors of tables beyond the shared size, of small partitions and of missing vectors."""

import numpy as np
from pyspark.sql import functions as F

from cohortgrid.operators import blocks as B
from cohortgrid.operators import evaluation as V
from cohortgrid.operators import mixtures as M
from cohortgrid.plans import jobs as P
from cohortgrid.session import cut_lineage


def vectors(spark, n, d=4, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def test_f1_a_table_beyond_the_shared_size_meets_itself(spark, monkeypatch):
    points = cut_lineage(vectors(spark, 300))
    labels = points.select("id", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).withColumn("c", F.col("id") % F.col("k"))
    wide = labels.groupBy("id").pivot("k", [2, 3]).agg(F.first("c"))
    df = points.join(wide, "id")
    shared = {r["labelling"]: r for r in V.silhouettes(df, ["2", "3"]).collect()}
    monkeypatch.setattr(B, "SHARED_VALUES", 400)
    monkeypatch.setattr(B, "TILE_VALUES", 400)
    tiled = {r["labelling"]: r for r in V.silhouettes(df, ["2", "3"]).collect()}
    assert tiled.keys() == shared.keys() == {"2", "3"}
    for k, r in shared.items():
        assert tiled[k]["n"] == r["n"] == 300
        assert np.isclose(tiled[k]["silhouette"], r["silhouette"])


def test_f1_partitions_of_few_rows_have_resamples_without_any(spark):
    fits = M.fit_all(vectors(spark, 30).repartition(12), (2,), ("full",), n_boot=8, vec="vec")
    rows = fits.agreement().collect()
    assert sorted(r["rep"] for r in rows) == list(range(1, 9))
    assert all(-1.0 <= r["ari"] <= 1.0 for r in rows)


def test_f1_one_row_agrees_with_itself(spark):
    one = spark.createDataFrame([("x", 1, 2)], "key string, a int, b int")
    assert V.adjusted_rand(one, "a", "b", ["key"]).first()["ari"] == 1.0


def test_f1_rows_without_a_vector_are_left_out(spark):
    v = vectors(spark, 40)
    with_null = v.unionByName(spark.createDataFrame([(40, None)], "id long, vec array<double>"))
    follow = spark.range(45).select("id", (F.col("id") % 7 + 1).cast("double").alias("time"), (F.col("id") % 3 == 0).cast("int").alias("event"))
    out = P.assemble_cohort(with_null, follow, (2,), 2, 2)
    assert out["latent"].count() == 40
    assert {r["n"] for r in out["logrank"].collect()} == {40}
