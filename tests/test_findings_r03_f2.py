"""F2 of the third round (job_01): silhouettes of many labelings keep sums alone in a worker."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from cohortgrid.operators import blocks as B
from cohortgrid.operators import evaluation as V
from cohortgrid.operators import mixtures as M


def test_f2_a_worker_keeps_one_sum_per_point_and_cluster(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40_000, 4))
    d = pd.DataFrame({"id": np.arange(40_000), "vec": list(x), **{f"k{i}": rng.integers(0, i + 2, 40_000) for i in range(7)}})
    seen = {}

    def meet(left, right, fn, schema, **more):
        seen.update(fn=fn, merge=more.get("merge"), finish=more.get("finish"))
        return left.sparkSession.createDataFrame([], schema)

    monkeypatch.setattr(V, "meet", meet)
    small = spark.createDataFrame([(1, [0.0], *[0] * 7)], "id long, vec array<double>, " + ", ".join(f"k{i} long" for i in range(7)))
    V.silhouettes(small, [f"k{i}" for i in range(7)])
    rows = d.rename(columns={f"k{i}": f"_l{i}" for i in range(7)})
    part = rows.iloc[: B._BATCH]
    tracemalloc.start()
    try:
        found = [seen["fn"](part, rows.iloc[i : i + B.PAIRS // B._BATCH]) for i in range(0, 16 * 976, 976)]
        one = seen["merge"](found if seen["finish"] else pd.concat(found, ignore_index=True))
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 16 blocks of 976 points: two tables of distances, and 35 sums a point for each block.
    assert held < 60e6
    sums = seen["finish"](part, one)
    mine = sums[(sums["id"] == 3) & (sums["at"] == 5)].set_index("other")
    dist = np.sqrt(((x[: 16 * 976] - x[3]) ** 2).sum(1))
    for label in range(7):
        assert np.isclose(mine["dist"][label], dist[d["k5"][: 16 * 976] == label].sum())
        assert mine["cnt"][label] == (d["k5"][: 16 * 976] == label).sum()


def test_f2_labelings_with_missing_labels(spark):
    rows = [(i, [float(i), float(i % 3)], None if i == 4 else "ab"[i % 2], "xyz"[i % 3]) for i in range(12)]
    df = spark.createDataFrame(rows, "id int, vec array<double>, one string, two string")
    both = {r["labelling"]: r for r in V.silhouettes(df, ["one", "two"]).collect()}
    assert both["one"]["n"] == both["two"]["n"] == 12
    assert np.isclose(V.silhouette(df, label="two").first()["silhouette"], both["two"]["silhouette"])


@pytest.mark.parametrize("kind", ["full", "diag", "tied"])
def test_f2_a_component_that_loses_its_rows_does_not_end_the_job(kind):
    x = np.random.default_rng(1).normal(size=(500, 3))
    cov = {"full": np.stack([np.eye(3), 1e-6 * np.eye(3)]), "diag": np.array([[1.0] * 3, [1e-6] * 3]), "tied": np.eye(3)}[kind]
    m = M.Model(kind, 2, weights=np.array([0.5, 0.5]), means=np.array([[0.0] * 3, [50.0] * 3]), cov=cov)
    for _ in range(3):
        m = M.updated(m, M.statistics(x, m), 3)
    assert np.isfinite(m.fit) and m.weights[1] < 1e-9
    whole = m.cov if kind == "tied" else m.cov[0]
    assert np.allclose(np.diagonal(whole) if kind != "diag" else whole, x.var(0), atol=1e-4)
