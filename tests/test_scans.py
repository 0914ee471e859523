"""Ordered scans: the range-split form must equal the plain form and a brute-force answer."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortgrid.operators import scans as S


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows and one value holds a third of that key."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        key = "hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}"
        value = 7.0 if rng.random() < 0.33 else round(rng.lognormvariate(0, 3), 3)
        rows.append((i, key, value))
    return spark.createDataFrame(rows, "id long, key string, value double"), pd.DataFrame(rows, columns=["id", "key", "value"])


@pytest.mark.parametrize("ranges", [None, 150])
def test_average_ranks_match_pandas(skewed, ranges):
    df, pdf = skewed
    got = S.average_ranks(df, ["key"], "value", ranges=ranges).toPandas()
    pdf = pdf.assign(r=pdf.groupby("key")["value"].rank())
    want = pdf.groupby(["key", "value"])["r"].first().to_dict()
    assert len(got) == len(want)
    assert all(abs(want[(k, v)] - r) < 1e-9 for k, v, r in zip(got["key"], got["value"], got["avg_rank"]))


@pytest.mark.parametrize("ranges", [None, 150])
def test_exact_quantiles_match_pandas(skewed, ranges):
    df, pdf = skewed
    got = S.exact_quantiles(df, ["key"], "value", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}, ranges=ranges).toPandas().set_index("key")
    for key, part in pdf.groupby("key"):
        want = part["value"].quantile([0.5, 0.95, 0.0, 1.0]).to_numpy()
        assert np.allclose(got.loc[key, ["a", "b", "c", "d"]].to_numpy(float), want)


@pytest.mark.parametrize("ranges", [None, 150])
def test_running_last_and_totals(skewed, ranges):
    df, pdf = skewed
    some = F.when(F.col("id") % 7 == 0, F.col("value"))
    scans = {"s": S.Scan("sum", F.col("value")), "lo": S.Scan("min", F.col("value"), back=True), "prev": S.Scan("last", some), "nxt": S.Scan("last", some, back=True)}
    got = S.running(df, ["key"], [F.col("value"), F.col("id")], scans, {"n": F.lit(1)}, ranges=ranges).toPandas()
    for key, part in pdf.groupby("key"):
        p = part.sort_values(["value", "id"]).reset_index(drop=True)
        g = got[got["key"] == key].sort_values(["value", "id"]).reset_index(drop=True)
        marked = p["value"].where(p["id"] % 7 == 0)
        assert np.allclose(g["s"], p["value"].cumsum())
        assert np.allclose(g["lo"], p["value"][::-1].cummin()[::-1])
        assert np.allclose(g["prev"].astype(float), marked.ffill(), equal_nan=True)
        assert np.allclose(g["nxt"].astype(float), marked.bfill(), equal_nan=True)
        assert (g["n"] == len(p)).all()


@pytest.mark.parametrize("ranges", [None, 150])
def test_q_values(skewed, ranges):
    df, pdf = skewed
    p = df.withColumn("p", F.rand(3))
    p = p.select("id", "key", F.round("p", 6).alias("p")).toPandas()
    d = df.sparkSession.createDataFrame(p)
    got = S.bh_q(d, ["key"], "p", ["id"], ranges=ranges).toPandas()
    for key, part in p.groupby("key"):
        s = part.sort_values(["p", "id"])
        raw = s["p"].to_numpy() * len(s) / np.arange(1, len(s) + 1)
        want = pd.Series(np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1.0), index=s["id"])
        g = got[got["key"] == key].set_index("id")["q"]
        assert np.allclose(g.loc[want.index], want)
        assert (g >= 0).all() and (g <= 1).all()


def test_hot_key_is_split(skewed):
    df, _ = skewed
    placed = S.place(df, ["key"], [F.col("value"), F.col("id")], 150)
    sizes = {r["key"]: (r["b"], r["m"]) for r in placed.groupBy("key", "_b").count().groupBy("key").agg(F.count(F.lit(1)).alias("b"), F.max("count").alias("m")).collect()}
    assert sizes["hot"][0] > 20
    assert sizes["hot"][1] < 1000


def test_one_plan_whatever_the_size(spark):
    """A join that makes far more rows than its inputs hold is ranked over no key without a single-task window."""
    few = spark.range(400).select((F.col("id") % 4).alias("k"), "id")
    wide = few.join(few.withColumnRenamed("id", "other"), "k")
    out = S.ranked(wide, [], [F.col("id"), F.col("other")])
    placed = S.place(wide, [], [F.col("id"), F.col("other")], 64)
    sizes = [r["count"] for r in placed.groupBy("_b").count().collect()]
    assert len(sizes) > 40 and max(sizes) < wide.count() / 10
    assert out.agg(F.max("rank"), F.countDistinct("rank")).head() == (wide.count(), wide.count())
