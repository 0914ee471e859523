"""Small known cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortgrid.functions import cleaning as C
from cohortgrid.functions import text as X
from cohortgrid.operators import aggregates as A
from cohortgrid.operators import blocks as B
from cohortgrid.operators import evaluation as V
from cohortgrid.operators import governance as G
from cohortgrid.operators import joins as J
from cohortgrid.operators import ml as ML
from cohortgrid.operators import signatures as S
from cohortgrid.operators import stats as T
from cohortgrid.operators import survival as K
from cohortgrid.operators import windows as W


def col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_receptor_typo_and_precedence(spark):
    assert col(spark, ["Positve", "Negative", "ER+", "0", "equivocal", None], C.receptor_code) == [1.0, 0.0, 1.0, 0.0, None, None]


def test_european_decimals(spark):
    assert col(spark, ["0,9246", "0.5", "nan", ""], C.euro_number) == [0.9246, 0.5, None, None]


def test_barcode(spark):
    assert col(spark, ["TCGA-AA-0001-11A", "TCGA-AA-0001-01A", "TCGA-AA-0001"], C.barcode_group) == ["normal", "tumour", "other"]


def test_compound_names(spark):
    assert col(spark, ["palbociclib_cdk6", "5-FU", "Sirolimus", "Taxol"], C.compound_name) == ["palbociclib", "5-fluorouracil", "rapamycin", "paclitaxel"]


def test_event_codes(spark):
    assert col(spark, ["1:DECEASED", "0:LIVING", None], C.event_code) == [1, 0, None]
    assert col(spark, ["1:DECEASED", "0:LIVING", None], C.event_flag) == [1.0, 0.0, 0.0]


def test_anonymous_names_in_raw_and_normalised_form(spark):
    assert col(spark, ["BRD-K1", "brd k1", "sa 12", "brdx"], C.is_anonymous) == [True, True, True, False]


def test_k_choice_takes_stability_within_the_bic_window(spark):
    t = spark.createDataFrame([(2, 100.0, 0.3, 0.7), (3, 105.0, 0.2, 0.9), (4, 140.0, 0.9, 0.99)], "k int, bic double, silhouette double, stability double")
    assert V.choose_k(t).first()["k"] == 3
    low = t.withColumn("stability", F.lit(0.5))
    assert V.choose_k(low).first()["k"] is None


def test_pair_coverage_counts_pairs_not_drugs(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "z"), ("c", "c")], "drug_a string, drug_b string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "drug string")
    assert A.covered_pairs(pairs, known).first()[0] == 3


def test_jaccard_of_equal_and_disjoint_sets(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "z")], "set_id int, member string")
    r = A.set_variation(m).first()
    assert (r["jaccard_max"], r["jaccard_min"], r["core_size"], r["singletons"]) == (1.0, 0.0, 0, 1)


def test_rebound(spark):
    rows = [("x", 0, 1.0), ("x", 1, 0.2), ("x", 2, 1.5), ("y", 0, 1.0), ("y", 1, 0.9), ("y", 2, 0.8)]
    got = {r["entity"]: r["rebound"] for r in W.rebound(spark.createDataFrame(rows, "entity string, t int, value double")).collect()}
    assert got == {"x": True, "y": False}


def test_half_maximal_point(spark):
    c = spark.createDataFrame([(1000.0, 1.0, 500.0)], "ic50_nm double, h double, max_conc_nm double")
    pts = S.dose_points(c).toPandas()
    assert len(pts) == 25 and pts["ic50_extrapolated"].all()
    near = pts.iloc[(pts["concentration_nm"] - 1000).abs().argmin()]
    assert near["viability"] == pytest.approx(1 / (1 + near["concentration_nm"] / 1000))


def test_logrank_separates_shifted_groups(spark):
    rows = [(i, float(20 + i * 1.5), 1, 0) for i in range(40)] + [(100 + i, 5.0 + i * 0.5, 1, 1) for i in range(40)]
    r = K.logrank(spark.createDataFrame(rows, "id int, time double, event int, grp int"), [], [0, 1]).first()
    assert r["p"] < 1e-6 and r["df"] == 1 and r["n"] == 80
    one = K.logrank(spark.createDataFrame(rows[:40], "id int, time double, event int, grp int"), [], [0, 1]).first()
    assert (one["statistic"], one["df"], one["p"]) == (0.0, 0, 1.0)


@pytest.mark.parametrize("ranges", [None, 40])
def test_logrank_matches_a_direct_loop(spark, ranges):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(300), "time": rng.integers(1, 60, 300).astype(float), "event": rng.integers(0, 2, 300), "grp": rng.integers(0, 4, 300)})
    o, e, v = np.zeros(4), np.zeros(4), np.zeros((4, 4))
    for t in np.unique(pdf.time[pdf.event > 0]):
        at, died = pdf.grp[pdf.time >= t], pdf.grp[(pdf.time == t) & (pdf.event > 0)]
        n, d = len(at), len(died)
        ni = np.array([(at == g).sum() for g in range(4)], float)
        o += np.array([(died == g).sum() for g in range(4)])
        e += ni * d / n
        if n > 1:
            v += d * (n - d) / (n - 1) * (np.diag(ni) / n - np.outer(ni, ni) / n ** 2)
    u = (o - e)[:3]
    want = u @ np.linalg.pinv(v[:3, :3]) @ u
    got = K.logrank(spark.createDataFrame(pdf), [], [0, 1, 2, 3], ranges=ranges).first()
    assert got["statistic"] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("ranges", [None, 30])
def test_survival_curve_is_monotone_and_matches_a_loop(spark, ranges):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": range(400), "time": np.round(rng.exponential(10, 400), 1), "event": rng.integers(0, 2, 400), "g": rng.integers(0, 2, 400)})
    got = K.kaplan_meier(spark.createDataFrame(pdf), ["g"], ranges=ranges).toPandas().sort_values(["g", "time"])
    for g, part in pdf.groupby("g"):
        s, want = 1.0, []
        for t in np.unique(part.time):
            n, d = (part.time >= t).sum(), ((part.time == t) & (part.event > 0)).sum()
            s *= 1 - d / n
            want.append(s)
        mine = got[got.g == g]["survival"].to_numpy()
        assert np.allclose(mine, want) and (np.diff(mine) <= 1e-12).all()


@pytest.mark.parametrize("ranges", [None, 30])
def test_censored_rows_weigh_nothing(spark, ranges):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": range(200), "time": np.round(rng.exponential(10, 200), 1), "event": rng.integers(0, 2, 200)})
    got = K.ipcw(spark.createDataFrame(pdf), "id", ranges=ranges).toPandas().set_index("id")
    s = pdf.sort_values(["time", "id"]).reset_index(drop=True)
    g = np.cumprod(1 - (1 - s.event) / np.arange(len(s), 0, -1))
    last = s.assign(g=g).groupby("time")["g"].last()
    for r in pdf.itertuples():
        want = 0.0 if r.event == 0 else min(20.0, 1 / max(last[r.time], 1e-3))
        assert got.loc[r.id, "weight"] == pytest.approx(want)


def test_gate_states(spark):
    m = spark.createDataFrame(
        [("syn", 9.0, 1.0, "gte", 10, None, False), ("thin", 9.0, 1.0, "gte", 3, 10, False), ("smoke", 9.0, 1.0, "gte", 10, None, True), ("good", 0.5, 1.0, "lte", 10, None, False), ("bad", 9.0, 1.0, "lte", 10, None, False), ("noids", 9.0, 1.0, "gte", 10, None, False)],
        "gate string, value double, threshold double, direction string, n int, min_n int, smoke_test boolean").withColumn("insufficient", F.lit(False)).withColumn("cohort_gate", F.lit(True))
    ids = spark.createDataFrame([("syn", "TCGA-SM-1"), ("syn", "TCGA-AA"), ("thin", "A"), ("smoke", "A"), ("good", "A"), ("bad", "A")], "gate string, sample_id string")
    got = {r["gate"]: r["status"] for r in G.evaluate_gates(m, ids).collect()}
    assert got == {"syn": "synthetic", "thin": "insufficient_data", "smoke": "provisional_pass", "good": "pass", "bad": "fail", "noids": "fail"}


def test_weaker_percentile_ranks_first(spark):
    schema = "drug string, canonical string, percentile double, rank int, reversal_score double, targets array<string>, source string, n_signatures int, n_cell_lines int, consistency double"
    a = spark.createDataFrame([("A", "a", 0.99, 1, 1.0, ["T"], "compact_gctx", 5, 3, 0.9), ("B", "b", 0.90, 2, 0.9, ["T"], "compact_gctx", 5, 3, 0.9)], schema)
    b = spark.createDataFrame([("A", "a", 0.60, 2, 1.0, ["T"], "compact_gctx", 5, 3, 0.9), ("B", "b", 0.88, 1, 0.9, ["U"], "compact_gctx", 5, 3, 0.9)], schema)
    out = {r["canonical"]: r for r in G.nominate(a, b).collect()}
    assert out["b"]["nomination_rank"] == 1 and out["a"]["nomination_rank"] == 2
    assert out["b"]["targets"] == ["T", "U"] and out["b"]["support_class"] == "breast_cell_line_supported"


def test_posterior_narrows_with_each_view(spark):
    v = spark.createDataFrame([(1, 0, "a", 1.0, 0.0, True), (1, 0, "b", 1.0, 0.0, True), (2, 0, "a", 1.0, 0.0, True), (2, 0, "b", 1.0, 0.0, False)], "sample_id int, dim int, view string, mu double, logvar double, present boolean")
    w = {r[0]: r[1] for r in S.posterior_width(S.product_of_experts(v)).collect()}
    assert w[1] < w[2] < 1.0


def test_multivariate_activity_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(5, 40))
    net = [(f"s{j}", f"g{i}", float(x[i, j])) for i in range(40) for j in range(3)]
    df = spark.createDataFrame([(s, f"g{i}", float(y[s, i])) for s in range(5) for i in range(40)], "sample_id int, feature string, value double")
    got = S.multivariate_activity(df, spark.createDataFrame(net, "source string, feature string, weight double")).toPandas()
    design = np.column_stack([np.ones(40), x])
    for s in range(5):
        beta, *_ = np.linalg.lstsq(design, y[s], rcond=None)
        rss = ((y[s] - design @ beta) ** 2).sum()
        t = beta / np.sqrt(rss / 36 * np.diag(np.linalg.inv(design.T @ design)))
        mine = got[got.sample_id == s].sort_values("source")["activity"].to_numpy()
        assert np.allclose(mine, t[1:])


def test_deconvolution_recovers_known_fractions(spark):
    cents = {"a": [10.0, 0.0, 0.0, 5.0], "b": [0.0, 8.0, 0.0, 5.0], "c": [0.0, 0.0, 9.0, 0.0]}
    log = {k: np.log1p(v) for k, v in cents.items()}
    mix = 0.5 * log["a"] + 0.5 * log["b"]
    bulk = spark.createDataFrame([(1, f"g{i}", float(np.expm1(v))) for i, v in enumerate(mix)], "sample_id int, feature string, value double")
    c = spark.createDataFrame([(k, f"g{i}", float(v)) for k, vs in cents.items() for i, v in enumerate(vs)], "cell_type string, feature string, value double")
    got = {r["cell_type"]: r["fraction"] for r in ML.deconvolve(bulk, c).collect()}
    assert got == pytest.approx({"a": 0.5, "b": 0.5, "c": 0.0}, abs=1e-6)


def test_self_agreement_is_one(spark):
    d = spark.createDataFrame([(i % 3,) for i in range(30)], "a int").withColumn("b", F.col("a"))
    assert V.adjusted_rand(d, "a", "b").first()["ari"] == 1.0
    assert V.class_metrics(d, "a", "b").first()["macro_f1"] == 1.0


def test_shuffles_keep_the_values(spark):
    d = spark.createDataFrame([(i, i % 4) for i in range(100)], "id int, v int")
    p = T.shuffled(d, "id", "v", 5, seed=1)
    counts = {(r["perm"], r["v"]): r["count"] for r in p.groupBy("perm", "v").count().collect()}
    assert len(counts) == 20 and set(counts.values()) == {25}
    assert p.groupBy("perm").agg(F.count_distinct("id").alias("n")).where("n <> 100").count() == 0


def test_shuffled_counts_keep_both_margins(spark, monkeypatch):
    monkeypatch.setattr("cohortgrid.operators.draws.CHUNK", 3)
    cells = spark.createDataFrame([(i, 4 + i) for i in range(10)], "c int, n long")
    got = T.shuffled_counts(cells, ["c"], [40, 25, 20], 120, seed=1).toPandas()
    assert len(got) == 1200 and (got[["_c0", "_c1", "_c2"]].sum(axis=1) == got["c"] + 4).all()
    assert got.groupby("perm")[["_c0", "_c1", "_c2"]].sum().drop_duplicates().to_numpy().tolist() == [[40, 25, 20]]
    one = got[got["c"] == 9]["_c0"]
    # Mean and variance of the hypergeometric law, with room for 120 draws.
    assert abs(one.mean() - 13 * 40 / 85) < 0.6 and 0.6 < one.var() / (13 * 40 / 85 * 45 / 85 * 72 / 84) < 1.6


def test_nulls_from_counts_agree_with_shuffled_rows(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, float(rng.integers(60)), int(rng.integers(2)), int(rng.integers(3)), float(rng.integers(7))) for i in range(200)], "id int, time double, event int, grp int, y double")
    fast = K.logrank_null(d, [0, 1], 300, seed=2).toPandas()["statistic"]
    slow = K.logrank(T.shuffled(d.select("id", "grp"), "id", "grp", 300, seed=2).join(d.drop("grp"), "id"), ["perm"], [0, 1]).toPandas()["statistic"]
    assert len(fast) == 300 and fast.mean() == pytest.approx(slow.mean(), rel=0.3) and fast.quantile(0.9) == pytest.approx(slow.quantile(0.9), rel=0.4)
    r = T.spearman_null(d, "id", "time", "y", 300, seed=3).first()
    assert abs(r["null_mean"]) < 0.02 and r["null_sd"] == pytest.approx(199**-0.5, rel=0.15)


def test_draw_correlations_match_the_joined_rows(spark):
    rng = np.random.default_rng(5)
    z = spark.createDataFrame([(s, f"g{f}", float(rng.normal())) for s in range(12) for f in range(9) if (s + f) % 5], "sample_id long, feature string, value double")
    c = spark.createDataFrame([(k, f"g{f}", float(rng.normal())) for k in range(3) for f in range(9) if f != k], "cluster long, feature string, value double")
    draws = spark.createDataFrame([(d, f"g{f}") for d in range(6) for f in range(9) if (f * 7 + d) % 3], "draw int, feature string")
    got = {(r["draw"], r["sample_id"], r["cluster"]): r["r"] for r in T.draw_correlations(z, c, draws).collect()}
    j = draws.join(c.withColumnRenamed("value", "_c"), "feature").join(z.withColumnRenamed("value", "_z"), "feature")
    expected = {(r["draw"], r["sample_id"], r["cluster"]): r["r"] for r in j.groupBy("draw", "sample_id", "cluster").agg(F.corr("_z", "_c").alias("r")).collect()}
    assert got == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("name, replicates", [("sta_10_composition_null", 1000), ("sta_11_random_sets", 200), ("sta_12_matched_sets", 200)])
def test_registered_nulls_have_all_replicates(spark, folder, name, replicates):
    from cohortgrid import bindings

    assert bindings.load()[0][name](spark, folder).first()["n_null"] == replicates


def test_transfer_job_has_1000_shuffles(spark, folder):
    from cohortgrid import bindings

    p = bindings.load()[0]["job_04_transfer_test"](spark, folder).first()["composition_p"] * 1001
    assert p == pytest.approx(round(p), abs=1e-6)


def test_registered_models_do_the_whole_job(spark, folder):
    from cohortgrid import bindings

    q = bindings.load()[0]
    assert {r["config"] for r in q["mlm_02_gaussian_mixture"](spark, folder).select("config").distinct().collect()} == {f"full_{k}" for k in range(2, 9)}
    assert sorted(r["fold"] for r in q["mlm_07_elastic_net"](spark, folder).collect()) == [0, 1, 2, 3, 4]


def test_inverse_normal_centre_and_order(spark):
    d = spark.createDataFrame([(1, f"g{i}", float(i)) for i in range(5)], "sample_id int, feature string, value double")
    z = [r["value"] for r in S.inverse_normal(d).orderBy("feature").collect()]
    assert z == sorted(z) and z[2] == pytest.approx(0.0, abs=1e-12) and z[0] == pytest.approx(-z[4])


@pytest.mark.parametrize("shared", [10_000, 1])
def test_nearest_references_shared_and_tiled(spark, monkeypatch, shared):
    rng = np.random.default_rng(2)
    q, r = rng.normal(size=(30, 6)), rng.normal(size=(50, 6))
    mk = lambda m: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id int, vec array<double>")
    monkeypatch.setattr(B, "SHARED_VALUES", shared)
    monkeypatch.setattr(B, "TILE_VALUES", 60)
    got = J.nearest_references(mk(q), mk(r), 3).toPandas().sort_values(["query_id", "rank"])
    sim = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
    want = np.argsort(-sim, axis=1)[:, :3].ravel()
    assert got["ref_id"].tolist() == want.tolist()


def test_text_rules(spark):
    t = ["We RECOMMEND this", "a cure is near", "curette", "p was 0.038 in 1200 rows", "All gates passed", "no gate failed", ""]
    assert [len(x) for x in col(spark, t, X.matched_patterns)] == [1, 1, 0, 0, 0, 0, 0]
    assert col(spark, t, X.numbers)[3] == ["0.038", "1200"]
    assert col(spark, t, X.claims_all_passed) == [False, False, False, False, True, True, False]
    assert col(spark, ["improved survival", "no benefit", "improved response but resistance", "plain", ""], X.stance) == ["supporting", "conflicting", "unclear", "neutral", "unclear"]


def test_numbers_are_grounded_at_the_quoted_precision(spark):
    from cohortgrid.operators.documents import unsupported_numbers

    texts = spark.createDataFrame([(1, 1, "p = 0.038, share 62%, n = 1082, made up 0.0021 and 77")], "text_id int, context_id int, text string")
    ctx = spark.createDataFrame([(1, 0.03797, None), (1, 0.62, None), (1, 1082.0, None), (1, 0.002, None)], "context_id int, value double, label string")
    assert unsupported_numbers(texts, ctx).first()["unsupported_numbers"] == ["0.0021", "77"]


@pytest.mark.parametrize("shared", [10_000, 1])
def test_silhouette_shared_and_tiled(spark, monkeypatch, shared):
    rng = np.random.default_rng(8)
    x, lab = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(60):
        a = d[i, lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        b = min(d[i, lab == g].mean() for g in range(3) if g != lab[i])
        want.append((b - a) / max(a, b))
    monkeypatch.setattr(B, "SHARED_VALUES", shared)
    monkeypatch.setattr(B, "TILE_VALUES", 50)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(g)) for i, (r, g) in enumerate(zip(x, lab))], "id int, vec array<double>, cluster int")
    assert V.silhouette(df).first()["silhouette"] == pytest.approx(np.mean(want))


@pytest.mark.parametrize("block", [2048, 4])
def test_set_variation_in_one_and_many_tiles(spark, monkeypatch, block):
    rng = np.random.default_rng(9)
    sets = {i: set(rng.choice(40, size=rng.integers(1, 15), replace=False).tolist()) for i in range(18)}
    js = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(18) for j in range(i + 1, 18)]
    monkeypatch.setattr(A, "SET_BLOCK", block)
    r = A.set_variation(spark.createDataFrame([(i, int(m)) for i, s in sets.items() for m in s], "set_id int, member int")).first()
    assert r["jaccard_mean"] == pytest.approx(np.mean(js)) and r["jaccard_median"] == pytest.approx(np.median(js))
    assert r["jaccard_min"] == pytest.approx(min(js)) and r["jaccard_max"] == pytest.approx(max(js))


def test_infinite_values_and_empty_cells(spark):
    """Only finite values count; a group without any is still a test with effect 0 and p 1."""
    from cohortgrid.operators import stats as S

    rows = [("f", c, float(v)) for c in (0, 1) for v in range(5 * c, 5 * c + 6)] + [("f", 0, float("inf")), ("f", 1, float("-inf")), ("f", 2, float("nan")), ("f", 2, None)]
    df = spark.createDataFrame(rows, "feature string, cluster int, value double")
    clean = df.where("cluster < 2 AND abs(value) < 100")
    for test in (lambda d: S.mann_whitney(d, "gene"), S.welch_one_vs_rest):
        got = {r["cluster"]: r.asDict() for r in test(df).collect()}
        want = {r["cluster"]: r.asDict() for r in test(clean).collect()}
        assert got[2]["effect"] == 0.0 and got[2]["p"] == 1.0 and (got[2]["n_in"], got[2]["n_out"]) == (0, 12)
        for c in (0, 1):
            assert all(got[c][k] == (pytest.approx(v, rel=1e-9) if isinstance(v, float) else v) for k, v in want[c].items())


def test_nothing_is_cut_by_default(spark):
    from cohortgrid.operators import documents as D
    from cohortgrid.operators import signatures as G

    deep = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":' + str(list(range(30))) + "}}}}}}}}")], "k int, js string")
    paths = {r["path"] for r in D.flatten_json(deep, "k", "js").collect()}
    assert "a.b.c.d.e.f.g.h" in paths and "a.b.c.d.e.f.g.h[29]" in paths
    texts = spark.createDataFrame([(1, 1, "it is 0.123456789 here")], "text_id int, context_id int, text string")
    context = spark.createDataFrame([(1, 0.123456789, None)], "context_id int, value double, label string")
    assert D.unsupported_numbers(texts, context).first()["unsupported_numbers"] == []
    long_ = "x" * 2000
    record = spark.createDataFrame([('{"title":"t","abstract":"' + long_ + '"}',)], "js string")
    assert D.parse_citation_records(record, "js").first()["excerpt"] == long_
    coefs = spark.createDataFrame([(0, f"g{i}", float(i - 150), 0.01) for i in range(300)], "cluster int, feature string, coef double, fdr double")
    assert G.cluster_detail(coefs, 100).count() == 200
    stats = spark.createDataFrame([("A", 0.0, 1.0), ("B", 0.0, 1.0)], "feature string, mean double, sd double")
    profiles = spark.createDataFrame([(1, "a", 1.0), (2, "zz", 1.0)], "profile_id int, feature string, value double")
    cover = {r["profile_id"]: (r["found"], r["coverage"], r["missing"]) for r in G.profile_coverage(G.align_profiles(profiles, stats), stats, profiles).collect()}
    assert cover == {1: (1, 0.5, ["B"]), 2: (0, 0.0, ["A", "B"])}
