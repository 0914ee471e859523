"""Models and end-to-end jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortgrid.bindings.registry import query
from cohortgrid.bindings.scoring import CE, RES, cluster_lists, network, stats, zscores
from cohortgrid.bindings.summaries import profiles
from cohortgrid.bindings.tables import M, measurements, pick, r6, survival, table
from cohortgrid.bindings.testing import MW, TN, WELCH, transfer, tumour_normal, tumour_pairs
from cohortgrid.operators import evaluation as V
from cohortgrid.operators import mixtures as MX
from cohortgrid.operators import ml as ML
from cohortgrid.operators import signatures as G
from cohortgrid.plans import jobs as P


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def latent(spark, folder, k=6):
    v = vectors(spark, folder)
    return ML.fit_projection(v, k).apply(v).select("id", "latent", "label")


@query("mlm_01_projection")
def _(spark, folder):
    v = vectors(spark, folder)
    p = ML.fit_projection(v, 2)
    return p.apply(v).select("id", F.col("latent")[0].alias("x"), F.col("latent")[1].alias("y"))


@query("mlm_01_loadings")
def _(spark, folder):
    return ML.fit_projection(vectors(spark, folder), 4).loadings(spark, [f"g{i:02d}" for i in range(64)], 5)


def mixtures(spark, folder, *kinds):
    return MX.fit_all(latent(spark, folder), range(2, 9), kinds)


def assigned(fits):
    """id, cluster, top, config and bic of every row under every model."""
    config = F.concat_ws("_", "kind", "k").alias("config")
    return fits.assignments().join(fits.selection(), ["kind", "k"]).select("id", "cluster", F.array_max("membership").alias("top"), config, "bic")


def invariants(fits):
    """What holds for any fit: each row assigned once per model, memberships and weights that add up."""
    held = fits.assignments().groupBy("kind", "k").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.aggregate("membership", F.lit(0.0), lambda s, x: s + x)) / F.count(F.lit(1))).alias("membership"), F.count_if(F.size("membership") == F.col("k")).alias("n_whole"))
    weight = fits.parameters().groupBy("kind", "k").agg(r6(F.sum("weight")).alias("weight"), F.count(F.lit(1)).alias("components"))
    return held.join(weight, ["kind", "k"]).join(fits.selection().select("kind", "k", F.col("n").alias("n_fitted")), ["kind", "k"])


def invariants_sql(*kinds):
    return f"""
SELECT kind, CAST(k AS INTEGER) AS k, count(*) AS n, 1.0::DOUBLE AS membership, count(*) AS n_whole, 1.0::DOUBLE AS weight, k AS components, count(*) AS n_fitted
FROM embeddings, (SELECT unnest({list(kinds)}) AS kind), range(2, 9) AS r(k) WHERE embedding IS NOT NULL GROUP BY kind, k"""


@query("mlm_02_gaussian_mixture")
def _(spark, folder):
    return assigned(mixtures(spark, folder, "full"))


@query("mlm_02_invariants", invariants_sql("full"))
def _(spark, folder):
    return invariants(mixtures(spark, folder, "full"))


@query("mlm_03_constrained_mixture")
def _(spark, folder):
    return assigned(mixtures(spark, folder, "diag", "tied"))


@query("mlm_03_invariants", invariants_sql("diag", "tied"))
def _(spark, folder):
    return invariants(mixtures(spark, folder, "diag", "tied"))


@query("mlm_04_kmeans")
def _(spark, folder):
    return assigned(mixtures(spark, folder, "kmeans")).drop("bic")


@query("mlm_04_one_hot", """
SELECT CAST(k AS INTEGER) AS k, count(*) AS n, count(*) AS n_one_hot, k AS clusters FROM embeddings, range(2, 9) AS r(k) WHERE embedding IS NOT NULL GROUP BY k""")
def _(spark, folder):
    a = mixtures(spark, folder, "kmeans").assignments()
    hot = (F.get("membership", F.col("cluster")) == 1.0) & (F.aggregate("membership", F.lit(0.0), lambda s, x: s + x) == 1.0)
    return a.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(hot).alias("n_one_hot"), F.count_distinct("cluster").alias("clusters"))


@query("mlm_05_nearest_centroid", f"""
WITH {M}, c AS (SELECT label % 5 AS subtype, feature, avg(value) AS c FROM m WHERE cohort = 0 GROUP BY 1, 2), d AS (SELECT m.sample_id, c.subtype, sum(pow(value - c, 2)) AS distance, count(*) AS n_shared FROM m JOIN c USING (feature) WHERE m.cohort = 1 GROUP BY 1, 2)
SELECT sample_id, subtype, round(distance, 6) AS distance, n_shared FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(distance, 12), subtype) AS rn FROM d) WHERE rn = 1""")
def _(spark, folder):
    m = measurements(spark, folder)
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") % 5).alias("subtype"))
    out = ML.nearest_centroid(m.where(F.col("cohort") == 0).drop("subtype"), labels, m.where(F.col("cohort") == 1), "subtype")
    return out.withColumn("distance", r6("distance"))


@query("mlm_06_signature_classifier", f"""
WITH {M}, x AS (SELECT sample_id, sample_id % 5 AS fold, cluster, feature, value FROM m), f AS (SELECT unnest([0,1,2,3,4]) AS fold), tr AS (SELECT f.fold, x.cluster, x.feature, x.value FROM x JOIN f ON f.fold <> x.fold),
st AS (SELECT fold, feature, avg(value) AS mu, stddev_samp(value) AS sd, sum(value) AS s, count(*) AS n FROM tr GROUP BY 1, 2), cf AS (SELECT tr.fold, tr.cluster, tr.feature, avg(tr.value) - (any_value(s) - sum(tr.value)) / (any_value(n) - count(*)) AS coef FROM tr JOIN st ON st.fold = tr.fold AND st.feature = tr.feature GROUP BY 1, 2, 3),
sg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, cluster ORDER BY round(abs(coef), 12) DESC, feature) AS rn FROM cf) WHERE rn <= 30),
sc AS (SELECT x.fold, x.sample_id, x.cluster AS truth, sg.cluster, sum(coef * (value - mu) / sd) / sqrt(sum(coef * coef) * sum(pow((value - mu) / sd, 2))) AS score FROM x JOIN sg ON sg.fold = x.fold AND sg.feature = x.feature JOIN st ON st.fold = x.fold AND st.feature = x.feature GROUP BY 1, 2, 3, 4),
e AS (SELECT *, exp(score / 0.15) AS e FROM sc)
SELECT fold, sample_id, truth, cluster, round(score, 6) AS score, round(e / sum(e) OVER (PARTITION BY fold, sample_id), 6) AS probability, first_value(cluster) OVER (PARTITION BY fold, sample_id ORDER BY round(score, 12) DESC, cluster) AS predicted FROM e""")
def _(spark, folder):
    m = measurements(spark, folder)
    folds = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 5).cast("int").alias("fold"), (F.col("label") % 4).alias("cluster"))
    return ML.signature_classifier_cv(m.select("sample_id", "feature", "value"), folds, 30).withColumns({"score": r6("score"), "probability": r6("probability")})


@query("mlm_07_elastic_net")
def _(spark, folder):
    m = measurements(spark, folder).select("sample_id", "feature", "value")
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") % 4).alias("cluster"))
    folds = ML.stratified_folds(labels, 5)
    feats = ML.top_variance_features(m, 1500)
    out = ML.elastic_net_cv(m, folds, feats, max_iter=2000)
    return V.class_metrics(out.select("fold", "cluster", F.col("predicted").cast("long").alias("predicted")), "cluster", "predicted", ["fold"])


def model_table(spark, folder):
    """A coefficient table from the data: cluster centroids as coefficients."""
    m = measurements(spark, folder)
    st = m.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("scale"))
    c = m.groupBy("cluster", "feature").agg((F.avg("value") * 8).alias("coef"))
    return c.join(st, "feature").select("cluster", F.upper("feature").alias("feature"), "coef", "mean", "scale")


@query("mlm_08_score_profiles", f"""
WITH {M}, st AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM m GROUP BY 1), c AS (SELECT cluster, feature, avg(value) * 8 AS coef FROM m GROUP BY 1, 2), pf AS (SELECT sample_id AS profile_id, feature, value FROM m WHERE CAST(substr(feature, 2) AS INTEGER) % (1 + sample_id % 4) = 0),
lg AS (SELECT profile_id, c.cluster, 0.1 * c.cluster + sum(coef * (value - mu) / sd) AS l FROM pf JOIN st USING (feature) JOIN c USING (feature) GROUP BY 1, 2), pr AS (SELECT profile_id, cluster, exp(l) / sum(exp(l)) OVER (PARTITION BY profile_id) AS p FROM lg), n AS (SELECT profile_id, count(*) / 64 AS cov FROM pf GROUP BY 1),
b AS (SELECT profile_id, arg_max(cluster, p) AS top_cluster, max(p) AS tp FROM pr GROUP BY 1)
SELECT profile_id, top_cluster, round(tp, 6) AS top_probability, round(cov, 6) AS coverage, CASE WHEN cov < 0.6 THEN 'abstain' WHEN tp >= 0.55 THEN 'high' WHEN tp >= 0.4 THEN 'moderate' WHEN tp < 0.25 THEN 'abstain' ELSE 'low' END AS confidence, CASE WHEN cov < 0.6 THEN 'coverage_too_low' WHEN tp >= 0.4 THEN NULL WHEN tp < 0.25 THEN 'probability_too_low' ELSE 'diffuse' END AS warning FROM b JOIN n USING (profile_id)""")
def _(spark, folder):
    m = measurements(spark, folder)
    pos = F.substring("feature", 2, 2).cast("int")
    pf = m.where(pos % (1 + F.col("sample_id") % 4) == 0).select(F.col("sample_id").alias("profile_id"), "feature", "value")
    inter = m.select("cluster").distinct().withColumn("intercept", 0.1 * F.col("cluster"))
    out = ML.score_profiles(pf, model_table(spark, folder), inter)
    return out.select("profile_id", "top_cluster", r6("top_probability").alias("top_probability"), r6("coverage").alias("coverage"), "confidence", "warning")


@query("mlm_09_response")
def _(spark, folder):
    x = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select("doc_id", (F.ln("n_chars") - 6).alias("score"), "quality", "lang")
    b, s = ML.fit_response(x.where(F.col("doc_id") % 2 == 0), "score", "quality")
    scored = x.withColumn("p", ML.response_probability(F.col("score"), b, s))
    auc = V.auroc(scored.where(F.col("doc_id") % 2 == 1), "p", "quality", ["lang"]).select(F.col("lang").alias("cohort"), "auroc")
    regimens = scored.select(F.col("doc_id").alias("profile_id"), F.array(F.lit("5-Fluorouracil"), pick(["doxorubicin", "cisplatin"], F.col("doc_id")), pick(["Paclitaxel", "docetaxel", "none"], F.col("doc_id"))).alias("drugs"))
    cohorts = scored.select(F.col("lang").alias("cohort")).distinct().select("cohort", F.array(F.lit("5-fluorouracil"), F.lit("doxorubicin")).alias("base"), F.array(F.lit("paclitaxel"), F.lit("docetaxel")).alias("options"), F.col("cohort").alias("position"))
    gate = ML.applicability(regimens, cohorts, auc, 0.5)
    return gate.join(scored.select(F.col("doc_id").alias("profile_id"), "p"), "profile_id").withColumn("p", F.when(F.col("gate_passed"), F.col("p")))


@query("mlm_10_principal_vectors")
def _(spark, folder):
    v = vectors(spark, folder)
    a, b = ML.fit_projection(v.where(F.col("id") % 2 == 0), 6), ML.fit_projection(v.where(F.col("id") % 2 == 1), 6)
    src, _tgt, angles = ML.principal_vectors(a, b, 3)
    out = ML.apply_directions(v, src, "vec", "aligned")
    return out.select("id", F.posexplode("aligned").alias("axis", "value")).withColumn("angle", F.element_at(F.array(*[F.lit(float(x)) for x in angles[:3]]), F.col("axis") + 1))


@query("mlm_11_multi_view")
def _(spark, folder):
    v = vectors(spark, folder)
    views = {"first": v.select("id", F.slice("vec", 1, 32).alias("vec")), "second": v.where(F.col("id") % 4 != 0).select("id", F.slice("vec", 33, 32).alias("vec"))}
    return ML.multi_view_encoder(views, 3)


@query("mlm_12_deconvolve")
def _(spark, folder):
    m = measurements(spark, folder).withColumn("value", F.col("value") * 10 + 5)
    c = m.where(F.col("cohort") == 0).groupBy(F.concat(F.lit("t"), F.col("cluster").cast("string")).alias("cell_type"), "feature").agg(F.avg("value").alias("value"))
    return ML.deconvolve(m.where(F.col("cohort") == 1).select("sample_id", "feature", "value"), c)


def regression(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), (F.col("l_quantity") / 50).alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"), (F.col("l_extendedprice") / 100000).alias("y"), F.col("l_returnflag").alias("platform"))


@query("mlm_13_conformal")
def _(spark, folder):
    d = regression(spark, folder).withColumn("_h", F.pmod(F.xxhash64("row"), F.lit(3)))
    iv = ML.conformal_intervals(d.where("_h = 0"), d.where("_h = 1"), d.where("_h = 2"), ["a", "b", "c"], "y")
    return ML.coverage(iv, "y", "platform")


@query("mlm_14_refit_weights")
def _(spark, folder):
    w = ML.refit_weights(regression(spark, folder), ["a", "b", "c"], "y", {"a": 0.6, "b": 0.25, "c": 0.15})
    return spark.createDataFrame([(k, v[0], v[1]) for k, v in w.items()], "stream string, weight double, shift double")


@query("mlm_15_abstention", """
WITH w AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'partial' ELSE 'full' END AS view_set, l_orderkey % 5 = 0 AS held_out, l_extendedprice * CASE WHEN l_linenumber % 3 = 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS width FROM lineitem), t AS (SELECT quantile_cont(width, 0.98) AS tau FROM w WHERE view_set = 'full' AND held_out)
SELECT view_set, round(avg(CAST(width > tau AS INTEGER)), 6) AS abstention_rate, count(*) AS n, round(any_value(tau), 4) AS tau FROM w, t GROUP BY 1""")
def _(spark, folder):
    part = F.col("l_linenumber") % 3 == 0
    w = table(spark, folder, "lineitem").select(F.when(part, "partial").otherwise("full").alias("view_set"), (F.col("l_orderkey") % 5 == 0).alias("held_out"), (F.col("l_extendedprice") * F.when(part, 1.2).otherwise(1.0)).alias("width"))
    return ML.abstention(w).withColumns({"abstention_rate": r6("abstention_rate"), "tau": r6("tau", 4)})


@query("evl_06_bootstrap_stability")
def _(spark, folder):
    return MX.fit_all(latent(spark, folder, 16), range(2, 9), ("full",), n_boot=50).stability()


# ---- jobs ---------------------------------------------------------------------------------------------
def families(m):
    return m.select("feature").distinct().select("feature", F.when(F.col("feature") < "g14", "pathway").when(F.col("feature") < "g30", "tf").otherwise("gene").alias("family"))


@query("job_profile_matrix")
def _(spark, folder):
    m = measurements(spark, folder).select("sample_id", "cluster", "feature", "value")
    return P.profile_matrix(m, families(m), [0, 1, 2, 3], {"pathway": 14, "tf": 10, "gene": 30})


@query("job_01_assemble_cohort")
def _(spark, folder):
    s = survival(spark, folder).select("id", "time", "event")
    out = P.assemble_cohort(vectors(spark, folder).select("id", "vec"), s)
    return out["logrank"].select("config_id", "statistic", "df", "p", "q", "n", "n_events")


@query("job_02_feature_profiles", f"""
WITH {MW}, {WELCH.replace(M + ', ', '')}
SELECT feature, CASE WHEN feature < 'g14' THEN 'pathway' ELSE 'tf' END AS family, cluster, round(effect, 6) AS effect, round(z, 5) AS statistic FROM mw WHERE feature < 'g30'
UNION ALL SELECT feature, 'gene', cluster, round(effect, 6), round(effect / sqrt(v1 / n1 + v2 / n2), 5) FROM w WHERE feature >= 'g30'""")
def _(spark, folder):
    m = measurements(spark, folder).select("sample_id", "cluster", "feature", "value")
    a = m.where(F.col("feature") < "g30").withColumn("family", F.when(F.col("feature") < "g14", "pathway").otherwise("tf"))
    out = P.feature_profiles(a, m.where(F.col("feature") >= "g30"))
    return out.select("feature", "family", "cluster", r6("effect").alias("effect"), r6("statistic", 5).alias("statistic"))


@query("job_03_cluster_reversal", f"""
WITH {TN}, q AS (SELECT cluster, feature, log2fc FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(log2fc, 12) DESC, feature) AS a, row_number() OVER (PARTITION BY cluster ORDER BY round(log2fc, 12), feature) AS b FROM tn) WHERE a <= 15 OR b <= 15),
c AS (SELECT q.cluster, m.sample_id, -corr(log2fc, value) AS s FROM m JOIN q USING (feature) GROUP BY 1, 2), g AS (SELECT cluster, 'drug ' || (sample_id % 50) AS drug, median(s) AS r, count(*) AS n_signatures FROM c GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT cluster, drug, round(r, 6) AS reversal_score, n_signatures, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(r, 12) DESC, drug) AS rank FROM g) WHERE rank <= 20""")
def _(spark, folder):
    m = measurements(spark, folder)
    pert = m.select(F.col("sample_id").alias("sig_id"), "feature", "value")
    meta = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sig_id"), F.concat(F.lit("drug "), (F.col("vec_id") % 50).cast("string")).alias("drug"))
    roles = table(spark, folder, "region").select(F.col("r_regionkey").alias("cluster"), F.lit("er_high").alias("role"))
    out, _control = P.cluster_reversal(tumour_normal(spark, folder), tumour_pairs(spark, folder), pert, meta, roles, {"er_high": ["drug 1", "drug 2"]}, 15, 20)
    return out.withColumn("reversal_score", r6("reversal_score"))


@query("job_04_transfer_test")
def _(spark, folder):
    z, c = transfer(spark, folder)
    e = table(spark, folder, "embeddings")
    sub = e.select(F.col("vec_id").alias("sample_id"), (F.col("label") % 5).alias("subtype"))
    ref = e.where(F.col("vec_id") % 2 == 0).select((F.col("label") % 4).alias("cluster"), (F.col("label") % 5).alias("subtype"))
    s = survival(spark, folder).select(F.col("id").alias("sample_id"), "time", "event")
    return P.transfer_test(z, c, ref, sub, s, [0, 1, 2, 3], [0, 1, 2, 3, 4])


@query("job_05_analyse_profiles", f"""
WITH {RES.replace(M, CE, 1)}, l1a AS (SELECT cluster, feature, 'up' AS d FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect DESC, feature) AS r FROM ce WHERE effect > 0) WHERE r <= 12 UNION ALL SELECT cluster, feature, 'down' FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect, feature) AS r FROM ce WHERE effect < 0) WHERE r <= 12),
s1 AS (SELECT x.cluster, m.sample_id, round(avg(value) FILTER (WHERE d = 'down') - avg(value) FILTER (WHERE d = 'up'), 12) AS s FROM m JOIN l1a x USING (feature) GROUP BY 1, 2), d1 AS (SELECT cluster, 'drug ' || (sample_id % 50) AS canonical, max(s) AS rs FROM s1 GROUP BY 1, 2), p1 AS (SELECT cluster, canonical, 1.0 - (row_number() OVER (PARTITION BY cluster ORDER BY rs DESC, canonical) - 1.0) / greatest(count(*) OVER (PARTITION BY cluster) - 1, 1) AS pc1 FROM d1),
s2 AS (SELECT x.profile_id, m.sample_id, round(avg(value) FILTER (WHERE direction = 'down') - avg(value) FILTER (WHERE direction = 'up'), 12) AS s FROM m JOIN ra x USING (feature) GROUP BY 1, 2), d2 AS (SELECT profile_id, 'drug ' || (sample_id % 50) AS canonical, max(s) AS rs, count(DISTINCT sample_id % 10) AS nc, avg(CAST(s > 0 AS INTEGER)) AS co FROM s2 GROUP BY 1, 2),
p2 AS (SELECT *, 1.0 - (row_number() OVER (PARTITION BY profile_id ORDER BY rs DESC, canonical) - 1.0) / greatest(count(*) OVER (PARTITION BY profile_id) - 1, 1) AS pc2 FROM d2), j AS (SELECT vec_id AS profile_id, p1.canonical, pc1, pc2, nc, co FROM embeddings JOIN p1 ON p1.cluster = label % 4 JOIN p2 ON p2.profile_id = vec_id AND p2.canonical = p1.canonical)
SELECT profile_id, canonical, round(least(pc1, pc2), 6) AS weaker_percentile, round(sqrt(pc1 * pc2), 6) AS rank_product, CAST(least(pc1, pc2) < 0.55 AS INTEGER) + CAST(nc <= 1 AS INTEGER) + CAST(co < 0.4 AS INTEGER) >= 2 OR (least(pc1, pc2) < 0.55 AND (nc <= 1 OR co < 0.4)) AS likely_artifact, row_number() OVER (PARTITION BY profile_id ORDER BY round(least(pc1, pc2), 12) DESC, round(sqrt(pc1 * pc2), 12) DESC, canonical) AS nomination_rank FROM j""")
def _(spark, folder):
    z, cent = zscores(spark, folder)
    e = table(spark, folder, "embeddings")
    a = e.select(F.col("vec_id").alias("profile_id"), (F.col("label") % 4).alias("cluster"))
    pert = measurements(spark, folder).select(F.col("sample_id").alias("sig_id"), "feature", "value")
    meta = e.select(F.col("vec_id").alias("sig_id"), F.concat(F.lit("drug "), (F.col("vec_id") % 50).cast("string")).alias("drug"), (F.col("vec_id") % 10).alias("cell_id"))
    out = P.analyse_profiles(a, z.drop("cluster"), cent, cluster_lists(spark, folder), pert, meta, 10)
    return out.select("profile_id", "canonical", r6("weaker_percentile").alias("weaker_percentile"), r6("rank_product").alias("rank_product"), "likely_artifact", "nomination_rank")


@query("job_06_refresh")
def _(spark, folder):
    p = profiles(spark, folder)
    old, _ = P.refresh_derived(p.withColumn("effect", F.round(F.col("effect"), 1)).withColumn("q", F.col("q") / 10), spark.createDataFrame([], "cluster long, takeaway string"), [0, 1, 2, 3], {"pathway": 14})
    _, changes = P.refresh_derived(p.withColumn("q", F.col("q") / 12), old, [0, 1, 2, 3], {"pathway": 14})
    return changes


@query("job_07_enrich_neighbours")
def _(spark, folder):
    v = vectors(spark, folder).withColumn("subtype", F.col("label") % 5)
    return P.enrich_neighbours(v.where(F.col("label") != 9), v.where(F.col("label") == 9))
