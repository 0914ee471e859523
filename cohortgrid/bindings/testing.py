"""Statistics, survival and evaluation operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortgrid.bindings.registry import query
from cohortgrid.bindings.summaries import FAMILY
from cohortgrid.bindings.tables import M, S, measurements, r6, survival, table
from cohortgrid.operators import aggregates as A
from cohortgrid.operators import evaluation as V
from cohortgrid.operators import joins as J
from cohortgrid.operators import stats as S_
from cohortgrid.operators import survival as K
from cohortgrid.operators import windows as W

MW = f"""{M}, rk AS (SELECT feature, cluster, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature) AS n, sum(value) OVER (PARTITION BY feature) AS sall FROM m),
tie AS (SELECT feature, sum(t * t * t - t) AS tt FROM (SELECT feature, count(*)::DOUBLE AS t FROM m GROUP BY feature, value) GROUP BY 1),
rs AS (SELECT feature, cluster, count(*) AS n_in, max(n) - count(*) AS n_out, sum(r) - count(*) * (count(*) + 1) / 2.0 AS u, avg(value) AS mean_in, (max(sall) - sum(value)) / (max(n) - count(*)) AS mean_out, max(n) AS n FROM rk GROUP BY 1, 2),
mw AS (SELECT rs.*, 2 * u / (n_in * n_out) - 1 AS effect, greatest(abs(u - n_in * n_out / 2.0) - 0.5, 0) / sqrt(n_in * n_out / 12.0 * (n + 1 - tt / (n * (n - 1.0)))) AS z FROM rs JOIN tie USING (feature))"""


@query("sta_01_mann_whitney", f"""
WITH {MW} SELECT feature, 'gene' AS family, cluster, n_in, n_out, round(u, 3) AS u, round(z, 6) AS z, round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out FROM mw""")
def _(spark, folder):
    out = S_.mann_whitney(measurements(spark, folder), "gene")
    return out.select("feature", "family", "cluster", "n_in", "n_out", r6("u", 3).alias("u"), r6("z").alias("z"), r6("mean_in").alias("mean_in"), r6("mean_out").alias("mean_out"))


@query("sta_01_mann_whitney_q")
def _(spark, folder):
    return S_.with_q(S_.mann_whitney(measurements(spark, folder), "gene"))


@query("sta_02_cliffs_delta", f"""
WITH {MW} SELECT feature, cluster, round(effect, 6) AS effect FROM mw""")
def _(spark, folder):
    return S_.mann_whitney(measurements(spark, folder), "gene").select("feature", "cluster", r6("effect").alias("effect"))


WELCH = f"""{M}, c AS (SELECT DISTINCT cluster FROM m), w AS (SELECT feature, c.cluster, avg(value) FILTER (WHERE m.cluster = c.cluster) - avg(value) FILTER (WHERE m.cluster <> c.cluster) AS effect,
 count(*) FILTER (WHERE m.cluster = c.cluster) AS n1, count(*) FILTER (WHERE m.cluster <> c.cluster) AS n2, var_samp(value) FILTER (WHERE m.cluster = c.cluster) AS v1, var_samp(value) FILTER (WHERE m.cluster <> c.cluster) AS v2 FROM m CROSS JOIN c GROUP BY 1, 2)"""


@query("sta_03_welch", f"""
WITH {WELCH} SELECT feature, 'gene' AS family, cluster, round(effect, 6) AS effect, round(effect / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df, n1 AS n_in, n2 AS n_out FROM w""")
def _(spark, folder):
    out = S_.welch_one_vs_rest(measurements(spark, folder))
    return out.select("feature", "family", "cluster", r6("effect").alias("effect"), r6("t").alias("t"), r6("df", 4).alias("df"), "n_in", "n_out")


@query("sta_03_welch_q")
def _(spark, folder):
    return S_.with_q_where_tested(S_.welch_one_vs_rest(measurements(spark, folder)))


def tumour_normal(spark, folder):
    m = measurements(spark, folder)
    return m.select("sample_id", (F.col("sample_id") % 100).alias("patient"), F.when(F.col("label") == 9, "normal").otherwise("tumour").alias("grp"), "cluster", "feature", "value")


def tumour_pairs(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 100).alias("patient"), F.when(F.col("label") == 9, "normal").otherwise("tumour").alias("grp"))
    return J.matched_pairs(e, [F.col("sample_id")])


TN = f"""{M}, x AS (SELECT *, sample_id % 100 AS patient, CASE WHEN label = 9 THEN 'normal' ELSE 'tumour' END AS grp FROM m), t AS (SELECT * FROM x WHERE grp = 'tumour'), n AS (SELECT * FROM x WHERE grp = 'normal'),
pr AS (SELECT patient, tumour_id, normal_id FROM (SELECT patient, min(sample_id) AS tumour_id FROM t GROUP BY 1) JOIN (SELECT DISTINCT patient, sample_id AS normal_id FROM n) USING (patient)),
ns AS (SELECT feature, count(*) AS n2, avg(value) AS m2, var_samp(value) AS v2 FROM n GROUP BY 1), ts AS (SELECT cluster, feature, avg(value) AS mt FROM t GROUP BY 1, 2),
pd AS (SELECT t.cluster, t.feature, count(*) AS n_paired, avg(t.value - n.value) AS md, stddev_samp(t.value - n.value) AS sd FROM pr JOIN t ON t.sample_id = tumour_id JOIN n ON n.sample_id = normal_id AND n.feature = t.feature GROUP BY 1, 2),
us AS (SELECT cluster, feature, count(*) AS n1, avg(value) AS m1, var_samp(value) AS v1 FROM t WHERE patient NOT IN (SELECT patient FROM pr) GROUP BY 1, 2),
tn AS (SELECT ts.cluster, ts.feature, mt - m2 AS log2fc, coalesce(n_paired, 0) AS n_paired, coalesce(n1, 0) AS n_unpaired, CASE WHEN n_paired >= 3 THEN md / (sd / sqrt(n_paired)) END AS t_paired, CASE WHEN n1 >= 3 AND n2 >= 3 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END AS t_unpaired
 FROM ts JOIN ns USING (feature) LEFT JOIN pd ON pd.cluster = ts.cluster AND pd.feature = ts.feature LEFT JOIN us ON us.cluster = ts.cluster AND us.feature = ts.feature)"""


@query("sta_04_cluster_vs_normal", f"""
WITH {TN} SELECT cluster, feature, round(log2fc, 6) AS log2fc, n_paired, n_unpaired, round(t_paired, 6) AS t_paired, round(t_unpaired, 6) AS t_unpaired FROM tn""")
def _(spark, folder):
    out = S_.cluster_vs_normal(tumour_normal(spark, folder), tumour_pairs(spark, folder))
    return out.select("cluster", "feature", r6("log2fc").alias("log2fc"), "n_paired", "n_unpaired", r6("t_paired").alias("t_paired"), r6("t_unpaired").alias("t_unpaired"))


@query("sta_05_adjusted", f"""
WITH {M}, c AS (SELECT DISTINCT cluster AS k FROM m), x AS (SELECT feature, subtype, k, CAST(cluster = k AS DOUBLE) AS g, value FROM m CROSS JOIN c),
ctr AS (SELECT feature, k, g - avg(g) OVER (PARTITION BY feature, subtype, k) AS gc, value - avg(value) OVER (PARTITION BY feature, subtype, k) AS yc FROM x),
b AS (SELECT feature, k, sum(gc * yc) / sum(gc * gc) AS coef, sum(gc * gc) AS den, sum(yc * yc) AS tss, count(*) - (SELECT count(DISTINCT subtype) FROM m) - 1 AS df FROM ctr GROUP BY 1, 2)
SELECT feature, k AS cluster, round(coef, 6) AS coef, round(coef / sqrt((tss - coef * coef * den) / df / den), 5) AS t, CAST(df AS DOUBLE) AS df FROM b""")
def _(spark, folder):
    out = S_.adjusted_one_vs_rest(measurements(spark, folder))
    return out.select("feature", "cluster", r6("coef").alias("coef"), r6("t", 5).alias("t"), "df")


CENT = f"""{M}, st AS (SELECT cohort, feature, avg(value) AS mu, nullif(stddev_samp(value), 0) AS sd FROM m GROUP BY 1, 2), z AS (SELECT m.*, (value - mu) / sd AS z FROM m JOIN st USING (cohort, feature)),
ct AS (SELECT cluster AS k, feature, avg(z) AS c FROM z WHERE cohort = 0 GROUP BY 1, 2), cr AS (SELECT sample_id, k, corr(z.z, ct.c) AS r FROM z JOIN ct USING (feature) WHERE cohort = 1 GROUP BY 1, 2)"""


def transfer(spark, folder):
    """z values of the second cohort and centroids of the first."""
    from cohortgrid.operators.signatures import cohort_z

    z = cohort_z(measurements(spark, folder))
    return z.where(F.col("cohort") == 1), A.centroids(z.where(F.col("cohort") == 0))


@query("sta_06_centroid_assignment", f"""
WITH {CENT} SELECT sample_id, cluster, r, margin FROM (SELECT sample_id, k AS cluster, round(r, 6) AS r, round(r - lead(r) OVER (PARTITION BY sample_id ORDER BY r DESC), 6) AS margin, row_number() OVER (PARTITION BY sample_id ORDER BY r DESC) AS rn FROM cr) WHERE rn = 1""")
def _(spark, folder):
    z, c = transfer(spark, folder)
    r = S_.correlate_to_centroids(z, c)
    best = W.lead_margin(r, ["sample_id"], "r", "cluster")
    return best.select("sample_id", F.col("best").alias("cluster"), r6("best_score").alias("r"), r6("margin").alias("margin"))


@query("sta_07_spearman", """
WITH p AS (SELECT event_type, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y, user_id % 2 = 0 AS flag FROM events), q AS (SELECT unnest(['all', CASE WHEN flag THEN 'in' ELSE 'out' END]) AS part, event_type, x, y FROM p),
r AS (SELECT part, rank() OVER (PARTITION BY part ORDER BY x) + (count(*) OVER (PARTITION BY part, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY part ORDER BY y) + (count(*) OVER (PARTITION BY part, y) - 1) / 2.0 AS ry FROM q)
SELECT part, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")
def _(spark, folder):
    p = table(spark, folder, "events").select(F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), (F.col("user_id") % 2 == 0).alias("flag"))
    return S_.spearman_split(p, "x", "y", "flag").withColumn("rho", r6("rho"))


@query("sta_08_target_sensitivity", f"""
WITH {M}, s AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey % 100 AS sample_id, l_extendedprice AS response, ['g' || lpad(CAST(l_partkey % 70 AS VARCHAR), 2, '0'), 'g' || lpad(CAST(l_suppkey % 70 AS VARCHAR), 2, '0')] AS targets FROM lineitem),
h AS (SELECT row_id, avg(abs(value)) AS score FROM (SELECT row_id, sample_id, unnest(targets) AS feature FROM s) t JOIN m USING (sample_id, feature) GROUP BY 1), j AS (SELECT s.*, round(score, 12) AS score FROM s JOIN h USING (row_id)),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rx, rank() OVER (ORDER BY -response) + (count(*) OVER (PARTITION BY response) - 1) / 2.0 AS ry FROM j)
SELECT count(*) AS n, round(corr(rx, ry), 5) AS rho, count(DISTINCT sample_id) AS n_lines, round(avg(CAST(score > 0 AS INTEGER)), 6) AS any_active FROM r""")
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    name = lambda c: F.concat(F.lit("g"), F.lpad((F.col(c) % 70).cast("string"), 2, "0"))
    s = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_suppkey") % 100).alias("sample_id"), F.col("l_extendedprice").alias("response"), F.array(name("l_partkey"), name("l_suppkey")).alias("targets"))
    act = measurements(spark, folder).select("sample_id", F.col("feature").alias("node"), F.col("value").alias("activity"))
    return S_.target_sensitivity(s, act).withColumns({"rho": r6("rho", 5), "any_active": r6("any_active")})


@query("sta_09_spearman_null")
def _(spark, folder):
    o = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal"), F.col("c_nationkey").cast("double").alias("y"))
    return S_.spearman_null(o, "c_custkey", "c_acctbal", "y", 1000, seed=3)


@query("sta_10_composition_null")
def _(spark, folder):
    z, c = transfer(spark, folder)
    called = S_.assign_best(S_.correlate_to_centroids(z, c)).select("sample_id", "cluster")
    sub = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") % 5).alias("subtype"), (F.col("label") % 4).alias("truth"))
    groups, vocabulary = [0, 1, 2], [0, 1, 2, 3, 4]
    ref = A.composition(sub.withColumnRenamed("truth", "cluster"), groups, vocabulary)
    obs = S_.matrix_agreement(ref, A.composition(called.join(sub, "sample_id"), groups, vocabulary)).select(F.col("r").alias("statistic"))
    null = S_.composition_null(ref, called, sub.select("sample_id", "subtype"), groups, vocabulary, 1000, seed=5)
    return S_.null_summary(null, obs)


@query("sta_10_logrank_null")
def _(spark, folder):
    s = survival(spark, folder).select("id", "time", "event", "grp")
    groups = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    obs = K.logrank(s, [], groups).select("statistic")
    return S_.null_summary(K.logrank_null(s, groups, 1000, seed=11), obs)


def draw_scores(spark, folder, draws):
    """Correlation of every second-cohort sample with every first-cohort centroid, per feature draw."""
    z, c = transfer(spark, folder)
    return S_.draw_correlations(z, c, draws)


def features(spark, folder):
    return measurements(spark, folder).select("feature").distinct()


@query("sta_11_random_sets")
def _(spark, folder):
    f = features(spark, folder)
    panel = f.where(F.col("feature") < "g20")
    pool = f.where(F.col("feature") >= "g20")
    n = 20
    draws = feature_draws(pool.withColumn("stratum", F.lit(0)), spark.createDataFrame([(0, n)], "stratum int, quota int"), 200, seed=1)
    both = draws.unionByName(panel.select(F.lit(0).alias("draw"), "feature"))
    called = W.lead_margin(draw_scores(spark, folder, both), ["draw", "sample_id"], "r", "cluster")
    s = survival(spark, folder).select(F.col("id").alias("sample_id"), "time", "event")
    t = K.logrank(called.join(s, "sample_id").withColumn("grp", F.col("best").cast("int")), ["draw"], [0, 1, 2, 3])
    return S_.null_summary(t.where(F.col("draw") > 0).select("draw", "statistic"), t.where(F.col("draw") == 0).select("statistic"))


def feature_draws(pool, quotas, n, seed):
    """n feature draws from the pool with a quota per stratum: (draw, feature), by hash order."""
    from cohortgrid.operators.scans import ranked

    reps = pool.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"), "stratum", "feature").withColumn("_h", F.xxhash64("draw", "feature", F.lit(seed)))
    r = ranked(reps, ["draw", "stratum"], [F.col("_h"), F.col("feature")], "_r")
    return r.join(quotas, "stratum").where(F.col("_r") <= F.col("quota")).select("draw", "feature")


@query("sta_12_matched_sets")
def _(spark, folder):
    m = measurements(spark, folder)
    mean = m.groupBy("feature").agg(F.avg("value").alias("mean"))
    strata = W.quantile_bins(mean, "mean", 10, name="stratum")
    panel = strata.where(F.pmod(F.xxhash64("feature"), F.lit(4)) == 0)
    pool = strata.join(panel.select("feature"), "feature", "left_anti")
    quotas = panel.groupBy("stratum").agg(F.count(F.lit(1)).alias("quota"))
    both = feature_draws(pool, quotas, 200, seed=2).unionByName(panel.select(F.lit(0).alias("draw"), "feature"))
    axis = draw_scores(spark, folder, both).groupBy("draw", "sample_id").agg((F.max(F.when(F.col("cluster") == 0, F.col("r"))) - F.max(F.when(F.col("cluster") == 1, F.col("r")))).alias("axis"))
    y = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") % 5 == 0).cast("int").alias("y"))
    a = V.auroc(axis.join(y, "sample_id"), "axis", "y", ["draw"]).select("draw", F.col("auroc").alias("statistic"))
    return S_.null_summary(a.where(F.col("draw") > 0), a.where(F.col("draw") == 0))


@query("sta_13_axis_score", f"""
WITH {CENT}, {S}, ax AS (SELECT sample_id, max(r) FILTER (WHERE k = 0) - max(r) FILTER (WHERE k = 1) AS axis FROM cr GROUP BY 1), y AS (SELECT ax.*, CAST(label % 5 = 0 AS INTEGER) AS y FROM ax JOIN embeddings ON vec_id = sample_id),
r AS (SELECT *, rank() OVER (ORDER BY axis) AS rk FROM y), auc AS (SELECT (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auroc, count(*) AS n, sum(y) AS positives FROM r),
b AS (SELECT time, event, axis > 0 AS g FROM y JOIN s ON s.id = sample_id), t AS (SELECT time, count(*) AS n, count(*) FILTER (WHERE g) AS n1, sum(event) AS d, sum(event) FILTER (WHERE g) AS d1 FROM b GROUP BY 1),
k AS (SELECT *, sum(n) OVER (ORDER BY time DESC) AS rr, sum(n1) OVER (ORDER BY time DESC) AS r1 FROM t),
lr AS (SELECT pow(sum(coalesce(d1, 0) - r1 * d / rr), 2) / sum(CASE WHEN rr > 1 THEN d * (rr - d) / (rr - 1.0) * r1 / rr * (1 - r1 / rr) ELSE 0 END) AS statistic FROM k WHERE d > 0)
SELECT round(auroc, 6) AS auroc, n, CAST(positives AS BIGINT) AS positives, round(statistic, 5) AS statistic FROM auc, lr""")
def _(spark, folder):
    z, c = transfer(spark, folder)
    r = S_.correlate_to_centroids(z, c)
    axis = r.groupBy("sample_id").agg((F.max(F.when(F.col("cluster") == 0, F.col("r"))) - F.max(F.when(F.col("cluster") == 1, F.col("r")))).alias("axis"))
    y = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") % 5 == 0).cast("int").alias("y"))
    a = V.auroc(axis.join(y, "sample_id"), "axis", "y")
    s = survival(spark, folder).select(F.col("id").alias("sample_id"), "time", "event")
    stat = K.logrank(axis.join(s, "sample_id").withColumn("grp", (F.col("axis") > 0).cast("int")), [], [0, 1]).select("statistic").scalar()
    return a.select(r6("auroc").alias("auroc"), "n", "positives", r6(stat, 5).alias("statistic"))


@query("sta_14_matrix_agreement", f"""
WITH a AS (SELECT label % 4 AS cluster, label % 5 AS subtype, count(*) / sum(count(*)) OVER (PARTITION BY label % 4) AS share FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT label % 4 AS cluster, label % 5 AS subtype, count(*) / sum(count(*)) OVER (PARTITION BY label % 4) AS share FROM embeddings WHERE vec_id % 2 = 1 GROUP BY 1, 2),
g AS (SELECT c AS cluster, u AS subtype FROM (SELECT unnest([0,1,2,3]) AS c) CROSS JOIN (SELECT unnest([0,1,2,3,4]) AS u)), j AS (SELECT cluster, subtype, coalesce(a.share, 0) AS x, coalesce(b.share, 0) AS y FROM g LEFT JOIN a USING (cluster, subtype) LEFT JOIN b USING (cluster, subtype)),
mj AS (SELECT cluster, (SELECT subtype FROM j q WHERE q.cluster = p.cluster ORDER BY x DESC, subtype DESC LIMIT 1) AS ma, (SELECT subtype FROM j q WHERE q.cluster = p.cluster ORDER BY y DESC, subtype DESC LIMIT 1) AS mb FROM (SELECT DISTINCT cluster FROM j) p)
SELECT round(corr(x, y), 6) AS r, (SELECT count(*) FROM mj WHERE ma = mb) AS n_agree FROM j""")
def _(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", (F.col("label") % 4).alias("cluster"), (F.col("label") % 5).alias("subtype"))
    a = A.composition(e.where(F.col("vec_id") % 2 == 0), [0, 1, 2, 3], [0, 1, 2, 3, 4])
    b = A.composition(e.where(F.col("vec_id") % 2 == 1), [0, 1, 2, 3], [0, 1, 2, 3, 4])
    return S_.matrix_agreement(a, b).withColumn("r", r6("r"))


@query("sta_15_direction", f"""
WITH {TN} SELECT cluster, round(avg(log2fc), 6) AS mean_value, min(avg(log2fc)) OVER () > 0 AS passed FROM tn WHERE feature IN ('g01','g02','g03','g04','g05') GROUP BY 1""")
def _(spark, folder):
    sig = S_.cluster_vs_normal(tumour_normal(spark, folder), tumour_pairs(spark, folder))
    return S_.direction_check(sig, ["g01", "g02", "g03", "g04", "g05"]).withColumn("mean_value", r6("mean_value"))


@query("sta_16_direction_angle", f"""
WITH {M}, t AS (SELECT * FROM m WHERE label <> 9), c AS (SELECT cluster, feature, avg(value) AS v, count(*) AS n, sum(value) AS s FROM t GROUP BY 1, 2), k AS (SELECT *, (sum(s) OVER (PARTITION BY feature) - s) / (sum(n) OVER (PARTITION BY feature) - n) AS rest FROM c), nn AS (SELECT feature, avg(value) AS nv FROM m WHERE label = 9 GROUP BY 1)
SELECT cluster, round(degrees(acos(sum((v - nv) * (v - rest)) / sqrt(sum(pow(v - nv, 2)) * sum(pow(v - rest, 2))))), 5) AS degrees FROM k JOIN nn USING (feature) GROUP BY 1""")
def _(spark, folder):
    m = measurements(spark, folder)
    t = m.where(F.col("label") != 9)
    sizes = table(spark, folder, "embeddings").where(F.col("label") != 9).groupBy((F.col("label") % 4).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    normal = m.where(F.col("label") == 9).groupBy("feature").agg(F.avg("value").alias("value"))
    return S_.direction_angle(A.centroids(t), sizes, normal).withColumn("degrees", r6("degrees", 5))


@query("agg_20_feature_agreement", f"""
WITH {M}, j AS (SELECT a.feature, a.value AS x, b.value AS y FROM m a JOIN m b ON b.sample_id = a.sample_id + 1 AND b.feature = a.feature WHERE a.sample_id % 2 = 0), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM j),
c AS (SELECT feature, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1 HAVING count(*) >= 10)
SELECT feature, n, round(rho, 6) AS rho, round(avg(CAST(rho >= 0.05 AS INTEGER)) OVER (), 6) AS share_passing FROM c""")
def _(spark, folder):
    m = measurements(spark, folder)
    a = m.where(F.col("sample_id") % 2 == 0)
    b = m.where(F.col("sample_id") % 2 == 1).withColumn("sample_id", F.col("sample_id") - 1)
    return S_.feature_agreement(a, b, 10, 0.05).withColumns({"rho": r6("rho"), "share_passing": r6("share_passing")})


# ---- survival -------------------------------------------------------------------------------------
KM = f"""{S}, t AS (SELECT grp, time, count(*) AS n, sum(event) AS events FROM s GROUP BY 1, 2), k AS (SELECT grp, time, CAST(events AS BIGINT) AS events, CAST(sum(n) OVER (PARTITION BY grp ORDER BY time DESC) AS BIGINT) AS at_risk FROM t),
km AS (SELECT *, exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) * (1 - max(CAST(events >= at_risk AS INTEGER)) OVER w) AS survival, sum(CASE WHEN events > 0 AND events < at_risk THEN events / (at_risk * (at_risk - events)) ELSE 0 END) OVER w AS vs FROM k WINDOW w AS (PARTITION BY grp ORDER BY time))"""


@query("sur_01_kaplan_meier", f"""
WITH {KM} SELECT grp, time, at_risk, events, round(survival, 6) AS survival, round(greatest(0, survival - 1.96 * survival * sqrt(vs)), 6) AS lower, round(least(1, survival + 1.96 * survival * sqrt(vs)), 6) AS upper FROM km""")
def _(spark, folder):
    return K.kaplan_meier(survival(spark, folder), ["grp"]).withColumns({c: r6(c) for c in ("survival", "lower", "upper")})


@query("sur_01_km_summary", f"""
WITH {KM} SELECT grp, max(at_risk) AS n, CAST(sum(events) AS BIGINT) AS n_events, min(time) FILTER (WHERE survival <= 0.5 + 1e-12) AS median FROM km GROUP BY 1""")
def _(spark, folder):
    return K.km_summary(K.kaplan_meier(survival(spark, folder), ["grp"]), ["grp"])


GROUPS3 = "CASE WHEN grp IN ('1-URGENT', '2-HIGH') THEN 0 WHEN grp = '3-MEDIUM' THEN 1 ELSE 2 END"
LR3 = """t AS (SELECT time, count(*) FILTER (WHERE g = 0) AS n0, count(*) FILTER (WHERE g = 1) AS n1, count(*) AS n, sum(event) AS d, sum(event) FILTER (WHERE g = 0) AS d0, sum(event) FILTER (WHERE g = 1) AS d1 FROM b GROUP BY 1),
k AS (SELECT time, coalesce(d, 0) AS d, coalesce(d0, 0) AS d0, coalesce(d1, 0) AS d1, sum(n) OVER w AS r, sum(n0) OVER w AS r0, sum(n1) OVER w AS r1 FROM t WINDOW w AS (ORDER BY time DESC)),
q AS (SELECT sum(d0 - r0 * d / r) AS u0, sum(d1 - r1 * d / r) AS u1, sum(w * r0 / r * (1 - r0 / r)) AS v00, sum(w * r1 / r * (1 - r1 / r)) AS v11, sum(-w * r0 / r * r1 / r) AS v01 FROM (SELECT *, CASE WHEN r > 1 THEN d * (r - d) / (r - 1.0) ELSE 0 END AS w FROM k WHERE d > 0))"""


@query("sur_02_logrank", f"""
WITH {S}, b AS (SELECT time, event, {GROUPS3} AS g FROM s), {LR3}
SELECT round((u0 * u0 * v11 - 2 * u0 * u1 * v01 + u1 * u1 * v00) / (v00 * v11 - v01 * v01), 5) AS statistic, 2 AS df, (SELECT count(*) FROM b) AS n, (SELECT CAST(sum(event) AS BIGINT) FROM b) AS n_events FROM q""")
def _(spark, folder):
    s = survival(spark, folder)
    g = F.when(F.col("grp").isin("1-URGENT", "2-HIGH"), 0).when(F.col("grp") == "3-MEDIUM", 1).otherwise(2)
    return K.logrank(s.withColumn("grp", g), [], [0, 1, 2]).select(r6("statistic", 5).alias("statistic"), "df", "n", "n_events")


@query("sur_02_logrank_parts", f"""
WITH {S}, t AS (SELECT time, grp, count(*) AS n, sum(event) AS d FROM s GROUP BY 1, 2), tt AS (SELECT time, sum(d) AS dd FROM t GROUP BY 1), r AS (SELECT time, sum(sum(n)) OVER (ORDER BY time DESC) AS rr FROM t GROUP BY 1),
g AS (SELECT DISTINCT grp FROM s), x AS (SELECT tt.time, dd, rr, g.grp, coalesce(t.n, 0) AS n, coalesce(t.d, 0) AS d FROM tt JOIN r USING (time) CROSS JOIN g LEFT JOIN t ON t.time = tt.time AND t.grp = g.grp), y AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY time DESC) AS ri FROM x)
SELECT grp, CAST(sum(d) AS BIGINT) AS observed, round(sum(ri * dd / rr), 4) AS expected FROM y GROUP BY 1""")
def _(spark, folder):
    groups = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    p = K.logrank_parts(survival(spark, folder), [], groups)
    return p.select(F.inline(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"observed_{i}").alias("observed"), r6(f"expected_{i}", 4).alias("expected")) for i, g in enumerate(groups)])))


@query("sur_02_logrank_five_groups")
def _(spark, folder):
    return K.logrank(survival(spark, folder), [], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("sur_03_sensitivity", f"""
WITH {S}, b0 AS (SELECT k AS config, time, event, id % k AS g FROM s CROSS JOIN (SELECT unnest([2, 3]) AS k)),
{', '.join(f"b{k} AS (SELECT time, event, CASE WHEN g > 1 THEN 2 ELSE g END AS g FROM b0 WHERE config = {k})" for k in (2, 3))}, {LR3.replace('t AS', 't3 AS').replace('FROM b ', 'FROM b3 ').replace('FROM t ', 'FROM t3 ').replace('k AS (SELECT', 'k3 AS (SELECT').replace('FROM k ', 'FROM k3 ').replace('q AS', 'q3 AS')},
{LR3.replace('t AS', 't2 AS').replace('FROM b ', 'FROM b2 ').replace('FROM t ', 'FROM t2 ').replace('k AS (SELECT', 'k2 AS (SELECT').replace('FROM k ', 'FROM k2 ').replace('q AS', 'q2 AS')}
SELECT 3 AS config, round((u0 * u0 * v11 - 2 * u0 * u1 * v01 + u1 * u1 * v00) / (v00 * v11 - v01 * v01), 5) AS statistic, 2 AS df, true AS exploratory FROM q3 UNION ALL SELECT 2, round(u0 * u0 / v00, 5), 1, true FROM q2""")
def _(spark, folder):
    s = survival(spark, folder).select(F.explode(F.array(F.lit(2), F.lit(3))).alias("config"), "id", "time", "event").withColumn("grp", (F.col("id") % F.col("config")).cast("int"))
    return K.sensitivity_logrank(s, "config", [0, 1, 2]).select("config", r6("statistic", 5).alias("statistic"), "df", "exploratory")


@query("sur_04_ipcw", f"""
WITH {S}, r AS (SELECT *, count(*) OVER (ORDER BY time DESC, id DESC ROWS UNBOUNDED PRECEDING) AS risk FROM s), g AS (SELECT *, exp(sum(CASE WHEN event = 0 AND risk > 1 THEN ln(1 - 1.0::DOUBLE / risk) ELSE 0 END) OVER w) * (1 - max(CASE WHEN event = 0 AND risk = 1 THEN 1 ELSE 0 END) OVER w) AS g FROM r WINDOW w AS (ORDER BY time, id ROWS UNBOUNDED PRECEDING)),
x AS (SELECT id, event, min(g) OVER (PARTITION BY time) AS ga FROM g)
SELECT id, round(CASE WHEN event > 0 THEN least(20, 1 / greatest(ga, 0.001)) ELSE 0 END, 6) AS weight FROM x""")
def _(spark, folder):
    return K.ipcw(survival(spark, folder), "id").select("id", r6("weight").alias("weight"))


@query("sur_05_endpoints", """
WITH c AS (SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 9 = 0 THEN 'NA' ELSE CAST(o_totalprice AS VARCHAR) END AS os, CASE o_orderstatus WHEN 'F' THEN '1:DECEASED' WHEN 'O' THEN '0:LIVING' END AS st, CAST(o_custkey AS VARCHAR) AS pf, CASE o_orderstatus WHEN 'P' THEN '1:Recurred' ELSE '0' END AS st2 FROM orders)
SELECT sample_id, 'os' AS endpoint, TRY_CAST(os AS DOUBLE) AS time, CASE WHEN TRY_CAST(os AS DOUBLE) IS NOT NULL AND st LIKE '1%' THEN 1.0 ELSE 0.0 END AS event FROM c
UNION ALL SELECT sample_id, 'pfi', TRY_CAST(pf AS DOUBLE), CASE WHEN st2 LIKE '1%' THEN 1.0 ELSE 0.0 END FROM c""")
def _(spark, folder):
    o = table(spark, folder, "orders")
    st = F.when(F.col("o_orderstatus") == "F", "1:DECEASED").when(F.col("o_orderstatus") == "O", "0:LIVING")
    c = o.select(F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderkey") % 9 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("OS_MONTHS"), st.alias("OS_STATUS"),
                 F.col("o_custkey").cast("string").alias("PFS_MONTHS"), F.when(F.col("o_orderstatus") == "P", "1:Recurred").otherwise("0").alias("PFS_STATUS"))
    return K.endpoints(c, o.select(F.col("o_orderkey").alias("sample_id")), {"os": ("OS_MONTHS", "OS_STATUS"), "pfi": ("PFS_MONTHS", "PFS_STATUS"), "dss": ("DSS_MONTHS", "DSS_STATUS")})


# ---- evaluation -----------------------------------------------------------------------------------
@query("evl_01_auroc", """
WITH x AS (SELECT lang, n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS rk FROM x)
SELECT lang, round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auroc, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM r GROUP BY 1""")
def _(spark, folder):
    x = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select("lang", F.col("n_chars").cast("double").alias("s"), "quality")
    return V.auroc(x, "s", "quality", ["lang"]).withColumn("auroc", r6("auroc"))


@query("evl_02_binary_metrics", """
WITH x AS (SELECT toxic AS y, 1 / (1 + exp((n_chars % 997) / 200.0 - 2)) AS p FROM labels JOIN documents USING (doc_id)), t AS (SELECT p, count(*) AS n, sum(y) AS tp FROM x GROUP BY 1), c AS (SELECT tp, sum(n) OVER (ORDER BY p DESC) AS cn, sum(tp) OVER (ORDER BY p DESC) AS ctp, sum(tp) OVER () AS pos FROM t)
SELECT (SELECT count(*) FROM x) AS n, (SELECT CAST(sum(y) AS BIGINT) FROM x) AS positives, (SELECT round(avg(pow(p - y, 2)), 6) FROM x) AS brier, (SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) FROM x) AS log_loss, round(sum(tp / pos * ctp / cn), 6) AS auprc FROM c""")
def _(spark, folder):
    x = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id").select((1 / (1 + F.exp((F.col("n_chars") % 997) / 200.0 - 2))).alias("p"), "toxic")
    return V.binary_metrics(x, "p", "toxic").withColumns({c: r6(c) for c in ("brier", "log_loss", "auprc")})


CLS = "x AS (SELECT o_custkey % 5 AS fold, o_orderkey % 3 AS truth, CASE WHEN o_custkey % 7 < 4 THEN o_orderkey % 3 ELSE o_custkey % 3 END AS pred FROM orders)"


def predictions(spark, folder):
    o = table(spark, folder, "orders")
    return o.select((F.col("o_custkey") % 5).alias("fold"), (F.col("o_orderkey") % 3).alias("truth"), F.when(F.col("o_custkey") % 7 < 4, F.col("o_orderkey") % 3).otherwise(F.col("o_custkey") % 3).alias("pred"))


@query("evl_03_class_metrics", f"""
WITH {CLS}, t AS (SELECT fold, truth AS c, count(*) AS t, count(*) FILTER (WHERE truth = pred) AS h FROM x GROUP BY 1, 2), p AS (SELECT fold, pred AS c, count(*) AS p FROM x GROUP BY 1, 2)
SELECT fold, CAST(sum(t) AS BIGINT) AS n, round(sum(h) / sum(t), 6) AS accuracy, round(avg(h / t), 6) AS balanced_accuracy, round(avg(2 * h / (t + p)), 6) AS macro_f1 FROM t JOIN p USING (fold, c) GROUP BY 1""")
def _(spark, folder):
    return V.class_metrics(predictions(spark, folder), "truth", "pred", ["fold"]).withColumns({c: r6(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")})


@query("evl_03_confusion", f"""
WITH {CLS} SELECT fold, truth, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1, count(*) FILTER (WHERE pred = 2) AS pred_2 FROM x GROUP BY 1, 2""")
def _(spark, folder):
    return V.confusion(predictions(spark, folder), "truth", "pred", [0, 1, 2], ["fold"])


@query("evl_04_adjusted_rand", f"""
WITH {CLS}, c AS (SELECT fold, truth, pred, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2, 3), a AS (SELECT fold, sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT fold, sum(n * (n - 1) / 2) AS aa FROM (SELECT fold, truth, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), d AS (SELECT fold, sum(n * (n - 1) / 2) AS bb FROM (SELECT fold, pred, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT fold, round((ij - aa * bb / (n * (n - 1) / 2)) / ((aa + bb) / 2 - aa * bb / (n * (n - 1) / 2)), 6) AS ari, CAST(n AS BIGINT) AS n FROM a JOIN b USING (fold) JOIN d USING (fold)""")
def _(spark, folder):
    return V.adjusted_rand(predictions(spark, folder), "truth", "pred", ["fold"]).withColumn("ari", r6("ari"))


@query("evl_05_silhouette", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label % 4 AS k FROM embeddings), d AS (SELECT a.vec_id, a.k, b.k AS o, sum(list_distance(a.v, b.v)) AS s, count(*) AS c FROM e a CROSS JOIN e b GROUP BY 1, 2, 3),
p AS (SELECT vec_id, max(CASE WHEN k = o THEN s / (c - 1) END) AS a, min(CASE WHEN k <> o THEN s / c END) AS b FROM d GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 5) AS silhouette, count(*) AS n FROM p""")
def _(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), (F.col("label") % 4).alias("cluster"))
    return V.silhouette(e).withColumn("silhouette", r6("silhouette", 5))


@query("evl_07_choose_k", """
WITH t AS (SELECT l_linenumber + 1 AS k, round(avg(l_quantity) * 4, 6) AS bic, round(avg(l_discount), 6) AS silhouette, round(avg(CAST(l_tax > 0.02 AS INTEGER)), 6) AS stability FROM lineitem GROUP BY 1), c AS (SELECT *, bic <= min(bic) OVER () + 10 AS ok FROM t)
SELECT CASE WHEN stability >= 0.6 THEN k END AS k, k AS best_k, 'stability_within_10_bic' AS selection_rule, 'gmm' AS method, 'full' AS covariance_type, bic, silhouette, stability, stability >= 0.6 AS clustering_available, 0.6::DOUBLE AS stability_threshold FROM c WHERE ok ORDER BY stability DESC, silhouette DESC, bic LIMIT 1""")
def _(spark, folder):
    t = table(spark, folder, "lineitem").groupBy((F.col("l_linenumber") + 1).alias("k")).agg(
        F.round(F.avg("l_quantity") * 4, 6).alias("bic"), F.round(F.avg("l_discount"), 6).alias("silhouette"), F.round(F.avg((F.col("l_tax") > 0.02).cast("double")), 6).alias("stability"))
    return V.choose_k(t)


@query("evl_08_hold_out", """
WITH n AS (SELECT p_name, row_number() OVER (ORDER BY md5(p_name || '|0'), p_name) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT p_name FROM part))
SELECT split, count(DISTINCT p_name) AS n_names, count(*) AS n_rows FROM (SELECT p_name, CASE WHEN r <= greatest(1, round(n * 0.3)) THEN 'test' ELSE 'train' END AS split FROM part JOIN n USING (p_name)) GROUP BY 1""")
def _(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", "p_name")
    return V.hold_out_names(p, "p_name").groupBy("split").agg(F.count_distinct("p_name").alias("n_names"), F.count(F.lit(1)).alias("n_rows"))
