"""Scaling, signature and reversal operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortgrid.bindings.joining import comparators
from cohortgrid.bindings.registry import query
from cohortgrid.bindings.summaries import blend_inputs, BLEND
from cohortgrid.bindings.tables import D, LISTS, M, drug_lists, drug_rows, measurements, pick, pick_sql, r6, table
from cohortgrid.operators import aggregates as A
from cohortgrid.operators import joins as J
from cohortgrid.operators import ml as ML
from cohortgrid.operators import signatures as G

Z = f"""{M}, st AS (SELECT cohort, feature, avg(value) AS mu, nullif(stddev_samp(value), 0) AS sd FROM m GROUP BY 1, 2), z AS (SELECT m.*, (value - mu) / sd AS z FROM m JOIN st USING (cohort, feature))"""
ZALL = f"""{M}, st AS (SELECT feature, avg(value) AS mu, nullif(stddev_samp(value), 0) AS sd FROM m GROUP BY 1), z AS (SELECT m.*, (value - mu) / sd AS z FROM m JOIN st USING (feature)), ct AS (SELECT cluster, feature, avg(z) AS c FROM z GROUP BY 1, 2)"""


@query("sig_01_cohort_z", f"""
WITH {Z}, sp AS (SELECT cohort, feature, stddev_pop(value) AS sdp FROM m GROUP BY 1, 2) SELECT sample_id, feature, round(z, 6) AS z_sample, round((value - mu) / CASE WHEN sdp = 0 THEN 1 ELSE sdp END, 6) AS z_pop FROM z JOIN st USING (cohort, feature) JOIN sp USING (cohort, feature)""")
def _(spark, folder):
    m = measurements(spark, folder)
    a = G.cohort_z(m).select("sample_id", "feature", r6("value").alias("z_sample"))
    b = G.cohort_z(m, "population", "one").select("sample_id", "feature", r6("value").alias("z_pop"))
    return a.join(b, ["sample_id", "feature"])


@query("sig_02_inverse_normal")
def _(spark, folder):
    return G.inverse_normal(measurements(spark, folder)).select("sample_id", "feature", "value")


@query("sig_03_harmonise")
def _(spark, folder):
    m = measurements(spark, folder)
    a, b = m.where(F.col("cohort") == 0), m.where(F.col("cohort") == 1)
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") % 5).alias("truth"))

    def score(x, y):
        called = ML.nearest_centroid(x, labels.withColumnRenamed("truth", "label_"), y, "label_")
        return called.join(labels, "sample_id").agg(F.avg((F.col("label_") == F.col("truth")).cast("double"))).first()[0]

    methods = {"inverse_normal": G.inverse_normal, "zscore": lambda d: G.cohort_z(d, "population", "one")}
    name, conc, _, _, tried = G.harmonise(a, b, methods, score)
    rows = [(n, float(c), n == name) for n, c in tried]
    return spark.createDataFrame(rows, "method string, concordance double, kept boolean")


def stats(spark, folder):
    return A.reference_stats(measurements(spark, folder)).select(F.upper("feature").alias("feature"), "mean", "sd")


def profiles(spark, folder):
    """All embeddings as profiles, with gaps that depend on the sample and the feature."""
    m = measurements(spark, folder)
    pos = F.substring("feature", 2, 2).cast("int")
    return m.where((F.col("sample_id") + pos * 3) % 11 != 0).select(F.col("sample_id").alias("profile_id"), F.concat(F.lit(" "), F.col("feature")).alias("feature"), "value", "cluster")


PROFILE = f"""{M}, rs AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS sd FROM m GROUP BY 1), pf AS (SELECT sample_id AS profile_id, cluster, feature, value FROM m WHERE (sample_id + CAST(substr(feature, 2) AS INTEGER) * 3) % 11 <> 0), al AS (SELECT profile_id, cluster, upper(feature) AS feature, (value - mean) / sd AS z FROM pf JOIN rs USING (feature))"""


@query("sig_04_align", f"""
WITH {PROFILE} SELECT profile_id, feature, round(z, 6) AS z FROM al""")
def _(spark, folder):
    return G.align_profiles(profiles(spark, folder), stats(spark, folder)).select("profile_id", "feature", r6("z").alias("z"))


@query("sig_04_coverage", f"""
WITH {PROFILE} SELECT profile_id, count(*) AS found, CAST(64 AS BIGINT) AS requested, round(count(*) / 64, 6) AS coverage, array_to_string(list_sort(list_filter((SELECT list(DISTINCT upper(feature)) FROM rs), lambda f: NOT list_contains(list(al.feature), f))), ';') AS missing FROM al GROUP BY 1""")
def _(spark, folder):
    st = stats(spark, folder)
    out = G.profile_coverage(G.align_profiles(profiles(spark, folder), st), st)
    return out.select("profile_id", "found", "requested", r6("coverage").alias("coverage"), F.array_join("missing", ";").alias("missing"))


def zscores(spark, folder):
    """profile_id, cluster, feature, z against the whole table, and the centroids of z."""
    m = measurements(spark, folder)
    z = G.cohort_z(m, keys=("feature",))
    cent = A.centroids(z)
    return z.select(F.col("sample_id").alias("profile_id"), "cluster", "feature", F.col("value").alias("z")), cent


def residual_arms(spark, folder):
    z, cent = zscores(spark, folder)
    assigned = table(spark, folder, "embeddings").select(F.col("vec_id").alias("profile_id"), (F.col("label") % 4).alias("cluster"))
    return G.arms(G.residual(z.drop("cluster"), assigned, cent), ["profile_id"], "residual", 10, 10), assigned


RES = f"""{ZALL}, re AS (SELECT sample_id AS profile_id, z.cluster, z.feature, z - c AS e FROM z JOIN ct ON ct.cluster = z.cluster AND ct.feature = z.feature),
ra AS (SELECT profile_id, feature, e AS effect, 'up' AS direction, rank FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(e, 12) DESC, feature) AS rank FROM re WHERE e > 0) WHERE rank <= 10
 UNION ALL SELECT profile_id, feature, e, 'down', rank FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(e, 12), feature) AS rank FROM re WHERE e < 0) WHERE rank <= 10)"""


@query("sig_05_residual_arms", f"""
WITH {RES} SELECT profile_id, feature, round(effect, 6) AS effect, direction, rank FROM ra""")
def _(spark, folder):
    return residual_arms(spark, folder)[0].withColumn("effect", r6("effect"))


@query("sig_05_arm_summary", f"""
WITH {RES} SELECT profile_id, count(*) FILTER (WHERE direction = 'up') AS n_up, count(*) FILTER (WHERE direction = 'down') AS n_down, count(*) FILTER (WHERE direction = 'up') < 10 OR count(*) FILTER (WHERE direction = 'down') < 10 AS thin FROM ra GROUP BY 1""")
def _(spark, folder):
    return G.arm_summary(residual_arms(spark, folder)[0], ["profile_id"])


def cluster_effects(spark, folder):
    m = measurements(spark, folder)
    g = m.groupBy("cluster", "feature").agg(F.avg("value").alias("a"), F.count(F.lit(1)).alias("n"))
    t = m.groupBy("feature").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("tn"))
    return g.join(t, "feature").select("cluster", "feature", F.round(F.col("a") - (F.col("s") - F.col("a") * F.col("n")) / (F.col("tn") - F.col("n")), 10).alias("effect"))


CE = f"""{M}, ce AS (SELECT c.cluster, feature, round(avg(value) FILTER (WHERE m.cluster = c.cluster) - avg(value) FILTER (WHERE m.cluster <> c.cluster), 10) AS effect FROM m CROSS JOIN (SELECT DISTINCT cluster FROM m) c GROUP BY 1, 2),
qs AS (SELECT cluster, feature, effect FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect DESC, feature) AS a, row_number() OVER (PARTITION BY cluster ORDER BY effect, feature) AS b FROM ce) WHERE a <= 12 OR b <= 12)"""


@query("sig_06_connectivity", f"""
WITH {CE} SELECT qs.cluster, sample_id AS sig_id, round(-corr(effect, value), 6) AS reversal_score, count(*) AS n_shared FROM m JOIN qs USING (feature) GROUP BY 1, 2""")
def _(spark, folder):
    sig = G.query_signature(cluster_effects(spark, folder), ["cluster"], "effect", 12)
    pert = measurements(spark, folder).select(F.col("sample_id").alias("sig_id"), "feature", "value")
    return G.connectivity(sig, pert, ["cluster"]).withColumn("reversal_score", r6("reversal_score"))


@query("sig_07_set_difference", f"""
WITH {CE}, ar AS (SELECT cluster, feature, 'up' AS d FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect DESC, feature) AS r FROM ce WHERE effect > 0) WHERE r <= 12 UNION ALL SELECT cluster, feature, 'down' FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect, feature) AS r FROM ce WHERE effect < 0) WHERE r <= 12)
SELECT ar.cluster, sample_id AS sig_id, round(avg(value) FILTER (WHERE d = 'down') - avg(value) FILTER (WHERE d = 'up'), 6) AS reversal_score FROM m JOIN ar USING (feature) GROUP BY 1, 2""")
def _(spark, folder):
    a = G.arms(cluster_effects(spark, folder), ["cluster"], "effect", 12, 12)
    pert = measurements(spark, folder).select(F.col("sample_id").alias("sig_id"), "feature", "value")
    return G.set_difference(a, pert, ["cluster"]).withColumn("reversal_score", r6("reversal_score"))


def cluster_table(spark, folder):
    """cluster, drug, percentile, targets: a committed list per cluster."""
    p = table(spark, folder, "part")
    t = p.groupBy((F.col("p_partkey") % 4).alias("cluster"), F.lower("p_name").alias("drug")).agg(
        F.round(F.avg(F.col("p_size") / 50), 9).alias("percentile"), F.array_sort(F.collect_set(F.concat(F.lit("g"), F.lpad((F.col("p_partkey") % 97).cast("string"), 2, "0")))).alias("targets"))
    return t


TB = """tb AS (SELECT p_partkey % 4 AS cluster, lower(p_name) AS drug, round(avg(p_size / 50), 9) AS percentile FROM part GROUP BY 1, 2), tt AS (SELECT DISTINCT p_partkey % 4 AS cluster, lower(p_name) AS drug, 'g' || lpad(CAST(p_partkey % 97 AS VARCHAR), 2, '0') AS feature FROM part)"""


@query("sig_08_proxy", f"""
WITH {RES}, {TB}, ca AS (SELECT cluster, feature, 'up' AS direction FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(c, 12) DESC, feature) AS r FROM ct WHERE c > 0) WHERE r <= 10 UNION ALL SELECT cluster, feature, 'down' FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(c, 12), feature) AS r FROM ct WHERE c < 0) WHERE r <= 10),
pc AS (SELECT vec_id AS profile_id, label % 4 AS cluster FROM embeddings), pa AS (SELECT profile_id, direction, feature FROM pc JOIN ca USING (cluster)), un AS (SELECT coalesce(r.profile_id, p.profile_id) AS profile_id, coalesce(r.direction, p.direction) AS direction, CAST(r.profile_id IS NOT NULL AND p.profile_id IS NOT NULL AS INTEGER) AS b FROM ra r FULL JOIN pa p ON r.profile_id = p.profile_id AND r.direction = p.direction AND r.feature = p.feature),
ov AS (SELECT profile_id, sum(j) / 2 AS ov FROM (SELECT profile_id, direction, sum(b) / count(*) AS j FROM un GROUP BY 1, 2) GROUP BY 1), h AS (SELECT pc.profile_id, tt.drug, sum(abs(effect)) AS hit FROM pc JOIN tt USING (cluster) JOIN ra ON ra.profile_id = pc.profile_id AND ra.feature = tt.feature GROUP BY 1, 2),
s AS (SELECT pc.profile_id, tb.drug, round(0.55 * percentile + 0.25 * ov * percentile + 0.2 * tanh(coalesce(hit, 0)), 12) AS score, ov FROM pc JOIN tb USING (cluster) JOIN ov USING (profile_id) LEFT JOIN h ON h.profile_id = pc.profile_id AND h.drug = tb.drug)
SELECT profile_id, drug, round(score, 6) AS reversal_score, round(ov, 6) AS consistency, 'residual_proxy' AS source, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, drug) AS rank, round(1.0 - (row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, drug) - 1.0) / greatest(count(*) OVER (PARTITION BY profile_id) - 1, 1), 6) AS percentile FROM s""")
def _(spark, folder):
    ra, assigned = residual_arms(spark, folder)
    _, cent = zscores(spark, folder)
    ca = G.arms(cent.withColumnRenamed("value", "effect"), ["cluster"], "effect", 10, 10)
    out = G.proxy_reversal(cluster_table(spark, folder), assigned, ra, ca)
    return out.select("profile_id", "drug", r6("reversal_score").alias("reversal_score"), r6("consistency").alias("consistency"), "source", "rank", r6("percentile").alias("percentile"))


@query("sig_09_lists", f"""
WITH {CE}, ar AS (SELECT cluster, feature, 'up' AS d FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect DESC, feature) AS r FROM ce WHERE effect > 0) WHERE r <= 12 UNION ALL SELECT cluster, feature, 'down' FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect, feature) AS r FROM ce WHERE effect < 0) WHERE r <= 12),
sc AS (SELECT ar.cluster, sample_id, round(avg(value) FILTER (WHERE d = 'down') - avg(value) FILTER (WHERE d = 'up'), 12) AS s FROM m JOIN ar USING (feature) GROUP BY 1, 2), dr AS (SELECT cluster, 'drug ' || (sample_id % 50) AS canonical, max(s) AS rs, median(s) AS ms, count(*) AS n_signatures, count(DISTINCT sample_id % 10) AS n_cell_lines, avg(CAST(s > 0 AS INTEGER)) AS consistency FROM sc GROUP BY 1, 2)
SELECT cluster, canonical, round(rs, 6) AS reversal_score, round(ms, 6) AS median_score, n_signatures, n_cell_lines, round(consistency, 6) AS consistency, row_number() OVER (PARTITION BY cluster ORDER BY rs DESC, canonical) AS rank FROM dr""")
def _(spark, folder):
    return cluster_lists(spark, folder).select("cluster", "canonical", r6("reversal_score").alias("reversal_score"), r6("median_score").alias("median_score"), "n_signatures", "n_cell_lines", r6("consistency").alias("consistency"), "rank")


def cluster_lists(spark, folder):
    """List builder for every cluster at once: signature scores rolled up per (cluster, drug)."""
    from cohortgrid.plans.jobs import reversal_lists

    m = measurements(spark, folder)
    a = G.arms(cluster_effects(spark, folder), ["cluster"], "effect", 12, 12)
    pert = m.select(F.col("sample_id").alias("sig_id"), "feature", "value")
    meta = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sig_id"), F.concat(F.lit("drug "), (F.col("vec_id") % 50).cast("string")).alias("drug"), (F.col("vec_id") % 10).alias("cell_id"))
    return reversal_lists(a, pert, meta, ["cluster"])


COEF = "co AS (SELECT p_brand AS drug, 'g' || lpad(CAST(p_partkey % 80 AS VARCHAR), 2, '0') AS feature, round(avg(p_size) - 25.5, 6) AS weight FROM part GROUP BY 1, 2)"


def coefficients(spark, folder):
    p = table(spark, folder, "part")
    return p.groupBy(F.col("p_brand").alias("drug"), F.concat(F.lit("g"), F.lpad((F.col("p_partkey") % 80).cast("string"), 2, "0")).alias("feature")).agg(F.round(F.avg("p_size") - 25.5, 6).alias("weight"))


SC = f"{ZALL}, {COEF}, ws AS (SELECT sample_id AS profile_id, drug, sum(weight * z) / sum(abs(weight)) AS raw, count(*) AS used FROM z JOIN co USING (feature) WHERE weight <> 0 GROUP BY 1, 2), tot AS (SELECT drug, count(*) AS total FROM co WHERE weight <> 0 GROUP BY 1), sc AS (SELECT ws.*, total, CASE WHEN used >= 3 AND used / total >= 0.7 THEN raw END AS raw_score FROM ws JOIN tot USING (drug))"


def drug_scores(spark, folder):
    z, _ = zscores(spark, folder)
    return G.weighted_scores(z, coefficients(spark, folder), 3, 0.70)


@query("sig_10_weighted_scores", f"""
WITH {SC} SELECT profile_id, drug, round(raw_score, 6) AS raw_score, used AS features_used, total AS features_total, round(used / total, 6) AS feature_coverage FROM sc""")
def _(spark, folder):
    return drug_scores(spark, folder).withColumns({"raw_score": r6("raw_score"), "feature_coverage": r6("feature_coverage")})


@query("sig_11_regimen", f"""
WITH {SC}, rf AS (SELECT drug, avg(raw_score) AS mu, stddev_pop(raw_score) AS sd FROM sc GROUP BY 1), zz AS (SELECT profile_id, drug, CASE WHEN sd > 0 THEN (raw_score - mu) / sd END AS z FROM sc JOIN rf USING (drug)), rg AS (SELECT vec_id AS profile_id, unnest(list_distinct(['Brand#' || (vec_id % 25 + 1), 'Brand#' || (vec_id % 7 + 1), 'none'])) AS drug FROM embeddings)
SELECT rg.profile_id, round(avg(z), 6) AS regimen_score, count(z) AS n_scored, count(*) AS n_requested FROM rg LEFT JOIN zz ON zz.profile_id = rg.profile_id AND zz.drug = rg.drug GROUP BY 1""")
def _(spark, folder):
    s = drug_scores(spark, folder)
    z = G.standardise_scores(s, G.score_reference(s))
    v = F.col("vec_id")
    r = table(spark, folder, "embeddings").select(v.alias("profile_id"), F.array(F.concat(F.lit("Brand#"), (v % 25 + 1).cast("string")), F.concat(F.lit("Brand#"), (v % 7 + 1).cast("string")), F.lit("none")).alias("drugs"))
    return G.regimen_scores(z, r).withColumn("regimen_score", r6("regimen_score"))


SUP = "su AS (SELECT p_brand AS drug, round(avg(p_size) / 50, 9) AS rel, round(avg(p_retailprice) / 3000, 9) AS dsup FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1)"
PRI = f"""{SC}, {SUP}, ep AS (SELECT profile_id, drug, round(raw_score, 12) AS rs, (rank() OVER (PARTITION BY drug ORDER BY round(raw_score, 12)) - 1 + 0.5 * count(*) OVER (PARTITION BY drug, round(raw_score, 12))) / count(*) OVER (PARTITION BY drug) AS pct FROM sc WHERE raw_score IS NOT NULL),
pri AS (SELECT sc.profile_id, sc.drug, pct, coalesce(dsup, 0) AS dsup, round(0.6 * pct + 0.25 * coalesce(rel, 0) + 0.15 * coalesce(dsup, 0), 12) AS priority FROM sc LEFT JOIN ep USING (profile_id, drug) LEFT JOIN su ON su.drug = sc.drug)"""


def priorities(spark, folder):
    s = drug_scores(spark, folder)
    p = table(spark, folder, "part").where(F.col("p_brand") != "Brand#3")
    support = p.groupBy(F.col("p_brand").alias("drug")).agg(F.round(F.avg("p_size") / 50, 9).alias("reliability"), F.round(F.avg("p_retailprice") / 3000, 9).alias("drug_support"))
    return G.integrated_priority(s, None, support)


@query("sig_12_priority", f"""
WITH {PRI} SELECT profile_id, drug, round(pct, 6) AS sensitivity_percentile, round(priority, 6) AS priority, CASE WHEN priority IS NOT NULL THEN row_number() OVER (PARTITION BY profile_id ORDER BY priority DESC NULLS LAST, drug) END AS rank FROM pri""")
def _(spark, folder):
    return priorities(spark, folder).select("profile_id", "drug", r6("sensitivity_percentile").alias("sensitivity_percentile"), r6("priority").alias("priority"), "rank")


@query("sig_13_pair_priority", f"""
WITH {PRI}, pa AS (SELECT 'Brand#' || least(l_partkey % 25 + 1, l_suppkey % 25 + 1) AS drug_a, 'Brand#' || greatest(l_partkey % 25 + 1, l_suppkey % 25 + 1) AS drug_b, round(avg(l_discount), 9) AS al FROM lineitem WHERE l_partkey % 25 <> l_suppkey % 25 GROUP BY 1, 2),
j AS (SELECT x.profile_id, drug_a, drug_b, sqrt(x.priority * y.priority) AS comp, round(0.55 * sqrt(x.priority * y.priority) + 0.35 * al + 0.10 * (x.dsup + y.dsup) / 2, 12) AS priority FROM pa JOIN pri x ON x.drug = drug_a JOIN pri y ON y.drug = drug_b AND y.profile_id = x.profile_id WHERE x.priority IS NOT NULL AND y.priority IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY priority DESC, drug_a, drug_b) AS rank FROM j)
SELECT profile_id, count(*) AS n_pairs, round(sum(comp), 4) AS component, round(sum(priority), 4) AS priority, max(drug_a) FILTER (WHERE rank = 1) AS best_a, max(drug_b) FILTER (WHERE rank = 1) AS best_b FROM k GROUP BY 1""")
def _(spark, folder):
    li = table(spark, folder, "lineitem").where(F.col("l_partkey") % 25 != F.col("l_suppkey") % 25)
    a, b = F.col("l_partkey") % 25 + 1, F.col("l_suppkey") % 25 + 1
    pairs = li.groupBy(F.concat(F.lit("Brand#"), F.least(a, b).cast("string")).alias("drug_a"), F.concat(F.lit("Brand#"), F.greatest(a, b).cast("string")).alias("drug_b")).agg(F.round(F.avg("l_discount"), 9).alias("aligned_support"))
    out = G.pair_priority(pairs, priorities(spark, folder))
    first = F.col("rank") == 1
    return out.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_pairs"), r6(F.sum("component"), 4).alias("component"), r6(F.sum("priority"), 4).alias("priority"),
                                         F.max(F.when(first, F.col("drug_a"))).alias("best_a"), F.max(F.when(first, F.col("drug_b"))).alias("best_b"))


@query("sig_13_overlap_pairs", f"""
WITH {LISTS}, o AS (SELECT a.canonical, least(a.percentile, b.percentile) AS percentile FROM l1 a JOIN l2 b USING (canonical)), pa AS (SELECT least(x.canonical, y.canonical) AS drug_a, greatest(x.canonical, y.canonical) AS drug_b, round(avg(l_discount), 9) AS al FROM lineitem
  JOIN (SELECT p_partkey, lower(concat(p_name, ' ', p_partkey % 50)) AS canonical FROM part) x ON x.p_partkey = l_partkey JOIN (SELECT p_partkey, lower(concat(p_name, ' ', p_partkey % 50)) AS canonical FROM part) y ON y.p_partkey = l_suppkey WHERE x.canonical <> y.canonical GROUP BY 1, 2),
j AS (SELECT drug_a, drug_b, sqrt(p.percentile * q.percentile) AS comp, round(0.6 * sqrt(p.percentile * q.percentile) + 0.4 * al, 12) AS priority FROM pa JOIN o p ON p.canonical = drug_a JOIN o q ON q.canonical = drug_b)
SELECT drug_a, drug_b, round(comp, 6) AS component, round(priority, 6) AS priority, rank FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, drug_a, drug_b) AS rank FROM j) WHERE rank <= 25""")
def _(spark, folder):
    o = J.dual_list(*drug_lists(spark, folder)).select("canonical", F.least("list1_percentile", "list2_percentile").alias("percentile"))
    p = table(spark, folder, "part").select("p_partkey", F.lower(F.concat(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 50).cast("string"))).alias("n"))
    li = table(spark, folder, "lineitem").join(p.withColumnsRenamed({"p_partkey": "l_partkey", "n": "x"}), "l_partkey").join(p.withColumnsRenamed({"p_partkey": "l_suppkey", "n": "y"}), "l_suppkey")
    pairs = li.where(F.col("x") != F.col("y")).groupBy(F.least("x", "y").alias("drug_a"), F.greatest("x", "y").alias("drug_b")).agg(F.round(F.avg("l_discount"), 9).alias("aligned_support"))
    return G.overlap_pairs(pairs, o, o, 25).withColumns({"component": r6("component"), "priority": r6("priority")})


@query("sig_14_concordance_class", f"""
WITH {LISTS}, cat AS (SELECT lower(concat(p_name, ' ', p_partkey % 50)) AS canonical FROM part GROUP BY 1 HAVING min(p_type) = 'ECONOMY'), pr AS (SELECT lower(concat(p_name, ' ', p_partkey % 50)) AS canonical, round(avg(p_size) / 50, 9) AS pp FROM part GROUP BY 1)
SELECT c.canonical, CASE WHEN least(a.percentile, b.percentile) >= 0.75 AND a.percentile IS NOT NULL AND b.percentile IS NOT NULL THEN CASE WHEN pp >= 0.75 THEN 'concordant_high' ELSE 'expression_only' END WHEN pp >= 0.75 THEN 'predictor_only' ELSE 'low_or_uncertain' END AS evidence_concordance
FROM cat c LEFT JOIN l1 a ON a.canonical = c.canonical LEFT JOIN l2 b ON b.canonical = c.canonical LEFT JOIN pr ON pr.canonical = c.canonical""")
def _(spark, folder):
    dual = J.dual_list(*drug_lists(spark, folder)).select("canonical", F.least("list1_percentile", "list2_percentile").alias("dual_support_percentile"))
    p = table(spark, folder, "part")
    pred = p.groupBy(F.lower(F.concat(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 50).cast("string"))).alias("canonical")).agg(F.round(F.avg("p_size") / 50, 9).alias("percentile"))
    return G.concordance_class(comparators(spark, folder).join(dual, "canonical", "left"), pred).select("canonical", "evidence_concordance")


@query("sig_15_consolidate", """
WITH pr AS (SELECT p_type || ':' || lower(p_name) || ':' || (p_size % 4) AS k, lower(p_name) AS drug, min(p_brand) AS treatment_class FROM part GROUP BY 1, 2), ok AS (SELECT lower(p_name) AS drug FROM part GROUP BY 1 HAVING avg(p_size) > 24),
r AS (SELECT p_type || ':' || lower(p_name) || ':' || (p_size % 4) AS k, 'G' || (l_suppkey % 20) AS feature, l_discount - 0.05 AS coefficient FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' AND l_linestatus = 'F')
SELECT drug, treatment_class, feature, round(median(coefficient), 6) AS coefficient FROM r JOIN pr USING (k) WHERE drug IN (SELECT drug FROM ok) GROUP BY 1, 2, 3""")
def _(spark, folder):
    p = table(spark, folder, "part")
    ident = F.col("p_size") % 4
    primary = p.groupBy(F.col("p_type").alias("primary_screen"), F.col("p_name").alias("drug"), ident.alias("primary_drug_id")).agg(F.min("p_brand").alias("treatment_class"))
    status = p.groupBy(F.col("p_name").alias("drug")).agg((F.avg("p_size") > 24).alias("available"))
    raw = table(spark, folder, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws(":", F.col("p_type"), F.lower("p_name"), ident.cast("string")).alias("drug_screen"), F.col("l_returnflag").alias("analysis"), F.col("l_linestatus").alias("model"),
        F.concat(F.lit(" g"), (F.col("l_suppkey") % 20).cast("string")).alias("feature"), (F.col("l_discount") - 0.05).alias("coefficient"))
    return G.consolidate_coefficients(raw, primary, status, "A", "F").withColumn("coefficient", r6("coefficient"))


NET = "nw AS (SELECT 's' || (p_partkey % 6) AS source, 'g' || lpad(CAST((p_partkey // 6) % 64 AS VARCHAR), 2, '0') AS feature, round(avg(p_size) - 20.3, 6) AS weight FROM part WHERE (p_partkey // 6) % 64 % 6 <> p_partkey % 5 GROUP BY 1, 2)"


def network(spark, folder):
    p = table(spark, folder, "part")
    f = F.floor(F.col("p_partkey") / 6) % 64
    return p.where(f % 6 != F.col("p_partkey") % 5).groupBy(F.concat(F.lit("s"), (F.col("p_partkey") % 6).cast("string")).alias("source"), F.concat(F.lit("g"), F.lpad(f.cast("string"), 2, "0")).alias("feature")).agg(F.round(F.avg("p_size") - 20.3, 6).alias("weight"))


@query("sig_16_univariate_activity", f"""
WITH {M}, {NET}, x AS (SELECT sample_id, s.source, coalesce(weight, 0) AS w, value AS y FROM m CROSS JOIN (SELECT DISTINCT source FROM nw) s LEFT JOIN nw ON nw.source = s.source AND nw.feature = m.feature), r AS (SELECT sample_id, source, corr(w, y) AS r, count(*) - 2 AS df FROM x GROUP BY 1, 2)
SELECT sample_id, source, round(r * sqrt(df / (1 - r * r)), 5) AS activity, df FROM r""")
def _(spark, folder):
    return G.univariate_activity(measurements(spark, folder), network(spark, folder)).withColumn("activity", r6("activity", 5))


@query("sig_16_multivariate_activity")
def _(spark, folder):
    return G.multivariate_activity(measurements(spark, folder), network(spark, folder))


@query("sig_16_marker_activity", f"""
WITH {M} SELECT sample_id, round(avg(value), 6) AS activity FROM m WHERE feature IN ('g07', 'g11') GROUP BY 1""")
def _(spark, folder):
    return G.marker_activity(measurements(spark, folder), ["g07", "g11", "absent"]).withColumn("activity", r6("activity"))


@query("sig_17_dose_points", """
WITH c AS (SELECT p_partkey, p_retailprice AS ic50_nm, 1.0 + p_size / 50.0::DOUBLE AS h, CASE WHEN p_partkey % 3 > 0 THEN p_size * 40.0::DOUBLE END AS max_nm FROM part), g AS (SELECT c.*, i AS point, pow(10, i * 5.0 / 24) AS cn FROM c CROSS JOIN range(25) t(i)), v AS (SELECT *, 1 / (1 + pow(cn / ic50_nm, h)) AS v FROM g)
SELECT p_partkey, CAST(point AS INTEGER) AS point, round(v, 6) AS viability, round(greatest(0, least(1, v - 0.08 * (1 - v))), 6) AS band_lower, round(greatest(0, least(1, v + 0.08 * (1 - v))), 6) AS band_upper, coalesce(ic50_nm > max_nm, false) AS ic50_extrapolated FROM v""")
def _(spark, folder):
    p = table(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("ic50_nm"), (1.0 + F.col("p_size") / 50.0).alias("h"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") * 40.0).alias("max_conc_nm"))
    return G.dose_points(p).select("p_partkey", "point", *[r6(c).alias(c) for c in ("viability", "band_lower", "band_upper")], "ic50_extrapolated")


@query("sig_18_fingerprints", """
WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS b FROM embeddings), x AS (SELECT a.vec_id, a.label, unnest([1,2,3,4,5]) AS ax, a.embedding::DOUBLE[] AS va, b.b AS vb FROM embeddings a JOIN r b ON b.vec_id = a.vec_id - a.vec_id % 10), p AS (SELECT vec_id, label, ax, va[ax] * vb[ax] AS c FROM x)
SELECT vec_id, ax - 1 AS axis, round(c / max(abs(c)) OVER (PARTITION BY vec_id), 6) AS own, round(c / max(abs(c)) OVER (PARTITION BY label), 6) AS shared FROM p""")
def _(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    ref = e.select(F.col("vec_id").alias("ref"), F.col("a").alias("b"))
    pairs = e.join(ref, F.col("ref") == F.col("vec_id") - F.col("vec_id") % 10)
    own = G.fingerprints(pairs, "a", "b").select("vec_id", F.posexplode("fingerprint").alias("axis", "own"))
    shared = G.fingerprints(pairs, "a", "b", shared_by=["label"]).select("vec_id", F.posexplode("fingerprint").alias("axis", "shared"))
    return own.join(shared, ["vec_id", "axis"]).withColumns({"own": r6("own"), "shared": r6("shared")})


@query("sig_19_compartment", f"""
WITH {M}, s AS (SELECT l_suppkey AS sample_id, avg(l_discount) AS malignant FROM lineitem GROUP BY 1) SELECT sample_id, feature, round(value / greatest(malignant, 0.05), 6) AS value, 'intrinsic_epithelium_vs_normal_epithelium' AS comparison_type FROM m JOIN s USING (sample_id)""")
def _(spark, folder):
    s = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id")).agg(F.avg("l_discount").alias("malignant"))
    return G.compartment_normalise(measurements(spark, folder).select("sample_id", "feature", "value"), s).withColumn("value", r6("value"))


@query("sig_20_bliss", """
SELECT l_orderkey, l_linenumber, round(l_tax - (l_discount + l_quantity / 50 - l_discount * l_quantity / 50), 6) AS excess FROM lineitem""")
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(G.bliss_excess(F.col("l_discount"), F.col("l_quantity") / 50, F.col("l_tax"))).alias("excess"))


POE = "v AS (SELECT l_orderkey AS sample_id, l_partkey % 4 AS dim, l_linenumber AS view, l_discount * 10 AS mu, l_tax * 20 - 1 AS logvar, l_returnflag <> 'N' AS present FROM lineitem)"


def views(spark, folder):
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_partkey") % 4).alias("dim"), F.col("l_linenumber").alias("view"), (F.col("l_discount") * 10).alias("mu"), (F.col("l_tax") * 20 - 1).alias("logvar"), (F.col("l_returnflag") != "N").alias("present"))


@query("sig_21_product_of_experts", f"""
WITH {POE}, p AS (SELECT *, CASE WHEN present THEN exp(-logvar) ELSE 0 END AS w FROM v) SELECT sample_id, dim, round(sum(w * mu) / (sum(w) + 1), 6) AS mu, round(-ln(sum(w) + 1), 6) AS logvar FROM p GROUP BY 1, 2""")
def _(spark, folder):
    return G.product_of_experts(views(spark, folder)).withColumns({"mu": r6("mu"), "logvar": r6("logvar")})


@query("sig_21_width_reduction", f"""
WITH {POE}, a AS (SELECT sample_id, avg(w) AS w FROM (SELECT sample_id, dim, exp(-0.5 * ln(sum(CASE WHEN present THEN exp(-logvar) ELSE 0 END) + 1)) AS w FROM v GROUP BY 1, 2) GROUP BY 1), b AS (SELECT sample_id, avg(w) AS w FROM (SELECT sample_id, dim, exp(-0.5 * ln(sum(CASE WHEN present AND view <> 1 THEN exp(-logvar) ELSE 0 END) + 1)) AS w FROM v GROUP BY 1, 2) GROUP BY 1)
SELECT sample_id, round((b.w - a.w) / b.w, 6) AS reduction FROM a JOIN b USING (sample_id)""")
def _(spark, folder):
    v = views(spark, folder)
    full = G.posterior_width(G.product_of_experts(v))
    less = G.posterior_width(G.product_of_experts(v.withColumn("present", F.col("present") & (F.col("view") != 1))))
    return G.width_reduction(less, full).withColumn("reduction", r6("reduction"))


_GENES = ["ESR1", "egfr", "PTEN", "KRAS", "CDK4", "OTHER"]


@query("sig_22_mapping", f"""
SELECT c_custkey, CASE upper(g) WHEN 'ESR1' THEN 'Estrogen' WHEN 'EGFR' THEN 'EGFR' WHEN 'PTEN' THEN 'PI3K' WHEN 'KRAS' THEN 'MAPK' WHEN 'CDK4' THEN 'p53' ELSE 'MAPK' END AS pathway, CASE WHEN c_custkey % 2 = 1 AND c_nationkey % 5 = 0 THEN 'lapatinib' WHEN c_nationkey % 3 = 1 THEN 'tamoxifen' WHEN c_custkey % 4 = 1 THEN 'paclitaxel' ELSE 'tamoxifen' END AS drug FROM (SELECT *, {pick_sql(_GENES, 'c_custkey')} AS g FROM customer)""")
def _(spark, folder):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, folder, "customer").select("c_custkey", G.target_pathway(pick(_GENES, k)).alias("pathway"), G.index_treatment(F.when(n % 5 == 0, k % 2), n % 3, k % 4).alias("drug"))


@query("sig_23_candidates", f"""
WITH a AS (SELECT user_id AS sample_id, ['estrogen','egfr','pi3k','mapk'][CAST(user_id % 4 + 1 AS INTEGER)] AS pathway, avg(value) - 50 AS act FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, 'p53', min(value) - 0.5 FROM events GROUP BY 1),
d AS (SELECT DISTINCT p_brand AS drug, CASE {pick_sql(_GENES, "CAST(substr(p_brand, 7) AS INTEGER)")} WHEN 'ESR1' THEN 'estrogen' WHEN 'egfr' THEN 'egfr' WHEN 'PTEN' THEN 'pi3k' WHEN 'CDK4' THEN 'p53' ELSE 'mapk' END AS pathway, CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0 THEN 'A' ELSE 'B' END AS tier FROM part),
g AS (SELECT u.sample_id, d.drug, d.tier, coalesce(act, 0) AS act FROM (SELECT DISTINCT user_id AS sample_id FROM events) u CROSS JOIN d LEFT JOIN a ON a.sample_id = u.sample_id AND a.pathway = d.pathway)
SELECT sample_id, coalesce(array_to_string(list(drug || ':' || tier ORDER BY lower(drug)) FILTER (WHERE act >= 0), ';'), '') AS members, count(*) FILTER (WHERE act < 0) AS excluded_count, count(*) AS n_scored FROM g GROUP BY 1""")
def _(spark, folder):
    e = table(spark, folder, "events")
    names = F.element_at(F.array(*[F.lit(x) for x in ("Estrogen", "EGFR", "PI3K", "MAPK")]), (F.col("user_id") % 4 + 1).cast("int"))
    act = e.groupBy(F.col("user_id").alias("sample_id"), names.alias("pathway")).agg((F.avg("value") - 50).alias("activity")).unionByName(
        e.groupBy(F.col("user_id").alias("sample_id")).agg(F.lit("p53").alias("pathway"), (F.min("value") - 0.5).alias("activity")))
    b = F.substring("p_brand", 7, 5).cast("int")
    pk = table(spark, folder, "part").select(F.col("p_brand").alias("drug_name"), pick(_GENES, b).alias("target_gene"), (b % 2 == 0).alias("in_topology")).distinct()
    out = G.pathway_candidates(act, pk)
    return out.select("sample_id", F.array_join(F.transform("set_members", lambda x: F.concat_ws(":", x["drug"], x["evidence_tier"])), ";").alias("members"), F.col("excluded_count").cast("long").alias("excluded_count"), "n_scored")


@query("sig_24_cluster_detail", f"""
WITH {CE}, s AS (SELECT *, round(1 / (1 + abs(effect) * 300), 9) AS fdr FROM ce), n AS (SELECT cluster, count(*) FILTER (WHERE fdr < 0.1) AS n_significant FROM s GROUP BY 1)
SELECT cluster, feature, round(effect, 6) AS effect, 'up' AS direction, rank, n_significant FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect DESC, feature) AS rank FROM s WHERE effect > 0) JOIN n USING (cluster) WHERE rank <= 15
UNION ALL SELECT cluster, feature, round(effect, 6), 'down', rank, n_significant FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect, feature) AS rank FROM s WHERE effect < 0) JOIN n USING (cluster) WHERE rank <= 15""")
def _(spark, folder):
    ce = cluster_effects(spark, folder).withColumn("fdr", F.round(1 / (1 + F.abs("effect") * 300), 9)).withColumnRenamed("effect", "coef")
    return G.cluster_detail(ce, 15).withColumn("effect", r6("effect"))


@query("sig_25_start_values", f"""
WITH {M}, n AS (SELECT vec_id AS sample_id, unnest(['ESR1','PTEN','KRAS','E2F1']) AS node FROM embeddings), r AS (SELECT sample_id, CASE feature WHEN 'g00' THEN 'ESR1' ELSE 'E2F1' END AS node, value * 20 AS a FROM m WHERE (feature = 'g00' AND sample_id % 2 = 0) OR (feature = 'g01' AND sample_id % 3 = 0)), p AS (SELECT sample_id, CASE feature WHEN 'g02' THEN 'estrogen' ELSE 'pi3k' END AS pw, value * 20 AS a FROM m WHERE feature IN ('g02','g03')),
x AS (SELECT n.*, CASE node WHEN 'ESR1' THEN 'estrogen' WHEN 'PTEN' THEN 'pi3k' WHEN 'KRAS' THEN 'mapk' ELSE 'p53' END AS pw FROM n)
SELECT x.sample_id, x.node, round(coalesce(greatest(0, least(1, (r.a + 3) / 6)), greatest(0, least(1, (p.a + 3) / 6)), 0.5), 6) AS x0 FROM x LEFT JOIN r ON r.sample_id = x.sample_id AND r.node = x.node LEFT JOIN p ON p.sample_id = x.sample_id AND p.pw = x.pw""")
def _(spark, folder):
    m = measurements(spark, folder)
    n = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), F.explode(F.array(*[F.lit(x) for x in ("ESR1", "PTEN", "KRAS", "E2F1")])).alias("node"))
    f, s = F.col("feature"), F.col("sample_id")
    r = m.where(((f == "g00") & (s % 2 == 0)) | ((f == "g01") & (s % 3 == 0))).select("sample_id", F.when(f == "g00", "ESR1").otherwise("E2F1").alias("source"), (F.col("value") * 20).alias("activity"))
    p = m.where(f.isin("g02", "g03")).select("sample_id", F.when(f == "g02", "Estrogen").otherwise("PI3K").alias("source"), (F.col("value") * 20).alias("activity"))
    return G.start_values(n, r, p).withColumn("x0", r6("x0"))
