"""Aggregate, window and set operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortgrid.bindings.registry import query
from cohortgrid.bindings.tables import D, LISTS, M, S, drug_lists, drug_rows, measurements, pick, pick_sql, r6, survival, table
from cohortgrid.bindings.joining import E, graph
from cohortgrid.operators import aggregates as A
from cohortgrid.operators import sets as T
from cohortgrid.operators import windows as W
from cohortgrid.operators.scans import bh_q, keep_first, top_k


# ---- aggregates -----------------------------------------------------------------------------------
@query("agg_01_collapse", """
WITH x AS (SELECT l_orderkey % 500 AS sample_id, l_partkey % 40 AS feature, l_quantity AS value, l_orderkey, l_linenumber FROM lineitem),
f AS (SELECT sample_id, feature, value AS first_value FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, feature ORDER BY l_orderkey, l_linenumber, value) AS rn FROM x) WHERE rn = 1)
SELECT sample_id, feature, round(avg(value), 6) AS mean_value, any_value(first_value) AS first_value FROM x JOIN f USING (sample_id, feature) GROUP BY 1, 2""")
def _(spark, folder):
    x = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 500).alias("sample_id"), (F.col("l_partkey") % 40).alias("feature"), F.col("l_quantity").alias("value"), "l_orderkey", "l_linenumber")
    first = A.collapse_first(x, [F.col("l_orderkey"), F.col("l_linenumber"), F.col("value")]).select("sample_id", "feature", F.col("value").alias("first_value"))
    return A.collapse_mean(x).withColumnRenamed("value", "mean_value").withColumn("mean_value", r6("mean_value")).join(first, ["sample_id", "feature"])


@query("agg_02_reference_stats", f"""
WITH {M} SELECT feature, round(avg(value), 6) AS mean, round(nullif(stddev_samp(value), 0), 6) AS sd, count(value) AS n FROM m GROUP BY 1""")
def _(spark, folder):
    return A.reference_stats(measurements(spark, folder)).select("feature", r6("mean").alias("mean"), r6("sd").alias("sd"), "n")


@query("agg_03_centroids", f"""
WITH {M} SELECT cluster, feature, round(avg(value), 6) AS value FROM m GROUP BY 1, 2""")
def _(spark, folder):
    return A.centroids(measurements(spark, folder)).withColumn("value", r6("value"))


def signature_scores(spark, folder):
    d = drug_rows(spark, folder)
    return d.select(F.col("canonical").alias("drug"), (F.col("l_suppkey") % 12).alias("cell_id"), F.concat_ws(";", F.lower("p_brand"), F.lower("p_type")).alias("targets"),
                    (F.col("l_discount") - 0.045).alias("reversal_score"), "l_orderkey", "l_linenumber")


@query("agg_04_compound_rollup", f"""
WITH {D}, g AS (SELECT canonical, min(canonical) AS drug, max(l_discount - 0.045) AS rs, median(l_discount - 0.045) AS ms, count(*) AS n_signatures, count(DISTINCT l_suppkey % 12) AS n_cell_lines, avg(CAST(l_discount - 0.045 > 0 AS INTEGER)) AS consistency FROM d GROUP BY 1),
t AS (SELECT canonical, array_to_string(list_sort(list(DISTINCT t)), ';') AS targets FROM (SELECT canonical, unnest([lower(p_brand), lower(p_type)]) AS t FROM d) GROUP BY 1)
SELECT canonical, drug, round(rs, 6) AS reversal_score, round(ms, 6) AS median_score, n_signatures, n_cell_lines, round(consistency, 6) AS consistency, targets,
 row_number() OVER (ORDER BY rs DESC, canonical) AS rank, round(1.0 - (row_number() OVER (ORDER BY rs DESC, canonical) - 1.0) / greatest(count(*) OVER () - 1, 1), 6) AS percentile FROM g JOIN t USING (canonical)""")
def _(spark, folder):
    out = A.compound_rollup(signature_scores(spark, folder))
    return out.select("canonical", "drug", r6("reversal_score").alias("reversal_score"), r6("median_score").alias("median_score"), "n_signatures", "n_cell_lines",
                      r6("consistency").alias("consistency"), F.array_join("targets", ";").alias("targets"), "rank", r6("percentile").alias("percentile"))


@query("agg_05_median_ranking", f"""
WITH {D}, g AS (SELECT canonical AS drug, median(l_discount - 0.045) AS ms, count(*) AS n_signatures FROM d GROUP BY 1 HAVING count(*) >= 2)
SELECT drug, round(ms, 6) AS reversal_score, n_signatures, row_number() OVER (ORDER BY round(ms, 9) DESC, drug) AS rank FROM g""")
def _(spark, folder):
    s = signature_scores(spark, folder).withColumn("reversal_score", F.round("reversal_score", 9))
    return A.median_ranking(s).withColumn("reversal_score", r6("reversal_score"))


@query("agg_06_composition", """
WITH v AS (SELECT unnest([0,1,2,7]) AS cluster), l AS (SELECT unnest([0,1,2,3]) AS subtype),
c AS (SELECT label % 4 AS cluster, label % 5 AS subtype, count(*) AS n FROM embeddings WHERE label % 5 < 4 GROUP BY 1, 2)
SELECT v.cluster, l.subtype, round(CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY v.cluster) > 0 THEN coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY v.cluster) END, 6) AS share
FROM v CROSS JOIN l LEFT JOIN c ON c.cluster = v.cluster AND c.subtype = l.subtype""")
def _(spark, folder):
    e = table(spark, folder, "embeddings").select((F.col("label") % 4).alias("cluster"), (F.col("label") % 5).alias("subtype"))
    return A.composition(e, [0, 1, 2, 7], [0, 1, 2, 3]).withColumn("share", r6("share"))


@query("agg_07_annotations", f"""
WITH {M}, x AS (SELECT sample_id, label, cluster, CAST(subtype AS VARCHAR) AS subtype, feature, value * 8 AS value FROM m), mm AS (SELECT cluster, feature, avg(value) AS v FROM x WHERE feature IN ('g01','g02','g03','g04','g05') GROUP BY 1, 2),
w AS (SELECT cluster, max(v) FILTER (WHERE feature = 'g01') AS er, max(v) FILTER (WHERE feature = 'g02') AS her2, avg(v) FILTER (WHERE feature IN ('g03','g04','g05')) AS prolif_mean FROM mm GROUP BY 1),
n AS (SELECT label % 4 AS cluster, count(*) AS n FROM embeddings GROUP BY 1), mj AS (SELECT cluster, subtype FROM (SELECT label % 4 AS cluster, CAST(label % 5 AS VARCHAR) AS subtype, row_number() OVER (PARTITION BY label % 4 ORDER BY count(*) DESC, CAST(label % 5 AS VARCHAR)) AS rn FROM embeddings GROUP BY 1, 2) WHERE rn = 1),
lead AS (SELECT (SELECT CASE WHEN max(er) - (SELECT er FROM w ORDER BY er DESC LIMIT 1 OFFSET 1) >= 0.25 THEN arg_max(cluster, er) END FROM w) AS le, (SELECT CASE WHEN max(her2) - (SELECT her2 FROM w ORDER BY her2 DESC LIMIT 1 OFFSET 1) >= 0.25 THEN arg_max(cluster, her2) END FROM w) AS lh,
 (SELECT CASE WHEN max(prolif_mean) - (SELECT prolif_mean FROM w ORDER BY prolif_mean DESC LIMIT 1 OFFSET 1) >= 0.25 THEN arg_max(cluster, prolif_mean) END FROM w) AS lp)
SELECT cluster, n, round(er, 6) AS er, round(her2, 6) AS her2, round(prolif_mean, 6) AS prolif_mean, mj.subtype AS majority, coalesce(cluster = le, false) AS er_leads, coalesce(cluster = lh, false) AS her2_leads, coalesce(cluster = lp, false) AS prolif_mean_leads
FROM w JOIN n USING (cluster) JOIN mj USING (cluster), lead""")
def _(spark, folder):
    m = measurements(spark, folder).withColumn("value", F.col("value") * 8)
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") % 4).alias("cluster"), (F.col("label") % 5).cast("string").alias("subtype"))
    out = A.annotate_groups(m.select("sample_id", "feature", "value"), labels, {"er": "g01", "her2": "g02"}, ["g03", "g04", "g05"])
    return out.withColumns({c: r6(c) for c in ("er", "her2", "prolif_mean")})


FAMILY = "CASE WHEN feature < 'g14' THEN 'pathway' WHEN feature < 'g30' THEN 'tf' ELSE 'gene' END"
PROF = f"""{M}, g AS (SELECT feature, cluster, count(*) AS n, avg(value) AS mu FROM m GROUP BY 1, 2), t AS (SELECT feature, count(*) AS n, avg(value) AS mu FROM m GROUP BY 1),
p AS (SELECT g.feature, {FAMILY.replace('feature', 'g.feature')} AS family, cluster, round(g.mu - (t.mu * t.n - g.mu * g.n) / (t.n - g.n), 9) AS effect, round(1 / (1 + abs(g.mu) * 40), 9) AS q FROM g JOIN t USING (feature))"""


def profiles(spark, folder):
    """Mean differences per feature and cluster with a stand-in q that SQL can repeat."""
    m = measurements(spark, folder)
    g = m.groupBy("feature", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mu"))
    t = m.groupBy("feature").agg(F.count(F.lit(1)).alias("tn"), F.avg("value").alias("tmu"))
    family = F.when(F.col("feature") < "g14", "pathway").when(F.col("feature") < "g30", "tf").otherwise("gene")
    return g.join(t, "feature").select("feature", family.alias("family"), "cluster",
                                       F.round(F.col("mu") - (F.col("tmu") * F.col("tn") - F.col("mu") * F.col("n")) / (F.col("tn") - F.col("n")), 9).alias("effect"),
                                       F.round(1 / (1 + F.abs("mu") * 40), 9).alias("q"))


@query("agg_08_effect_matrix", f"""
WITH {PROF}, s AS (SELECT feature, family, max(abs(effect)) AS st FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY st DESC, feature) AS position FROM s),
k AS (SELECT * FROM r WHERE (family = 'pathway' AND position <= 14) OR (family = 'tf' AND position <= 10) OR (family = 'gene' AND position <= 30))
SELECT family, position, feature, {', '.join(f"round(coalesce(max(effect) FILTER (WHERE cluster = {c}), 0), 6) AS effect_{c}, round(coalesce(max(q) FILTER (WHERE cluster = {c}), 1), 6) AS q_{c}" for c in range(4))}
FROM p JOIN k USING (feature, family) GROUP BY 1, 2, 3""")
def _(spark, folder):
    out = A.effect_matrix(profiles(spark, folder), [0, 1, 2, 3], {"pathway": 14, "tf": 10, "gene": 30})
    return out.withColumns({f"{k}_{c}": r6(f"{k}_{c}") for k in ("effect", "q") for c in range(4)})


@query("agg_09_significant_counts", f"""
WITH {PROF} SELECT cluster, n_significant, min(n_significant) OVER () AS minimum FROM (SELECT cluster, count(*) FILTER (WHERE family = 'pathway' AND q < 0.5) AS n_significant FROM p GROUP BY 1)""")
def _(spark, folder):
    return A.significant_counts(profiles(spark, folder), "pathway", 0.5)


@query("agg_10_set_variation", """
WITH s AS (SELECT DISTINCT l_suppkey % 60 AS set_id, l_partkey % 700 AS member FROM lineitem), z AS (SELECT set_id, count(*) AS size FROM s GROUP BY 1),
i AS (SELECT a.set_id AS i, b.set_id AS j, count(*) AS n FROM s a JOIN s b ON a.member = b.member AND a.set_id < b.set_id GROUP BY 1, 2),
jc AS (SELECT coalesce(n, 0) / (a.size + b.size - coalesce(n, 0)) AS jaccard FROM z a JOIN z b ON a.set_id < b.set_id LEFT JOIN i ON i.i = a.set_id AND i.j = b.set_id), u AS (SELECT member, count(*) AS k FROM s GROUP BY 1)
SELECT (SELECT count(*) FROM z) AS n_sets, (SELECT round(avg(size), 6) FROM z) AS size_mean, (SELECT min(size) FROM z) AS size_min, (SELECT max(size) FROM z) AS size_max, round(avg(jaccard), 6) AS jaccard_mean, round(min(jaccard), 6) AS jaccard_min, round(max(jaccard), 6) AS jaccard_max,
 round(avg(CAST(jaccard > 0.8 AS INTEGER)), 6) AS share_over_08, round(median(jaccard), 6) AS jaccard_median, (SELECT count(*) FROM u) AS union_size, (SELECT count(*) FILTER (WHERE k = (SELECT count(*) FROM z)) FROM u) AS core_size, (SELECT count(*) FILTER (WHERE k = 1) FROM u) AS singletons, avg(jaccard) < 0.8 AS informative FROM jc""")
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    out = A.set_variation(li.select((F.col("l_suppkey") % 60).alias("set_id"), (F.col("l_partkey") % 700).alias("member")))
    return out.withColumns({c: r6(c) for c in ("size_mean", "jaccard_mean", "jaccard_min", "jaccard_max", "share_over_08", "jaccard_median")})


@query("agg_11_essentiality", f"""
WITH {M}, f AS (SELECT *, value < -0.05 AS pos FROM m), pan AS (SELECT feature FROM f GROUP BY 1 HAVING avg(CAST(pos AS INTEGER)) >= 0.36),
per AS (SELECT sample_id, count(*) FILTER (WHERE pos AND feature NOT IN (SELECT feature FROM pan)) AS k FROM f WHERE label IN (1, 3) GROUP BY 1)
SELECT count(*) AS n_entities, min(k) AS minimum, max(k) AS maximum, median(k) AS median, (SELECT count(*) FROM pan) AS n_pan, min(k) < 10 AS degenerate FROM per""")
def _(spark, folder):
    m = measurements(spark, folder)
    return A.essentiality_summary(m, m.where(F.col("label").isin(1, 3)), -0.05, 0.36)


@query("agg_12_completeness", f"""
WITH {M} SELECT feature, round(avg(CAST(sample_id % (3 + CAST(substr(feature, 2) AS INTEGER) % 5) <> 0 AS INTEGER)), 6) AS completeness FROM m GROUP BY 1""")
def _(spark, folder):
    m = measurements(spark, folder)
    pos = F.substring("feature", 2, 2).cast("int")
    holes = m.withColumn("value", F.when(F.col("sample_id") % (3 + pos % 5) != 0, F.col("value")))
    return A.completeness(holes).withColumn("completeness", r6("completeness"))


REGULON = "r AS (SELECT DISTINCT 'r' || (CAST(substr(feature, 2) AS INTEGER) % 9) AS regulator, CASE WHEN CAST(substr(feature, 2) AS INTEGER) % 9 = 8 THEN 'x' || feature ELSE feature END AS target FROM m)"


def regulons(spark, folder):
    m = measurements(spark, folder)
    pos = F.substring("feature", 2, 2).cast("int") % 9
    return m.select(F.concat(F.lit("r"), pos.cast("string")).alias("regulator"), F.when(pos == 8, F.concat(F.lit("x"), F.col("feature"))).otherwise(F.col("feature")).alias("target")).distinct()


@query("agg_13_silencing", f"""
WITH {M}, {REGULON}, me AS (SELECT feature, avg(CAST(abs(value) * 6 >= 0.6 AS INTEGER)) AS sil FROM m WHERE sample_id % 2 = 0 GROUP BY 1), ex AS (SELECT feature, avg(value) AS rna FROM m WHERE sample_id % 2 = 1 GROUP BY 1), md AS (SELECT median(value) AS med FROM m WHERE sample_id % 2 = 1),
g AS (SELECT regulator, count(*) AS al, count(sil) AS pr, avg(sil) AS sf, avg(CASE WHEN sil IS NOT NULL THEN rna END) AS rm FROM r LEFT JOIN me ON me.feature = target LEFT JOIN ex ON ex.feature = target GROUP BY 1)
SELECT regulator, CASE WHEN pr = 0 THEN 'unknown' WHEN sf >= 0.5 AND rm < med THEN 'low' ELSE 'high' END AS reliability, round(sf, 6) AS silenced_fraction, CASE WHEN pr = 0 THEN al ELSE pr END AS n_regulon FROM g, md""")
def _(spark, folder):
    m = measurements(spark, folder)
    out = A.silencing_reliability(regulons(spark, folder), m.where(F.col("sample_id") % 2 == 0).withColumn("value", F.abs("value") * 6), m.where(F.col("sample_id") % 2 == 1))
    return out.withColumn("silenced_fraction", r6("silenced_fraction"))


@query("agg_14_pair_frequency", """
WITH p AS (SELECT DISTINCT least(l_partkey % 80, l_suppkey % 80) AS drug_a, greatest(l_partkey % 80, l_suppkey % 80) AS drug_b FROM lineitem WHERE l_partkey % 80 <> l_suppkey % 80),
c AS (SELECT drug, count(*) AS n_pairs FROM (SELECT drug_a AS drug FROM p UNION ALL SELECT drug_b FROM p) GROUP BY 1)
SELECT drug, n_pairs, row_number() OVER (ORDER BY n_pairs DESC, drug) AS rank, (SELECT count(*) FROM p WHERE drug_a IN (SELECT n_nationkey FROM nation) AND drug_b IN (SELECT n_nationkey FROM nation)) AS n_covered FROM c""")
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    a, b = F.col("l_partkey") % 80, F.col("l_suppkey") % 80
    p = li.where(a != b).select(F.least(a, b).alias("drug_a"), F.greatest(a, b).alias("drug_b")).distinct()
    known = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("drug"))
    return A.pair_frequency(p).withColumn("n_covered", A.covered_pairs(p, known).scalar())


@query("agg_15_censoring", f"""
WITH {S} SELECT grp, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_events, round(avg(event), 6) AS event_rate, round(avg(1 - event), 6) AS censored_rate, round(avg(time), 6) AS mean_time FROM s GROUP BY 1""")
def _(spark, folder):
    return A.censoring_summary(survival(spark, folder), "grp").withColumns({c: r6(c) for c in ("event_rate", "censored_rate", "mean_time")})


@query("agg_16_degeneracy", """
WITH c AS (SELECT o_orderstatus AS cluster, count(*) AS n FROM orders GROUP BY 1)
SELECT cluster, n, round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / sum(n) OVER (), 6) AS largest_share, max(n) OVER () / sum(n) OVER () > 0.8 AS degenerate FROM c""")
def _(spark, folder):
    out = A.degeneracy(table(spark, folder, "orders").select(F.col("o_orderstatus").alias("cluster")))
    return out.withColumns({c: r6(c) for c in ("share", "largest_share")})


_SUB = ["BRCA_LumA", "Luminal A", "LumB", "Her2-enriched", "Her2", None, ""]


@query("agg_17_concordance", f"""
WITH p AS (SELECT {pick_sql(_SUB, 'o_custkey')} AS a, {pick_sql(_SUB, 'o_orderkey')} AS b FROM orders), n AS (SELECT {', '.join(f"replace(replace(replace(replace(trim({x}), 'BRCA_', ''), 'Her2-enriched', 'Her2'), 'Luminal A', 'LumA'), 'Luminal B', 'LumB') AS {x}" for x in 'ab')} FROM p WHERE a <> '' AND b <> ''),
g AS (SELECT b, count(*) AS n, count(*) FILTER (WHERE a = b) AS k FROM n GROUP BY 1)
SELECT round(sum(k) / sum(n), 6) AS concordance, round(greatest(max(n) / sum(n), 1.0 / count(*)), 6) AS chance, CAST(sum(n) AS BIGINT) AS n, sum(k) / sum(n) >= 0.4 AS passed FROM g""")
def _(spark, folder):
    p = table(spark, folder, "orders").select(pick(_SUB, F.col("o_custkey")).alias("a"), pick(_SUB, F.col("o_orderkey")).alias("b"))
    return A.subtype_concordance(p).withColumns({c: r6(c) for c in ("concordance", "chance")})


BLEND = f"""{D}, tb AS (SELECT cluster, drug, percentile FROM (SELECT l_suppkey % 4 AS cluster, canonical AS drug, avg(l_discount) AS percentile FROM d GROUP BY 1, 2)),
pr AS (SELECT c_nationkey AS profile_id, c_custkey % 3 AS cluster, sqrt(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey)) AS probability FROM customer GROUP BY 1, 2)"""


def blend_inputs(spark, folder):
    d = drug_rows(spark, folder)
    tables = d.groupBy((F.col("l_suppkey") % 4).alias("cluster"), F.col("canonical").alias("drug")).agg(F.avg("l_discount").alias("percentile")).withColumn("drug_rank", F.lit(1))
    from pyspark.sql import Window

    c = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("profile_id"), (F.col("c_custkey") % 3).alias("cluster")).agg(F.count(F.lit(1)).alias("_n"))
    prob = c.withColumn("probability", F.sqrt(F.col("_n") / F.sum("_n").over(Window.partitionBy("profile_id")))).drop("_n")
    return prob, tables


@query("agg_18_blend", f"""
WITH {BLEND} SELECT profile_id, drug, round(sum(probability * percentile) / sum(probability), 10) AS blended_percentile, count(*) AS clusters_with_data FROM pr JOIN tb USING (cluster) GROUP BY 1, 2 HAVING sum(probability) > 0""")
def _(spark, folder):
    return A.blend_percentiles(*blend_inputs(spark, folder)).withColumn("blended_percentile", r6("blended_percentile", 10))


_ST = ["supporting", "conflicting", "neutral", "unclear", "odd", None, "neutral"]


@query("agg_19_stance_tally", f"""
WITH c AS (SELECT source, CASE WHEN s IN ('supporting','conflicting','neutral','unclear') THEN s ELSE 'unclear' END AS s FROM (SELECT source, {pick_sql(_ST, 'doc_id * 5 + n_chars')} AS s FROM documents)),
g AS (SELECT source, count(*) AS n_references, count(*) FILTER (WHERE s = 'supporting') AS supporting, count(*) FILTER (WHERE s = 'conflicting') AS conflicting, count(*) FILTER (WHERE s = 'neutral') AS neutral, count(*) FILTER (WHERE s = 'unclear') AS unclear FROM c GROUP BY 1)
SELECT *, CASE greatest(supporting, conflicting, neutral, unclear) WHEN supporting THEN 'supporting' WHEN conflicting THEN 'conflicting' WHEN neutral THEN 'neutral' ELSE 'unclear' END AS dominant_stance FROM g""")
def _(spark, folder):
    d = table(spark, folder, "documents").select("source", pick(_ST, F.col("doc_id") * 5 + F.col("n_chars")).alias("stance"))
    return A.stance_tally(d, "source")


# ---- windows --------------------------------------------------------------------------------------
@query("win_01_keep_first", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(spark, folder):
    return keep_first(table(spark, folder, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("win_02_top_k", f"""
WITH {PROF} SELECT cluster, 'up' AS arm, feature, round(effect, 6) AS effect, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect DESC, feature) AS rank FROM p WHERE effect > 0) WHERE rank <= 10
UNION ALL SELECT cluster, 'down', feature, round(effect, 6), rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY effect, feature) AS rank FROM p WHERE effect < 0) WHERE rank <= 10""")
def _(spark, folder):
    p = profiles(spark, folder)
    up = top_k(p.where(F.col("effect") > 0), ["cluster"], [F.col("effect").desc(), F.col("feature")], 10).withColumn("arm", F.lit("up"))
    down = top_k(p.where(F.col("effect") < 0), ["cluster"], [F.col("effect"), F.col("feature")], 10).withColumn("arm", F.lit("down"))
    return up.unionByName(down).select("cluster", "arm", "feature", r6("effect").alias("effect"), "rank")


@query("win_03_rank_percentile", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, round(1.0 - (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1.0) / greatest(count(*) OVER () - 1, 1), 6) AS percentile FROM orders""")
def _(spark, folder):
    return W.rank_percentile(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]).select("o_orderkey", "rank", r6("percentile").alias("percentile"))


@query("win_04_midrank_percentile", """
SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY event_type), 6) AS percentile FROM events""")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", "value")
    return W.midrank_percentile(e, "value", ["event_type"]).select("event_id", r6("percentile").alias("percentile"))


@query("win_05_empirical_percentile", """
WITH r AS (SELECT value, count(*) AS n FROM events GROUP BY 1), c AS (SELECT value, n, sum(n) OVER (ORDER BY value) AS upto, sum(n) OVER () AS al FROM r), v AS (SELECT DISTINCT round(l_quantity * 1.5, 2) AS value FROM lineitem)
SELECT v.value, round((coalesce((SELECT max(upto) FROM c WHERE c.value < v.value), 0) + 0.5 * coalesce((SELECT n FROM c WHERE c.value = v.value), 0)) / (SELECT max(al) FROM c), 6) AS percentile FROM v""")
def _(spark, folder):
    ref = table(spark, folder, "events").select("value")
    v = table(spark, folder, "lineitem").select(F.round(F.col("l_quantity") * 1.5, 2).alias("value")).distinct()
    return W.empirical_percentile(v, ref, "value").withColumn("percentile", r6("percentile"))


@query("win_06_bh_q", """
WITH t AS (SELECT event_id, event_type, value / 1000 AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS rk, count(*) OVER (PARTITION BY event_type) AS n FROM t)
SELECT event_id, round(least(1.0, min(p * n / rk) OVER (PARTITION BY event_type ORDER BY p DESC, event_id DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def _(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", (F.col("value") / 1000).alias("p"))
    return bh_q(e, ["event_type"], "p", ["event_id"]).select("event_id", r6("q").alias("q"))


@query("win_07_class_ranks", """
SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS nomination_rank, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS support_rank FROM supplier""")
def _(spark, folder):
    s = table(spark, folder, "supplier")
    return W.class_ranks(s, "s_nationkey", [-F.col("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "nomination_rank", "support_rank")


@query("win_08_quantile_bins", f"""
WITH q AS (SELECT list_distinct([{', '.join(f'quantile_cont(o_totalprice, {i / 10})' for i in range(1, 10))}]) AS e FROM orders)
SELECT bin, count(*) AS n, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high FROM (SELECT o_totalprice, len(list_filter(e, lambda x: o_totalprice > x)) AS bin FROM orders, q) GROUP BY 1""")
def _(spark, folder):
    b = W.quantile_bins(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.min("o_totalprice"), 2).alias("low"), r6(F.max("o_totalprice"), 2).alias("high"))


@query("win_09_lead_margin", """
WITH s AS (SELECT user_id, event_type, round(sum(value), 4) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS rn FROM s)
SELECT user_id, max(event_type) FILTER (WHERE rn = 1) AS best, max(score) FILTER (WHERE rn = 1) AS best_score, round(max(score) FILTER (WHERE rn = 1) - max(score) FILTER (WHERE rn = 2), 4) AS margin FROM r GROUP BY 1""")
def _(spark, folder):
    s = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("score"))
    return W.lead_margin(s, ["user_id"], "score", "event_type").withColumn("margin", r6("margin", 4))


@query("win_10_rebound", """
WITH s AS (SELECT user_id AS entity, arg_min(value, event_id) AS start, arg_max(value, event_id) AS "end", min(value) AS trough FROM events GROUP BY 1)
SELECT *, trough > 0 AND "end" > 1.5 * trough AND "end" > 1.2 * start AS rebound FROM s""")
def _(spark, folder):
    return W.rebound(table(spark, folder, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("t"), "value"))


_ASSESS = ["potentially_eligible", "insufficient_information", "potentially_ineligible", "other"]
_STATUS = ["RECRUITING", "Not yet open", "Completed"]
_TIER = ["tier_a_x", "tier_b_y", "tier_c_z", None]


@query("win_11_rank_matches", f"""
WITH t AS (SELECT c_custkey AS study_id, {pick_sql(_ASSESS, 'c_custkey')} AS a, c_custkey % 5 AS n_known, {pick_sql(_STATUS, 'c_nationkey')} AS st, {pick_sql(_TIER, 'c_custkey // 7')} AS tier, c_nationkey % 3 AS site_tier, CASE WHEN c_nationkey % 6 = 0 THEN 0.0 ELSE c_acctbal END AS km FROM customer)
SELECT study_id, row_number() OVER (ORDER BY CASE a WHEN 'potentially_eligible' THEN 0 WHEN 'insufficient_information' THEN 1 WHEN 'potentially_ineligible' THEN 2 ELSE 3 END, -n_known, CASE WHEN lower(st) LIKE '%recruit%' THEN 0 WHEN lower(st) LIKE '%not yet%' THEN 1 ELSE 2 END,
 CASE WHEN tier LIKE 'tier_a%' THEN -2 WHEN tier LIKE 'tier_b%' THEN -1 ELSE 0 END, site_tier, CASE WHEN km = 0 THEN 1e9 ELSE km END, study_id) AS position FROM t""")
def _(spark, folder):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    t = table(spark, folder, "customer").select(k.alias("study_id"), pick(_ASSESS, k).alias("assessment"), (k % 5).alias("n_known"), pick(_STATUS, n).alias("status"),
                                                pick(_TIER, F.floor(k / 7)).alias("evidence_tier"), (n % 3).alias("site_tier"), F.when(n % 6 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("distance_km"))
    return W.rank_matches(t).select("study_id", "position")


@query("win_12_latest", """
WITH l AS (SELECT user_id % 20 AS notebook, CASE WHEN event_type = 'error' AND user_id % 20 < 8 THEN 'view' ELSE event_type END AS gate, event_id AS ts, value FROM events), k AS (SELECT notebook, gate, max(ts) AS ts, arg_max(value, ts) AS value FROM l GROUP BY 1, 2)
SELECT notebook, gate, ts, value FROM k UNION ALL SELECT notebook, 'error', ts, value FROM k WHERE gate = 'view' AND notebook NOT IN (SELECT notebook FROM k WHERE gate = 'error')""")
def _(spark, folder):
    e = table(spark, folder, "events")
    gate = F.when((F.col("event_type") == "error") & (F.col("user_id") % 20 < 8), "view").otherwise(F.col("event_type"))
    l = e.select((F.col("user_id") % 20).alias("notebook"), gate.alias("gate"), F.col("event_id").alias("ts"), "value")
    return W.latest_records(l, ["notebook", "gate"], "ts", ["value"], {"view": "error"}, "gate")


# ---- sets -----------------------------------------------------------------------------------------
@query("set_01_first_source", """
WITH a AS (SELECT p_partkey % 300 AS nsc, lower(p_name) AS drug, 0 AS p FROM part WHERE p_size > 30 UNION ALL SELECT p_partkey % 400, lower(p_brand), 1 FROM part WHERE p_size <= 30)
SELECT nsc, CASE WHEN p = 1 THEN regexp_replace(drug, '[^a-z0-9]+', ' ', 'g') ELSE drug END AS drug FROM (SELECT *, row_number() OVER (PARTITION BY nsc ORDER BY p, CASE WHEN p = 1 THEN regexp_replace(drug, '[^a-z0-9]+', ' ', 'g') ELSE drug END) AS rn FROM a) WHERE rn = 1""")
def _(spark, folder):
    p = table(spark, folder, "part")
    a = p.where(F.col("p_size") > 30).select((F.col("p_partkey") % 300).alias("nsc"), F.upper("p_name").alias("drug"))
    b = p.where(F.col("p_size") <= 30).select((F.col("p_partkey") % 400).cast("string").alias("nsc"), F.col("p_brand").alias("drug"))
    return T.first_source_wins([a, b])


@query("set_02_source_only", f"""
WITH {E}, x AS (SELECT * FROM e WHERE source < target), s AS (SELECT source AS node FROM x EXCEPT SELECT target FROM x),
c AS (SELECT source, target, sign, n_references FROM e UNION ALL SELECT -1, node, 1, 1 FROM (SELECT n_nationkey AS node FROM nation) WHERE node IN (SELECT source FROM e UNION SELECT target FROM e) AND NOT EXISTS (SELECT source FROM e EXCEPT SELECT target FROM e))
SELECT 'source_only' AS kind, CAST(node AS VARCHAR) AS a, NULL AS b, 0 AS sign FROM s UNION ALL SELECT 'with_input', CASE WHEN source = -1 THEN 'INPUT' ELSE CAST(source AS VARCHAR) END, CAST(target AS VARCHAR), sign FROM c""")
def _(spark, folder):
    g = graph(spark, folder)
    only = T.source_only(g.where(F.col("source") < F.col("target"))).select(F.lit("source_only").alias("kind"), F.col("node").cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).alias("sign"))
    txt = g.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "sign", "n_references")
    full = T.ensure_source(txt, table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("node")))
    return only.unionByName(full.select(F.lit("with_input").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "sign"))


@query("set_03_missing_keys", """
SELECT DISTINCT c_nationkey AS dataset FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def _(spark, folder):
    req = table(spark, folder, "customer").select(F.col("c_nationkey").alias("dataset"))
    man = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("dataset"), (F.col("s_acctbal") > 5000).alias("verified"))
    return T.missing_keys(req, man)


@query("set_04_signed_edges", """
WITH raw AS (SELECT CAST(l_partkey % 90 AS VARCHAR) AS source, CASE WHEN l_suppkey % 90 = 7 THEN '' ELSE CAST(l_suppkey % 90 AS VARCHAR) END AS target, l_returnflag <> 'R' AS st, l_linestatus = 'F' AS inh, l_discount < 0.08 AS cons, l_linenumber AS n FROM lineitem),
k AS (SELECT source, target, CASE WHEN st THEN 1 ELSE -1 END AS sign, max(n) AS n FROM raw WHERE cons AND st <> inh AND source <> target AND source <> '' AND target <> '' GROUP BY 1, 2, 3), lit AS (SELECT CAST(n_nationkey AS VARCHAR) AS source, CAST(n_regionkey + 40 AS VARCHAR) AS target, 1 AS sign FROM nation)
SELECT source, target, sign, CAST(10 AS BIGINT) AS n_references FROM lit UNION ALL SELECT source, target, sign, n FROM k WHERE NOT EXISTS (SELECT 1 FROM lit WHERE lit.source = k.source AND lit.target = k.target AND lit.sign = k.sign)""")
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    raw = li.select((F.col("l_partkey") % 90).cast("string").alias("source"), F.when(F.col("l_suppkey") % 90 == 7, "").otherwise((F.col("l_suppkey") % 90).cast("string")).alias("target"),
                    (F.col("l_returnflag") != "R").alias("is_stimulation"), (F.col("l_linestatus") == "F").alias("is_inhibition"), (F.col("l_discount") < 0.08).alias("consensus_direction"), F.col("l_linenumber").alias("n_references"))
    lit = table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("source"), (F.col("n_regionkey") + 40).cast("string").alias("target"), F.lit(1).alias("sign"))
    return T.signed_edges(raw, lit)


@query("set_05_panel_sets", """
WITH p AS (SELECT DISTINCT l_partkey * 2 AS feature FROM lineitem), u AS (SELECT p_partkey AS feature FROM part)
SELECT feature, 'panel' AS kind FROM p WHERE feature IN (SELECT feature FROM u) UNION ALL SELECT feature, 'pool' FROM u WHERE feature NOT IN (SELECT feature FROM p)""")
def _(spark, folder):
    p = table(spark, folder, "lineitem").select((F.col("l_partkey") * 2).alias("feature"))
    return T.panel_sets(p, table(spark, folder, "part").select(F.col("p_partkey").alias("feature")))
