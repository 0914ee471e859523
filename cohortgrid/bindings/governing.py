"""Governance operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortgrid.bindings.joining import REG, registry
from cohortgrid.bindings.registry import query
from cohortgrid.bindings.summaries import PROF, profiles
from cohortgrid.bindings.tables import LISTS, drug_lists, pick, pick_sql, r6, table
from cohortgrid.operators import governance as G
from cohortgrid.operators import joins as J
from cohortgrid.operators import windows as W


@query("gov_01_gates", """
WITH i AS (SELECT event_type || '-' || (user_id % 6) AS gate, CASE WHEN event_type = 'error' AND user_id % 6 = 1 AND event_id % 50 = 0 THEN 'SYN-' || user_id ELSE 'S' || user_id END AS sid FROM events WHERE user_id % 6 <> 5),
m AS (SELECT event_type || '-' || (user_id % 6) AS gate, round(avg(value), 6) AS value, 51.0::DOUBLE AS threshold, CASE WHEN user_id % 6 < 3 THEN 'gte' ELSE 'lte' END AS direction, count(*) AS n, CASE WHEN user_id % 6 = 2 THEN 400 END AS min_n, user_id % 6 = 3 AS smoke FROM events GROUP BY event_type, user_id % 6),
s AS (SELECT gate, count(*) FILTER (WHERE sid LIKE 'SYN-%') AS n_synthetic, count(*) AS n_checked FROM i GROUP BY 1),
j AS (SELECT m.*, coalesce(n_synthetic, 0) AS n_synthetic, coalesce(n_checked, 0) AS n_checked, CASE direction WHEN 'gte' THEN value >= threshold ELSE value <= threshold END AND coalesce(n_checked, 0) > 0 AS ok FROM m LEFT JOIN s USING (gate)),
t AS (SELECT gate, value, n_synthetic, n_checked, CASE WHEN n_synthetic > 0 THEN 'synthetic' WHEN min_n IS NOT NULL AND n < min_n THEN 'insufficient_data' WHEN ok AND smoke THEN 'provisional_pass' WHEN ok THEN 'pass' ELSE 'fail' END AS status FROM j)
SELECT gate, value, n_synthetic, n_checked, status, status IN ('pass', 'provisional_pass') AS passed FROM t""")
def _(spark, folder):
    e = table(spark, folder, "events")
    u = F.col("user_id") % 6
    gate = F.concat(F.col("event_type"), F.lit("-"), u.cast("string"))
    ids = e.where(u != 5).select(gate.alias("gate"), F.when((F.col("event_type") == "error") & (u == 1) & (F.col("event_id") % 50 == 0), F.concat(F.lit("SYN-"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("S"), F.col("user_id").cast("string"))).alias("sample_id"))
    m = e.groupBy(gate.alias("gate"), u.alias("u")).agg(F.round(F.avg("value"), 6).alias("value"), F.count(F.lit(1)).alias("n"))
    m = m.select("gate", "value", F.lit(51.0).alias("threshold"), F.when(F.col("u") < 3, "gte").otherwise("lte").alias("direction"), "n", F.when(F.col("u") == 2, 400).alias("min_n"), (F.col("u") == 3).alias("smoke_test"), F.lit(False).alias("insufficient"), F.lit(True).alias("cohort_gate"))
    return G.evaluate_gates(m, ids).select("gate", "value", "n_synthetic", "n_checked", "status", "passed")


CFG = """c AS (SELECT method || ':' || coalesce(cov, 'na') || ':k=' || k AS id, method, cov, k, bool_or(p_size > 25) AS exploratory, ep, bool_or(p_retailprice > 1200) AS has_p FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'kmeans' ELSE 'gmm' END AS method, CASE WHEN p_partkey % 3 = 1 THEN 'full' WHEN p_partkey % 3 = 2 THEN 'diag' END AS cov, p_size % 7 + 2 AS k, CASE WHEN p_partkey % 2 = 0 THEN 'os' ELSE 'pfi' END AS ep, p_size, p_retailprice FROM part) GROUP BY 1, 2, 3, 4, 6)"""


@query("gov_02_audit_configurations", f"""
WITH {CFG}, r AS (SELECT *, NOT (method = 'gmm' AND coalesce(cov = 'full', false) AND k = 4) AS rule FROM c)
SELECT DISTINCT 'exploratory_mismatch:' || id AS error FROM r WHERE exploratory <> rule UNION SELECT 'p_value_on_exploratory:' || id || ':' || ep FROM r WHERE exploratory AND has_p UNION SELECT 'missing_preregistered_p:' || id || ':' || ep FROM r WHERE NOT exploratory AND NOT has_p""")
def _(spark, folder):
    p = table(spark, folder, "part")
    three = F.col("p_partkey") % 3
    method = F.when(three == 0, "kmeans").otherwise("gmm")
    cov = F.when(three == 1, "full").when(three == 2, "diag")
    k = F.col("p_size") % 7 + 2
    c = p.groupBy(F.concat_ws(":", method, F.coalesce(cov, F.lit("na")), F.concat(F.lit("k="), k.cast("string"))).alias("config_id"), method.alias("method"), cov.alias("covariance_type"), k.alias("k"), F.when(F.col("p_partkey") % 2 == 0, "os").otherwise("pfi").alias("endpoint")).agg(
        F.bool_or(F.col("p_size") > 25).alias("exploratory"), F.bool_or(F.col("p_retailprice") > 1200).alias("has_p"))
    reg = table(spark, folder, "region").agg((F.max("r_regionkey")).alias("k"))
    return G.audit_configurations(c, reg)


@query("gov_03_audit_samples", """
WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE 'S' || o_orderkey END AS sid, o_orderkey % 3 + 1 AS state, o_custkey % 2 = 0 AS ab, o_custkey % 5 = 0 AS rev, o_custkey % 7 = 0 AS prog, o_custkey % 11 = 0 AS near, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE 'pca' END AS enc, o_custkey % 4 > 0 AS ok FROM orders)
SELECT id, coalesce(array_to_string(list_filter([CASE WHEN sid = '' THEN 'patient_id' END, CASE WHEN state = 3 AND NOT ab THEN 'state3_without_abstention' END, CASE WHEN state = 3 AND rev THEN 'state3_has_reversal' END, CASE WHEN state = 3 AND prog THEN 'state3_has_prognostic' END, CASE WHEN state = 3 AND near THEN 'state3_has_nearest_lines' END,
 CASE WHEN enc IS DISTINCT FROM 'pca' THEN 'encoder_mismatch' END, CASE WHEN NOT ok AND rev THEN 'reversal_present_after_a4_fail' END], lambda x: x IS NOT NULL), ';'), '') AS errors FROM s""")
def _(spark, folder):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    s = table(spark, folder, "orders").select(
        o.alias("id"), F.when(o % 101 == 0, "").otherwise(F.concat(F.lit("S"), o.cast("string"))).alias("sample_id"), (o % 3 + 1).alias("state"), (c % 2 == 0).alias("abstained"), (c % 5 == 0).alias("has_reversal"), (c % 7 == 0).alias("has_prognostic"),
        (c % 11 == 0).alias("has_neighbours"), F.when(c % 13 != 0, "pca").alias("encoder"), F.lit("pca").alias("cohort_encoder"), (c % 4 > 0).alias("reversal_gate_passed"))
    return G.audit_samples(s, keep=["id"]).select("id", F.array_join("errors", ";").alias("errors"))


NOM = f"""{LISTS}, n0 AS (SELECT canonical, a.percentile AS p1, b.percentile AS p2, a.rank AS r1, b.rank AS r2, a.source AS s1, b.source AS s2, b.n_cell_lines AS nc, b.consistency AS co, list_distinct(list_concat(a.targets, b.targets)) AS tg FROM l1 a JOIN l2 b USING (canonical)),
n1 AS (SELECT *, least(p1, p2) < 0.55 AS weak, nc <= 1 AS single, co < 0.4 AS low, len(tg) = 0 AS missing FROM n0),
n2 AS (SELECT *, CAST(weak AS INTEGER) + CAST(single AS INTEGER) + CAST(low AS INTEGER) AS votes FROM n1), n3 AS (SELECT *, votes >= 2 OR (weak AND (single OR low)) AS artifact FROM n2),
n4 AS (SELECT *, CASE WHEN artifact THEN 'excluded_low_confidence' WHEN s1 = 'compact_gctx' AND s2 = 'compact_gctx' AND nc >= 2 AND co >= 0.5 THEN 'breast_cell_line_supported' ELSE 'suggestive' END AS support_class FROM n3)"""


def nominated(spark, folder):
    return G.nominate(*drug_lists(spark, folder))


@query("gov_04_robustness", f"""
WITH {NOM} SELECT canonical, weak AS weak_dual_support, single AS single_cell_line, low AS low_consistency, CAST(votes AS INTEGER) AS artifact_votes, artifact AS likely_artifact,
 coalesce(array_to_string(list_filter([CASE WHEN weak THEN 'weak_dual_support' END, CASE WHEN single THEN 'single_cell_line' END, CASE WHEN low THEN 'low_consistency' END, CASE WHEN missing THEN 'missing_target_support' END, CASE WHEN artifact THEN 'likely_artifact' END], lambda x: x IS NOT NULL), ';'), '') AS notes FROM n4""")
def _(spark, folder):
    return nominated(spark, folder).select("canonical", "weak_dual_support", "single_cell_line", "low_consistency", "artifact_votes", "likely_artifact", F.array_join("notes", ";").alias("notes"))


_CTX = ["old gear", "small ring", "blue anvil"]
_OTHER = ["red widget", "large gear"]


@query("gov_05_tiers", f"""
SELECT p_partkey, CASE WHEN lower(p_name) IN ('old gear', 'small ring', 'blue anvil') THEN 'breast_context' WHEN lower(p_name) IN ('red widget', 'large gear') THEN 'repurposing_hypothesis' ELSE 'unclassified_or_investigational' END AS bucket,
 CASE WHEN p_size > 40 THEN 'tier_d_artifact_or_insufficient' WHEN p_partkey % 11 = 0 THEN 'tier_a_potential_trial_match' WHEN lower(p_name) IN ('old gear', 'small ring', 'blue anvil') THEN 'tier_b_breast_preclinical_or_investigational' ELSE 'tier_c_novel_repurposing_hypothesis' END AS tier FROM part""")
def _(spark, folder):
    p = table(spark, folder, "part")
    b = G.indication(F.lower("p_name"), _CTX, _OTHER)
    return p.select("p_partkey", b.alias("bucket"), G.evidence_tier(F.col("p_size") > 40, b, F.col("p_partkey") % 11 == 0).alias("tier"))


@query("gov_06_nominations", f"""
WITH {NOM} SELECT canonical, round(least(p1, p2), 6) AS weaker_percentile, round(greatest(p1, p2), 6) AS stronger_percentile, round(sqrt(p1 * p2), 6) AS rank_product, array_to_string(list_sort(tg), ';') AS targets, support_class, CASE WHEN artifact THEN 'tier_d_artifact_or_insufficient' ELSE 'tier_c_novel_repurposing_hypothesis' END AS evidence_tier,
 row_number() OVER (ORDER BY round(least(p1, p2), 12) DESC, round(sqrt(p1 * p2), 12) DESC, canonical) AS nomination_rank, row_number() OVER (PARTITION BY support_class ORDER BY round(least(p1, p2), 12) DESC, round(sqrt(p1 * p2), 12) DESC, canonical) AS support_rank FROM n4""")
def _(spark, folder):
    return nominated(spark, folder).select("canonical", r6("weaker_percentile").alias("weaker_percentile"), r6("stronger_percentile").alias("stronger_percentile"), r6("rank_product").alias("rank_product"), F.array_join("targets", ";").alias("targets"),
                                           "support_class", "evidence_tier", "nomination_rank", "support_rank")


_ACT = ["default_visible", "exploratory_only", "technical_excluded"]
_HD = ["approved_breast", "tool_compound", "withdrawn", "odd"]


def lanes(spark, folder):
    r = registry(spark, folder)
    at = F.length("canonical")
    r = r.select("canonical", "synonyms", "lincs_pert_ids", "inchi_keys", pick(_HD, at).alias("human_development_status"), F.lit("approved_drug").alias("entity_type"), pick(_ACT, at).alias("display_action"), F.lit("reviewed").alias("display_gate_reason"))
    o = nominated(spark, folder).select(
        F.when(F.col("nomination_rank") % 17 == 0, F.concat(F.lit("brd "), F.col("canonical"))).otherwise(F.col("canonical")).alias("canonical"), F.lit(None).cast("string").alias("pert_id"), F.lit(None).cast("string").alias("inchi_key"), "likely_artifact", "nomination_rank")
    return G.display_lanes(o, r)


LANES = f"""{NOM}, {REG}, o AS (SELECT canonical AS base, artifact, row_number() OVER (ORDER BY round(least(p1, p2), 12) DESC, round(sqrt(p1 * p2), 12) DESC, canonical) AS nomination_rank FROM n4), o2 AS (SELECT *, CASE WHEN nomination_rank % 17 = 0 THEN 'brd ' || base ELSE base END AS canonical FROM o),
h AS (SELECT o2.*, nomination_rank % 17 = 0 AS anon, kn.c AS rc FROM o2 LEFT JOIN kn ON kn.key = o2.canonical),
la AS (SELECT canonical, nomination_rank, CASE WHEN anon THEN 'non_drug_perturbagen' WHEN rc IS NULL THEN 'unresolved' ELSE {pick_sql(_HD, 'length(rc)')} END AS human_development_status, CASE WHEN artifact OR anon OR rc IS NULL THEN 'technical_excluded' ELSE {pick_sql(_ACT, 'length(rc)')} END AS display_action,
 CASE WHEN artifact THEN 'likely_artifact_flag' WHEN anon THEN 'anonymous_lincs_identifier' WHEN rc IS NULL THEN 'unresolved_not_in_registry' ELSE 'reviewed' END AS display_gate_reason FROM h)"""


@query("gov_07_lanes", f"""
WITH {LANES} SELECT *, CASE display_action WHEN 'default_visible' THEN 'visible' WHEN 'exploratory_only' THEN 'exploratory' ELSE 'technical_excluded' END AS lane FROM la""")
def _(spark, folder):
    return lanes(spark, folder).select("canonical", "nomination_rank", "human_development_status", "display_action", "display_gate_reason", "lane")


@query("gov_07_lane_summary", f"""
WITH {LANES} SELECT count(*) AS n_input, count(*) FILTER (WHERE display_action = 'default_visible') AS n_default_visible, count(*) FILTER (WHERE display_action = 'exploratory_only') AS n_exploratory_only, count(*) FILTER (WHERE display_action = 'technical_excluded') AS n_technical_excluded FROM la""")
def _(spark, folder):
    return G.lane_summary(lanes(spark, folder))


@query("gov_08_registry", """
WITH seed AS (SELECT lower(p_name) AS c, min(p_type) AS et, 'investigational' AS st, 'exploratory_only' AS ac FROM part WHERE p_size > 20 GROUP BY 1), ex AS (SELECT lower(p_name) AS c, max(p_size / 10.0::DOUBLE) AS mp, bool_or(p_retailprice > 2850) AS w, array_to_string(list_sort(list(DISTINCT 'CH' || (p_partkey % 7))), ';') AS ch FROM part WHERE p_size <= 25 GROUP BY 1), off AS (SELECT DISTINCT lower(p_name) AS c FROM part WHERE p_retailprice < 902),
ap AS (SELECT c, et, rv FROM (SELECT lower(p_name) AS c, p_type AS et, 'r' || p_partkey AS rv, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey DESC) AS rn FROM part WHERE p_size = 7) WHERE rn = 1 UNION ALL SELECT 'brand new', 'approved_drug', 'rx'),
ids AS (SELECT lower(p_name) AS c, array_to_string(list_sort(list(DISTINCT 'P' || (p_partkey % 50)) FILTER (WHERE p_partkey % 9 > 0)), ';') AS pt, array_to_string(list_sort(list(DISTINCT CASE WHEN p_partkey % 5 = 0 THEN 'nan' ELSE 'K' || (p_partkey % 60) END) FILTER (WHERE p_partkey % 5 > 0)), ';') AS ik FROM part GROUP BY 1),
b AS (SELECT seed.c, CASE WHEN coalesce(w, false) THEN 'withdrawn' ELSE seed.et END AS et, CASE WHEN coalesce(w, false) THEN 'withdrawn' ELSE st END AS st, CASE WHEN coalesce(w, false) THEN 'technical_excluded' ELSE ac END AS ac, coalesce(w, false) OR off.c IS NOT NULL AS wd, mp, ch FROM seed LEFT JOIN ex ON ex.c = seed.c LEFT JOIN off ON off.c = seed.c)
SELECT coalesce(b.c, ap.c) AS canonical, coalesce(ap.et, b.et) AS entity_type, CASE WHEN ap.c IS NOT NULL THEN 'approved_oncology' ELSE b.st END AS human_development_status, CASE WHEN ap.c IS NOT NULL THEN 'default_visible' ELSE b.ac END AS display_action, coalesce(wd, false) AS withdrawn_or_discontinued, mp AS max_clinical_phase, coalesce(ch, '') AS chembl_ids, coalesce(pt, '') AS lincs_pert_ids, coalesce(ik, '') AS inchi_keys, rv AS reviewed_by
FROM b FULL JOIN ap ON ap.c = b.c LEFT JOIN ids ON ids.c = coalesce(b.c, ap.c)""")
def _(spark, folder):
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    seed = p.where(F.col("p_size") > 20).groupBy(F.lower("p_name").alias("canonical")).agg(F.min("p_type").alias("entity_type")).select("canonical", "entity_type", F.lit("investigational").alias("human_development_status"), F.lit("exploratory_only").alias("display_action"))
    ext = p.where(F.col("p_size") <= 25).select(F.upper("p_name").alias("name"), (F.col("p_size") / 10.0).alias("max_phase"), (F.col("p_retailprice") > 2850).alias("withdrawn"), F.concat(F.lit("CH"), (k % 7).cast("string")).alias("chembl_id"))
    off = p.where(F.col("p_retailprice") < 902).select(F.col("p_name").alias("name"))
    ap = p.where(F.col("p_size") == 7).select(F.col("p_name").alias("canonical"), F.col("p_type").alias("entity_type"), F.lit("approved_oncology").alias("human_development_status"), F.lit("default_visible").alias("display_action"), F.concat(F.lit("r"), k.cast("string")).alias("reviewer"), k.alias("reviewed_at"))
    new = p.where(k == 0).select(F.lit("Brand New").alias("canonical"), F.lit("approved_drug").alias("entity_type"), F.lit("approved_oncology").alias("human_development_status"), F.lit("default_visible").alias("display_action"), F.lit("rx").alias("reviewer"), k.alias("reviewed_at"))
    ids = p.select(F.col("p_name").alias("name"), F.when(k % 9 > 0, F.concat(F.lit("P"), (k % 50).cast("string"))).otherwise("").alias("pert_id"), F.when(k % 5 == 0, "nan").otherwise(F.concat(F.lit("K"), (k % 60).cast("string"))).alias("inchi_key"))
    out = G.build_registry(seed, ext, off, ap.unionByName(new), ids)
    return out.withColumns({c: F.array_join(c, ";") for c in ("chembl_ids", "lincs_pert_ids", "inchi_keys")})


@query("gov_09_unresolved", """
WITH t AS (SELECT lower(CASE WHEN p_partkey % 50 = 7 THEN 'BRD ' || p_name ELSE p_name || ' ' || (p_partkey % 9) END) AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), n AS (SELECT c AS canonical, count(*) AS frequency FROM t WHERE r <= 40 GROUP BY 1), kn AS (SELECT DISTINCT lower(p_name || ' ' || (p_partkey % 9)) AS c FROM part WHERE p_size > 30), rg AS (SELECT DISTINCT lower(p_name || ' ' || (p_partkey % 9)) AS c FROM part WHERE p_size < 3)
SELECT canonical, frequency, canonical IN (SELECT c FROM rg) AS in_regimen, canonical LIKE 'brd %' AS anonymous, CASE WHEN canonical LIKE 'brd %' THEN 'non_therapeutic_perturbagen' ELSE 'unresolved' END AS proposed_entity_type, row_number() OVER (ORDER BY CASE WHEN canonical IN (SELECT c FROM rg) THEN 0 ELSE 1 END, frequency DESC, canonical) AS priority_rank
FROM n WHERE canonical NOT IN (SELECT c FROM kn) OR canonical LIKE 'brd %'""")
def _(spark, folder):
    p = table(spark, folder, "part")
    k = F.col("p_partkey")
    plain = F.concat(F.col("p_name"), F.lit(" "), (k % 9).cast("string"))
    t = W.class_ranks(p, "p_brand", [-F.col("p_retailprice"), k], "_g", "drug_rank").select(F.when(k % 50 == 7, F.concat(F.lit("BRD-"), F.col("p_name"))).otherwise(plain).alias("drug"), "drug_rank")
    reg = p.where(F.col("p_size") > 30).select(F.lower(plain).alias("canonical")).distinct().withColumn("synonyms", F.array().cast("array<string>"))
    return G.unresolved_queue(t, reg, p.where(F.col("p_size") < 3).select(plain.alias("drug")), 40)


@query("gov_10_strongest_tier", """
WITH e AS (SELECT 'g' || lpad(CAST(l_partkey % 70 AS VARCHAR), 2, '0') AS symbol, CASE WHEN l_returnflag = 'A' AND l_quantity > 49 AND l_discount > 0.08 THEN 'established' WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 'investigational' ELSE 'not_established' END AS tier, l_linestatus AS source, l_orderkey * 100 + l_linenumber AS position, l_extendedprice FROM lineitem), s AS (SELECT symbol, tier, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE tier WHEN 'established' THEN 2 WHEN 'investigational' THEN 1 ELSE 0 END DESC, position, l_extendedprice) AS rn FROM e) WHERE rn = 1),
f AS (SELECT DISTINCT 'g' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature FROM (SELECT generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))
SELECT feature, coalesce(tier, 'not_established') AS evidence_tier, source AS evidence_source FROM f LEFT JOIN s ON s.symbol = f.feature""")
def _(spark, folder):
    from cohortgrid.bindings.testing import features

    li = table(spark, folder, "lineitem")
    top = F.col("l_quantity") > 49
    tier = F.when((F.col("l_returnflag") == "A") & top & (F.col("l_discount") > 0.08), "established").when((F.col("l_returnflag") == "R") & top, "investigational").otherwise("not_established")
    e = li.select(F.concat(F.lit("g"), F.lpad((F.col("l_partkey") % 70).cast("string"), 2, "0")).alias("symbol"), tier.alias("tier"), F.col("l_linestatus").alias("source"), F.lit("gene").alias("kind"),
                  F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("a"), F.col("l_extendedprice").alias("b")).alias("position"))
    return G.tier_features(features(spark, folder), G.strongest_tier(e))


@query("gov_10_compound_tiers", """
WITH ph AS (SELECT c, phase FROM (SELECT lower(p_name) AS c, p_type AS phase, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM part WHERE p_size > 35) WHERE rn = 1), soc AS (SELECT DISTINCT lower(p_name) AS c FROM part WHERE p_retailprice < 905)
SELECT p_partkey, lower(p_name) AS canonical, CASE WHEN lower(p_name) IN (SELECT c FROM soc) THEN 'standard_of_care' WHEN phase = 'ECONOMY' THEN 'repurposing' WHEN phase = 'PROMO' THEN 'investigational' ELSE 'unresolved' END AS evidence_tier, CASE WHEN lower(p_name) IN (SELECT c FROM soc) THEN 'curated_list' WHEN phase IN ('ECONOMY', 'PROMO') THEN 'development_phase' ELSE 'no_status_found' END AS evidence_reason FROM part LEFT JOIN ph ON ph.c = lower(p_name)""")
def _(spark, folder):
    p = table(spark, folder, "part")
    cur = p.where(F.col("p_retailprice") < 905).select(F.col("p_name").alias("drug"))
    ph = p.where(F.col("p_size") > 35).select(F.col("p_name").alias("name"), F.col("p_type").alias("phase"), F.col("p_partkey").alias("position"))
    return G.tier_compounds(p.select("p_partkey", F.col("p_name").alias("drug")), cur, ph, {"economy": "repurposing", "promo": "investigational"}).select("p_partkey", "canonical", "evidence_tier", "evidence_reason")


@query("gov_11_known_answers", f"""
WITH {LISTS}, r AS (SELECT l_suppkey % 5 AS cluster, lower(canonical) AS canonical FROM d), ro AS (SELECT unnest([0,1,2,3,4]) AS cluster, unnest(['er_high','her2_amplified','er_high','other','basal']) AS role), wl AS (SELECT 'er_high' AS role, unnest(['old gear 1', 'small ring 5', 'blue anvil 7', 'nothing']) AS c UNION ALL SELECT 'her2_amplified', unnest(['absent one', 'red widget 99']))
SELECT cluster, role, coalesce((SELECT array_to_string(list_sort(list(DISTINCT c)), ';') FROM wl WHERE wl.role = ro.role AND c IN (SELECT canonical FROM r WHERE r.cluster = ro.cluster)), '') AS hits, role NOT IN (SELECT role FROM wl) OR EXISTS (SELECT 1 FROM wl WHERE wl.role = ro.role AND c IN (SELECT canonical FROM r WHERE r.cluster = ro.cluster)) AS passed FROM ro""")
def _(spark, folder):
    from cohortgrid.bindings.tables import drug_rows

    d = drug_rows(spark, folder)
    roles = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("cluster"), pick(["er_high", "her2_amplified", "er_high", "other", "basal"], F.col("r_regionkey")).alias("role"))
    lists = {"er_high": ["old gear 1", "small ring 5", "blue anvil 7", "nothing"], "her2_amplified": ["absent one", "red widget 99"]}
    out = G.known_answers(d.select((F.col("l_suppkey") % 5).alias("cluster"), "canonical"), roles, lists)
    return out.withColumn("hits", F.array_join("hits", ";"))


@query("gov_12_approve", """
SELECT p_partkey, lower(p_name) AS canonical, CASE WHEN p_partkey % 4 = 0 THEN 'reviewer_required' WHEN p_partkey % 3 = 0 THEN 'citation_required' END AS error, p_partkey % 4 > 0 AND p_partkey % 3 > 0 AS accepted FROM part""")
def _(spark, folder):
    k = F.col("p_partkey")
    d = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("canonical"), F.when(k % 8 == 0, "  ").when(k % 4 != 0, "ann").alias("reviewer"), F.when(k % 3 != 0, F.array(F.lit("c1"))).otherwise(F.array().cast("array<string>")).alias("citations"))
    return G.approve(d).select("p_partkey", "canonical", "error", "accepted")


@query("gov_13_glossary", """
WITH l AS (SELECT user_id % 10 AS notebook, event_type AS gate, max(event_id) AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2), p AS (SELECT DISTINCT user_id % 12 AS notebook, event_type AS gate FROM events WHERE user_id % 12 > 2)
SELECT 'panel ' || p.notebook || ' ' || p.gate AS panel, p.gate AS metric, value, ts AS n, 50.0::DOUBLE AS threshold, CASE WHEN ts % 2 = 0 THEN 'provisional' WHEN value > 50 THEN 'pass' ELSE 'fail' END AS status, ts % 3 = 0 AS revised, CASE WHEN ts % 3 = 0 THEN 'Threshold Revised' END AS revision_note FROM p JOIN l ON l.notebook = p.notebook AND l.gate = p.gate
UNION ALL SELECT r_name, NULL, NULL, NULL, NULL, 'unvalidated', false, NULL FROM region""")
def _(spark, folder):
    e = table(spark, folder, "events")
    l = e.select((F.col("user_id") % 10).alias("notebook"), F.col("event_type").alias("gate"), F.col("event_id").alias("ts"), "value")
    latest = W.latest_records(l, ["notebook", "gate"], "ts", ["value"])
    latest = latest.select("notebook", "gate", "value", F.col("ts").alias("n"), F.lit(50.0).alias("threshold"), F.when(F.col("ts") % 2 == 0, "provisional").alias("status"), (F.col("value") > 50).alias("passed"), F.when(F.col("ts") % 3 == 0, "Threshold Revised").otherwise("first run").alias("note"))
    panels = e.where(F.col("user_id") % 12 > 2).select((F.col("user_id") % 12).alias("notebook"), F.col("event_type").alias("gate")).distinct().withColumn("panel", F.concat(F.lit("panel "), F.col("notebook").cast("string"), F.lit(" "), F.col("gate")))
    return G.glossary(latest, panels, table(spark, folder, "region").select(F.col("r_name").alias("panel")))


_ROLES = ["full_modality", "missing_view", "abstain", "other"]


@query("gov_14_states", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 60 AS f, {pick_sql(_ROLES, 'l_linenumber')} AS role FROM lineitem), v AS (SELECT *, CASE WHEN f >= 0.4 THEN 'sufficient' WHEN f >= 0.25 THEN 'marginal' ELSE 'insufficient' END AS verdict FROM s),
t AS (SELECT *, CASE WHEN verdict = 'insufficient' OR role = 'abstain' THEN 3 WHEN role = 'missing_view' OR verdict = 'marginal' THEN 2 ELSE 1 END AS state FROM v)
SELECT l_orderkey, l_linenumber, verdict, state, CASE state WHEN 3 THEN CASE WHEN verdict = 'insufficient' THEN 'insufficient_tumour_fraction' ELSE 'posterior_width' END WHEN 2 THEN CASE WHEN verdict = 'marginal' THEN 'marginal_tumour_fraction' ELSE 'missing_modality' END END AS reason_code, CASE role WHEN 'missing_view' THEN 'rna;cna' WHEN 'abstain' THEN 'rna' ELSE 'rna;cna;methylation' END AS views, CASE WHEN state = 3 THEN 2 ELSE 5 END AS n_sections FROM t""")
def _(spark, folder):
    s = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 60).alias("fraction"), pick(_ROLES, F.col("l_linenumber")).alias("role"))
    return G.sample_states(s).select("l_orderkey", "l_linenumber", "verdict", "state", "reason_code", F.array_join("views", ";").alias("views"), F.size("sections").alias("n_sections"))


@query("gov_15_evidence_context", f"""
WITH {PROF}, tq AS (SELECT cluster, family, feature, row_number() OVER (PARTITION BY cluster, family ORDER BY abs(effect) DESC, feature) AS r FROM p WHERE q < 0.9), f AS (SELECT cluster, string_agg(feature, ',' ORDER BY r) FILTER (WHERE family = 'pathway' AND r <= 6) AS pathways, string_agg(feature, ',' ORDER BY r) FILTER (WHERE family = 'gene' AND r <= 8) AS genes FROM tq GROUP BY 1),
rv AS (SELECT p_partkey % 4 AS cluster, p_type AS tier, p_name || p_partkey AS drug, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_retailprice, p_partkey) AS rank FROM part), c AS (SELECT cluster, count(*) AS n FROM rv WHERE tier = 'ECONOMY' GROUP BY 1), d AS (SELECT cluster, string_agg(drug, ',' ORDER BY rank) AS names FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY rank) AS k FROM rv WHERE tier = 'ECONOMY') WHERE k <= 8 GROUP BY 1)
SELECT vec_id AS sample_id, label % 4 AS cluster, pathways, genes, n AS n_economy, names AS economy_names FROM embeddings LEFT JOIN f ON f.cluster = label % 4 LEFT JOIN c ON c.cluster = label % 4 LEFT JOIN d ON d.cluster = label % 4""")
def _(spark, folder):
    e = table(spark, folder, "embeddings")
    p = table(spark, folder, "part")
    rev = W.class_ranks(p.withColumn("cluster", F.col("p_partkey") % 4), "cluster", [F.col("p_retailprice"), F.col("p_partkey")], "_g", "rank").select("cluster", F.col("p_type").alias("tier"), F.concat(F.col("p_name"), F.col("p_partkey").cast("string")).alias("drug"), "rank")
    near = e.select(F.col("vec_id").alias("sample_id"), F.col("label").cast("long").alias("ref_id"), F.lit(0.5).alias("similarity"), F.lit(1).cast("long").alias("rank"))
    out = G.evidence_context(e.select(F.col("vec_id").alias("sample_id"), (F.col("label") % 4).alias("cluster")), profiles(spark, folder), near, rev, 0.9)

    def names(family):
        return F.array_join(F.transform(F.try_element_at("features", F.lit(family)), lambda x: x["feature"]), ",")

    econ = F.try_element_at("reversal_by_tier", F.lit("ECONOMY"))
    return out.select("sample_id", "cluster", names("pathway").alias("pathways"), names("gene").alias("genes"), econ["n"].alias("n_economy"), F.array_join(econ["names"], ",").alias("economy_names"))
