"""Cleaning and filtering operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortgrid.bindings.registry import query
from cohortgrid.bindings.tables import M, measurements, pick, pick_sql, r6, table
from cohortgrid.functions import cleaning as C
from cohortgrid.functions.vocabulary import ALIASES, ALIASES_SHORT
from cohortgrid.operators import filters as O

MARKS = [" [Not Available] ", "nan", "None", "[Unknown]", "   ", " Kept text ", None]
RAW_STATUS = ["1:DECEASED", "0:LIVING", "[Not Available]", " 1 :Recurred", None]
RECEPTOR = ["Positve", "positive", "Negative", "neg", "ER+", "0", "1.0", "equivocal", " ", None, "GAIN", "NEUTRAL", "LOSS", "Positive by other"]
NAMES = ["Taxol", "5-FU", "palbociclib_cdk6", "Tykerb ", "CCI-779", "Sirolimus", "Doxorubicin  Hydrochloride", "BRD-K1234", "sa 99", "Adria", "taxotere"]
SUBTYPES = ["BRCA_LumA", "Luminal B", "Her2-enriched", " Luminal A", "claudin-low", "BRCA_Basal"]
FLAGS = ["1", "TRUE", " Yes", "t", "n", "0", "", None]


def _alias_case(col: str, table_: dict[str, str]) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {col} END"


_NAME = f"concat({pick_sql(NAMES, 'p_partkey')}, CASE WHEN p_partkey % 3 = 0 THEN concat('_', p_name) ELSE '' END)"
_NORM = "trim(regexp_replace(lower(split_part(raw, '_', 1)), '[^a-z0-9]+', ' ', 'g'))"
_NORM2 = "trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'))"


def raw_names(spark, folder):
    p = table(spark, folder, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), F.col("p_name"))).otherwise(F.lit(""))
    return p.select("p_partkey", F.concat(pick(NAMES, F.col("p_partkey")), tail).alias("raw"))


@query("flt_01_number", """
SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'NA' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS num FROM events""")
def _(spark, folder):
    e = table(spark, folder, "events")
    raw = F.when(F.col("event_id") % 5 == 0, "NA").otherwise(F.col("value").cast("string"))
    return e.select("event_id", C.number(raw).alias("num"))


@query("flt_02_euro_number", """
SELECT l_orderkey, l_linenumber, TRY_CAST(replace(CASE WHEN l_linenumber = 3 THEN 'nan' ELSE replace(CAST(l_extendedprice AS VARCHAR), '.', ',') END, ',', '.') AS DOUBLE) AS num
FROM lineitem WHERE l_linenumber <> 3
UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM lineitem WHERE l_linenumber = 3""")
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    raw = F.when(F.col("l_linenumber") == 3, "nan").otherwise(F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(",")))
    return li.select("l_orderkey", "l_linenumber", C.euro_number(raw).alias("num"))


@query("flt_03_blank_to_null", f"""
SELECT o_orderkey, CASE WHEN trim(raw) = '' OR lower(trim(raw)) IN ('nan','none','[not available]','[unknown]') THEN NULL ELSE trim(raw) END AS cleaned,
  CASE WHEN lower(trim(rec)) = 'positve' THEN 'Positive' WHEN trim(rec) = '' OR lower(trim(rec)) = 'nan' THEN NULL ELSE trim(rec) END AS receptor
FROM (SELECT o_orderkey, {pick_sql(MARKS, 'o_orderkey')} AS raw, {pick_sql(RECEPTOR, 'o_custkey')} AS rec FROM orders)""")
def _(spark, folder):
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", C.blank_to_null(pick(MARKS, F.col("o_orderkey"))).alias("cleaned"),
                    C.receptor_text(pick(RECEPTOR, F.col("o_custkey"))).alias("receptor"))


@query("flt_04_event", f"""
SELECT o_orderkey, TRY_CAST(trim(split_part(raw, ':', 1)) AS INTEGER) AS code, CASE WHEN raw LIKE '1%' THEN 1.0 ELSE 0.0 END AS flag
FROM (SELECT o_orderkey, {pick_sql(RAW_STATUS, 'o_orderkey')} AS raw FROM orders)""")
def _(spark, folder):
    raw = pick(RAW_STATUS, F.col("o_orderkey"))
    return table(spark, folder, "orders").select("o_orderkey", C.event_code(raw).alias("code"), C.event_flag(raw).alias("flag"))


@query("flt_05_receptor", f"""
SELECT c_custkey,
 CASE WHEN regexp_matches(t, 'pos|\\+') OR t IN ('1','1.0','true','yes','er+') THEN 1.0
      WHEN regexp_matches(t, 'neg') OR t IN ('0','0.0','false','no','er-') THEN 0.0 END AS code,
 CASE WHEN t LIKE 'posit%' THEN 'positive' WHEN t LIKE 'neg%' THEN 'negative' ELSE 'unknown' END AS er,
 CASE WHEN regexp_matches(t, 'posit|gain') THEN 'positive' WHEN regexp_matches(t, 'negat|neutral|loss') THEN 'negative' ELSE 'unknown' END AS her2
FROM (SELECT c_custkey, lower(trim(coalesce({pick_sql(RECEPTOR, 'c_custkey')}, ''))) AS t FROM customer)""")
def _(spark, folder):
    raw = pick(RECEPTOR, F.col("c_custkey"))
    return table(spark, folder, "customer").select(
        "c_custkey", C.receptor_code(raw).alias("code"), C.status_label(raw).alias("er"), C.status_label(raw, amplification=True).alias("her2"))


@query("flt_06_barcode", """
SELECT c_custkey, substr(b, 1, 12) AS patient, CASE WHEN length(b) >= 15 THEN substr(b, 14, 2) ELSE '' END AS stype,
 CASE WHEN length(b) < 15 THEN 'other' WHEN substr(b, 14, 2) IN ('01','03') THEN 'tumour' WHEN substr(b, 14, 2) = '11' THEN 'normal' ELSE 'other' END AS grp
FROM (SELECT c_custkey, concat('TCGA-', lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), '-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'),
      ['-01A-11', '-11A-11', '-03B', '-06A', ''][CAST(c_custkey % 5 AS INTEGER) + 1]) AS b FROM customer)""")
def _(spark, folder):
    c = table(spark, folder, "customer")
    b = F.concat(F.lit("TCGA-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"),
                 F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), pick(["-01A-11", "-11A-11", "-03B", "-06A", ""], F.col("c_custkey")))
    return c.select("c_custkey", b.alias("b")).select("c_custkey", C.barcode_patient(F.col("b")).alias("patient"),
                                                      C.barcode_type(F.col("b")).alias("stype"), C.barcode_group(F.col("b")).alias("grp"))


@query("flt_07_compound_name", f"""
SELECT p_partkey, {_alias_case('a', ALIASES)} AS canonical, {_alias_case('b', ALIASES_SHORT)} AS canonical_short
FROM (SELECT p_partkey, {_NORM} AS a, {_NORM2} AS b FROM (SELECT p_partkey, {_NAME} AS raw FROM part))""")
def _(spark, folder):
    return raw_names(spark, folder).select("p_partkey", C.compound_name(F.col("raw")).alias("canonical"), C.compound_name_short(F.col("raw")).alias("canonical_short"))


@query("flt_08_entity_key", """
SELECT s_suppkey, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS entity FROM supplier""")
def _(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", C.entity_key(F.col("s_name")).alias("entity"))


@query("flt_09_subtype_label", f"""
SELECT c_custkey, replace(replace(replace(replace(trim(raw), 'BRCA_', ''), 'Her2-enriched', 'Her2'), 'Luminal A', 'LumA'), 'Luminal B', 'LumB') AS subtype
FROM (SELECT c_custkey, {pick_sql(SUBTYPES, 'c_custkey')} AS raw FROM customer)""")
def _(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", C.subtype_label(pick(SUBTYPES, F.col("c_custkey"))).alias("subtype"))


@query("flt_10_anonymous", f"""
SELECT p_partkey, regexp_matches(lower(trim(raw)), '^(brd|sa)[- ]') OR regexp_matches(lower(p_brand), '^(brd|sa)[- ]') AS anonymous
FROM (SELECT p_partkey, p_brand, {_NAME} AS raw FROM part)""")
def _(spark, folder):
    brands = table(spark, folder, "part").select("p_partkey", "p_brand")
    return raw_names(spark, folder).join(brands, "p_partkey").select("p_partkey", C.is_anonymous(F.col("raw"), F.col("p_brand")).alias("anonymous"))


@query("flt_11_units", """
SELECT l_orderkey, l_linenumber, round(exp(ln(l_quantity)) * 1000, 6) AS ic50_nm, l_discount * 1000.0 AS max_nm FROM lineitem""")
def _(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r6(C.ln_um_to_nm(F.ln("l_quantity"))).alias("ic50_nm"), (F.col("l_discount") * 1000.0).alias("max_nm"))


@query("flt_12_scales", """
SELECT event_id, round(log2(greatest(value - 20, 0) + 1), 6) AS log2p, round(ln(1 + value), 6) AS log1p, round(pow(2, value / 100), 6) AS pow2 FROM events""")
def _(spark, folder):
    v = F.col("value")
    return table(spark, folder, "events").select("event_id", r6(C.log2_plus_one(v - 20)).alias("log2p"), r6(F.log1p(v)).alias("log1p"), r6(F.pow(F.lit(2.0), v / 100)).alias("pow2"))


@query("flt_13_scale_detection", f"""
WITH {M}, med AS (SELECT median(value) AS med FROM m)
SELECT feature, CASE WHEN med < 20 THEN 'log2_to_2p' ELSE 'linear_counts' END AS scale, count(*) AS n,
  round(sum(CASE WHEN med < 20 THEN pow(2, greatest(value, 0)) ELSE greatest(value, 0) END), 6) AS total
FROM m, med GROUP BY 1, 2""")
def _(spark, folder):
    out = O.to_counts(measurements(spark, folder))
    return out.groupBy("feature", "scale").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query("flt_14_hold_out", """
SELECT c_custkey, c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_acctbal > 9000)
 AND substr(c_name, 1, 17) NOT IN (SELECT substr(c_name, 1, 17) FROM customer WHERE c_acctbal > 9000)""")
def _(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return O.hold_out(c, c.where(F.col("c_acctbal") > 9000), "c_name", 17).select("c_custkey", "c_name")


@query("flt_15_align_vocabulary", f"""
WITH {M}, v AS (SELECT unnest(['g00','g05','zz','g63','g10']) AS feature, unnest([0,1,2,3,4]) AS pos),
x AS (SELECT s.sample_id, v.pos, coalesce(m.value, 0) AS value FROM (SELECT DISTINCT sample_id FROM m) s CROSS JOIN v LEFT JOIN m ON m.sample_id = s.sample_id AND m.feature = v.feature)
SELECT sample_id, pos, round(value, 6) AS value FROM x""")
def _(spark, folder):
    out = O.align_vocabulary(measurements(spark, folder), ["g00", "g05", "zz", "g63", "g10"])
    return out.select("sample_id", F.posexplode("vector").alias("pos", "value")).select("sample_id", "pos", r6("value").alias("value"))


@query("flt_16_truth", f"""
SELECT c_custkey, coalesce(lower(trim(raw)) IN ('1','true','yes','t','y'), false) AS flag FROM (SELECT c_custkey, {pick_sql(FLAGS, 'c_custkey')} AS raw FROM customer)""")
def _(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", C.truth(pick(FLAGS, F.col("c_custkey"))).alias("flag"))


_GAPS = "CASE WHEN (sample_id * 7 + CAST(substr(feature, 2) AS INTEGER)) % (3 + CAST(substr(feature, 2) AS INTEGER) % 9) = 0 THEN NULL ELSE value END"


def gappy(spark, folder):
    pos = F.substring("feature", 2, 2).cast("int")
    m = measurements(spark, folder)
    return m.withColumn("value", F.when((F.col("sample_id") * 7 + pos) % (3 + pos % 9) == 0, F.lit(None)).otherwise(F.col("value")))


@query("flt_17_impute", f"""
WITH {M}, g AS (SELECT sample_id, feature, {_GAPS} AS value FROM m),
st AS (SELECT feature, avg(CAST(value IS NULL AS INTEGER)) AS missing, median(value) AS med, avg(value) AS mean FROM g GROUP BY 1)
SELECT feature, count(*) AS n, round(sum(coalesce(value, med)), 6) AS by_median, round(sum(coalesce(value, mean)), 6) AS by_mean FROM g JOIN st USING (feature) WHERE missing < 0.2 GROUP BY 1""")
def _(spark, folder):
    g = gappy(spark, folder)
    a = O.impute(g, "median").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("by_median"))
    b = O.impute(g, "mean").groupBy("feature").agg(r6(F.sum("value")).alias("by_mean"))
    return a.join(b, "feature")


@query("flt_18_quality_filter", """
WITH a AS (SELECT *, count(*) FILTER (WHERE vec_id % 3 <> 0) OVER () AS na, count(*) FILTER (WHERE vec_id % 97 = 0) OVER () AS nb FROM embeddings)
SELECT vec_id, label FROM a WHERE (na < 100 OR vec_id % 3 <> 0) AND (nb < 100 OR vec_id % 97 = 0)""")
def _(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "label")
    return O.quality_filter(e, F.col("vec_id") % 3 != 0, F.col("vec_id") % 97 == 0)


@query("flt_19_verdict", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 100 >= 0.40 THEN 'sufficient' WHEN l_quantity / 100 >= 0.25 THEN 'marginal' ELSE 'insufficient' END AS verdict FROM lineitem""")
def _(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", C.sample_verdict(F.col("l_quantity") / 100).alias("verdict"))


@query("flt_20_samples", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY h, o_orderkey) AS r1, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS r2, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS al FROM (SELECT o_orderkey, o_orderpriority, md5(CAST(o_orderkey AS VARCHAR) || '|0') AS h FROM orders))
SELECT o_orderkey, o_orderpriority, 'fixed' AS kind FROM r WHERE r1 <= 200 UNION ALL SELECT o_orderkey, o_orderpriority, 'stratified' FROM r WHERE r2 <= least(n, greatest(50, round(500 * n / al))) UNION ALL SELECT o_orderkey, o_orderpriority, 'group' FROM r WHERE r2 <= 80""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    fixed = O.seeded_sample(o, 200, "o_orderkey").withColumn("kind", F.lit("fixed"))
    strat = O.stratified_sample(o, 500, "o_orderpriority", "o_orderkey").select(*o.columns).withColumn("kind", F.lit("stratified"))
    grp = O.group_sample(o, "o_orderpriority", "o_orderkey", 80).withColumn("kind", F.lit("group"))
    return fixed.unionByName(strat).unionByName(grp)


@query("flt_21_validate_profiles", """
WITH p AS (SELECT user_id AS profile_id, count(DISTINCT CAST(props AS VARCHAR)) AS feature_count FROM events GROUP BY 1),
r AS (SELECT c_custkey AS profile_id, CASE c_custkey % 3 WHEN 0 THEN 'paclitaxel' WHEN 1 THEN 'tamoxifen' ELSE NULL END AS d FROM customer)
SELECT r.profile_id, coalesce(feature_count, 0) > 0 AS ok, coalesce(feature_count, 0) AS feature_count, CASE WHEN d = 'tamoxifen' THEN 'tamoxifen' ELSE '' END AS unknown,
  concat(CASE WHEN coalesce(feature_count, 0) < 60 THEN 'few_features' ELSE '' END, CASE WHEN coalesce(feature_count, 0) < 60 AND d = 'tamoxifen' THEN ';' ELSE '' END, CASE WHEN d = 'tamoxifen' THEN 'unmodelled_drugs' ELSE '' END) AS warnings
FROM r LEFT JOIN p USING (profile_id)""")
def _(spark, folder):
    e = table(spark, folder, "events").select(F.col("user_id").alias("profile_id"), F.col("props").alias("feature"), "value")
    at = F.col("c_custkey") % 3
    r = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("profile_id"),
        F.when(at == 0, F.array(F.lit("paclitaxel"))).when(at == 1, F.array(F.lit("tamoxifen"))).otherwise(F.array().cast("array<string>")).alias("drugs"))
    out = O.validate_profiles(e, r, 60)
    return out.withColumn("unknown", F.array_join("unknown", ";")).withColumn("warnings", F.array_join("warnings", ";"))


@query("flt_22_composition", """
SELECT l_orderkey, l_linenumber, part, round(f, 6) AS fraction, round(greatest(0, f - 0.04), 6) AS lower, round(least(1, f + 0.04), 6) AS upper
FROM (SELECT l_orderkey, l_linenumber, 'immune' AS part, l_discount + l_tax AS f FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'stroma', l_quantity / 50 FROM lineitem)""")
def _(spark, folder):
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("T-cells"), F.col("l_tax").alias("Myeloid"), (F.col("l_quantity") / 50).alias("CAFs"))
    out = O.composition_bands(li, {"immune": ["T-cells", "Myeloid", "B-cells"], "stroma": ["Endothelial", "CAFs", "PVL"]}, 0.04)
    return out.select("l_orderkey", "l_linenumber", F.inline("composition")).select(
        "l_orderkey", "l_linenumber", "part", r6("fraction").alias("fraction"), r6("lower").alias("lower"), r6("upper").alias("upper"))


@query("flt_23_discrepancy", f"""
WITH {M}, c AS (SELECT vec_id AS sample_id, CASE WHEN label % 3 = 0 THEN 'positive' WHEN label % 3 = 1 THEN 'negative' END AS call FROM embeddings)
SELECT sample_id, call, round(value * 4, 6) AS activity, CASE WHEN call = 'positive' THEN 'positive_call_low_activity' ELSE 'negative_call_high_activity' END AS note
FROM m JOIN c USING (sample_id) WHERE feature = 'g03' AND ((call = 'positive' AND value * 4 < 0) OR (call = 'negative' AND value * 4 > 0.5))""")
def _(spark, folder):
    m = measurements(spark, folder)
    act = m.where(F.col("feature") == "g03").select("sample_id", (F.col("value") * 4).alias("activity"))
    calls = table(spark, folder, "embeddings").select(F.col("vec_id").alias("sample_id"), F.when(F.col("label") % 3 == 0, "positive").when(F.col("label") % 3 == 1, "negative").alias("call"))
    return O.receptor_discrepancy(calls, act).withColumn("activity", r6("activity"))


@query("flt_24_config_key", """
SELECT DISTINCT key, split_part(key, ':', 1) AS method, CASE WHEN split_part(key, ':', 2) = 'na' THEN NULL ELSE split_part(key, ':', 2) END AS covariance_type, CAST(split_part(key, '=', 2) AS INTEGER) AS k
FROM (SELECT concat(m, ':', CASE WHEN m = 'gmm' THEN cov ELSE 'na' END, ':k=', CAST(k AS VARCHAR)) AS key FROM (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'gmm' ELSE 'kmeans' END AS m, ['full','diag','tied'][CAST(p_partkey % 3 AS INTEGER) + 1] AS cov, p_size % 7 + 2 AS k FROM part))""")
def _(spark, folder):
    p = table(spark, folder, "part")
    method = F.when(F.col("p_partkey") % 2 == 0, "gmm").otherwise("kmeans")
    key = C.config_key(method, pick(["full", "diag", "tied"], F.col("p_partkey")), F.col("p_size") % 7 + 2)
    return p.select(key.alias("key")).distinct().select("key", *[v.alias(n) for n, v in C.parse_config(F.col("key")).items()])
