"""Join operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortgrid.bindings.registry import query
from cohortgrid.bindings.tables import D, LISTS, M, drug_lists, drug_rows, measurements, r6, ranked_list, table
from cohortgrid.functions.vocabulary import CATEGORY_ORDER
from cohortgrid.operators import joins as J


@query("jn_01_attach_first", """
WITH c AS (SELECT substr(c_name, 1, 17) AS k, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY substr(c_name, 1, 17) ORDER BY c_custkey) AS rn FROM customer)
SELECT o_orderkey, c_mktsegment, c_acctbal FROM (SELECT o_orderkey, substr(concat('Customer#', lpad(CAST(o_custkey + 50 AS VARCHAR), 9, '0')), 1, 17) AS k FROM orders) o
LEFT JOIN (SELECT * FROM c WHERE rn = 1) c USING (k)""")
def _(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + 50).cast("string"), 9, "0")).alias("raw"))
    c = table(spark, folder, "customer")
    out = J.attach_first(o, c, F.substring("raw", 1, 17), F.substring("c_name", 1, 17), [F.col("c_custkey")], ["c_mktsegment", "c_acctbal"])
    return out.select("o_orderkey", "c_mktsegment", "c_acctbal")


def samples(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 100).alias("patient"), F.when(F.col("label") == 9, "normal").otherwise("tumour").alias("grp"))


@query("jn_02_matched_pairs", """
WITH s AS (SELECT vec_id AS sample_id, vec_id % 100 AS patient, CASE WHEN label = 9 THEN 'normal' ELSE 'tumour' END AS grp FROM embeddings)
SELECT patient, tumour_id, sample_id AS normal_id FROM (SELECT patient, min(sample_id) AS tumour_id FROM s WHERE grp = 'tumour' GROUP BY 1) JOIN s USING (patient) WHERE grp = 'normal'""")
def _(spark, folder):
    return J.matched_pairs(samples(spark, folder), [F.col("sample_id")])


@query("jn_03_shared_features", """
WITH x AS (SELECT DISTINCT l_partkey AS feature FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)
SELECT feature, (SELECT count(*) FROM x) AS n_shared, CASE WHEN (SELECT count(*) FROM x) >= 500 THEN 'available' ELSE 'unavailable' END AS status FROM x""")
def _(spark, folder):
    li = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "feature")
    return J.shared_features(li.where(F.col("l_returnflag") == "A"), li.where((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)), 500)


@query("jn_04_resolve_ids", """
WITH dd AS (SELECT s_suppkey AS model_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 10 END AS id_a, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 5 END AS id_b, regexp_replace(upper(s_name), '[^A-Z0-9]', '', 'g') AS nm FROM supplier),
a AS (SELECT id_a, max(model_id) AS ta FROM dd WHERE id_a IS NOT NULL GROUP BY 1), b AS (SELECT id_b, max(model_id) AS tb FROM dd WHERE id_b IS NOT NULL GROUP BY 1), n AS (SELECT nm, max(model_id) AS tn FROM dd GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(ta, tb, tn) AS model_id FROM lineitem
LEFT JOIN a ON id_a = CASE WHEN l_linenumber = 1 THEN l_suppkey * 10 END LEFT JOIN b ON id_b = CASE WHEN l_linenumber <= 3 THEN l_suppkey END
LEFT JOIN n ON nm = CASE WHEN l_linenumber <= 5 THEN concat('SUPPLIER', lpad(CAST(l_suppkey AS VARCHAR), 9, '0')) END""")
def _(spark, folder):
    from cohortgrid.functions.cleaning import entity_key

    s = table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    d = s.select(k.alias("model_id"), F.when(k % 2 == 0, k * 10).alias("id_a"), F.when(k % 3 == 0, k + 5).alias("id_b"), entity_key(F.col("s_name")).alias("nm"))
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    n, sk = F.col("l_linenumber"), F.col("l_suppkey")
    name = F.when(n <= 5, entity_key(F.concat(F.lit("supplier #"), F.lpad(sk.cast("string"), 9, "0"))))
    out = J.resolve_ids(li, d, [(F.when(n == 1, sk * 10), "id_a"), (F.when(n <= 3, sk), "id_b"), (name, "nm")], "model_id")
    return out.select("l_orderkey", "l_linenumber", "model_id")


def registry(spark, folder):
    """Distinct part names as a compound registry."""
    p = table(spark, folder, "part").where(F.col("p_partkey") % 4 != 1)
    name = F.lower(F.concat(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 50).cast("string")))
    return p.groupBy(name.alias("canonical")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("PERT-"), (F.col("p_partkey") % 997).cast("string")))).alias("lincs_pert_ids"),
        F.array_sort(F.collect_set(F.concat(F.lit("KEY-"), (F.col("p_partkey") % 1009).cast("string")))).alias("inchi_keys"),
        F.array_sort(F.collect_set(F.concat(F.lit("alias "), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_partkey") % 31).cast("string")))).alias("synonyms"),
        F.min("p_type").alias("p_type"))


REG = """reg AS (SELECT lower(concat(p_name, ' ', p_partkey % 50)) AS canonical, list(DISTINCT concat('PERT-', p_partkey % 997)) AS pert, list(DISTINCT concat('KEY-', p_partkey % 1009)) AS inchi,
  list(DISTINCT concat('alias ', p_size, ' ', p_partkey % 31)) AS syn, min(p_type) AS p_type FROM part WHERE p_partkey % 4 <> 1 GROUP BY 1),
kp AS (SELECT key, min(canonical) AS c FROM (SELECT canonical, unnest(pert) AS key FROM reg) GROUP BY 1),
ki AS (SELECT key, min(canonical) AS c FROM (SELECT canonical, unnest(inchi) AS key FROM reg) GROUP BY 1),
kn AS (SELECT key, c FROM (SELECT key, canonical AS c, row_number() OVER (PARTITION BY key ORDER BY p, canonical) AS rn FROM (SELECT canonical AS key, canonical, 0 AS p FROM reg UNION ALL SELECT unnest(syn), canonical, 1 FROM reg)) WHERE rn = 1)"""


@query("jn_05_registry_lookup", f"""
WITH {REG}, x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN concat('KEY-', l_partkey % 1200) END AS ik, CASE WHEN l_linenumber <= 2 THEN concat('PERT-', l_suppkey) END AS pk,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('alias ', l_suppkey % 50, ' ', l_partkey % 31) ELSE lower(concat(p_name, ' ', p_partkey % 50)) END AS nm FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, coalesce(ki.c, kp.c, kn.c) AS registry_canonical, CASE WHEN ki.c IS NOT NULL THEN 'inchi_key' WHEN kp.c IS NOT NULL THEN 'lincs_pert_id' WHEN kn.c IS NOT NULL THEN 'canonical' END AS match_key, reg.p_type
FROM x LEFT JOIN ki ON ki.key = ik LEFT JOIN kp ON kp.key = pk LEFT JOIN kn ON kn.key = nm LEFT JOIN reg ON reg.canonical = coalesce(ki.c, kp.c, kn.c)""")
def _(spark, folder):
    d = drug_rows(spark, folder)
    n = F.col("l_linenumber")
    rows = d.select(
        "l_orderkey", "l_linenumber", F.when(n == 1, F.concat(F.lit("key-"), (F.col("l_partkey") % 1200).cast("string"))).alias("inchi_key"),
        F.when(n <= 2, F.concat(F.lit("pert-"), F.col("l_suppkey").cast("string"))).alias("pert_id"),
        F.when(n % 2 == 0, F.concat_ws(" ", F.lit("Alias"), (F.col("l_suppkey") % 50).cast("string"), (F.col("l_partkey") % 31).cast("string"))).otherwise(F.col("canonical")).alias("name"))
    return J.lookup_registry(rows, registry(spark, folder), ["p_type"]).select("l_orderkey", "l_linenumber", "registry_canonical", "match_key", "p_type")


@query("jn_06_first_dimension", """
WITH dim AS (SELECT n, p_type, p_size FROM (SELECT lower(p_name) AS n, p_type, p_size, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM part WHERE p_size > 25) WHERE rn = 1)
SELECT p.p_partkey, lower(p.p_name) AS canonical, dim.p_type AS phase, dim.p_size AS target_size FROM part p LEFT JOIN dim ON dim.n = lower(p.p_name)""")
def _(spark, folder):
    p = table(spark, folder, "part")
    dim = p.where(F.col("p_size") > 25).select("p_partkey", F.upper("p_name").alias("nm"), F.col("p_type").alias("phase"), F.col("p_size").alias("target_size"))
    out = J.first_dimension(p.select("p_partkey", "p_name"), dim, F.col("p_name"), F.col("nm"), [F.col("p_partkey")], ["phase", "target_size"])
    return out.select("p_partkey", "canonical", "phase", "target_size")


@query("jn_07_dual_list", f"""
WITH {LISTS} SELECT a.canonical, a.rank AS list1_rank, b.rank AS list2_rank, round(a.percentile, 6) AS list1_percentile, round(b.percentile, 6) AS list2_percentile,
 a.reversal_score AS list1_reversal_score, b.reversal_score AS list2_reversal_score FROM l1 a JOIN l2 b USING (canonical)""")
def _(spark, folder):
    out = J.dual_list(*drug_lists(spark, folder))
    return out.select("canonical", "list1_rank", "list2_rank", r6("list1_percentile").alias("list1_percentile"), r6("list2_percentile").alias("list2_percentile"),
                      "list1_reversal_score", "list2_reversal_score")


@query("jn_08_near_consensus", f"""
WITH {LISTS}, u AS (SELECT * FROM (SELECT drug, canonical, 'list1_only' AS side, percentile, row_number() OVER (ORDER BY percentile DESC, canonical) AS r FROM l1 WHERE percentile >= 0.8 AND canonical NOT IN (SELECT canonical FROM l2)) WHERE r <= 50
 UNION ALL SELECT * FROM (SELECT drug, canonical, 'list2_only' AS side, percentile, row_number() OVER (ORDER BY percentile DESC, canonical) AS r FROM l2 WHERE percentile >= 0.8 AND canonical NOT IN (SELECT canonical FROM l1)) WHERE r <= 50)
SELECT drug, canonical, side, round(percentile, 6) AS percentile FROM (SELECT * FROM u ORDER BY side, percentile DESC, canonical LIMIT 20)""")
def _(spark, folder):
    return J.near_consensus(*drug_lists(spark, folder), per_side=50, total=20).withColumn("percentile", r6("percentile"))


def pair_rows(spark, folder, flag):
    li = table(spark, folder, "lineitem").where(F.col("l_returnflag") == flag)
    return li.groupBy((F.col("l_partkey") % 60).alias("a"), (F.col("l_suppkey") % 60).alias("b")).agg(F.sum("l_quantity").alias(f"q_{flag.lower()}"))


@query("jn_09_pair_join", """
WITH p AS (SELECT least(l_partkey % 60, l_suppkey % 60) AS drug_a, greatest(l_partkey % 60, l_suppkey % 60) AS drug_b, l_partkey % 60 AS a, sum(l_quantity) AS q_a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2, 3),
o AS (SELECT least(l_partkey % 60, l_suppkey % 60) AS drug_a, greatest(l_partkey % 60, l_suppkey % 60) AS drug_b, l_partkey % 60 AS a, sum(l_quantity) AS q_r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3),
j AS (SELECT p.drug_a, p.drug_b, q_a, q_r FROM p JOIN o ON p.drug_a = o.drug_a AND p.drug_b = o.drug_b)
SELECT * FROM j WHERE drug_a IN (SELECT n_nationkey FROM nation) AND drug_b IN (SELECT n_nationkey FROM nation)""")
def _(spark, folder):
    out = J.join_pairs(pair_rows(spark, folder, "A"), pair_rows(spark, folder, "R"))
    return J.pairs_within(out, table(spark, folder, "nation"), "n_nationkey")


@query("jn_10_enumerate_pairs", """
WITH n AS (SELECT DISTINCT p_brand AS name, min(p_type) OVER (PARTITION BY p_brand) AS target FROM part)
SELECT a.name AS drug_a, a.target AS target_a, b.name AS drug_b, b.target AS target_b FROM n a JOIN n b ON a.name < b.name AND a.target <> b.target
UNION ALL SELECT a.p_brand, a.p_type, b.p_brand, b.p_type FROM (SELECT DISTINCT p_brand, p_type FROM part) a JOIN (SELECT DISTINCT p_brand, p_type FROM part) b ON (a.p_brand < b.p_brand OR (a.p_brand = b.p_brand AND a.p_type < b.p_type)) AND a.p_type <> b.p_type""")
def _(spark, folder):
    p = table(spark, folder, "part")
    one = p.groupBy("p_brand").agg(F.min("p_type").alias("p_type"))
    return J.enumerate_pairs(one, "p_brand", "p_type").unionByName(J.enumerate_pairs(p, "p_brand", "p_type"))


@query("jn_11_comparators", f"""
WITH {LISTS}, ref AS (SELECT canonical, drug, rank AS drug_rank, percentile FROM (SELECT *, row_number() OVER (ORDER BY reversal_score DESC, canonical) AS rank, 1.0 - (row_number() OVER (ORDER BY reversal_score DESC, canonical) - 1.0) / greatest(count(*) OVER () - 1, 1) AS percentile
   FROM (SELECT canonical, canonical AS drug, round(avg(l_discount * l_quantity), 9) AS reversal_score FROM d WHERE l_returnflag = 'N' GROUP BY 1))),
cat AS (SELECT canonical, ['Chemotherapy','PARP inhibitor','Endocrine therapy','CDK4/6 inhibitor','PI3K/AKT/mTOR inhibitor','HER2-targeted small molecule'][CAST(p % 6 AS INTEGER) + 1] AS category, p % 6 AS o
   FROM (SELECT lower(concat(p_name, ' ', p_partkey % 50)) AS canonical, min(p_partkey) AS p FROM part GROUP BY 1 HAVING min(p_type) = 'ECONOMY')),
j AS (SELECT coalesce(a.drug, b.drug, r.drug) AS drug, c.canonical, category, coalesce(a.rank, r.drug_rank) AS list1_rank, b.rank AS list2_rank, coalesce(a.percentile, r.percentile) AS list1_percentile, b.percentile AS list2_percentile,
  CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN least(a.percentile, b.percentile) END AS dual, a.rank IS NOT NULL AND b.rank IS NOT NULL AS present_in_both_lists, o
  FROM cat c LEFT JOIN l1 a USING (canonical) LEFT JOIN l2 b ON b.canonical = c.canonical LEFT JOIN ref r ON r.canonical = c.canonical WHERE coalesce(a.rank, b.rank, r.drug_rank) IS NOT NULL)
SELECT drug, canonical, category, list1_rank, list2_rank, round(list1_percentile, 6) AS list1_percentile, round(list2_percentile, 6) AS list2_percentile, round(dual, 6) AS dual_support_percentile, present_in_both_lists,
 row_number() OVER (ORDER BY o, coalesce(dual, -1) DESC, lower(drug)) AS position FROM j""")
def _(spark, folder):
    l1, l2 = drug_lists(spark, folder)
    ref = ranked_list(drug_rows(spark, folder).where(F.col("l_returnflag") == "N")).select("canonical", "drug", F.col("rank").alias("drug_rank"), "percentile")
    return J.comparator_table(comparators(spark, folder), l1, l2, ref).select(
        "drug", "canonical", "category", "list1_rank", "list2_rank", *[r6(c).alias(c) for c in ("list1_percentile", "list2_percentile", "dual_support_percentile")],
        "present_in_both_lists", F.col("position").cast("long").alias("position"))


def comparators(spark, folder):
    p = table(spark, folder, "part")
    name = F.lower(F.concat(F.col("p_name"), F.lit(" "), (F.col("p_partkey") % 50).cast("string")))
    c = p.groupBy(name.alias("canonical")).agg(F.min("p_partkey").alias("_p"), F.min("p_type").alias("_t")).where(F.col("_t") == "ECONOMY")
    return c.select("canonical", F.element_at(F.array(*[F.lit(x) for x in CATEGORY_ORDER]), (F.col("_p") % 6 + 1).cast("int")).alias("category"))


@query("jn_12_nearest_references", """
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 9), r AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 9),
x AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, list_cosine_similarity(q.v, r.v) AS sim FROM q CROSS JOIN r)
SELECT query_id, ref_id, round(sim, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ref_id) AS rank FROM x) WHERE rank <= 5""")
def _(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return J.nearest_references(e.where(F.col("label") != 9), e.where(F.col("label") == 9), 5).withColumn("similarity", r6("similarity"))


@query("jn_13_interpolate", """
WITH k AS (SELECT CAST(l_quantity AS DOUBLE) * 2 AS x, avg(l_extendedprice) AS y FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 GROUP BY 1),
e AS (SELECT event_id, value, (SELECT max(x) FROM k WHERE x <= value) AS px, (SELECT min(x) FROM k WHERE x > value) AS nx FROM events)
SELECT event_id, round(CASE WHEN px IS NULL THEN n.y WHEN nx IS NULL THEN p.y ELSE p.y + (n.y - p.y) * (e.value - px) / (nx - px) END, 4) AS value
FROM e LEFT JOIN k p ON p.x = px LEFT JOIN k n ON n.x = nx""")
def _(spark, folder):
    k = table(spark, folder, "lineitem").where(F.col("l_quantity").between(5, 45)).groupBy((F.col("l_quantity") * 2).alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    rows = table(spark, folder, "events").select("event_id", F.col("value").alias("at"))
    return J.interpolate_at(rows, k.withColumn("seq", F.lit(0)), "at").select("event_id", r6("value", 4).alias("value"))


def graph(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.groupBy((F.col("l_partkey") % 40).alias("source"), (F.col("l_suppkey") % 40).alias("target"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("sign")).agg(
        F.count(F.lit(1)).alias("n_references")).where(F.col("source") != F.col("target"))


E = """e AS (SELECT l_partkey % 40 AS source, l_suppkey % 40 AS target, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign, count(*) AS n_references FROM lineitem WHERE l_partkey % 40 <> l_suppkey % 40 GROUP BY 1, 2, 3)"""


@query("jn_14_induced_subgraph", f"""
WITH {E} SELECT DISTINCT source, target, sign FROM e WHERE source IN (SELECT n_nationkey FROM nation) AND target IN (SELECT n_nationkey FROM nation)""")
def _(spark, folder):
    return J.induced_subgraph(graph(spark, folder), table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("node")))


@query("jn_15_two_layer", f"""
WITH {E}, core AS (SELECT r_regionkey AS node FROM region), inc AS (SELECT source AS node FROM e WHERE target IN (SELECT node FROM core) AND n_references > 2), nodes AS (SELECT node FROM core UNION SELECT source FROM e WHERE target IN (SELECT node FROM core)),
x AS (SELECT source, target, sign, n_references, source IN (SELECT node FROM core) AND target IN (SELECT node FROM core) AS in_core FROM e WHERE source IN (SELECT node FROM nodes) AND target IN (SELECT node FROM nodes))
SELECT * FROM (SELECT *, row_number() OVER (ORDER BY in_core DESC, n_references DESC, source, target, sign) AS position FROM x) WHERE position <= 300""")
def _(spark, folder):
    return J.two_layer_subgraph(graph(spark, folder), table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("node")), 300)


def screen(spark, folder):
    li, p, s = (table(spark, folder, t) for t in ("lineitem", "part", "supplier"))
    return li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).select(
        F.col("s_name").alias("line_name"), F.col("p_name").alias("drug_name"), F.ln("l_quantity").alias("ln_ic50"), (F.col("p_size") / 1000).alias("min_conc"),
        (F.col("p_size") * 2.0).alias("max_conc"), F.col("l_discount").alias("auc"), F.when(F.col("s_nationkey") % 5 == 0, "brca").otherwise("other").alias("tissue"))


SCREEN = """sc AS (SELECT s_suppkey, s_name AS line_name, lower(p_name) AS canonical, ln(l_quantity) AS ln_ic50, p_size / 1000.0::DOUBLE AS min_conc, p_size * 2.0::DOUBLE AS max_conc, l_discount AS auc,
  CASE WHEN s_nationkey % 5 = 0 THEN 'BRCA' ELSE 'OTHER' END AS tissue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


@query("jn_16_screen_curves", f"""
WITH {SCREEN}, w AS (SELECT DISTINCT lower(p_name) AS canonical FROM part WHERE p_size > 20), pk AS (SELECT lower(p_name) AS canonical, min(p_retailprice) AS cmax_nm FROM part GROUP BY 1)
SELECT line_name AS line_id, canonical, round(exp(median(ln_ic50)) * 1000, 4) AS ic50_nm, round(median(min_conc) * 1000, 6) AS min_conc_nm, round(median(max_conc) * 1000, 6) AS max_conc_nm, round(median(auc), 6) AS auc, any_value(cmax_nm) AS cmax_nm
FROM sc JOIN w USING (canonical) LEFT JOIN pk USING (canonical) GROUP BY 1, 2""")
def _(spark, folder):
    p = table(spark, folder, "part")
    near = table(spark, folder, "supplier").select(F.col("s_name").alias("line_id"))
    out = J.attach_screen(near, screen(spark, folder), p.where(F.col("p_size") > 20).select(F.col("p_name").alias("drug")),
                          p.select(F.col("p_name").alias("drug_name"), F.col("p_retailprice").alias("cmax_nm")))
    return out.select("line_id", "canonical", r6("ic50_nm", 4).alias("ic50_nm"), r6("min_conc_nm").alias("min_conc_nm"), r6("max_conc_nm").alias("max_conc_nm"), r6("auc").alias("auc"), "cmax_nm")


@query("jn_16_tissue_ic50", f"""
WITH {SCREEN}, n AS (SELECT canonical, count(*) FILTER (WHERE tissue = 'BRCA') AS n_tissue FROM sc GROUP BY 1)
SELECT canonical, n_tissue, round(median(exp(ln_ic50) * 1000), 4) AS ic50_nm, n_tissue >= 3 AS used_tissue FROM sc JOIN n USING (canonical) WHERE n_tissue < 3 OR tissue = 'BRCA' GROUP BY 1, 2""")
def _(spark, folder):
    return J.tissue_ic50(screen(spark, folder), "BRCA").withColumn("ic50_nm", r6("ic50_nm", 4))
