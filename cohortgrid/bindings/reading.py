"""Readers and writers: the given tables are written in the source's file format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortgrid.bindings.governing import nominated
from cohortgrid.bindings.registry import query
from cohortgrid.bindings.summaries import D
from cohortgrid.bindings.tables import M, drug_rows, measurements, pick, pick_sql, r6, table
from cohortgrid.bindings.governing import NOM
from cohortgrid.session import shared_folder
from cohortgrid.sources import readers as R
from cohortgrid.sources import sinks as K


def scratch(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/cohortgrid-{name}-{uuid.uuid4().hex}"


def wide(spark, folder, symbol, names, entrez=True):
    """Part names by supplier nation: average discount, one column per nation."""
    li, p, s = (table(spark, folder, t) for t in ("lineitem", "part", "supplier"))
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    cols = [F.avg(F.when(F.col("s_nationkey") == n, F.col("l_discount"))).alias(names(n)) for n in range(25)]
    g = j.groupBy(symbol.alias("Hugo_Symbol"), F.col("p_brand").alias("Entrez_Gene_Id")).agg(*cols)
    return g if entrez else g.drop("Entrez_Gene_Id")


WIDE = "w AS (SELECT upper(p_name) AS feature, p_brand, s_nationkey AS n, avg(l_discount) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3), g AS (SELECT feature, 'S-' || n AS sample_id, round(avg(v), 10) AS value FROM w GROUP BY 1, 2)"


@query("src_01_wide_matrix", f"""
WITH {WIDE}, a AS (SELECT f.feature, 'S-' || s.n AS sample_id FROM (SELECT DISTINCT feature FROM w) f CROSS JOIN range(25) s(n)) SELECT a.feature, a.sample_id, value FROM a LEFT JOIN g USING (feature, sample_id)""")
def _(spark, folder):
    path = scratch(spark, "wide")
    w = wide(spark, folder, F.col("p_name"), lambda n: f"S-{n}")
    w.write.csv(path, sep="\t", header=True)
    spark.range(1).select(F.lit("# a comment line").alias("value")).write.mode("append").text(path)
    return R.read_wide_matrix(spark, path).select("feature", "sample_id", r6("value", 10).alias("value"))


@query("src_02_gct", f"""
WITH {WIDE}, a AS (SELECT f.feature, 'S-' || s.n AS sample_id FROM (SELECT DISTINCT feature FROM w) f CROSS JOIN range(25) s(n)) SELECT a.feature, a.sample_id, value FROM a LEFT JOIN g USING (feature, sample_id)""")
def _(spark, folder):
    path = scratch(spark, "gct")
    w = wide(spark, folder, F.col("p_name"), lambda n: f"S{n}")
    names = [f"S-{n}" for n in range(25)]
    line = F.concat_ws("\t", F.col("Entrez_Gene_Id"), F.col("Hugo_Symbol"), *[F.coalesce(F.col(f"S{n}").cast("string"), F.lit("NA")) for n in range(25)])
    head = spark.range(1).select(F.explode(F.array(F.lit("#1.2"), F.lit("100\t25"), F.lit("Name\tDescription\t" + "\t".join(names)))).alias("value"))
    head.unionByName(w.select(line.alias("value"))).write.text(path, compression="gzip")
    return R.read_gct(spark, path).select("feature", "sample_id", r6("value", 10).alias("value"))


@query("src_03_series_metadata", """
SELECT 'GSM' || c_custkey AS geo_accession, c_name AS title, c_mktsegment AS tumor_type, CAST(c_acctbal AS VARCHAR) AS age_at_diagnosis FROM customer""")
def _(spark, folder):
    path = scratch(spark, "series")
    c = table(spark, folder, "customer")
    parts = c.groupBy((F.col("c_custkey") / 200).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("string").alias("bal")))).alias("r"))
    q = F.lit('"')

    def row(tag, fn):
        return F.concat_ws("\t", F.concat(F.lit(tag)), F.array_join(F.transform("r", fn), "\t"))

    # one file per block, as a series has one file per platform
    lines = parts.select("block", F.explode(F.array(
        row("!Sample_geo_accession", lambda x: F.concat(q, F.lit("GSM"), x["c_custkey"].cast("string"), q)), row("!Sample_title", lambda x: F.concat(q, x["c_name"], q)),
        row("!Sample_characteristics_ch1", lambda x: F.concat(q, F.lit("Tumor type: "), x["c_mktsegment"], q)), row("!Sample_characteristics_ch1", lambda x: F.concat(q, F.lit("age at diagnosis: "), x["bal"], q)),
        F.lit("!series_matrix_table_begin"))).alias("value"))
    lines.repartition("block").write.partitionBy("block").text(path)
    return R.read_series_metadata(spark, path, ["block"]).drop("block", "pos")


@query("src_04_tagged_union", """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'GPL18573' ELSE 'unknown' END AS platform, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS overall_survival_days, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::DOUBLE END AS er_status FROM orders""")
def _(spark, folder):
    path = scratch(spark, "tagged")
    o = table(spark, folder, "orders")
    days = F.when(F.col("o_orderkey") % 7 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("overall_survival_days")
    o.where(F.col("o_orderkey") % 2 == 0).select("o_orderkey", days, F.col("o_custkey").alias("er_status")).write.csv(f"{path}/x-gpl18573", header=True)
    o.where(F.col("o_orderkey") % 2 == 1).select("o_orderkey", days).write.csv(f"{path}/x-other", header=True)
    out = R.read_tagged(spark, [f"{path}/x-gpl18573", f"{path}/x-other"], {"GPL18573": "GPL18573", "GPL11154": "GPL11154"}, ["overall_survival_days", "er_status"])
    return out.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


def triples(spark, folder):
    path = scratch(spark, "triples")
    li = table(spark, folder, "lineitem")
    t = li.groupBy((F.col("l_partkey") % 150).cast("int").alias("gene_idx"), (F.col("l_orderkey") % 900).cast("int").alias("cell_idx")).agg(F.sum("l_quantity").cast("float").alias("value"))
    t.write.csv(path)
    genes = table(spark, folder, "part").groupBy((F.col("p_partkey") % 150).cast("int").alias("gene_idx")).agg(F.min("p_name").alias("feature"))
    cells = table(spark, folder, "orders").groupBy((F.col("o_orderkey") % 900).cast("int").alias("cell_idx")).agg(F.concat(F.lit("cell-"), F.min("o_custkey").cast("string")).alias("cell_id"), F.min("o_orderpriority").alias("cell_type"))
    return path, genes, cells


TRI = """t AS (SELECT l_partkey % 150 AS gi, l_orderkey % 900 AS ci, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), ge AS (SELECT p_partkey % 150 AS gi, upper(min(p_name)) AS feature FROM part GROUP BY 1), ce AS (SELECT o_orderkey % 900 AS ci, 'cell-' || min(o_custkey) AS cell_id, min(o_orderpriority) AS cell_type FROM orders GROUP BY 1)"""


@query("src_05_triples", f"""
WITH {TRI} SELECT cell_id, feature, count(*) AS n, round(sum(v), 4) AS total FROM t JOIN ge USING (gi) JOIN ce USING (ci) WHERE cell_id IN (SELECT cell_id FROM ce WHERE cell_type = '1-URGENT') AND feature LIKE '%RING%' GROUP BY 1, 2""")
def _(spark, folder):
    path, genes, cells = triples(spark, folder)
    wanted = [r[0] for r in genes.where(F.upper("feature").contains("RING")).select("feature").distinct().collect()]
    out = R.read_triples(spark, path, genes, cells.select("cell_idx", "cell_id"), cells.where(F.col("cell_type") == "1-URGENT"), wanted)
    return out.groupBy("cell_id", "feature").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 4).alias("total"))


@query("src_06_atlas", f"""
WITH {TRI}, c AS (SELECT cell_id, feature, avg(v) AS v FROM t JOIN ge USING (gi) JOIN ce USING (ci) WHERE ci % 3 <> 0 OR cell_id IN (SELECT cell_id FROM ce WHERE ci % 3 <> 0) GROUP BY 1, 2), vr AS (SELECT feature FROM (SELECT feature, round(var_samp(v), 10) AS s FROM c GROUP BY 1) ORDER BY s DESC NULLS LAST, feature LIMIT 20)
SELECT cell_id, feature, round(v, 6) AS value FROM c WHERE feature IN (SELECT feature FROM vr)""")
def _(spark, folder):
    path, genes, cells = triples(spark, folder)
    picked = cells.where(F.col("cell_idx") % 3 != 0).select("cell_id").distinct()
    counts = R.read_triples(spark, path, genes, cells.select("cell_idx", "cell_id"))
    ref, _types = R.build_atlas(counts, cells.select("cell_id", "cell_type"), picked, 20)
    return ref.withColumn("value", r6("value"))


@query("src_07_matrix_columns", """
SELECT vec_id AS sig_id, round(embedding[4]::DOUBLE, 6) AS g03, round(embedding[11]::DOUBLE, 6) AS g10, 'compact_matrix' AS source FROM embeddings""")
def _(spark, folder):
    path = scratch(spark, "matrix")
    e = table(spark, folder, "embeddings")
    e.select(F.col("vec_id").alias("sig_id"), *[F.col("embedding")[i].alias(f"g{i:02d}") for i in range(64)]).write.parquet(path)
    out, tag = R.read_matrix_columns(spark, path, ["g03", "absent", "g10", "g03"])
    return out.select("sig_id", r6(F.col("g03").cast("double")).alias("g03"), r6(F.col("g10").cast("double")).alias("g10"), F.lit(tag).alias("source"))


_TR = ["yes", "TRUE", "0", "", "f"]


@query("src_08_reference_table", f"""
SELECT lower(p_name) AS drug_name, upper(p_type) AS target_gene, coalesce(lower({pick_sql(_TR, 'p_partkey')}) IN ('1','true','yes','t','y'), false) AS in_ode_topology, CASE WHEN p_partkey % 6 > 0 THEN p_partkey::DOUBLE END AS nsc_id, p_retailprice AS ic50_nm, 1.0 AS h FROM part""")
def _(spark, folder):
    path = scratch(spark, "pk")
    k = F.col("p_partkey")
    table(spark, folder, "part").select(F.concat(F.upper("p_name"), F.lit("_x")).alias("drug"), F.lower("p_type").alias("target_gene"), pick(_TR, k).alias("in_ode_topology"), F.when(k % 6 > 0, k.cast("string")).otherwise("n/a").alias("nsc_id"), F.col("p_retailprice").alias("ic50_nm")).write.csv(path, header=True)
    return R.read_reference_table(spark, path).select("drug_name", "target_gene", "in_ode_topology", "nsc_id", "ic50_nm", "h")


@query("src_09_pair_scores", """
WITH r AS (SELECT least(l_partkey % 70, l_suppkey % 70) AS a, greatest(l_partkey % 70, l_suppkey % 70) AS b, l_discount AS s FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R'), m AS (SELECT p_partkey % 70 AS nsc, min(lower(p_name)) AS drug FROM part WHERE p_partkey % 70 < 60 GROUP BY 1)
SELECT a AS nsc_a, b AS nsc_b, round(median(s), 6) AS score, x.drug AS drug_a, y.drug AS drug_b FROM r JOIN m x ON x.nsc = a JOIN m y ON y.nsc = b WHERE x.drug <> y.drug GROUP BY 1, 2, 4, 5""")
def _(spark, folder):
    path = scratch(spark, "pairs")
    li = table(spark, folder, "lineitem")
    li.select((F.col("l_partkey") % 70).alias("Nsc1"), (F.col("l_suppkey") % 70).alias("NSC2"), F.col("l_discount").alias("Score"), F.when(F.col("l_returnflag") == "R", "Breast Cancer").otherwise("Lung").alias("PANEL"), F.when(F.col("l_linestatus") == "F", "y").otherwise("N").alias("valid"), F.lit("x").alias("CELLNAME")).write.csv(path, header=True)
    m = table(spark, folder, "part").where(F.col("p_partkey") % 70 < 60).select((F.col("p_partkey") % 70).alias("nsc"), F.upper("p_name").alias("drug"))
    return R.read_pair_scores(spark, path, m).withColumn("score", r6("score"))


@query("src_10_line_expression", """
WITH x AS (SELECT s_suppkey, s_nationkey, l_linenumber AS g, round(avg(l_discount), 8) AS v FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_linenumber <= 4 GROUP BY 1, 2, 3), l AS (SELECT DISTINCT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 5 > 0), f AS (SELECT unnest(['GA','GA','GB','GC']) AS feature, unnest([1,2,3,4]) AS g)
SELECT 'ACH-' || l.s_suppkey AS sample_id, feature, round(coalesce(avg(v), 0), 6) AS value FROM l CROSS JOIN f LEFT JOIN x ON x.s_suppkey = l.s_suppkey AND x.g = f.g GROUP BY 1, 2""")
def _(spark, folder):
    path = scratch(spark, "lines")
    li = table(spark, folder, "lineitem")
    names = ["Ga (11)", "GA (12)", "gb (3)", "GC (4)"]
    g = li.groupBy("l_suppkey").agg(*[F.round(F.avg(F.when(F.col("l_linenumber") == i + 1, F.col("l_discount"))), 8).alias(n) for i, n in enumerate(names)])
    g.select(F.concat(F.lit("ACH-"), F.col("l_suppkey").cast("string")).alias("ModelID"), F.when(F.col("l_suppkey") % 5 > 0, "Yes").otherwise("No").alias("IsDefaultEntryForModel"), *names).write.csv(path, header=True)
    models = table(spark, folder, "supplier").select(F.concat(F.lit("ACH-"), F.col("s_suppkey").cast("string")).alias("ModelID"), F.when(F.col("s_nationkey") % 2 == 0, "Breast").otherwise("Lung").alias("lineage"))
    return R.read_line_expression(spark, path, models, "breast").withColumn("value", r6("value"))


@query("src_11_feature_subset", """
WITH w AS (SELECT p_brand AS feature, s_nationkey AS n, round(avg(l_discount), 8) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT upper(f.feature) AS feature, 'S' || n.n AS sample_id, round(coalesce(v, 0), 6) AS value FROM (SELECT DISTINCT feature FROM w WHERE feature LIKE '%2%') f CROSS JOIN range(25) n(n) LEFT JOIN w ON w.feature = f.feature AND w.n = n.n""")
def _(spark, folder):
    path = scratch(spark, "subset")
    li, p, s = (table(spark, folder, t) for t in ("lineitem", "part", "supplier"))
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    j.groupBy(F.col("p_brand").alias("gene")).agg(*[F.round(F.avg(F.when(F.col("s_nationkey") == n, F.col("l_discount"))), 8).alias(f"S{n}") for n in range(25)]).write.csv(path, header=True)
    keep = p.where(F.col("p_brand").contains("2")).select(F.col("p_brand").alias("feature")).distinct()
    return R.read_feature_subset(spark, path, keep).withColumn("value", r6("value"))


@query("src_12_extract_signatures", """
WITH s AS (SELECT vec_id, ['MCF7','T47D','HELA'][CAST(label % 3 AS INTEGER) + 1] AS cell, lower(['Taxol','Tykerb','Other','None'][CAST(vec_id % 4 AS INTEGER) + 1]) AS nm FROM embeddings WHERE label % 4 <> 1 AND label % 3 <> 2), x AS (SELECT vec_id, unnest(embedding) AS raw, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
tg AS (SELECT nm, array_to_string(list_sort(list(DISTINCT t)), ';') AS targets FROM (SELECT ['taxol','tykerb','other'][CAST(p_partkey % 3 AS INTEGER) + 1] AS nm, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS t FROM part) WHERE t IS NOT NULL GROUP BY 1)
SELECT s.vec_id AS sig_id, cell AS cell_id, coalesce(targets, '') AS targets, count(*) AS n_features, round(sum(raw::DOUBLE), 6) AS total FROM s JOIN x USING (vec_id) LEFT JOIN tg USING (nm) WHERE pos BETWEEN 10 AND 45 GROUP BY 1, 2, 3""")
def _(spark, folder):
    path = scratch(spark, "signatures")
    e = table(spark, folder, "embeddings")
    matrix = e.select(F.col("vec_id").alias("sig_id"), F.posexplode("embedding").alias("gene_id", "value"))
    info = e.select(F.col("vec_id").alias("sig_id"), F.when(F.col("label") % 4 == 1, "trt_sh").otherwise("trt_cp").alias("pert_type"), pick(["MCF-7", "T47 D", "HELA"], F.col("label")).alias("cell_iname"), pick(["Taxol", "Tykerb", "Other", "None"], F.col("vec_id")).alias("cmap_name"))
    p = table(spark, folder, "part")
    comp = p.select(pick(["taxol", "TYKERB", "other"], F.col("p_partkey")).alias("cmap_name"), F.when(F.col("p_partkey") % 7 == 0, '""').otherwise(F.col("p_brand")).alias("target"))
    pos = e.select(F.posexplode("embedding").alias("gene_id", "_v")).select("gene_id").distinct()
    ids = pos.select("gene_id", F.concat(F.lit("sym"), F.col("gene_id").cast("string")).alias("feature"))
    m, meta = R.extract_signatures(matrix, info, comp, ids, ["MCF7", "T47D"], ids.where(F.col("gene_id").between(10, 45)))
    m.write.parquet(path)
    back = spark.read.parquet(path)
    return back.join(meta, "sig_id").groupBy("sig_id", "cell_id", F.coalesce("targets", F.lit("")).alias("targets")).agg(F.count(F.lit(1)).alias("n_features"), r6(F.sum(F.col("value").cast("double"))).alias("total"))


@query("src_13_manifest")
def _(spark, folder):
    return R.file_manifest(spark, folder, "*.parquet").select("file_name", "length", "sha256", "html", "placeholder", "verified")


@query("src_14_best_file")
def _(spark, folder):
    m = R.file_manifest(spark, folder, "*.parquet")
    return R.best_files(m, F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).select("folder", "file_name")


@query("src_15_ledger", """
SELECT event_type AS notebook, CAST(user_id AS VARCHAR) AS gate, count(*) AS n_records, round(sum(value), 4) AS total, sum(CAST(value > 50 AS INTEGER))::BIGINT AS n_passed FROM events GROUP BY 1, 2""")
def _(spark, folder):
    path = scratch(spark, "ledger")
    e = table(spark, folder, "events")
    rec = e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("notebook"), F.col("user_id").cast("string").alias("gate"), "value", F.lit(50.0).alias("threshold"), F.lit("gte").alias("direction"), (F.col("value") > 50).alias("passed"), F.col("event_id").alias("n"))
    K.append_ledger(rec.where(F.col("n") % 2 == 0), path)
    K.append_ledger(rec.where(F.col("n") % 2 == 1), path)
    return R.read_ledger(spark, path).groupBy("notebook", "gate").agg(F.count(F.lit(1)).alias("n_records"), r6(F.sum("value"), 4).alias("total"), F.count_if("passed").alias("n_passed"))


@query("src_16_documents", """
SELECT c_custkey AS patient_id, c_mktsegment AS cohort, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS score, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 2 END AS nested_first FROM customer""")
def _(spark, folder):
    path = scratch(spark, "documents")
    k = F.col("c_custkey")
    bad = F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    inner = F.when(k % 7 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal") / 2)
    d = table(spark, folder, "customer").select(k.alias("patient_id"), F.col("c_mktsegment").alias("cohort"), bad.alias("score"), F.struct(F.array(inner).alias("values")).alias("detail"))
    K.write_documents(d, path, "cohort")
    back = spark.read.schema("patient_id long, cohort string, score double, detail struct<values: array<double>>").json(path)
    return back.select("patient_id", "cohort", "score", F.get("detail.values", 0).alias("nested_first"))


@query("src_17_export", f"""
WITH {NOM} SELECT canonical, support_class, array_to_string(list_sort(tg), ';') AS targets FROM n4""")
def _(spark, folder):
    path = scratch(spark, "export")
    K.export_evidence(nominated(spark, folder), path)
    return spark.read.csv(path, header=True).select("canonical", "support_class", "targets")


@query("src_18_evidence_set", """
SELECT p_brand AS symbol, min(p_type) AS tier, CAST(count(*) AS VARCHAR) AS source, 'gene' AS kind FROM part GROUP BY 1""")
def _(spark, folder):
    path = scratch(spark, "evidence")
    g = table(spark, folder, "part").groupBy("p_brand").agg(F.struct(F.min("p_type").alias("tier"), F.count(F.lit(1)).cast("string").alias("source"), F.lit("gene").alias("kind")).alias("e"))
    doc = g.groupBy(F.substring("p_brand", -1, 1).alias("schema")).agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "e"))).alias("entries"))
    doc.repartition("schema").write.partitionBy("schema").json(path)
    keys = [r[0] for r in doc.select("schema").collect()]
    out = None
    for k in keys:
        part = R.read_evidence_set(spark, f"{path}/schema={k}")
        out = part if out is None else out.unionByName(part)
    return out


@query("src_19_assignments", """
SELECT 'kmeans:na:k=' || k AS config_id, count(*) AS n, count(DISTINCT vec_id % k) AS n_clusters FROM embeddings CROSS JOIN (SELECT unnest([2,3,4,5]) AS k) GROUP BY 1""")
def _(spark, folder):
    path = scratch(spark, "assignments")
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("patient_id"), F.explode(F.array(*[F.lit(k) for k in (2, 3, 4, 5)])).alias("k"))
    a = e.select("patient_id", (F.col("patient_id") % F.col("k")).cast("int").alias("cluster"), F.lit("kmeans").alias("method"), F.lit(None).cast("string").alias("covariance_type"), "k", F.concat(F.lit("kmeans:na:k="), F.col("k").cast("string")).alias("config_id"))
    K.write_assignments(a, path)
    return spark.read.parquet(path).groupBy("config_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("n_clusters"))


@query("src_20_methylation", """
WITH w AS (SELECT p_partkey % 300 AS probe, p_type AS name, s_nationkey AS n, round(avg(l_tax), 8) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)
SELECT t.name AS feature, 'TCGA-AA-' || lpad(CAST(k AS VARCHAR), 4, '0') AS sample_id, round(avg(v), 6) AS value FROM (SELECT DISTINCT name FROM w) t CROSS JOIN range(25) n(k) LEFT JOIN w ON w.name = t.name AND w.n = k GROUP BY 1, 2""")
def _(spark, folder):
    path = scratch(spark, "methylation")
    li, p, s = (table(spark, folder, t) for t in ("lineitem", "part", "supplier"))
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    j.groupBy((F.col("p_partkey") % 300).alias("ENTITY_STABLE_ID"), F.col("p_type").alias("NAME")).agg(*[F.round(F.avg(F.when(F.col("s_nationkey") == n, F.col("l_tax"))), 8).alias(f"TCGA-AA-{n:04d}-01A") for n in range(25)]).write.csv(path, sep="\t", header=True)
    return R.read_methylation(spark, path).withColumn("value", r6("value"))


@query("src_21_networks", """
SELECT 'u' || (user_id) AS sample_id, 'n' || (event_id % 30) AS node, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id % 9 > 0 AND event_id % 30 > 1 AND event_type <> 'error' GROUP BY 1, 2""")
def _(spark, folder):
    path = scratch(spark, "networks")
    e = table(spark, folder, "events")
    i = F.col("event_id") % 30
    node = F.when(i == 0, "INPUT").when(i == 1, "Perturbation").otherwise(F.concat(F.lit("n"), i.cast("string")))
    docs = e.groupBy("user_id", (F.col("event_id") / 500).cast("int").alias("_part")).agg(F.collect_list(F.struct(node.alias("Node"), F.when(F.col("event_type") == "error", "bad").otherwise(F.col("value").cast("string")).alias("AvgAct"))).alias("a"))
    docs.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sample_id"), F.when(F.col("user_id") % 9 == 0, "fallback_threshold").otherwise("ilp").alias("mode"), F.struct(F.col("a").alias("nodesAttributes")).alias("result")).write.json(path)
    return R.read_networks(spark, path, multiline=False).groupBy("sample_id", "node").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("activity"), 4).alias("total"))
