"""Readers for wide assay text, clinical text, reference tables and nested documents.

Wide files become long rows straight after the scan: every line is unpivoted where it is read, so no
step after the scan sees more than four columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortgrid.functions import cleaning as C
from cohortgrid.operators.scans import exact_quantiles, keep_first, top_k


def _long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, "_raw").withColumn("value", C.number(F.col("_raw"))).drop("_raw")


def read_wide_matrix(spark: SparkSession, path: str, symbol: str = "Hugo_Symbol", drop: Sequence[str] = ("Entrez_Gene_Id",), collapse: str = "mean") -> DataFrame:
    """Tab-separated features-by-samples text with `#` comments to (sample_id, feature, value).

    Symbols are upper-cased; repeated symbols are averaged, or with `collapse="none"` kept.
    """
    raw = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    key = symbol if symbol in raw.columns else raw.columns[0]
    samples = [c for c in raw.columns if c != key and c not in drop and "entrez" not in c.lower()]
    named = raw.where(F.col(f"`{key}`").isNotNull()).select(F.upper(F.trim(F.col(f"`{key}`"))).alias("feature"), *[F.col(f"`{c}`") for c in samples])
    long = _long(named, ["feature"], samples, "sample_id")
    if collapse == "none":
        return long
    return long.groupBy("sample_id", "feature").agg(F.avg("value").alias("value"))


def read_gct(spark: SparkSession, path: str) -> DataFrame:
    """GCT text (two preamble lines, symbol in the second column, gzip or not) to long rows, symbols averaged."""
    lines = spark.read.text(path)
    head = lines.where(F.lower("value").startswith("name\tdescription\t")).first()
    if head is None:
        raise ValueError(f"no GCT header line in {path}")
    samples = head[0].split("\t")[2:]
    body = lines.where(~F.col("value").startswith("#") & ~F.col("value").rlike(r"^\d+\t\d+\s*$") & ~F.lower("value").startswith("name\tdescription\t"))
    cells = F.split("value", "\t")
    ids = F.array(*[F.lit(s) for s in samples])
    long = body.select(F.upper(cells[1]).alias("feature"), F.explode(F.arrays_zip(ids.alias("sample_id"), F.slice(cells, 3, len(samples)).alias("raw"))).alias("c"))
    return long.select("feature", "c.sample_id", C.number(F.col("c.raw")).alias("value")).groupBy("sample_id", "feature").agg(F.avg("value").alias("value"))


def read_series_metadata(spark: SparkSession, path: str, series: Sequence[str] = ()) -> DataFrame:
    """Series-matrix header lines to one row per sample: accession, title and one column per characteristic key.

    `series` are the columns of a partitioned path that tell its series apart: any number of them is one
    scan. Without them the path holds one series.
    """
    by = list(series)
    lines = spark.read.text(path).where(F.col("value").startswith("!Sample_")).select(*by, F.split("value", "\t").alias("cells"))
    cell = F.trim(F.regexp_replace(F.trim("cell"), '^"|"$', ""))
    rows = lines.select(*by, F.col("cells")[0].alias("line"), F.posexplode(F.slice("cells", F.lit(2), F.size("cells"))).alias("pos", "cell")).withColumn("cell", cell)
    plain = rows.where(F.col("line").isin("!Sample_geo_accession", "!Sample_title")).select(*by, "pos", F.when(F.col("line") == "!Sample_title", "title").otherwise("geo_accession").alias("key"), F.col("cell").alias("val"))
    ch = rows.where((F.col("line") == "!Sample_characteristics_ch1") & F.col("cell").contains(":"))
    at = F.instr("cell", ":")
    ch = ch.select(*by, "pos", F.replace(F.lower(F.trim(F.substring(F.col("cell"), F.lit(1), at - 1))), F.lit(" "), F.lit("_")).alias("key"), F.trim(F.substring(F.col("cell"), at + 1, F.length("cell"))).alias("val"))
    both = plain.unionByName(ch)
    keys = sorted(r[0] for r in both.select("key").distinct().collect())
    return both.groupBy(*by, "pos").pivot("key", keys).agg(F.max("val"))


def read_tagged(spark: SparkSession, paths: Sequence[str], tags: dict[str, str], numeric: Sequence[str], tag: str = "platform") -> DataFrame:
    """Union of CSV files with differing columns, a tag taken from the file path, and numeric text coerced."""
    out = None
    for p in paths:
        df = spark.read.csv(p, header=True, inferSchema=False).withColumn("_path", F.upper(F.col("_metadata.file_path")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    hit = F.lit("unknown")
    for word, value in reversed(list(tags.items())):
        hit = F.when(F.col("_path").contains(word.upper()), value).otherwise(hit)
    out = out.withColumn(tag, hit).drop("_path")
    return out.withColumns({c: C.number(F.col(c)) for c in numeric if c in out.columns})


TRIPLE = "gene_idx int, cell_idx int, value float"


def read_triples(spark: SparkSession, path: str, genes: DataFrame, cells: DataFrame, keep_cells: DataFrame | None = None, keep_genes: Sequence[str] | None = None) -> DataFrame:
    """Sparse (gene_idx, cell_idx, value) text joined to its dictionaries; filters act on the dictionaries first.

    `genes` is (gene_idx, feature), `cells` is (cell_idx, cell_id).
    """
    t = spark.read.schema(TRIPLE).csv(path)
    g = genes.select("gene_idx", F.upper("feature").alias("feature"))
    if keep_genes is not None:
        g = g.where(F.col("feature").isin([x.upper() for x in keep_genes]))
    c = cells.join(keep_cells.select("cell_id").distinct(), "cell_id", "left_semi") if keep_cells is not None else cells
    return t.join(g, "gene_idx").join(c, "cell_idx").select("cell_id", "feature", F.col("value").cast("double").alias("value"))


def build_atlas(counts: DataFrame, types: DataFrame, picked: DataFrame, max_features: int) -> tuple[DataFrame, DataFrame]:
    """Reference atlas: picked cells, repeated features averaged, the most variable features kept, types aligned."""
    c = counts.join(picked.select("cell_id").distinct(), "cell_id", "left_semi").groupBy("cell_id", "feature").agg(F.avg("value").alias("value"))
    var = c.groupBy("feature").agg(F.round(F.var_samp("value"), 10).alias("_v"))
    best = top_k(var, [], [F.col("_v").desc_nulls_last(), F.col("feature")], max_features, "_r").select("feature")
    ref = c.join(best, "feature", "left_semi")
    have = keep_first(types.join(picked.select("cell_id").distinct(), "cell_id", "left_semi"), ["cell_id"], [F.col("cell_type")]).select("cell_id", "cell_type")
    return ref.join(have.select("cell_id"), "cell_id", "left_semi"), have


def read_matrix_columns(spark: SparkSession, path: str, features: Sequence[str], key: str = "sig_id") -> tuple[DataFrame, str]:
    """Only the requested, existing feature columns of a wide columnar matrix, with a source tag."""
    df = spark.read.parquet(path)
    have = set(df.columns)
    cols = [f for f in dict.fromkeys(features) if f in have and f != key]
    if not cols:
        return df.select(key).limit(0), "unavailable"
    return df.select(key, *cols), "compact_matrix"


def read_reference_table(spark: SparkSession, path: str) -> DataFrame:
    """Pharmacokinetic table: legacy `drug` alias, normalised names, upper-case target, boolean text, numeric id, default slope."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    name = F.coalesce(*[F.col(c) for c in ("drug_name", "drug") if c in raw.columns])
    out = raw.withColumn("drug_name", C.compound_name(name)).withColumn("drug", F.col("drug_name"))
    fixes = {"target_gene": F.upper("target_gene"), "in_ode_topology": C.truth(F.col("in_ode_topology")), "nsc_id": C.number(F.col("nsc_id")), "ic50_nm": C.number(F.col("ic50_nm")), "cmax_nm": C.number(F.col("cmax_nm"))}
    out = out.withColumns({c: e for c, e in fixes.items() if c in raw.columns})
    return out.withColumn("h", F.coalesce(C.number(F.col("h")), F.lit(1.0)) if "h" in raw.columns else F.lit(1.0))


def read_pair_scores(spark: SparkSession, path: str, id_map: DataFrame, panel: str = "breast", **kw) -> DataFrame:
    """Combination screen: valid rows, one tissue panel where any row has it, median score per unordered pair, named.

    Column names match in any case; pairs whose two names are equal drop out.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = {c.upper(): c for c in raw.columns}
    d = raw.select(*[F.col(f"`{names[c]}`").alias(c) for c in ("NSC1", "NSC2", "SCORE", "PANEL", "VALID") if c in names])
    if "VALID" in names:
        d = d.where(F.upper(F.trim("VALID")) == "Y")
    if "PANEL" in names:
        at = F.coalesce(F.lower("PANEL").contains(panel), F.lit(False))
        some = d.select(F.coalesce(F.bool_or(at), F.lit(False))).scalar()
        d = d.where(~some | at)
    a, b = C.number(F.col("NSC1")).cast("long"), C.number(F.col("NSC2")).cast("long")
    d = d.select(F.least(a, b).alias("nsc_a"), F.greatest(a, b).alias("nsc_b"), C.number(F.col("SCORE")).alias("score")).where(a.isNotNull() & b.isNotNull() & F.col("score").isNotNull())
    med = exact_quantiles(d, ["nsc_a", "nsc_b"], "score", {"score": 0.5}, **kw)
    m = keep_first(id_map.withColumn("drug", C.compound_name(F.col("drug"))), ["nsc"], [F.col("drug")])
    out = med.join(m.select(F.col("nsc").alias("nsc_a"), F.col("drug").alias("drug_a")), "nsc_a").join(m.select(F.col("nsc").alias("nsc_b"), F.col("drug").alias("drug_b")), "nsc_b")
    return out.where(F.col("drug_a") != F.col("drug_b"))


def read_line_expression(spark: SparkSession, path: str, models: DataFrame, tissue: str, default_column: str = "IsDefaultEntryForModel") -> DataFrame:
    """Cell-line expression of one tissue: default entries, one row per model, ` (123)` cut from names, missing as 0."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    genes = [c for c in raw.columns if c.endswith(")")]
    ids = models.where(F.lower("lineage").contains(tissue.lower())).select("ModelID").distinct()
    d = raw.join(ids, "ModelID", "left_semi")
    if default_column in raw.columns:
        d = d.where(F.lower(default_column).isin("yes", "true", "1"))
    d = keep_first(d, ["ModelID"], [F.col("ModelID"), F.monotonically_increasing_id()])
    long = _long(d.select("ModelID", *[F.col(f"`{g}`") for g in genes]), ["ModelID"], genes, "feature")
    long = long.withColumn("feature", F.upper(F.regexp_replace("feature", r" \(\d+\)$", ""))).groupBy(F.col("ModelID").alias("sample_id"), "feature").agg(F.avg("value").alias("value"))
    return long.withColumn("value", F.coalesce("value", F.lit(0.0)))


def read_feature_subset(spark: SparkSession, path: str, keep: DataFrame, sep: str = ",") -> DataFrame:
    """Features-by-samples text reduced to wanted features before unpivoting; the first of repeated features wins."""
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    key, samples = raw.columns[0], raw.columns[1:]
    d = raw.withColumn("feature", F.upper(F.trim(F.col(f"`{key}`")))).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    d = d.join(keep.select(F.upper("feature").alias("feature")).distinct(), "feature", "left_semi")
    d = keep_first(d, ["feature"], [F.col("_at")]).select("feature", *[F.col(f"`{c}`") for c in samples])
    return _long(d, ["feature"], samples, "sample_id").withColumn("value", F.coalesce("value", F.lit(0.0)))


def extract_signatures(matrix: DataFrame, siginfo: DataFrame, compounds: DataFrame, gene_ids: DataFrame, panel: Sequence[str], wanted: DataFrame, kind: str = "trt_cp") -> tuple[DataFrame, DataFrame]:
    """Bulk reduction of a perturbation matrix: one perturbation kind, a cell panel, wanted genes, joined targets.

    `matrix` is long (sig_id, gene_id, value); returns (long compact matrix, signature metadata).
    """
    lines = [p.upper().replace("-", "").replace(" ", "").replace("_", "") for p in panel]
    s = siginfo.where(F.col("pert_type") == kind).withColumn("cell_norm", C.entity_key(F.col("cell_iname"))).where(F.col("cell_norm").isin(lines))
    t = compounds.where(F.col("target").isNotNull() & ~F.col("target").isin("", '""')).select(F.lower("cmap_name").alias("_n"), "target").distinct()
    t = t.groupBy("_n").agg(F.array_join(F.array_sort(F.collect_list("target")), ";").alias("targets"))
    meta = s.withColumn("_n", F.lower("cmap_name")).join(t, "_n", "left").select("sig_id", F.col("cmap_name").alias("drug"), F.col("cell_norm").alias("cell_id"), "targets")
    g = keep_first(gene_ids.withColumn("feature", F.upper(F.trim("feature"))), ["feature"], [F.col("gene_id")]).join(wanted.select(F.upper("feature").alias("feature")).distinct(), "feature", "left_semi")
    m = matrix.join(meta.select("sig_id"), "sig_id", "left_semi").join(g.select("gene_id", "feature"), "gene_id").select("sig_id", "feature", F.col("value").cast("float").alias("value"))
    return m, meta


MANIFEST = "path string, file_name string, length long, sha256 string, html boolean, placeholder boolean, verified boolean"


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Size, SHA-256 and masquerade checks per file.

    Only the listing comes from the file source; each file is hashed as a stream of blocks inside a
    task, so no file is held in memory.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")

    def inspect(batches):
        import hashlib

        from pyarrow import fs

        for b in batches:
            out = []
            for p, n in zip(b["path"], b["length"]):
                uri = p if "://" in p else "file://" + p.removeprefix("file:")
                system, inner = fs.FileSystem.from_uri(uri)
                digest, head = hashlib.sha256(), b""
                with system.open_input_stream(inner) as f:
                    while block := f.read(8 << 20):
                        head = head or block[:64]
                        digest.update(block)
                low = bytes(head).lstrip().lower()
                html = low.startswith(b"<") or b"<html" in low
                name = inner.rsplit("/", 1)[-1]
                held = "placeholder" in name.lower()
                out.append((p, name, int(n), digest.hexdigest(), html, held, n > 32 and not html and not held))
            yield pd.DataFrame(out, columns=["path", "file_name", "length", "sha256", "html", "placeholder", "verified"])

    return files.repartition("path").mapInPandas(inspect, MANIFEST)


def upsert(manifest: DataFrame, new: DataFrame, key: str = "source_key") -> DataFrame:
    """Replace manifest rows by key."""
    return manifest.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


BAD_NAMES = ["annot", "attribute", "gtf", "transcript_expression", "readme", "license"]
GOOD_NAMES = ["gene_expression", ".gct", "counts", "mrna", "raw.tar", "dose_response"]


def best_files(manifest: DataFrame, folder: Column) -> DataFrame:
    """One file per folder: not badly named, then well named, then largest; tiny, hidden, HTML and placeholder files never."""
    name = F.lower("file_name")

    def any_of(words: Sequence[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | name.contains(w)
        return hit.cast("int")

    real = manifest.where(~F.col("html") & ~F.col("placeholder") & (F.col("length") > 1024) & ~F.col("file_name").startswith("."))
    order = F.struct((1 - any_of(BAD_NAMES)).alias("a"), any_of(GOOD_NAMES).alias("b"), F.col("length").alias("c"), F.col("path").alias("d"))
    return real.groupBy(folder.alias("folder")).agg(F.max_by("path", order).alias("path"), F.max_by("file_name", order).alias("file_name"))


LEDGER = "ts timestamp, notebook string, gate string, value double, threshold double, direction string, passed boolean, status string, n long, min_n long, smoke_test boolean, note string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def read_evidence_set(spark: SparkSession, path: str) -> DataFrame:
    """Nested {entries: {symbol: {tier, source, kind}}} documents to (symbol, tier, source, kind) rows."""
    doc = spark.read.schema("schema string, entries map<string, struct<tier: string, source: string, kind: string>>").json(path, multiLine=True)
    return doc.select(F.explode("entries").alias("symbol", "e")).select("symbol", "e.*")


NETWORK = "sample_id string, mode string, result struct<nodesAttributes: array<struct<Node: string, node_alias: string, AvgAct: string>>>"


def read_networks(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Solved-network documents to (sample_id, node, activity); fallback documents and input nodes drop out."""
    docs = spark.read.schema(NETWORK).json(path, multiLine=multiline).where(F.coalesce("mode", F.lit("")) != "fallback_threshold")
    n = docs.select("sample_id", F.explode("result.nodesAttributes").alias("a")).select("sample_id", F.coalesce("a.Node", "a.node_alias").alias("node"), F.coalesce("a.AvgAct", F.lit("0")).alias("raw"))
    n = n.where(F.col("node").isNotNull() & ~F.col("node").isin("Perturbation", "INPUT")).withColumn("activity", F.col("raw").try_cast("double"))
    return n.where(F.col("activity").isNotNull()).select("sample_id", "node", "activity")


def read_methylation(spark: SparkSession, path: str, name: str = "NAME", drop: Sequence[str] = ("ENTITY_STABLE_ID", "DESCRIPTION", "TRANSCRIPT_ID")) -> DataFrame:
    """Probe-level text to mean per (sample, symbol) with 12-character sample keys."""
    raw = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    samples = [c for c in raw.columns if c != name and c not in drop]
    long = _long(raw.select(F.col(name).alias("feature"), *[F.col(f"`{c}`") for c in samples]), ["feature"], samples, "sample_id")
    return long.groupBy(F.substring("sample_id", 1, 12).alias("sample_id"), "feature").agg(F.avg("value").alias("value"))
