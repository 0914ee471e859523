"""Dictionary unions, missing keys, panels and signed edge sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgrid.functions.cleaning import compound_name, truth
from cohortgrid.operators.scans import keep_first

INPUT_NODE = "INPUT"


def first_source_wins(sources: Sequence[DataFrame], key: str = "nsc", name: str = "drug") -> DataFrame:
    """Union of (key, name) dictionaries with normalised names; an earlier source, then the lower name, wins."""
    parts = []
    for i, s in enumerate(sources):
        parts.append(s.select(F.col(key).try_cast("long").alias(key) if dict(s.dtypes)[key] == "string" else F.col(key).cast("long").alias(key),
                              compound_name(F.col(name)).alias(name), F.lit(i).alias("_p")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where(F.col(key).isNotNull() & (F.length(name) > 0))
    return keep_first(every, [key], [F.col("_p"), F.col(name)]).drop("_p")


def source_only(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).subtract(edges.select(F.col("target").alias("node")))


def ensure_source(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Attach an input node to the seeds present in the graph when no node is source-only."""
    n = source_only(edges).select(F.count(F.lit(1))).scalar()
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    present = seeds.select("node").distinct().join(nodes, "node", "left_semi").where(n == 0)
    extra = present.select(F.lit(INPUT_NODE).alias("source"), F.col("node").alias("target"), F.lit(1).alias("sign"), F.lit(1).cast("long").alias("n_references"))
    return edges.select("source", "target", F.col("sign").cast("int"), F.col("n_references").cast("long")).unionByName(extra)


def missing_keys(required: DataFrame, manifest: DataFrame, key: str = "dataset") -> DataFrame:
    """Required keys without a verified manifest row."""
    return required.select(key).distinct().join(manifest.where(F.col("verified")).select(key), key, "left_anti")


def signed_edges(raw: DataFrame, literature: DataFrame | None = None) -> DataFrame:
    """Agreed edges that are exactly one of stimulating and inhibiting, without self-loops, one row each.

    Literature edges come first, so their reference counts stay. `raw` has source, target,
    is_stimulation, is_inhibition, consensus_direction, n_references.
    """
    stim, inh = F.coalesce("is_stimulation", F.lit(False)), F.coalesce("is_inhibition", F.lit(False))
    ok = F.coalesce("consensus_direction", F.lit(False)) & (stim != inh) & (F.col("source") != F.col("target"))
    ok = ok & (F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "")
    edges = raw.where(ok).select("source", "target", F.when(stim, 1).otherwise(-1).alias("sign"), F.coalesce(F.col("n_references").cast("long"), F.lit(1)).alias("n_references"), F.lit(1).alias("_p"))
    if literature is not None:
        edges = literature.select("source", "target", F.col("sign").cast("int"), F.lit(10).cast("long").alias("n_references"), F.lit(0).alias("_p")).unionByName(edges)
    return keep_first(edges, ["source", "target", "sign"], [F.col("_p"), F.col("n_references").desc()]).drop("_p")


def panel_sets(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """(feature, kind): panel features in the universe, and the pool of universe features outside the panel."""
    p, u = panel.select("feature"), universe.select("feature")
    shared = p.intersect(u).withColumn("kind", F.lit("panel"))
    return shared.unionByName(u.subtract(p).withColumn("kind", F.lit("pool")))
