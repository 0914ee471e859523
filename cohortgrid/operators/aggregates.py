"""Grouped summaries over measurements, scores, labels and edges."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgrid.functions import cleaning as C
from cohortgrid.operators.scans import attach_row, exact_quantiles, keep_first, ranked, top_k
from cohortgrid.session import cut_lineage


def collapse_mean(df: DataFrame, keys: Sequence[str] = ("sample_id", "feature")) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("value").alias("value"))


def collapse_first(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("sample_id", "feature")) -> DataFrame:
    return keep_first(df, keys, order)


def reference_stats(df: DataFrame) -> DataFrame:
    """Mean and sample deviation per feature; a zero deviation is no deviation."""
    sd = F.stddev_samp("value")
    return df.groupBy("feature").agg(F.avg("value").alias("mean"), F.when(sd != 0, sd).alias("sd"), F.count("value").alias("n"))


def centroids(z: DataFrame, group: str = "cluster", value: str = "value") -> DataFrame:
    return z.groupBy(group, "feature").agg(F.avg(value).alias("value"))


def compound_rollup(scores: DataFrame, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Signature scores (drug, cell_id, targets, reversal_score) per canonical compound, ranked by best score.

    With `keys`, one roll-up and ranking per key.
    """
    k = [*keys, "canonical"]
    s = scores.where(F.col("reversal_score").isNotNull()).withColumn("canonical", C.compound_name_short(F.col("drug"))).withColumn("reversal_score", F.round("reversal_score", 12))
    base = s.groupBy(*k).agg(
        F.min("drug").alias("drug"), F.max("reversal_score").alias("reversal_score"), F.count("reversal_score").alias("n_signatures"),
        F.count_distinct("cell_id").alias("n_cell_lines"), F.avg((F.col("reversal_score") > 0).cast("double")).alias("consistency"))
    out = base.join(exact_quantiles(s, k, "reversal_score", {"median_score": 0.5}, **kw), k)
    return _ranked_compounds(out, s, keys, **kw)


def _ranked_compounds(out: DataFrame, s: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """Compounds with the targets of their signatures, ranked within the keys."""
    k, none = [*keys, "canonical"], F.array().cast("array<string>")
    if "targets" in s.columns:
        names = s.select(*k, F.explode(F.split("targets", ";")).alias("_t")).where(F.col("_t") != "").distinct()
        out = out.join(names.groupBy(*k).agg(F.array_sort(F.collect_list("_t")).alias("targets")), k, "left").withColumn("targets", F.coalesce("targets", none))
    else:
        out = out.withColumn("targets", none)
    from cohortgrid.operators.windows import rank_percentile

    return rank_percentile(out, "reversal_score", ["canonical"], list(keys), **kw).withColumn("source", F.lit("compact_gctx"))


def compound_rollup_counts(counts: DataFrame, keys: Sequence[str] = (), **kw) -> DataFrame:
    """As `compound_rollup`, of rows that stand for several signatures (drug, cell_id, targets, best, n, n_positive); without the median."""
    k = [*keys, "canonical"]
    s = counts.withColumn("canonical", C.compound_name_short(F.col("drug")))
    out = s.groupBy(*k).agg(
        F.min("drug").alias("drug"), F.round(F.max("best"), 12).alias("reversal_score"), F.sum("n").alias("n_signatures"),
        F.count_distinct("cell_id").alias("n_cell_lines"), (F.sum("n_positive") / F.sum("n")).alias("consistency"))
    return _ranked_compounds(out, s, keys, **kw)


def median_ranking(scores: DataFrame, minimum: int = 2, **kw) -> DataFrame:
    """Median score per drug over at least `minimum` signatures, ranked downwards; ties (12 digits) go by name."""
    med = exact_quantiles(scores, ["drug"], "reversal_score", {"reversal_score": 0.5}, count="n_signatures", **kw)
    kept = med.where(F.col("n_signatures") >= minimum)
    return ranked(kept, [], [-F.round("reversal_score", 12), F.col("drug")], **kw)


def composition(rows: DataFrame, groups: Sequence, vocabulary: Sequence, group: str = "cluster", label: str = "subtype") -> DataFrame:
    """Share of each vocabulary label inside each group; other labels are left out, absent ones are 0.

    A group without any vocabulary row has null shares. The grid is built from the two lists, one
    counter column per label.
    """
    kept = rows.where(F.col(group).isin(list(groups)) & F.col(label).isin(list(vocabulary)))
    counts = kept.groupBy(group).agg(*[F.count_if(F.col(label) == v).alias(f"_{i}") for i, v in enumerate(vocabulary)])
    every = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(g) for g in groups])).alias(group))
    wide = every.join(counts, group, "left")
    total = sum((F.col(f"_{i}") for i in range(len(vocabulary))), F.lit(0))
    cells = F.array(*[F.struct(F.lit(v).alias(label), (F.col(f"_{i}") / total).alias("share")) for i, v in enumerate(vocabulary)])
    return wide.select(group, F.inline(cells))


def annotate_groups(expr: DataFrame, labels: DataFrame, markers: dict[str, str], proliferation: Sequence[str], margin: float = 0.25) -> DataFrame:
    """Per cluster: size, marker means, mean of proliferation means, majority subtype, leader flags.

    A flag is set only for a leader that clears the runner-up by `margin`. `labels` is (sample_id,
    cluster, subtype); `markers` maps an output name to its feature.
    """
    size = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    wanted = [*markers.values(), *proliferation]
    means = expr.where(F.col("feature").isin(wanted)).join(labels.select("sample_id", "cluster"), "sample_id").groupBy("cluster", "feature").agg(F.avg("value").alias("_m"))
    cols = [F.coalesce(F.max(F.when(F.col("feature") == f, F.col("_m"))), F.lit(0.0)).alias(name) for name, f in markers.items()]
    cols.append(F.coalesce(F.avg(F.when(F.col("feature").isin(list(proliferation)), F.col("_m"))), F.lit(0.0)).alias("prolif_mean"))
    counts = labels.where(F.col("subtype").isNotNull()).groupBy("cluster", "subtype").agg(F.count(F.lit(1)).alias("_n"))
    major = keep_first(counts, ["cluster"], [F.col("_n").desc(), F.col("subtype")]).select("cluster", F.col("subtype").alias("majority"))
    out = size.join(means.groupBy("cluster").agg(*cols), "cluster", "left").join(major, "cluster", "left")
    from cohortgrid.operators.windows import flag_leader

    for name in [*markers, "prolif_mean"]:
        out = flag_leader(out, name, f"{name}_leads", "cluster", margin)
    return out


def effect_matrix(profiles: DataFrame, clusters: Sequence[int], quotas: dict[str, int]) -> DataFrame:
    """Features by clusters with effect and q; per family only its strongest rows by largest absolute effect."""
    strength = profiles.groupBy("feature", "family").agg(F.max(F.abs("effect")).alias("strength"))
    picked = None
    for family, quota in quotas.items():
        part = top_k(strength.where(F.col("family") == family), [], [F.col("strength").desc(), F.col("feature")], quota, "position")
        picked = part if picked is None else picked.unionByName(part)
    rows = profiles.join(picked.select("feature", "family", "position"), ["feature", "family"])
    cells = []
    for c in clusters:
        at = F.col("cluster") == c
        cells.append(F.coalesce(F.max(F.when(at, F.col("effect"))), F.lit(0.0)).alias(f"effect_{c}"))
        cells.append(F.coalesce(F.max(F.when(at, F.col("q"))), F.lit(1.0)).alias(f"q_{c}"))
    return rows.groupBy("family", "position", "feature").agg(*cells)


def significant_counts(profiles: DataFrame, family: str, q: float = 0.05) -> DataFrame:
    """Significant features per cluster, clusters without any included, with the minimum over clusters."""
    hit = (F.col("family") == family) & (F.col("q") < q)
    per = profiles.groupBy("cluster").agg(F.count_if(hit).alias("n_significant"))
    return per.withColumn("minimum", per.select(F.min("n_significant")).scalar())


SET_BLOCK = 2_048
_TILE_SALTS = 16


def _co_occurrence(coded: DataFrame, n_sets: int) -> DataFrame:
    """(i, j, n): members shared by each pair of sets i < j that share any, from (member, sets ARRAY of positions).

    Pairs of set blocks are tiles. A task meets its rows tile by tile, counts each tile as a matrix
    product in memory of fixed size, and hands on one row per pair of sets, not per member.
    """
    blocks, width = -(-n_sets // SET_BLOCK), min(SET_BLOCK, n_sets)

    def part(b: Column) -> Column:
        return F.filter("sets", lambda x: F.floor(x / SET_BLOCK) == b)

    have = F.array_sort(F.array_distinct(F.transform("sets", lambda x: F.floor(x / SET_BLOCK).cast("int"))))
    t = coded.withColumn("bi", F.explode(have)).withColumn("_have", have)
    t = t.withColumn("bj", F.explode(F.filter("_have", lambda x: x >= F.col("bi")))).select("bi", "bj", part(F.col("bi")).alias("a"), part(F.col("bj")).alias("b"), F.pmod(F.xxhash64("member"), F.lit(_TILE_SALTS)).alias("salt"))
    if blocks > 1:
        t = t.repartition("bi", "bj", "salt").sortWithinPartitions("bi", "bj")

    def count(batches):
        tile, acc = None, None

        def done(tile, acc):
            i, j = np.nonzero(acc)
            i, j, n = i + tile[0] * SET_BLOCK, j + tile[1] * SET_BLOCK, acc[i, j]
            keep = i < j
            return pd.DataFrame({"i": i[keep].astype(np.int32), "j": j[keep].astype(np.int32), "n": n[keep].astype(np.int64)})

        for b in batches:
            for key, rows in b.groupby(["bi", "bj"], sort=True):
                if key != tile:
                    if tile is not None:
                        yield done(tile, acc)
                    tile, acc = key, np.zeros((width, width))
                for start in range(0, len(rows), 1_024):
                    cut = rows.iloc[start:start + 1_024]
                    left, right = (np.zeros((len(cut), width), dtype=np.float32) for _ in range(2))
                    for r, (x, y) in enumerate(zip(cut["a"], cut["b"])):
                        left[r, np.asarray(x) - key[0] * SET_BLOCK] = 1.0
                        right[r, np.asarray(y) - key[1] * SET_BLOCK] = 1.0
                    acc += left.T @ right
        if tile is not None:
            yield done(tile, acc)

    return t.drop("salt").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def set_variation(members: DataFrame) -> DataFrame:
    """Sizes, pairwise Jaccard summary, union, core and singletons over (set_id, member); one row.

    Pairs of sets that share nothing are only counted, not listed.
    """
    m = members.select("set_id", "member").distinct()
    order = ranked(m.groupBy("set_id").agg(F.count(F.lit(1)).alias("size")), [], [F.col("set_id")], "idx")
    order = cut_lineage(order.select("set_id", "size", (F.col("idx") - 1).cast("int").alias("idx")))
    n_sets = order.count()
    coded = m.join(order.select("set_id", "idx"), "set_id").groupBy("member").agg(F.collect_list("idx").alias("sets"))
    inter = _co_occurrence(coded, n_sets)
    a = order.select(F.col("idx").alias("i"), F.col("size").alias("si"))
    b = order.select(F.col("idx").alias("j"), F.col("size").alias("sj"))
    jac = inter.join(a, "i").join(b, "j").select((F.col("n") / (F.col("si") + F.col("sj") - F.col("n"))).alias("jaccard"))
    counted = cut_lineage(jac.groupBy("jaccard").agg(F.count(F.lit(1)).alias("w")))
    apart = counted.agg(F.lit(0.0).alias("jaccard"), (F.lit(n_sets * (n_sets - 1) // 2) - F.coalesce(F.sum("w"), F.lit(0))).cast("long").alias("w"))
    every = counted.unionByName(apart).where(F.col("w") > 0)
    w, j = F.col("w"), F.col("jaccard")
    pairs = every.agg((F.sum(w * j) / F.sum(w)).alias("jaccard_mean"), F.min(j).alias("jaccard_min"), F.max(j).alias("jaccard_max"), (F.sum(F.when(j > 0.8, w).otherwise(0)) / F.sum(w)).alias("share_over_08"))
    out = order.agg(F.count(F.lit(1)).alias("n_sets"), F.avg("size").alias("size_mean"), F.min("size").alias("size_min"), F.max("size").alias("size_max"))
    use = m.groupBy("member").agg(F.count(F.lit(1)).alias("k")).agg(
        F.count(F.lit(1)).alias("union_size"), F.count_if(F.col("k") == n_sets).alias("core_size"), F.count_if(F.col("k") == 1).alias("singletons"))
    for part in (pairs, exact_quantiles(every, [], "jaccard", {"jaccard_median": 0.5}, weight="w"), use):
        out = attach_row(out, part)
    return out.withColumn("informative", (F.col("n_sets") >= 2) & (F.col("jaccard_mean") < 0.8))


def essentiality_summary(scores: DataFrame, chosen: DataFrame, threshold: float = -0.5, pan_share: float = 0.5, **kw) -> DataFrame:
    """Positives per chosen entity after leaving out features below the threshold in half of all entities."""
    flagged = scores.withColumn("_pos", F.col("value") < threshold)
    pan = flagged.groupBy("feature").agg(F.avg(F.col("_pos").cast("double")).alias("_share")).where(F.col("_share") >= pan_share)
    n_pan = pan.select(F.count(F.lit(1))).scalar()
    per = flagged.join(chosen.select("sample_id").distinct(), "sample_id", "left_semi").join(pan.select("feature", F.lit(True).alias("_pan")), "feature", "left")
    per = per.groupBy("sample_id").agg(F.count_if(F.col("_pan").isNull() & F.col("_pos")).alias("positives"))
    med = exact_quantiles(per, [], "positives", {"median": 0.5}, **kw)
    ends = per.agg(F.count(F.lit(1)).alias("n_entities"), F.min("positives").alias("minimum"), F.max("positives").alias("maximum"))
    return attach_row(ends, med).withColumn("n_pan", n_pan).withColumn("degenerate", F.col("minimum") < 10)


def completeness(activity: DataFrame) -> DataFrame:
    finite = F.col("value").isNotNull() & ~F.isnan("value")
    return activity.groupBy("feature").agg(F.avg(finite.cast("double")).alias("completeness"))


def silencing_reliability(regulons: DataFrame, methylation: DataFrame | None, expression: DataFrame | None = None, threshold: float = 0.6, **kw) -> DataFrame:
    """Per regulator whether its targets look silenced: high, low, unknown (no target measured) or unavailable.

    `regulons` is (regulator, target).
    """
    reg = regulons.select("regulator", "target").distinct()
    if methylation is None:
        return reg.groupBy("regulator").agg(F.count(F.lit(1)).alias("n_regulon")).select(
            "regulator", F.lit("unavailable").alias("reliability"), F.lit(None).cast("double").alias("silenced_fraction"), "n_regulon")
    meth = methylation.groupBy("feature").agg(F.avg((F.coalesce(F.col("value"), F.lit(float("-inf"))) >= threshold).cast("double")).alias("_sil"))
    j = reg.join(meth, reg["target"] == meth["feature"], "left").drop("feature")
    if expression is not None:
        em = expression.groupBy("feature").agg(F.avg("value").alias("_rna"))
        j = j.join(em, j["target"] == em["feature"], "left").drop("feature")
    else:
        j = j.withColumn("_rna", F.lit(None).cast("double"))
    measured = F.col("_sil").isNotNull()
    g = j.groupBy("regulator").agg(F.count(F.lit(1)).alias("_all"), F.count_if(measured).alias("_present"), F.avg("_sil").alias("silenced_fraction"),
                                   F.avg(F.when(measured, F.col("_rna"))).alias("_rna_mean"))
    silenced = F.col("silenced_fraction") >= 0.5
    if expression is not None:
        mid = exact_quantiles(expression, [], "value", {"_m": 0.5}, **kw).scalar()
        silenced = silenced & F.coalesce(F.col("_rna_mean") < mid, F.lit(False))
    state = F.when(F.col("_present") == 0, "unknown").when(silenced, "low").otherwise("high")
    return g.select("regulator", state.alias("reliability"), "silenced_fraction",
                    F.when(F.col("_present") == 0, F.col("_all")).otherwise(F.col("_present")).alias("n_regulon"))


def pair_frequency(pairs: DataFrame, **kw) -> DataFrame:
    """How many pairs each drug is in, most first."""
    each = pairs.select(F.explode(F.array("drug_a", "drug_b")).alias("drug")).groupBy("drug").agg(F.count(F.lit(1)).alias("n_pairs"))
    return ranked(each, [], [-F.col("n_pairs"), F.col("drug")], **kw)


def covered_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Number of pairs of two different drugs that are both in the known table."""
    names = known.select(F.col("drug").alias("_k")).distinct()
    kept = pairs.where(F.col("drug_a") != F.col("drug_b"))
    kept = kept.join(names, kept["drug_a"] == names["_k"], "left_semi").join(names, F.col("drug_b") == names["_k"], "left_semi")
    return kept.agg(F.count(F.lit(1)).alias("n_covered"))


def censoring_summary(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("long")).alias("n_events"), F.avg(F.col("event").cast("double")).alias("event_rate"),
        F.avg((F.col("event") == 0).cast("double")).alias("censored_rate"), F.avg("time").alias("mean_time"))


def degeneracy(labels: DataFrame, column: str = "cluster", limit: float = 0.80) -> DataFrame:
    """Assignment counts with the largest group's share and whether it passes the limit."""
    c = labels.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = c.select(F.sum("n")).scalar()
    top = c.select(F.max("n")).scalar()
    return c.withColumn("share", F.col("n") / total).withColumn("largest_share", top / total).withColumn("degenerate", F.col("largest_share") > limit)


def subtype_concordance(pairs: DataFrame, minimum: float = 0.40) -> DataFrame:
    """Share of equal labels in (a, b) against the majority share of b."""
    p = pairs.select(C.subtype_label(F.col("a")).alias("a"), C.subtype_label(F.col("b")).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != "") & (F.col("b") != ""))
    per = p.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("k"))
    out = per.agg(F.sum("n").alias("n"), F.sum("k").alias("_k"), F.max("n").alias("_top"), F.count(F.lit(1)).alias("_labels"))
    conc = F.coalesce(F.col("_k") / F.col("n"), F.lit(0.0))
    return out.select(conc.alias("concordance"), F.greatest(F.col("_top") / F.col("n"), 1.0 / F.col("_labels")).alias("chance"), "n", (conc >= minimum).alias("passed"))


def blend_percentiles(probabilities: DataFrame, tables: DataFrame) -> DataFrame:
    """Probability-weighted percentile per (profile, drug) over the clusters that list the drug.

    `probabilities` is (profile_id, cluster, probability); `tables` is (cluster, drug, percentile, drug_rank).
    """
    best = keep_first(tables, ["cluster", "drug"], [F.col("drug_rank"), F.col("percentile").desc()]).select("cluster", "drug", "percentile")
    j = probabilities.join(best, "cluster").groupBy("profile_id", "drug").agg(
        F.sum(F.col("probability") * F.col("percentile")).alias("_w"), F.sum("probability").alias("_p"), F.count(F.lit(1)).alias("clusters_with_data"))
    return j.where(F.col("_p") > 0).select("profile_id", "drug", (F.col("_w") / F.col("_p")).alias("blended_percentile"), "clusters_with_data")


STANCES = ["supporting", "conflicting", "neutral", "unclear"]


def stance_tally(citations: DataFrame, by: str) -> DataFrame:
    """Stance counts per subject with the dominant one; ties go to the earlier stance, others count as unclear."""
    s = F.when(F.col("stance").isin(STANCES), F.col("stance")).otherwise("unclear")
    g = citations.withColumn("_s", s).groupBy(by).agg(F.count(F.lit(1)).alias("n_references"), *[F.count_if(F.col("_s") == x).alias(x) for x in STANCES])
    top = F.greatest(*STANCES)
    dominant = F.coalesce(*[F.when(F.col(x) == top, F.lit(x)) for x in STANCES])
    return g.withColumn("dominant_stance", dominant)
