"""Ranks, percentiles, margins, strata and latest-record picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgrid.operators.scans import Scan, average_ranks, exact_quantiles, place, ranked, running, scan_placed, clean, top_k
from cohortgrid.session import cut_lineage


def rank_percentile(df: DataFrame, score: str, ties: Sequence[str], keys: Sequence[str] = (), **kw) -> DataFrame:
    """Rank downwards by score and percentile 1 - (rank-1)/max(n-1, 1)."""
    r = ranked(df, keys, [-F.col(score), *[F.col(t) for t in ties]], "rank", total="_n", **kw)
    return r.withColumn("percentile", 1.0 - (F.col("rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_n")


def midrank_percentile(df: DataFrame, score: str, keys: Sequence[str] = (), name: str = "percentile", **kw) -> DataFrame:
    """(average rank - 0.5) / n per key."""
    r = average_ranks(df, keys, score, **kw).select(*keys, score, ((F.col("avg_rank") - 0.5) / F.col("n_group")).alias(name))
    return df.join(r, [*keys, score], "left")


def empirical_percentile(values: DataFrame, reference: DataFrame | None, value: str, keys: Sequence[str] = (), name: str = "percentile", **kw) -> DataFrame:
    """(reference values below + half of those equal) / reference count, per key.

    Both sides go through one ordered scan over distinct values, so no pair is formed. Without a reference
    the values are their own. They are written once: values worked out again may differ in the last digit
    and then meet nothing.
    """
    k, values = list(keys), cut_lineage(values)
    reference = values if reference is None else reference
    ref = reference.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*k, value).agg(F.count(F.lit(1)).alias("_n"))
    mine = values.select(*k, value).where(F.col(value).isNotNull() & ~F.isnan(value)).distinct().withColumn("_n", F.lit(0).cast("long"))
    both = ref.unionByName(mine).groupBy(*k, value).agg(F.sum("_n").alias("_n"))
    s = running(both, k, [F.col(value)], {"_upto": Scan("sum", F.col("_n"))}, {"_all": F.col("_n")}, **kw)
    p = s.where(F.col("_all") > 0).select(*k, value, ((F.col("_upto") - F.col("_n") + 0.5 * F.col("_n")) / F.col("_all")).alias(name))
    return values.join(p, [*k, value], "left")


def class_ranks(df: DataFrame, cls: str, order: Sequence[Column], rank: str = "nomination_rank", class_rank: str = "support_rank", **kw) -> DataFrame:
    """Global rank and rank within class over the same order."""
    return ranked(ranked(df, [], order, rank, **kw), [cls], order, class_rank, **kw)


def quantile_bins(df: DataFrame, value: str, n: int, keys: Sequence[str] = (), name: str = "bin", **kw) -> DataFrame:
    """Bin number by quantile edges (a value on an edge stays in the lower bin); equal edges collapse."""
    probs = {f"_e{i}": i / n for i in range(1, n)}
    edges = exact_quantiles(df, keys, value, probs, **kw)
    packed = edges.select(*keys, F.array_distinct(F.array(*probs)).alias("_edges"))
    if keys:
        j = df.join(packed, list(keys), "left")
    else:
        j = df.withColumn("_edges", packed.scalar())
    return j.withColumn(name, F.size(F.filter("_edges", lambda e: F.col(value) > e))).drop("_edges")


def lead_margin(scores: DataFrame, key: Sequence[str], score: str, item: str) -> DataFrame:
    """Best item per key and its lead over the second best."""
    t = top_k(scores, key, [F.col(score).desc(), F.col(item)], 2, "_r")
    best, second = F.max(F.when(F.col("_r") == 1, F.col(score))), F.max(F.when(F.col("_r") == 2, F.col(score)))
    return t.groupBy(*key).agg(F.max(F.when(F.col("_r") == 1, F.col(item))).alias("best"), best.alias("best_score"), (best - second).alias("margin"))


def flag_leader(rows: DataFrame, metric: str, flag: str, key: str, margin: float = 0.25) -> DataFrame:
    """Mark the row leading a small table on `metric` when its lead reaches `margin`."""
    two = top_k(rows.select(key, metric), [], [F.col(metric).desc(), F.col(key)], 2, "_r")
    top = two.agg(F.max(F.when(F.col("_r") == 1, F.col(key))).alias("_lead"),
                  (F.max(F.when(F.col("_r") == 1, F.col(metric))) - F.max(F.when(F.col("_r") == 2, F.col(metric)))).alias("_gap"))
    lead = top.select(F.when(F.col("_gap") >= margin, F.col("_lead"))).scalar()
    return rows.withColumn(flag, F.coalesce(F.col(key) == lead, F.lit(False)))


def rebound(series: DataFrame, key: str = "entity", t: str = "t", value: str = "value") -> DataFrame:
    """Series that fall and come back: end > 1.5 x trough and > 1.2 x start, trough above zero."""
    s = series.groupBy(key).agg(F.min_by(value, t).alias("start"), F.max_by(value, t).alias("end"), F.min(value).alias("trough"))
    hit = (F.col("trough") > 0) & (F.col("end") > 1.5 * F.col("trough")) & (F.col("end") > 1.2 * F.col("start"))
    return s.withColumn("rebound", hit)


ASSESSMENT_ORDER = ["potentially_eligible", "insufficient_information", "potentially_ineligible"]


def rank_matches(matches: DataFrame, **kw) -> DataFrame:
    """Order study matches by assessment, known criteria, status, evidence tier, site tier, distance."""
    pos = F.array_position(F.array(*[F.lit(a) for a in ASSESSMENT_ORDER]), F.col("assessment"))
    assessed = F.when(pos > 0, pos - 1).otherwise(3)
    status = F.lower(F.coalesce("status", F.lit("")))
    state = F.when(status.contains("recruit"), 0).when(status.contains("not yet"), 1).otherwise(2)
    bonus = F.when(F.col("evidence_tier").startswith("tier_a"), -2).when(F.col("evidence_tier").startswith("tier_b"), -1).otherwise(0)
    distance = F.when(F.col("distance_km") != 0, F.col("distance_km")).otherwise(F.lit(1e9))
    order = [assessed, -F.col("n_known"), state, bonus, F.coalesce(F.col("site_tier"), F.lit(99)), F.coalesce(distance, F.lit(1e9)), F.col("study_id")]
    return ranked(matches, [], order, "position", **kw)


def latest_records(ledger: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], renamed: dict[str, str] | None = None, name: str | None = None) -> DataFrame:
    """Last record per key; a key missing under its new name is served from the old one."""
    last = ledger.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("_l"), F.max(ts).alias(ts)).select(*keys, ts, "_l.*")
    for old, new in (renamed or {}).items():
        rest = [k for k in keys if k != name]
        have = last.where(F.col(name) == new)
        moved = last.where(F.col(name) == old).withColumn(name, F.lit(new))
        if rest:
            moved = moved.join(have.select(*rest), rest, "left_anti")
        else:
            moved = moved.where(have.select(F.count(F.lit(1))).scalar() == 0)
        last = last.unionByName(moved)
    return last
