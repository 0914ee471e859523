"""Survival curves, log-rank tests and censoring weights from counts per distinct time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortgrid.functions.tails import chi2_pvalue
from cohortgrid.operators.scans import Scan, bh_q, clean, finite, place, running, scan_placed
from cohortgrid.operators.draws import shuffled_counts


def kaplan_meier(rows: DataFrame, keys: Sequence[str], time: str = "time", event: str = "event", **kw) -> DataFrame:
    """Curve steps per key: time, at_risk, events, survival, lower, upper (Greenwood, 1.96, clipped to [0, 1])."""
    d = rows.where(finite(time)).groupBy(*keys, time).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(event) > 0).alias("events"))
    placed = place(d, keys, [F.col(time)], kw.get("ranges"))
    s = scan_placed(placed, keys, {"at_risk": Scan("sum", F.col("_n"), back=True)})
    n, k = F.col("at_risk").cast("double"), F.col("events").cast("double")
    s = s.withColumn("_log", F.when((k > 0) & (k < n), F.log1p(-k / n)).otherwise(0.0)).withColumn("_dead", (k >= n).cast("int"))
    s = s.withColumn("_var", F.when((k > 0) & (k < n), k / (n * (n - k))).otherwise(0.0))
    s = scan_placed(s, keys, {"_cum": Scan("sum", F.col("_log")), "_cdead": Scan("max", F.col("_dead")), "_cvar": Scan("sum", F.col("_var"))})
    s = clean(s).withColumn("survival", F.when(F.col("_cdead") > 0, 0.0).otherwise(F.exp("_cum")))
    se = F.col("survival") * F.sqrt("_cvar")
    return s.select(*keys, time, "at_risk", "events", "survival", F.greatest(F.lit(0.0), F.col("survival") - 1.96 * se).alias("lower"),
                    F.least(F.lit(1.0), F.col("survival") + 1.96 * se).alias("upper"))


def km_summary(curve: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """Rows, events and the first time with survival at or under one half."""
    return curve.groupBy(*keys).agg(F.max("at_risk").alias("n"), F.sum("events").alias("n_events"), F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col(time))).alias("median"))


@F.pandas_udf(DoubleType())
def _quadratic(o_minus_e: pd.Series, cov: pd.Series) -> pd.Series:
    out = []
    for u, v in zip(o_minus_e, cov):
        u = np.asarray(u, float)
        m = np.asarray(v, float).reshape(len(u), len(u))
        out.append(float(u @ np.linalg.pinv(m, rcond=1e-10, hermitian=True) @ u))
    return pd.Series(out)


def logrank_parts(rows: DataFrame, keys: Sequence[str], groups: Sequence, group: str = "grp", time: str = "time", event: str = "event", **kw) -> DataFrame:
    """Per key: sizes, observed, expected and hypergeometric covariance over the listed groups.

    Everything after the first aggregation works on distinct times, with one column per group.
    """
    ks = list(keys)
    ok = rows.where(finite(time) & F.col(event).isNotNull() & F.col(group).isin(list(groups)))
    d = ok.groupBy(*ks, time).agg(
        *[F.count_if(F.col(group) == g).alias(f"_n{i}") for i, g in enumerate(groups)],
        *[F.count_if((F.col(group) == g) & (F.col(event) > 0)).alias(f"_d{i}") for i, g in enumerate(groups)])
    return _parts_of_counts(d, ks, len(groups), time, **kw)


def _parts_of_counts(d: DataFrame, ks: list[str], n_groups: int, time: str, **kw) -> DataFrame:
    """`logrank_parts` of rows and events per distinct time and group (_n0, _d0, ...)."""
    ids = range(n_groups)
    s = running(d, ks, [F.col(time)], {f"_r{i}": Scan("sum", F.col(f"_n{i}"), back=True) for i in ids}, **kw)
    risk = sum((F.col(f"_r{i}") for i in ids), F.lit(0)).cast("double")
    died = sum((F.col(f"_d{i}") for i in ids), F.lit(0)).cast("double")
    s = s.withColumn("_R", risk).withColumn("_D", died)
    scale = F.when(F.col("_R") > 1, F.col("_D") * (F.col("_R") - F.col("_D")) / (F.col("_R") - 1)).otherwise(0.0)
    s = s.withColumn("_w", F.when(F.col("_D") > 0, scale).otherwise(0.0))
    aggs = []
    for i in ids:
        aggs.append(F.sum(f"_n{i}").alias(f"size_{i}"))
        aggs.append(F.sum(f"_d{i}").alias(f"observed_{i}"))
        aggs.append(F.sum(F.when(F.col("_D") > 0, F.col(f"_r{i}") * F.col("_D") / F.col("_R")).otherwise(0.0)).alias(f"expected_{i}"))
        for j in ids:
            if j >= i:
                diag = F.col(f"_r{i}") / F.col("_R") if i == j else F.lit(0.0)
                aggs.append(F.sum(F.col("_w") * (diag - F.col(f"_r{i}") * F.col(f"_r{j}") / (F.col("_R") * F.col("_R")))).alias(f"v_{i}_{j}"))
    return s.groupBy(*ks).agg(*aggs) if ks else s.agg(*aggs)


def logrank(rows: DataFrame, keys: Sequence[str], groups: Sequence, **kw) -> DataFrame:
    """Log-rank statistic, df, p, n and events per key; fewer than two groups present gives 0, 0, 1."""
    return _logrank_of(logrank_parts(rows, keys, groups, **kw), keys, len(groups))


def _logrank_of(parts: DataFrame, keys: Sequence[str], n_groups: int) -> DataFrame:
    ids = range(n_groups)
    u = F.array(*[(F.col(f"observed_{i}") - F.col(f"expected_{i}")).cast("double") for i in ids])
    v = F.array(*[F.col(f"v_{min(i, j)}_{max(i, j)}").cast("double") for i in ids for j in ids])
    present = sum(((F.col(f"size_{i}") > 0).cast("int") for i in ids), F.lit(0))
    out = parts.withColumn("statistic", F.greatest(_quadratic(u, v), F.lit(0.0))).withColumn("df", F.greatest(present - 1, F.lit(0)))
    out = out.withColumn("statistic", F.when(F.col("df") > 0, F.col("statistic")).otherwise(0.0))
    out = out.withColumn("p", F.when(F.col("df") > 0, chi2_pvalue("statistic", F.col("df").cast("double"))).otherwise(1.0))
    return out.select(*keys, "statistic", "df", "p", sum((F.col(f"size_{i}") for i in ids), F.lit(0)).alias("n"), sum((F.col(f"observed_{i}") for i in ids), F.lit(0)).alias("n_events"))


def logrank_null(rows: DataFrame, groups: Sequence, n_perm: int, seed: int = 0, group: str = "grp", time: str = "time", event: str = "event", **kw) -> DataFrame:
    """(perm, statistic) when the group is shuffled over all rows, drawn from the rows per time and event."""
    ok = finite(time) & F.col(event).isNotNull()
    cells = rows.groupBy(F.when(ok, F.col(time)).alias("_time"), F.when(ok, F.col(event) > 0).alias("_dead")).agg(F.count(F.lit(1)).alias("n"))
    have = rows.agg(F.count(F.lit(1)), *[F.count_if(F.col(group) == g) for g in groups]).first()
    drawn = shuffled_counts(cells, ["_time", "_dead"], [*have[1:], have[0] - sum(have[1:])], n_perm, seed).where(F.col("_time").isNotNull())
    d = drawn.groupBy("perm", "_time").agg(
        *[F.sum(F.col(f"_c{i}")).alias(f"_n{i}") for i in range(len(groups))],
        *[F.sum(F.when(F.col("_dead"), F.col(f"_c{i}")).otherwise(0)).alias(f"_d{i}") for i in range(len(groups))])
    return _logrank_of(_parts_of_counts(d, ["perm"], len(groups), "_time", **kw), ["perm"], len(groups)).select("perm", "statistic")


def sensitivity_logrank(rows: DataFrame, config: str, groups: Sequence, **kw) -> DataFrame:
    """One log-rank per configuration with q over all of them; always exploratory."""
    t = logrank(rows, [config], groups, **kw)
    return bh_q(t, [], "p", [config]).withColumn("exploratory", F.lit(True))


def ipcw(rows: DataFrame, row: str, time: str = "time", event: str = "event", keys: Sequence[str] = (), clip: float = 20.0, **kw) -> DataFrame:
    """Inverse probability of censoring weights; censored rows weigh 0.

    The censoring curve steps row by row in (time, row) order; a row takes its value after all rows
    of the same time, floored at 1e-3, and weights are clipped.
    """
    ks = list(keys)
    placed = place(rows, ks, [F.col(time), F.col(row)], kw.get("ranges"))
    s = scan_placed(placed, ks, {"_risk": Scan("sum", F.lit(1).cast("long"), back=True)})
    cens = 1 - F.coalesce(F.col(event), F.lit(0))
    s = s.withColumn("_log", F.when((cens > 0) & (F.col("_risk") > 1), F.log1p(-1.0 / F.col("_risk"))).otherwise(0.0))
    s = s.withColumn("_zero", F.when((cens > 0) & (F.col("_risk") == 1), 1).otherwise(0))
    s = clean(scan_placed(s, ks, {"_cum": Scan("sum", F.col("_log")), "_z": Scan("max", F.col("_zero"))}))
    g = F.when(F.col("_z") > 0, 0.0).otherwise(F.exp("_cum"))
    at = s.groupBy(*ks, time).agg(F.min(g).alias("_g"))
    out = rows.join(at, [*ks, time])
    weight = F.when(F.col(event) > 0, 1.0 / F.greatest(F.col("_g"), F.lit(1e-3))).otherwise(0.0)
    return out.withColumn("weight", F.least(weight, F.lit(clip))).drop("_g")


def endpoints(clinical: DataFrame, ids: DataFrame, pairs: dict[str, tuple[str, str]], key: str = "sample_id") -> DataFrame:
    """(sample, endpoint, time, event) for each endpoint whose two columns exist; no time means no event."""
    from cohortgrid.functions.cleaning import event_flag, number

    entries = []
    for name, (months, status) in pairs.items():
        if months in clinical.columns and status in clinical.columns:
            t = number(F.col(months))
            entries.append(F.struct(F.lit(name).alias("endpoint"), t.alias("time"), F.when(t.isNull(), 0.0).otherwise(event_flag(F.col(status))).alias("event")))
    if not entries:
        return ids.select(key).limit(0).select(key, F.lit("").alias("endpoint"), F.lit(None).cast("double").alias("time"), F.lit(0.0).alias("event"))
    j = ids.select(key).join(clinical, key, "left")
    return j.select(key, F.inline(F.array(*entries)))
