"""Classifier metrics, labeling agreement, silhouette and the choice of k."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortgrid.operators.blocks import dense, meet
from cohortgrid.operators.filters import drawn
from cohortgrid.operators.scans import Scan, attach_row, keep_first, ranked, running
from cohortgrid.operators.stats import rank_sums

BIC_WINDOW = 10.0
STABILITY_FLOOR = 0.60


def auroc(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Area under the ROC curve from rank sums, with counts; null when a class is missing."""
    k = list(keys) or ["_k"]
    d = df if keys else df.withColumn("_k", F.lit(0))
    d = d.where(F.col(label).isNotNull()).withColumn("_y", (F.col(label) > 0).cast("int"))
    s = rank_sums(d, k, score, "_y", **kw).where(F.col("_y") == 1)
    n1, n2 = F.col("n_in").cast("double"), (F.col("n_all") - F.col("n_in")).cast("double")
    out = s.select(*k, F.when(n2 > 0, (F.col("rank_sum") - n1 * (n1 + 1) / 2) / (n1 * n2)).alias("auroc"), F.col("n_all").alias("n"), F.col("n_in").alias("positives"))
    return out if keys else out.drop("_k")


def binary_metrics(df: DataFrame, p: str, label: str, keys: Sequence[str] = (), **kw) -> DataFrame:
    """n, positives, average precision, Brier score and log-loss per key."""
    k = list(keys) or ["_k"]
    d = df if keys else df.withColumn("_k", F.lit(0))
    d = d.where(F.col(label).isNotNull() & F.col(p).isNotNull())
    y, q = F.col(label).cast("double"), F.col(p)
    safe = F.least(F.greatest(q, F.lit(2.220446049250313e-16)), F.lit(1 - 2.220446049250313e-16))
    base = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(F.pow(q - y, 2)).alias("brier"),
                             F.avg(-(y * F.ln(safe) + (1 - y) * F.log1p(-safe))).alias("log_loss"))
    steps = d.groupBy(*k, p).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_tp"))
    r = running(steps, k, [-F.col(p)], {"_cn": Scan("sum", F.col("_n")), "_ctp": Scan("sum", F.col("_tp"))}, {"_pos": F.col("_tp")}, **kw)
    ap = r.groupBy(*k).agg(F.sum(F.col("_tp") / F.col("_pos") * F.col("_ctp") / F.col("_cn")).alias("auprc"))
    return base.join(ap, k) if keys else attach_row(base.drop("_k"), ap.drop("_k"))


def confusion(df: DataFrame, truth: str, predicted: str, labels: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per true label with one column per predicted label, over a fixed label list."""
    k = list(keys)
    kept = df.where(F.col(truth).isin(list(labels)) & F.col(predicted).isin(list(labels)))
    return kept.groupBy(*k, truth).agg(*[F.count_if(F.col(predicted) == x).alias(f"pred_{x}") for x in labels])


def class_metrics(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, balanced accuracy (over true classes) and macro-F1 (over classes seen on either side)."""
    k = list(keys) or ["_k"]
    d = df if keys else df.withColumn("_k", F.lit(0))
    c = d.groupBy(*k, truth, predicted).agg(F.count(F.lit(1)).alias("_n"))
    t = c.groupBy(*k, F.col(truth).alias("_c")).agg(F.sum("_n").alias("_t"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("_n")).otherwise(0)).alias("_hit"))
    p = c.groupBy(*k, F.col(predicted).alias("_c")).agg(F.sum("_n").alias("_p"))
    j = t.join(p, [*k, "_c"], "full").na.fill(0, ["_t", "_p", "_hit"])
    out = j.groupBy(*k).agg(
        F.sum("_t").alias("n"), (F.sum("_hit") / F.sum("_t")).alias("accuracy"), F.avg(F.when(F.col("_t") > 0, F.col("_hit") / F.col("_t"))).alias("balanced_accuracy"),
        F.avg(2 * F.col("_hit") / (F.col("_t") + F.col("_p"))).alias("macro_f1"))
    return out if keys else out.drop("_k")


def adjusted_rand(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Adjusted Rand index of two labelings per key; identical trivial labelings give 1. `count` stands for that many rows."""
    k = list(keys) or ["_k"]
    d = df if keys else df.withColumn("_k", F.lit(0))
    cells = d.groupBy(*k, a, b).agg((F.sum(count) if count else F.count(F.lit(1))).alias("_n"))

    def pairs(c):
        return c.cast("double") * (c - 1) / 2

    s = cells.groupBy(*k).agg(F.sum(pairs(F.col("_n"))).alias("_ij"), F.sum("_n").alias("n"))
    sa = cells.groupBy(*k, a).agg(F.sum("_n").alias("_n")).groupBy(*k).agg(F.sum(pairs(F.col("_n"))).alias("_a"))
    sb = cells.groupBy(*k, b).agg(F.sum("_n").alias("_n")).groupBy(*k).agg(F.sum(pairs(F.col("_n"))).alias("_b"))
    j = s.join(sa, k).join(sb, k) if keys else attach_row(attach_row(s, sa.drop("_k")), sb.drop("_k"))
    # A single row makes no pairs: its labelings agree.
    expected = F.when(F.col("n") > 1, F.col("_a") * F.col("_b") / pairs(F.col("n"))).otherwise(0.0)
    top = (F.col("_a") + F.col("_b")) / 2
    out = j.select(*k, F.when(top == expected, 1.0).otherwise((F.col("_ij") - expected) / (top - expected)).alias("ari"), "n")
    return out if keys else out.drop("_k")


def _distances(part: pd.DataFrame, block: pd.DataFrame, n: int) -> dict[tuple, tuple[np.ndarray, int]]:
    """(labeling, label of the block): each point's distances to its points summed up, and their number; labelings are _l0 to _l(n - 1)."""
    q, m = dense(part["vec"]), dense(block["vec"])
    dist = (q * q).sum(1)[:, None] + (m * m).sum(1)[None, :]
    dist -= 2 * q @ m.T
    np.sqrt(np.maximum(dist, 0.0, out=dist), out=dist)
    dist[part["id"].to_numpy()[:, None] == block["id"].to_numpy()[None, :]] = 0.0
    names, flags = [], []
    for i in range(n):
        place, seen = pd.factorize(block[f"_l{i}"], use_na_sentinel=False)
        names += [(i, None if pd.isna(x) else x) for x in seen]
        flags.append(np.arange(len(seen)) == place[:, None])
    flags = np.concatenate(flags, axis=1)
    sums = (dist @ flags.astype(float)).T
    return {name: (sums[j], int(c)) for j, (name, c) in enumerate(zip(names, flags.sum(0)))}


def _added(found: list[dict]) -> dict:
    out: dict = {}
    for one in found:
        for name, (d, c) in one.items():
            before = out.get(name)
            out[name] = (before[0] + d, before[1] + c) if before else (d, c)
    return out


def _sum_rows(part: pd.DataFrame, found: dict) -> pd.DataFrame:
    """id, at, label, other, dist, cnt: a row per point, labeling and label met."""
    names = list(found)
    return pd.DataFrame({
        "id": np.tile(part["id"].to_numpy(), len(names)), "at": np.repeat(np.array([i for i, _ in names], np.int32), len(part)),
        "label": np.concatenate([part[f"_l{i}"].to_numpy() for i, _ in names]), "other": np.repeat(np.array(pd.Series([x for _, x in names])), len(part)),
        "dist": np.concatenate([found[x][0] for x in names]), "cnt": np.repeat([found[x][1] for x in names], len(part))})


def silhouettes(df: DataFrame, labels: Sequence[str], vec: str = "vec", id_col: str = "id") -> DataFrame:
    """labelling, silhouette, n: mean Euclidean silhouette of several labelings (columns of one type), exact.

    See `meet`: the distances of two blocks are worked out once for all labelings and summed up by one
    product. A worker keeps one sum per point, labeling and cluster, never the distances themselves.
    """
    kinds = dict(df.dtypes)
    t_id, t_label = kinds[id_col], kinds[labels[0]]
    pts = df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"), *[F.col(c).alias(f"_l{i}") for i, c in enumerate(labels)])
    n = len(labels)
    met = meet(pts, pts, lambda part, block: _distances(part, block, n), f"id {t_id}, at int, label {t_label}, other {t_label}, dist double, cnt long", merge=_added, finish=_sum_rows)
    per = met.groupBy("id", "at", "label", "other").agg(F.sum("dist").alias("d"), F.sum("cnt").alias("c"))
    own = F.max(F.when(F.col("label") == F.col("other"), F.when(F.col("c") > 1, F.col("d") / (F.col("c") - 1))))
    near = F.min(F.when(F.col("label") != F.col("other"), F.col("d") / F.col("c")))
    s = per.groupBy("id", "at").agg(own.alias("a"), near.alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    name = F.element_at(F.array(*[F.lit(c) for c in labels]), F.col("at") + 1)
    return s.groupBy("at").agg(F.avg(value).alias("silhouette"), F.count(F.lit(1)).alias("n")).select(name.alias("labelling"), "silhouette", "n")


def silhouette(df: DataFrame, vec: str = "vec", label: str = "cluster", id_col: str = "id") -> DataFrame:
    """Mean Euclidean silhouette of one labeling; see `silhouettes`."""
    return silhouettes(df, [label], vec, id_col).drop("labelling")


def choose_k(table: DataFrame, window: float = BIC_WINDOW, floor: float = STABILITY_FLOOR) -> DataFrame:
    """Mark candidates within the BIC window and pick by stability, then silhouette, then lower BIC.

    A pick under the stability floor is recorded as unavailable.
    """
    best = table.select(F.min("bic")).scalar()
    t = table.withColumn("candidate", F.col("bic") <= best + window)
    first = keep_first(t.where("candidate").withColumn("_o", F.lit(1)), ["_o"], [F.col("stability").desc(), F.coalesce("silhouette", F.lit(0.0)).desc(), F.col("bic"), F.col("k")])
    return first.select(
        F.when(F.col("stability") >= floor, F.col("k")).alias("k"), F.col("k").alias("best_k"), F.lit("stability_within_10_bic").alias("selection_rule"), F.lit("gmm").alias("method"),
        F.lit("full").alias("covariance_type"), "bic", "silhouette", "stability", (F.col("stability") >= floor).alias("clustering_available"), F.lit(floor).alias("stability_threshold"))


def hold_out_names(rows: DataFrame, name: str, fraction: float = 0.3, seed: int = 0, **kw) -> DataFrame:
    """Split by name, not by row: every row of a name is on the same side. Under 4 names all are on both."""
    names = rows.select(name).distinct().withColumn("_h", drawn(name, seed))
    r = ranked(names, [], [F.col("_h"), F.col(name)], "_r", total="_n", **kw)
    test = F.col("_r") <= F.greatest(F.lit(1), F.round(F.col("_n") * fraction))
    side = F.when(F.col("_n") < 4, F.array(F.lit("train"), F.lit("test"))).when(test, F.array(F.lit("test"))).otherwise(F.array(F.lit("train")))
    return rows.join(r.select(name, F.explode(side).alias("split")), name)
