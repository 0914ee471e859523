"""Scaling, signatures, reversal scores and priorities over long tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortgrid.functions.tails import normal_score, t_pvalue
from cohortgrid.functions.vocabulary import TARGET_PATHWAY
from cohortgrid.operators.blocks import meet
from cohortgrid.operators.scans import average_ranks, finite, keep_first, medians, ranked, top_k
from cohortgrid.operators.windows import empirical_percentile, rank_percentile
from cohortgrid.session import cut_lineage


# ---- scaling ----------------------------------------------------------------------------------------
def cohort_z(df: DataFrame, sd: str = "sample", zero_sd: str = "null", keys: tuple = ("cohort", "feature")) -> DataFrame:
    """z of every value within its cohort and feature; cohorts of one row pass through.

    `sd` is sample or population; a zero deviation gives null or is taken as 1.
    """
    dev = F.stddev_samp("value") if sd == "sample" else F.stddev_pop("value")
    st = df.groupBy(*keys).agg(F.avg("value").alias("_mu"), dev.alias("_sd"), F.count("value").alias("_n"))
    scale = F.when(F.col("_sd") != 0, F.col("_sd")).otherwise(F.lit(1.0) if zero_sd == "one" else F.lit(None))
    z = F.when(F.col("_n") < 2, F.col("value")).otherwise((F.col("value") - F.col("_mu")) / scale)
    return df.join(st, list(keys)).withColumn("value", z).drop("_mu", "_sd", "_n")


def inverse_normal(df: DataFrame, sample: str = "sample_id", **kw) -> DataFrame:
    """Per sample: tie-averaged rank to normal score of (rank - 0.5) / n."""
    r = average_ranks(df, [sample], "value", **kw).select(sample, "value", ((F.col("avg_rank") - 0.5) / F.col("n_group")).alias("_p"))
    scored = r.withColumn("_z", normal_score("_p")).drop("_p")
    return df.join(scored, [sample, "value"]).withColumn("value", F.col("_z")).drop("_z")


def harmonise(train: DataFrame, test: DataFrame, methods: dict[str, Callable[[DataFrame], DataFrame]], score: Callable[[DataFrame, DataFrame], float], enough: float = 0.85):
    """Try the methods in order, keep the best concordance, stop once it is enough.

    Returns (method, concordance, train, test, tried). One number per method reaches the driver.
    """
    best, tried = None, []
    for name, fn in methods.items():
        a, b = fn(train), fn(test)
        c = score(a, b)
        tried.append((name, c))
        if best is None or c >= best[1]:
            best = (name, c, a, b)
        if c >= enough:
            break
    return (*best, tried)


def align_profiles(profiles: DataFrame, stats: DataFrame) -> DataFrame:
    """z of each profile against reference mean and sd, with coverage of the reference features.

    Names are trimmed and upper-cased; non-finite values do not count as present. Coverage is one row
    per profile, joined on.
    """
    clean = profiles.select("profile_id", F.upper(F.trim("feature")).alias("feature"), "value").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    one = clean.groupBy("profile_id", "feature").agg(F.max("value").alias("value"))
    n = stats.select(F.count(F.lit(1))).scalar()
    j = one.join(stats.select("feature", "mean", "sd"), "feature")
    z = F.when(F.col("sd") != 0, (F.col("value") - F.col("mean")) / F.col("sd"))
    return j.select("profile_id", "feature", "value", z.alias("z")).withColumn("reference_size", n)


def profile_coverage(aligned: DataFrame, stats: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Found features, coverage and all missing features per profile.

    `profiles` (profile_id) adds those without any reference feature, with coverage 0.
    """
    names = stats.select(F.array_sort(F.collect_set("feature"))).scalar()
    g = aligned.groupBy("profile_id").agg(F.count(F.lit(1)).alias("found"), F.max("reference_size").alias("requested"), F.collect_set("feature").alias("_have"))
    if profiles is not None:
        none = F.array().cast("array<string>")
        g = profiles.select("profile_id").distinct().join(g, "profile_id", "left").select("profile_id", F.coalesce("found", F.lit(0)).alias("found"), stats.select(F.count(F.lit(1))).scalar().alias("requested"), F.coalesce("_have", none).alias("_have"))
    missing = F.array_except(names, F.col("_have"))
    return g.select("profile_id", "found", "requested", (F.col("found") / F.greatest(F.col("requested"), F.lit(1))).alias("coverage"), missing.alias("missing"))


def compartment_normalise(expr: DataFrame, shares: DataFrame | None, parts: Sequence[str] = ("Normal_Epithelial", "malignant"), floor: float = 0.05) -> DataFrame:
    """Divide by the epithelial share of the sample (floored); without shares the values are kept and tagged."""
    have = [c for c in parts if shares is not None and c in shares.columns]
    if not have:
        return expr.withColumn("comparison_type", F.lit("bulk_fallback"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in have), F.lit(0.0))
    s = shares.select("sample_id", F.greatest(total, F.lit(floor)).alias("_share"))
    return expr.join(s, "sample_id").withColumn("value", F.col("value") / F.col("_share")).drop("_share").withColumn(
        "comparison_type", F.lit("intrinsic_epithelium_vs_normal_epithelium"))


# ---- signatures and reversal ------------------------------------------------------------------------
def arms(signature: DataFrame, keys: Sequence[str], effect: str, n_up: int, n_down: int) -> DataFrame:
    """Strongest positive and negative features per key as (keys, feature, effect, direction, rank)."""
    up = top_k(signature.where(F.col(effect) > 0), keys, [F.round(effect, 12).desc(), F.col("feature")], n_up).withColumn("direction", F.lit("up"))
    down = top_k(signature.where(F.col(effect) < 0), keys, [F.round(effect, 12), F.col("feature")], n_down).withColumn("direction", F.lit("down"))
    return up.unionByName(down).select(*keys, "feature", F.col(effect).alias("effect"), "direction", "rank")


def query_signature(signature: DataFrame, keys: Sequence[str], effect: str, n_side: int = 150) -> DataFrame:
    """The n_side lowest and highest features per key, each feature once."""
    ok = signature.where(F.col(effect).isNotNull() & ~F.isnan(effect))
    high = top_k(ok, keys, [F.round(effect, 12).desc(), F.col("feature")], n_side)
    low = top_k(ok, keys, [F.round(effect, 12), F.col("feature")], n_side)
    return high.unionByName(low).select(*keys, "feature", F.col(effect).alias("effect")).distinct()


def residual(z: DataFrame, assignment: DataFrame, centroids: DataFrame) -> DataFrame:
    """z minus the centroid of the profile's cluster over shared features."""
    c = centroids.select("cluster", "feature", F.col("value").alias("_c"))
    j = z.where(F.col("z").isNotNull()).join(assignment.select("profile_id", "cluster"), "profile_id").join(c, ["cluster", "feature"])
    return j.select("profile_id", "cluster", "feature", (F.col("z") - F.col("_c")).alias("residual")).where(F.col("residual").isNotNull() & ~F.isnan("residual"))


def arm_summary(arm_rows: DataFrame, keys: Sequence[str], minimum: int = 10) -> DataFrame:
    """Arm sizes per key and whether an arm is thin."""
    g = arm_rows.groupBy(*keys).agg(F.count_if(F.col("direction") == "up").alias("n_up"), F.count_if(F.col("direction") == "down").alias("n_down"))
    return g.withColumn("thin", (F.col("n_up") < minimum) | (F.col("n_down") < minimum))


#: Numbers of a dense matrix, and query signatures, that a worker multiplies at once.
DENSE_VALUES, QUERIES = 4_000_000, 256


class Matrix:
    """Rows of positions and values as a dense matrix, 0 where nothing is measured, and as a mask of what is.

    Repeated positions of a row are averaged.
    """

    def __init__(self, rows: pd.DataFrame, width: int):
        row = np.repeat(np.arange(len(rows)), [len(x) for x in rows["at"]])
        cell = row * width + np.concatenate([np.zeros(0, np.int64), *rows["at"]]).astype(np.int64)
        count = np.bincount(cell, minlength=len(rows) * width).reshape(len(rows), width)
        self.values = np.bincount(cell, np.concatenate([np.zeros(0), *rows["vec"]]), len(rows) * width).reshape(len(rows), width)
        self.values /= np.maximum(count, 1)
        self.mask = (count > 0).astype(float)

    def part(self, begin: int, end: int) -> Matrix:
        """Some of the rows."""
        some = Matrix.__new__(Matrix)
        some.values, some.mask = self.values[begin:end], self.mask[begin:end]
        return some


def _vectors(df: DataFrame, by: Sequence[str], value: str, places: DataFrame) -> DataFrame:
    """One row per `by`: positions and values of the features in `places`, and a number to deal rows by."""
    held = df.where(finite(value)).join(places, "feature").groupBy(*by).agg(F.collect_list(F.struct("at", F.col(value).cast("double").alias("vec"))).alias("_p"))
    return held.select(*by, F.xxhash64(*by).alias("id"), F.col("_p.at").alias("at"), F.col("_p.vec").alias("vec"))


def _taken(column: pd.Series, at: np.ndarray) -> pd.Series:
    """Cells by position; texts as objects, which stay one piece when frames are put together."""
    return pd.Series(column.to_numpy()[at], dtype=column.dtype if column.dtype.kind in "biuf" else object)


def score_by_blocks(queries: DataFrame, value: str, perturbations: DataFrame, keys: Sequence[str], score: Callable[[Matrix, Matrix], tuple[dict[str, np.ndarray], np.ndarray]], columns: dict[str, str]) -> DataFrame:
    """keys, sig_id and `columns` for every query and perturbation row that `score` keeps.

    The features of the queries are numbered. A perturbation row becomes one vector over them, once,
    whatever the number of queries; blocks of rows meet blocks of queries as matrix products (see
    `meet`), so no row per query, perturbation and feature is ever made.
    """
    places = cut_lineage(ranked(queries.select("feature").distinct(), [], [F.col("feature")], "at").select("feature", (F.col("at") - 1).cast("int").alias("at")))
    width = places.count()
    asked = cut_lineage(_vectors(queries, keys, value, places))
    measured = cut_lineage(_vectors(perturbations, ["sig_id"], "value", places))
    rows_at_once = max(1, DENSE_VALUES // max(1, width))

    def products(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        done = []
        for i in range(0, len(part), rows_at_once):
            rows = part.iloc[i : i + rows_at_once]
            m = Matrix(rows, width)
            for j in range(0, len(block), QUERIES):
                asked_rows = block.iloc[j : j + QUERIES]
                found, keep = score(m, Matrix(asked_rows, width))
                r, q = np.nonzero(keep)
                own = {k: _taken(asked_rows[k], q) for k in keys}
                done.append(pd.DataFrame({**own, "sig_id": _taken(rows["sig_id"], r), **{c: x[r, q] for c, x in found.items()}}))
        return pd.concat(done, ignore_index=True)

    types = dict(asked.dtypes) | dict(measured.dtypes) | columns
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, "sig_id", *columns])
    return meet(measured, asked, products, schema)


def connectivity(signature: DataFrame, perturbations: DataFrame, keys: Sequence[str], minimum: int = 5) -> DataFrame:
    """Negative Pearson correlation of each query signature with every perturbation row on shared features.

    `perturbations` is (sig_id, feature, value); only finite values count. No score where fewer than
    `minimum` features are shared or one side doesn't vary over them. See `score_by_blocks`.
    """

    def correlate(m: Matrix, q: Matrix):
        # Centred by each row's own mean first, so that the sums below don't cancel.
        y = m.mask * (m.values - (m.values.sum(1) / np.maximum(m.mask.sum(1), 1))[:, None])
        x = q.mask * (q.values - (q.values.sum(1) / np.maximum(q.mask.sum(1), 1))[:, None])
        n = m.mask @ q.mask.T
        sx, sxx, sy, syy = m.mask @ x.T, m.mask @ (x * x).T, y @ q.mask.T, (y * y) @ q.mask.T
        vx, vy, safe = sxx - sx * sx / np.maximum(n, 1), syy - sy * sy / np.maximum(n, 1), np.maximum(n, 1)
        varies = (vx > 1e-12 * np.maximum(sxx, 1e-300)) & (vy > 1e-12 * np.maximum(syy, 1e-300))
        r = np.divide(y @ x.T - sx * sy / safe, np.sqrt(np.where(varies, vx * vy, 1.0)))
        return {"reversal_score": -np.clip(r, -1.0, 1.0), "n_shared": n.astype(np.int64)}, varies & (n >= minimum)

    return score_by_blocks(signature, "effect", perturbations, keys, correlate, {"reversal_score": "double", "n_shared": "long"})


def _sides(arm_rows: DataFrame) -> DataFrame:
    return arm_rows.where(F.col("direction").isin("up", "down")).withColumn("_side", F.when(F.col("direction") == "up", 1.0).otherwise(-1.0))


def _differ(m: Matrix, q: Matrix, minimum: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the down features less that of the up features, and where both sides have `minimum` of them."""
    up, down = (q.values > 0).astype(float), (q.values < 0).astype(float)
    if m.mask.all():
        # Nothing is missing, so the sizes of the sides are those of the query.
        n_up, n_down = up.sum(1), down.sum(1)
        score = m.values @ (down / np.maximum(n_down, 1)[:, None]).T - m.values @ (up / np.maximum(n_up, 1)[:, None]).T
        return score, np.broadcast_to((n_up >= minimum) & (n_down >= minimum), score.shape)
    n_up, n_down = m.mask @ up.T, m.mask @ down.T
    score = m.values @ down.T / np.maximum(n_down, 1) - m.values @ up.T / np.maximum(n_up, 1)
    return score, (n_up >= minimum) & (n_down >= minimum)


def set_difference(arm_rows: DataFrame, perturbations: DataFrame, keys: Sequence[str], minimum: int = 5) -> DataFrame:
    """-(mean of up features - mean of down features) per perturbation row, with at least `minimum` per side measured.

    Only finite values count. See `score_by_blocks`.
    """

    def differ(m: Matrix, q: Matrix):
        score, keep = _differ(m, q, minimum)
        return {"reversal_score": score}, keep

    return score_by_blocks(_sides(arm_rows), "_side", perturbations, keys, differ, {"reversal_score": "double"})


#: A score that rounds to a positive number of 12 digits.
POSITIVE = 5e-13
#: Rows scored at once (their signs are counted in bytes, so 127 at most), queries, and rows of a mean run that is short.
ROWS, SLAB, SHORT = 127, 2_048, 32


def _places(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few cells that are set; several times faster than nonzero of a table."""
    return np.divmod(np.flatnonzero(flags), max(1, flags.shape[1]))


def _short_runs(m: Matrix, starts: np.ndarray, q: Matrix, minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`best_and_counts` in double precision alone, several runs at once."""
    best = np.full((len(starts), len(q.values)), -np.inf)
    n, positive = np.zeros(best.shape, np.int64), np.zeros(best.shape, np.int64)
    for i in range(0, len(m.values), ROWS):
        j = min(i + ROWS, len(m.values))
        first, last = np.searchsorted(starts, [i, j - 1], "right") - 1
        own, at = slice(first, last + 1), np.maximum(starts[first : last + 1], i) - i
        score, keep = _differ(m.part(i, j), q, minimum)
        best[own] = np.maximum(best[own], np.maximum.reduceat(np.where(keep, score, -np.inf), at, axis=0))
        n[own] += np.add.reduceat(keep, at, axis=0, dtype=np.int64)
        positive[own] += np.add.reduceat(keep & (score >= POSITIVE), at, axis=0, dtype=np.int64)
    return best, n, positive


def best_and_counts(m: Matrix, starts: np.ndarray, q: Matrix, minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per run of rows (one begins at each of `starts`) and query: best score, scores, and scores of POSITIVE or more.

    The scores are those of `_differ`. Where nothing is missing they are worked out in single precision
    first, with a bound on what they may be off by; a score that may be its run's best, or whose side of
    POSITIVE the bound leaves open, is worked out again in double precision.
    """
    if len(m.values) < SHORT * len(starts):
        return _short_runs(m, starts, q, minimum)
    up, down = q.values > 0, q.values < 0
    n_up, n_down = up.sum(1), down.sum(1)
    weights = down / np.maximum(n_down, 1)[:, None] - up / np.maximum(n_up, 1)[:, None]
    asked = (n_up >= minimum) & (n_down >= minimum)
    largest = np.abs(m.values).max(initial=0.0)
    kind = np.float32 if largest < 1e30 else np.float64
    # A sum of t products is off by at most t + 3 roundings of half an eps each, of the sum of the products' sizes.
    off = float(((n_up + n_down).max(initial=0) + 4) * np.finfo(kind).eps * largest * np.abs(weights).sum(1).max(initial=0.0) + np.finfo(kind).tiny)
    x, w = m.values.astype(kind), np.ascontiguousarray(weights.T.astype(kind))
    complete = m.mask.all(1)
    best = np.full((len(starts), len(asked)), -np.inf)
    n, positive = np.zeros(best.shape, np.int64), np.zeros(best.shape, np.int64)
    scores, sure, likely = np.empty((ROWS, len(asked)), kind), np.empty((ROWS, len(asked)), bool), np.empty((ROWS, len(asked)), bool)

    def exact(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        some = max(1, DENSE_VALUES // max(1, x.shape[1]))
        return np.concatenate([np.einsum("ij,ij->i", m.values[r[i : i + some]], weights[c[i : i + some]]) for i in range(0, max(1, len(r)), some)])

    for g, (begin, end) in enumerate(zip(starts, [*starts[1:], len(x)])):
        top = np.full(len(asked), -np.inf, kind)
        for i in range(begin, end, ROWS):
            j = min(i + ROWS, end)
            if not complete[i:j].all():
                score, keep = _differ(m.part(i, j), q, minimum)
                best[g] = np.maximum(best[g], np.where(keep, score, -np.inf).max(0))
                n[g] += keep.sum(0)
                positive[g] += (keep & (score >= POSITIVE)).sum(0)
                continue
            s, yes, perhaps = np.matmul(x[i:j], w, out=scores[: j - i]), sure[: j - i], likely[: j - i]
            np.greater(s, POSITIVE + off, out=yes)
            np.greater_equal(s, POSITIVE - off, out=perhaps)
            positive[g] += np.add.reduce(yes.view(np.int8), axis=0, dtype=np.int8)
            r, c = _places(np.not_equal(yes, perhaps, out=perhaps))
            positive[g] += np.bincount(c[exact(i + r, c) >= POSITIVE], minlength=len(asked))
            high = s.max(0)
            may = np.flatnonzero(high >= top - 2 * off)
            r, c = _places((s if len(may) == len(asked) else s[:, may]) >= high[may] - 2 * off)
            np.maximum.at(best[g], may[c], exact(i + r, may[c]))
            np.maximum(top, high, out=top)
            n[g] += j - i
    n[:, ~asked] = positive[:, ~asked] = 0
    return best, n, positive


def set_difference_counts(arm_rows: DataFrame, perturbations: DataFrame, meta: DataFrame, keys: Sequence[str], minimum: int = 5) -> DataFrame:
    """Scores of `set_difference` summed up where they are made: keys, the columns of `meta` without sig_id, best, n, n_positive.

    One row per key and distinct row of `meta`, or a few where the perturbation rows of one lie in several
    parts; no row per key and perturbation row is made. Perturbation rows are dealt in the order of `meta`.
    """
    kinds = [c for c in meta.columns if c != "sig_id"]
    places = cut_lineage(ranked(arm_rows.select("feature").distinct(), [], [F.col("feature")], "at").select("feature", (F.col("at") - 1).cast("int").alias("at")))
    width = places.count()
    asked = cut_lineage(_vectors(_sides(arm_rows), keys, "_side", places))
    rows = _vectors(perturbations, ["sig_id"], "value", places).join(meta, "sig_id")
    measured = cut_lineage(ranked(rows, [], [*[F.col(c) for c in kinds], F.col("sig_id")], "_place").withColumn("_place", F.col("_place") - 1))

    def summed(part: pd.DataFrame, block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        group = part.groupby(kinds, dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        part, group = part.iloc[order], group[order]
        at_once = max(1, DENSE_VALUES // max(1, width))
        for i in range(0, len(part), at_once):
            rows = part.iloc[i : i + at_once]
            m, starts = Matrix(rows, width), np.flatnonzero(np.diff(group[i : i + at_once], prepend=-1))
            for j in range(0, len(block), min(SLAB, at_once)):
                some = block.iloc[j : j + min(SLAB, at_once)]
                best, n, positive = best_and_counts(m, starts, Matrix(some, width), minimum)
                g, q = np.nonzero(n)
                own = {k: _taken(some[k], q) for k in keys} | {c: _taken(rows[c], starts[g]) for c in kinds}
                yield pd.DataFrame({**own, "best": best[g, q], "n": n[g, q], "n_positive": positive[g, q]})

    types = dict(asked.dtypes) | dict(measured.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, *kinds]) + ", best double, n long, n_positive long"
    return meet(measured, asked, summed, schema, at="_place", whole=True)


def proxy_reversal(table: DataFrame, assignment: DataFrame, residual_arms: DataFrame, cluster_arms: DataFrame, blended: DataFrame | None = None, **kw) -> DataFrame:
    """Residual list without a perturbation matrix: 0.55 base + 0.25 overlap base + 0.20 tanh(target weight).

    base is the cluster list's percentile, overlap the mean Jaccard of up and down arms, target weight
    the summed absolute residual of the drug's targets. With blended percentiles: 0.7 score + 0.3 blend.
    `table` is (cluster, drug, percentile, targets ARRAY).
    """
    r = residual_arms.select("profile_id", "direction", "feature", F.lit(1).alias("_r"))
    c = assignment.select("profile_id", "cluster").join(cluster_arms.select("cluster", "direction", "feature"), "cluster").select("profile_id", "direction", "feature", F.lit(1).alias("_c"))
    per = r.join(c, ["profile_id", "direction", "feature"], "full").groupBy("profile_id", "direction").agg(
        (F.count_if(F.col("_r").isNotNull() & F.col("_c").isNotNull()) / F.count(F.lit(1))).alias("_j"))
    overlap = per.groupBy("profile_id").agg((F.sum("_j") / 2.0).alias("overlap"))
    drugs = table.select("cluster", "drug", "percentile", "targets")
    # Arms meet the targets of their own features only, and stay dealt by profile up to the sums.
    hits = (
        residual_arms.select("profile_id", "feature", F.abs("effect").alias("_w"))
        .join(assignment.select("profile_id", "cluster"), "profile_id")
        .join(drugs.select("cluster", "drug", F.explode("targets").alias("feature")), ["cluster", "feature"])
        .groupBy("profile_id", "drug").agg(F.sum("_w").alias("_hit"))
    )
    j = assignment.select("profile_id", "cluster").join(drugs.drop("targets"), "cluster").join(overlap, "profile_id", "left").join(hits, ["profile_id", "drug"], "left")
    base, ov = F.col("percentile"), F.coalesce("overlap", F.lit(0.0))
    score = 0.55 * base + 0.25 * ov * base + 0.20 * F.tanh(F.coalesce("_hit", F.lit(0.0)))
    out = j.select("profile_id", "drug", score.alias("reversal_score"), ov.alias("consistency"), F.lit("residual_proxy").alias("source"))
    if blended is not None:
        out = out.join(blended.select("profile_id", "drug", "blended_percentile"), ["profile_id", "drug"], "left").withColumn(
            "reversal_score", F.when(F.col("blended_percentile").isNotNull(), 0.7 * F.col("reversal_score") + 0.3 * F.col("blended_percentile")).otherwise(F.col("reversal_score"))).drop("blended_percentile")
    # A profile has as many rows as its cluster's list.
    longest = table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return rank_percentile(out.withColumn("reversal_score", F.round("reversal_score", 12)), "reversal_score", ["drug"], ["profile_id"], at_most=longest, **kw)


# ---- coefficient scores --------------------------------------------------------------------------------
def weighted_scores(z: DataFrame, coefficients: DataFrame, minimum: int = 3, coverage: float = 0.0) -> DataFrame:
    """sum(w z) / sum(|w|) per (profile, drug) with features used and coverage; null under the guards.

    `coefficients` is (drug, feature, weight); zero and missing weights do not count.
    """
    w = coefficients.where(F.col("weight").isNotNull() & (F.col("weight") != 0)).select("drug", "feature", "weight")
    size = w.groupBy("drug").agg(F.count(F.lit(1)).alias("features_total"))
    s = z.where(F.col("z").isNotNull()).join(w, "feature").groupBy("profile_id", "drug").agg(
        F.sum(F.col("weight") * F.col("z")).alias("_n"), F.sum(F.abs("weight")).alias("_d"), F.count(F.lit(1)).alias("features_used"))
    j = s.join(size, "drug").withColumn("feature_coverage", F.col("features_used") / F.col("features_total"))
    ok = (F.col("features_used") >= minimum) & (F.col("feature_coverage") >= coverage)
    return j.select("profile_id", "drug", F.when(ok, F.col("_n") / F.col("_d")).alias("raw_score"), "features_used", "features_total", "feature_coverage")


def score_reference(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of a drug's scores over the reference profiles."""
    return scores.where(F.col("raw_score").isNotNull()).groupBy("drug").agg(F.avg("raw_score").alias("mean"), F.stddev_pop("raw_score").alias("sd"))


def standardise_scores(scores: DataFrame, reference: DataFrame) -> DataFrame:
    j = scores.join(reference, "drug", "left")
    return j.withColumn("z_score", F.when(F.col("sd") > 0, (F.col("raw_score") - F.col("mean")) / F.col("sd"))).drop("mean", "sd")


def regimen_scores(scores: DataFrame, regimens: DataFrame) -> DataFrame:
    """Mean z over the regimen's scoreable drugs per profile; null when none can be scored."""
    asked = regimens.select("profile_id", F.explode(F.array_distinct("drugs")).alias("drug"))
    j = asked.join(scores.select("profile_id", "drug", "z_score"), ["profile_id", "drug"], "left")
    return j.groupBy("profile_id").agg(F.avg("z_score").alias("regimen_score"), F.count("z_score").alias("n_scored"), F.count(F.lit(1)).alias("n_requested"))


def integrated_priority(scores: DataFrame, reference_scores: DataFrame | None, support: DataFrame, **kw) -> DataFrame:
    """0.60 empirical percentile + 0.25 reliability + 0.15 target support, ranked within the profile.

    Without reference scores the profiles are compared with each other. Rows without a score keep null priority, rank and percentile.
    """
    s = scores.withColumn("raw_score", F.round("raw_score", 12))
    ref = reference_scores.select("drug", F.round("raw_score", 12).alias("raw_score")) if reference_scores is not None else None
    j = empirical_percentile(s, ref, "raw_score", ["drug"], "sensitivity_percentile", **kw).join(support.select("drug", "reliability", "drug_support"), "drug", "left")
    rel, sup = F.coalesce("reliability", F.lit(0.0)), F.coalesce("drug_support", F.lit(0.0))
    j = j.withColumn("priority", F.round(0.60 * F.col("sensitivity_percentile") + 0.25 * rel + 0.15 * sup, 12)).withColumn("drug_support", sup)
    done = rank_percentile(j.where(F.col("priority").isNotNull()), "priority", ["drug"], ["profile_id"], **kw)
    rest = j.where(F.col("priority").isNull()).withColumn("rank", F.lit(None).cast("long")).withColumn("percentile", F.lit(None).cast("double"))
    return done.unionByName(rest)


def nested_score(sensitivity: Column, reliability: Column, support: Column) -> Column:
    return 0.60 * sensitivity + 0.25 * reliability + 0.15 * support


def pair_priority(pairs: DataFrame, priorities: DataFrame, **kw) -> DataFrame:
    """0.55 sqrt(pa pb) + 0.35 aligned support + 0.10 mean drug support, ranked per profile.

    `pairs` is (drug_a, drug_b, aligned_support); `priorities` is (profile_id, drug, priority, drug_support).
    """
    p = priorities.where(F.col("priority").isNotNull())
    a = p.select("profile_id", F.col("drug").alias("drug_a"), F.col("priority").alias("_pa"), F.col("drug_support").alias("_sa"))
    b = p.select("profile_id", F.col("drug").alias("drug_b"), F.col("priority").alias("_pb"), F.col("drug_support").alias("_sb"))
    j = pairs.join(a, "drug_a").join(b, ["profile_id", "drug_b"])
    comp = F.sqrt(F.greatest("_pa", F.lit(0.0)) * F.greatest("_pb", F.lit(0.0)))
    score = 0.55 * comp + 0.35 * F.coalesce("aligned_support", F.lit(0.0)) + 0.10 * (F.coalesce("_sa", F.lit(0.0)) + F.coalesce("_sb", F.lit(0.0))) / 2
    out = j.select("profile_id", "drug_a", "drug_b", comp.alias("component"), F.round(score, 12).alias("priority"))
    return ranked(out, ["profile_id"], [-F.col("priority"), F.col("drug_a"), F.col("drug_b")], **kw)


def overlap_pairs(pairs: DataFrame, allowed: DataFrame, percentiles: DataFrame, k: int | None = None) -> DataFrame:
    """Pairs with both drugs allowed: 0.60 sqrt(pa pb) + 0.40 aligned support, best k where it is given."""
    from cohortgrid.operators.joins import pairs_within

    kept = pairs_within(pairs, allowed)
    a = percentiles.select(F.col("canonical").alias("drug_a"), F.col("percentile").alias("_pa"))
    b = percentiles.select(F.col("canonical").alias("drug_b"), F.col("percentile").alias("_pb"))
    j = kept.join(a, "drug_a", "left").join(b, "drug_b", "left")
    comp = F.sqrt(F.greatest(F.coalesce("_pa", F.lit(0.0)), F.lit(0.0)) * F.greatest(F.coalesce("_pb", F.lit(0.0)), F.lit(0.0)))
    out = j.select("drug_a", "drug_b", comp.alias("component"), F.round(0.60 * comp + 0.40 * F.coalesce("aligned_support", F.lit(0.0)), 12).alias("priority"))
    return top_k(out, [], [-F.col("priority"), F.col("drug_a"), F.col("drug_b")], k)


def concordance_class(comparators: DataFrame, predictor: DataFrame, high: float = 0.75) -> DataFrame:
    """concordant_high, expression_only, predictor_only or low_or_uncertain per comparator."""
    j = comparators.join(predictor.select("canonical", F.col("percentile").alias("_pp")), "canonical", "left")
    e, p = F.coalesce(F.col("dual_support_percentile") >= high, F.lit(False)), F.coalesce(F.col("_pp") >= high, F.lit(False))
    return j.withColumn("evidence_concordance", F.when(e & p, "concordant_high").when(e, "expression_only").when(p, "predictor_only").otherwise("low_or_uncertain")).drop("_pp")


def consolidate_coefficients(raw: DataFrame, primary: DataFrame, status: DataFrame, analysis: str, model: str, **kw) -> DataFrame:
    """Median coefficient per (drug, class, feature) of one analysis and model over primary screens, available drugs only."""
    from cohortgrid.functions.cleaning import compound_name_short

    key = F.concat_ws(":", F.col("primary_screen"), compound_name_short(F.col("drug")), F.col("primary_drug_id").cast("string"))
    p = primary.select(key.alias("drug_screen"), compound_name_short(F.col("drug")).alias("drug"), "treatment_class")
    ok = status.where(F.col("available")).select(compound_name_short(F.col("drug")).alias("drug")).distinct()
    s = raw.where((F.col("analysis") == analysis) & (F.col("model") == model)).select("drug_screen", F.upper(F.trim("feature")).alias("feature"), "coefficient")
    j = s.join(p, "drug_screen").join(ok, "drug", "left_semi")
    return medians(j, ["drug", "treatment_class", "feature"], ["coefficient"], **kw)


# ---- footprint activity ---------------------------------------------------------------------------------
def univariate_activity(df: DataFrame, network: DataFrame, sample: str = "sample_id") -> DataFrame:
    """t of each sample's expression on one source's weights over all of the sample's features (weight 0 outside)."""
    y = df.where(F.col("value").isNotNull())
    tot = y.groupBy(sample).agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_sy"), F.sum(F.col("value") * F.col("value")).alias("_syy"))
    hit = y.join(network.select("source", "feature", "weight"), "feature").groupBy(sample, "source").agg(
        F.sum(F.col("weight") * F.col("value")).alias("_swy"), F.sum("weight").alias("_sw"), F.sum(F.col("weight") * F.col("weight")).alias("_sww"))
    j = hit.join(tot, sample)
    n = F.col("_n")
    cov = F.col("_swy") - F.col("_sw") * F.col("_sy") / n
    vw, vy = F.col("_sww") - F.col("_sw") * F.col("_sw") / n, F.col("_syy") - F.col("_sy") * F.col("_sy") / n
    r = F.when((vw > 0) & (vy > 0), cov / F.sqrt(vw * vy))
    out = j.select(sample, "source", r.alias("_r"), (n - 2).alias("df"))
    t = F.col("_r") * F.sqrt(F.col("df") / F.greatest(1 - F.col("_r") * F.col("_r"), F.lit(1e-300)))
    return out.select(sample, "source", t.alias("activity"), "df")


def multivariate_activity(df: DataFrame, network: DataFrame, sample: str = "sample_id") -> DataFrame:
    """t of every source in one regression of a sample's expression on all sources' weights.

    All samples share the design, so its inverse is taken once: the cross products of sources are a
    grouped sum, and only that source-by-source table reaches the driver.
    """
    features = df.select("feature").distinct()
    net = network.join(features, "feature", "left_semi").select("source", "feature", "weight").groupBy("source", "feature").agg(F.sum("weight").alias("weight"))
    names = [r[0] for r in net.select("source").distinct().orderBy("source").limit(2001).collect()]
    if len(names) > 2000:
        raise ValueError("a joint regression is meant for at most 2000 sources")
    at = {s: i + 1 for i, s in enumerate(names)}
    p = len(names) + 1
    n = features.count()
    xtx = np.zeros((p, p))
    xtx[0, 0] = n
    for r in net.groupBy("source").agg(F.sum("weight").alias("s")).collect():
        xtx[0, at[r["source"]]] = xtx[at[r["source"]], 0] = r["s"]
    cross = net.alias("a").join(net.select(F.col("source").alias("other"), "feature", F.col("weight").alias("w2")).alias("b"), "feature").groupBy("source", "other").agg(F.sum(F.col("weight") * F.col("w2")).alias("s"))
    for r in cross.collect():
        xtx[at[r["source"]], at[r["other"]]] = r["s"]
    inv = np.linalg.pinv(xtx)
    dof = max(n - p, 1)
    base = df.where(F.col("value").isNotNull()).groupBy(sample).agg(F.sum("value").alias("_sy"), F.sum(F.col("value") * F.col("value")).alias("_syy"))
    xy = df.join(net, "feature").groupBy(sample, "source").agg(F.sum(F.col("weight") * F.col("value")).alias("_xy"))
    packed = xy.groupBy(sample).agg(F.map_from_entries(F.collect_list(F.struct("source", "_xy"))).alias("_m"))
    vec = F.transform(F.array(*[F.lit(s) for s in names]), lambda s: F.coalesce(F.try_element_at(F.col("_m"), s), F.lit(0.0)))
    rows = base.join(packed, sample, "left").select(sample, F.concat(F.array("_sy"), vec).alias("_v"), "_syy")

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(v: pd.Series, syy: pd.Series) -> pd.Series:
        b = np.array(v.tolist(), dtype=float)
        beta = b @ inv
        rss = np.maximum(syy.to_numpy(float) - (beta * b).sum(axis=1), 0.0)
        se = np.sqrt(np.outer(rss / dof, np.diag(inv)))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(se > 0, beta / se, 0.0)
        return pd.Series(list(t[:, 1:]))

    return rows.withColumn("_t", solve("_v", "_syy")).select(sample, F.posexplode("_t").alias("_i", "activity")).select(
        sample, F.element_at(F.array(*[F.lit(s) for s in names]), F.col("_i") + 1).alias("source"), "activity", F.lit(dof).alias("df"))


def marker_activity(df: DataFrame, markers: Sequence[str], sample: str = "sample_id") -> DataFrame:
    """Fallback activity: mean of the marker features, or of all features where no marker is measured."""
    at = F.col("feature").isin(list(markers))
    return df.groupBy(sample).agg(F.coalesce(F.avg(F.when(at, F.col("value"))), F.avg("value")).alias("activity"))


# ---- curves, fingerprints, mixtures -----------------------------------------------------------------------
def dose_points(curves: DataFrame, n_points: int = 25, band: float = 0.08) -> DataFrame:
    """Hill viability on a log grid from 1 nM to 100 uM with a fixed display band; ic50_nm, h, max_conc_nm given."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(n_points - 1)), lambda i: F.pow(F.lit(10.0), i * (5.0 / (n_points - 1))))
    d = curves.select("*", F.posexplode(grid).alias("point", "concentration_nm"))
    v = 1.0 / (1.0 + F.pow(F.col("concentration_nm") / F.greatest(F.col("ic50_nm"), F.lit(1e-9)), F.col("h")))
    d = d.withColumn("viability", v)
    spread = band * (1 - F.col("viability"))
    return d.withColumns({
        "band_lower": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("viability") - spread)),
        "band_upper": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("viability") + spread)),
        "ic50_extrapolated": F.coalesce(F.col("ic50_nm") > F.col("max_conc_nm"), F.lit(False))})


def fingerprints(pairs: DataFrame, a: str, b: str, n_axes: int = 5, shared_by: Sequence[str] | None = None) -> DataFrame:
    """Per-axis products scaled to the pair's own peak, or to the peak over all pairs of a key."""
    cut = F.zip_with(F.slice(a, 1, n_axes), F.slice(b, 1, n_axes), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    d = pairs.withColumn("_c", cut).withColumn("_peak", F.array_max(F.transform("_c", lambda x: F.abs(x))))
    if shared_by:
        top = d.groupBy(*shared_by).agg(F.max("_peak").alias("_peak"))
        d = d.drop("_peak").join(top, list(shared_by))
    peak = F.when(F.coalesce("_peak", F.lit(0.0)) > 0, F.col("_peak")).otherwise(1.0)
    scaled = F.transform("_c", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / peak)))
    padded = F.slice(F.concat(scaled, F.array_repeat(F.lit(0.0), n_axes)), 1, n_axes)
    return d.withColumn("fingerprint", padded).drop("_c", "_peak")


def bliss_excess(ea: Column, eb: Column, eab: Column) -> Column:
    return eab - (ea + eb - ea * eb)


def product_of_experts(views: DataFrame, keys: Sequence[str] = ("sample_id", "dim")) -> DataFrame:
    """Gaussian estimates per view combined with a standard normal prior; a masked view adds no precision.

    `views` is (sample, view, dim, mu, logvar, present).
    """
    prec = F.when(F.coalesce(F.col("present"), F.lit(False)) & F.col("mu").isNotNull(), F.exp(-F.col("logvar"))).otherwise(0.0)
    g = views.withColumn("_p", prec).groupBy(*keys).agg((F.sum("_p") + 1.0).alias("_t"), F.sum(F.col("_p") * F.coalesce("mu", F.lit(0.0))).alias("_w"))
    return g.select(*keys, (F.col("_w") / F.col("_t")).alias("mu"), (-F.ln("_t")).alias("logvar"))


def posterior_width(joint: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Mean posterior deviation over dimensions."""
    return joint.groupBy(sample).agg(F.avg(F.exp(0.5 * F.col("logvar"))).alias("width"))


def width_reduction(without: DataFrame, with_view: DataFrame, sample: str = "sample_id") -> DataFrame:
    j = without.select(sample, F.col("width").alias("_a")).join(with_view.select(sample, F.col("width").alias("_b")), sample)
    return j.select(sample, ((F.col("_a") - F.col("_b")) / F.greatest("_a", F.lit(1e-8))).alias("reduction"))


# ---- targets, candidates, detail ---------------------------------------------------------------------------
def target_pathway(c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in TARGET_PATHWAY.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.upper(c)), F.lit("MAPK"))


def index_treatment(her2: Column, endocrine: Column, chemo: Column) -> Column:
    return F.when(her2 == 1, "lapatinib").when(endocrine == 1, "tamoxifen").when(chemo == 1, "paclitaxel").otherwise("tamoxifen")


def pathway_candidates(activity: DataFrame, pk: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Drugs whose target pathway reaches the threshold per sample, by name, with tier and excluded count.

    `activity` is (sample_id, pathway, activity); `pk` is (drug_name, target_gene, in_topology). A
    pathway a sample has no value for counts as 0. Pathways are few, so a sample's values travel as a map.
    """
    drugs = pk.select(F.col("drug_name").alias("drug"), F.lower(target_pathway(F.col("target_gene"))).alias("pathway"), F.when(F.col("in_topology"), "A").otherwise("B").alias("tier"))
    by_path = drugs.groupBy("pathway").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.lower("drug").alias("k"), F.col("drug"), F.col("tier")))).alias("members"))
    samples = activity.select("sample_id").distinct()
    paths = by_path.select(F.collect_list(F.struct("pathway", "n", "members"))).scalar()
    grid = samples.withColumn("_p", F.explode(paths)).select("sample_id", "_p.*")
    j = grid.join(activity.select("sample_id", F.lower("pathway").alias("pathway"), "activity"), ["sample_id", "pathway"], "left").withColumn("activity", F.coalesce("activity", F.lit(0.0)))
    kept = F.col("activity") >= threshold
    g = j.groupBy("sample_id").agg(F.sum("n").alias("n_scored"), F.sum(F.when(~kept, F.col("n")).otherwise(0)).alias("excluded_count"),
                                   F.array_sort(F.flatten(F.collect_list(F.when(kept, F.col("members"))))).alias("_m"))
    return g.select("sample_id", F.transform("_m", lambda x: F.struct(x["drug"].alias("drug"), x["tier"].alias("evidence_tier"))).alias("set_members"), "excluded_count", "n_scored")


def cluster_detail(signatures: DataFrame, n: int = 20) -> DataFrame:
    """The n top up and down coefficients each with the number of features at fdr < 0.10."""
    rows = arms(signatures.withColumnRenamed("coef", "effect"), ["cluster"], "effect", n, n)
    sig = signatures.groupBy("cluster").agg(F.count_if(F.col("fdr") < 0.10).alias("n_significant"))
    return rows.join(sig, "cluster")


def start_values(nodes: DataFrame, regulator: DataFrame, pathway: DataFrame, default: float = 0.5) -> DataFrame:
    """Activity of each node in [0, 1]: the regulator's own value, else its pathway's, else the default.

    `nodes` is (sample_id, node); the others are (sample_id, source, activity).
    """
    from cohortgrid.functions.cleaning import unit_clip

    n = nodes.withColumn("_pw", F.lower(target_pathway(F.col("node"))))
    r = regulator.select("sample_id", F.col("source").alias("node"), F.col("activity").alias("_r"))
    p = pathway.select("sample_id", F.lower("source").alias("_pw"), F.col("activity").alias("_p"))
    j = n.join(r, ["sample_id", "node"], "left").join(p, ["sample_id", "_pw"], "left")
    return j.select("sample_id", "node", F.coalesce(unit_clip(F.col("_r")), unit_clip(F.col("_p")), F.lit(default)).alias("x0"))
