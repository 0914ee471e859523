"""Latents, mixtures, classifiers and calibrated intervals: models fit by Spark, small algebra on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortgrid.operators.scans import exact_quantiles, keep_first, ranked, top_k
from cohortgrid.session import cut_lineage


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    clean = F.transform(F.col(vec).cast("array<double>"), lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x))
    return df.withColumn("_raw", array_to_vector(clean))


# ---- projections ------------------------------------------------------------------------------------
class Projection:
    """Centred principal components: `scores` table, component matrix (dim x k), mean and variance shares."""

    def __init__(self, scaler, pca, k: int, vec: str):
        self._scaler, self._pca, self.k, self.vec = scaler, pca, k, vec
        self.components = pca.pc.toArray()
        self.mean = scaler.mean.toArray()
        self.explained = pca.explainedVariance.toArray()

    def apply(self, df: DataFrame, out: str = "latent") -> DataFrame:
        x = self._pca.transform(self._scaler.transform(_vectors(df, self.vec)))
        return x.withColumn(out, vector_to_array("_pc")).drop("_raw", "_centred", "_pc")

    def loadings(self, spark, names: Sequence[str], top: int) -> DataFrame:
        """(axis, feature, loading, rank): strongest absolute loadings per axis."""
        rows = [(a, str(n), float(self.components[i, a])) for i, n in enumerate(names) for a in range(self.k)]
        t = spark.createDataFrame(rows, "axis int, feature string, loading double")
        return top_k(t, ["axis"], [F.abs("loading").desc(), F.col("feature")], top)


def fit_projection(df: DataFrame, k: int, vec: str = "vec") -> Projection:
    """Principal components of an array column; missing entries count as 0."""
    x = _vectors(df, vec)
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred").fit(x)
    pca = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(scaler.transform(x))
    return Projection(scaler, pca, k, vec)


def principal_vectors(source: Projection, target: Projection, n: int):
    """Aligned directions of two cohorts and the angles between them, from the small cross product."""
    u, s, vt = np.linalg.svd(source.components.T @ target.components, full_matrices=False)
    return (u.T @ source.components.T)[:n], (vt @ target.components.T)[:n], np.arccos(np.clip(s, -1.0, 1.0))


def apply_directions(df: DataFrame, directions: np.ndarray, vec: str, out: str) -> DataFrame:
    """Dot products with a few fixed directions."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in d]) for d in directions])
    return df.withColumn(out, F.transform(rows, lambda d: F.aggregate(F.zip_with(F.col(vec).cast("array<double>"), d, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


# ---- classifiers ------------------------------------------------------------------------------------
def nearest_centroid(train: DataFrame, labels: DataFrame, test: DataFrame, label: str, panel: Sequence[str] | None = None, minimum: int = 20) -> DataFrame:
    """Label of the closest class centroid (squared distance over shared features) per test sample.

    Samples with fewer than `minimum` shared features are left out.
    """
    if panel is not None:
        train = train.where(F.col("feature").isin(list(panel)))
    cent = train.join(labels.select("sample_id", label), "sample_id").where(F.col(label).isNotNull()).groupBy(label, "feature").agg(F.avg("value").alias("_c"))
    d = test.select("sample_id", "feature", "value").join(cent, "feature").groupBy("sample_id", label).agg(
        F.sum(F.pow(F.col("value") - F.col("_c"), 2)).alias("distance"), F.count(F.lit(1)).alias("n_shared"))
    return keep_first(d.where(F.col("n_shared") >= minimum), ["sample_id"], [F.round("distance", 12), F.col(label)])


def softmax(scores: DataFrame, keys: Sequence[str], score: str, temperature: float = 1.0, out: str = "probability") -> DataFrame:
    """Softmax within a key over its classes (a handful of rows)."""
    w = Window.partitionBy(*keys)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return scores.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def signature_classifier_cv(df: DataFrame, folds: DataFrame, top_n: int = 200, temperature: float = 0.15, minimum: int = 3) -> DataFrame:
    """Cross-validated signature similarity: (fold, sample_id, truth, cluster, score, probability, predicted).

    `folds` is (sample_id, fold, cluster). Sums per (feature, cluster, fold) are taken once; the training
    part of a fold is the total minus its own sums, so the data is not repeated per fold.
    """
    j = df.select("sample_id", "feature", "value").where(F.col("value").isNotNull()).join(folds, "sample_id")
    s = j.groupBy("feature", "cluster", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("y"), F.sum(F.col("value") * F.col("value")).alias("yy"))
    fold_list = s.select(F.array_sort(F.collect_set("fold"))).scalar()
    cells = s.withColumn("_f", F.explode(fold_list)).where(F.col("_f") != F.col("fold")).groupBy("feature", "cluster", F.col("_f").alias("fold")).agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("yy").alias("yy"))
    w = Window.partitionBy("feature", "fold")
    cells = cells.withColumns({"tn": F.sum("n").over(w), "ty": F.sum("y").over(w), "tyy": F.sum("yy").over(w)})
    mean = F.col("ty") / F.col("tn")
    sd = F.sqrt(F.greatest(F.col("tyy") - F.col("tn") * mean * mean, F.lit(0.0)) / (F.col("tn") - 1))
    cells = cells.select("fold", "cluster", "feature", (F.col("y") / F.col("n") - (F.col("ty") - F.col("y")) / (F.col("tn") - F.col("n"))).alias("coef"), mean.alias("mean"), F.when(sd > 0, sd).alias("sd"))
    sig = top_k(cells, ["fold", "cluster"], [F.round(F.abs("coef"), 12).desc(), F.col("feature")], top_n)
    t = j.select("sample_id", "fold", F.col("cluster").alias("truth"), "feature", "value").join(sig, ["fold", "feature"]).withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd")).where(F.col("z").isNotNull())
    g = t.groupBy("fold", "sample_id", "truth", "cluster").agg(F.sum(F.col("coef") * F.col("z")).alias("_d"), F.sum(F.col("coef") * F.col("coef")).alias("_w"), F.sum(F.col("z") * F.col("z")).alias("_z"), F.count(F.lit(1)).alias("_n"))
    score = F.when((F.col("_n") >= minimum) & (F.col("_w") * F.col("_z") > 0), F.col("_d") / F.sqrt(F.col("_w") * F.col("_z"))).otherwise(0.0)
    p = softmax(g.select("fold", "sample_id", "truth", "cluster", score.alias("score")), ["fold", "sample_id"], "score", temperature)
    best = F.max_by("cluster", F.struct(F.round("score", 12), -F.col("cluster"))).over(Window.partitionBy("fold", "sample_id"))
    return p.withColumn("predicted", best)


def stratified_folds(labels: DataFrame, n: int = 5, seed: int = 42, **kw) -> DataFrame:
    """Fold number per sample, balanced within class, by hash order."""
    h = labels.withColumn("_h", F.xxhash64("sample_id", F.lit(seed)))
    r = ranked(h, ["cluster"], [F.col("_h"), F.col("sample_id")], "_r", **kw)
    return r.select("sample_id", ((F.col("_r") - 1) % n).cast("int").alias("fold"), "cluster")


def top_variance_features(df: DataFrame, n: int) -> list[str]:
    """Names of the n most variable features (a fixed-size list)."""
    v = df.groupBy("feature").agg(F.round(F.var_samp("value"), 12).alias("v"))
    return [r["feature"] for r in top_k(v, [], [F.col("v").desc_nulls_last(), F.col("feature")], n).select("feature").collect()]


def elastic_net_fit(df: DataFrame, labels: DataFrame, features: Sequence[str], c: float = 0.5, mix: float = 0.3, max_iter: int = 100):
    """Multinomial elastic net on standardised dense vectors: (model, scaler). Missing values take the feature mean."""
    return _fit_dense(_dense(df, features), labels, c, mix, max_iter)


def _fit_dense(x: DataFrame, labels: DataFrame, c: float, mix: float, max_iter: int):
    n = labels.count()
    t = x.join(labels.select("sample_id", F.col("cluster").cast("double").alias("label")), "sample_id")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="features").fit(t)
    lr = LogisticRegression(family="multinomial", elasticNetParam=mix, regParam=1.0 / (c * n), maxIter=max_iter, standardization=False)
    return lr.fit(scaler.transform(t)), scaler


def elastic_net_predict(df: DataFrame, features: Sequence[str], model, scaler) -> DataFrame:
    return _predict_dense(_dense(df, features), model, scaler)


def _predict_dense(x: DataFrame, model, scaler) -> DataFrame:
    out = model.transform(scaler.transform(x))
    return out.select("sample_id", F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("probabilities"))


def elastic_net_cv(df: DataFrame, folds: DataFrame, features: Sequence[str], c: float = 0.5, mix: float = 0.3, max_iter: int = 100) -> DataFrame:
    """Every sample as predicted by the elastic net of the other folds: (sample_id, fold, cluster, predicted, probabilities).

    `folds` is (sample_id, fold, cluster). The long rows become vectors once for all folds, and the models are
    fitted side by side, since an iteration is a short job. As in `elastic_net_fit` and `elastic_net_predict`,
    missing values take the mean of all rows in training, and that of the fold's rows in prediction.
    """
    folds, wide = cut_lineage(folds), cut_lineage(_wide(df, features))
    parts = cut_lineage(wide.join(folds, "sample_id"))
    all_means = _means(wide.withColumn("fold", F.lit(0)), len(features)).get(0, [])
    own_means = _means(parts, len(features))

    def one(fold) -> DataFrame:
        model, scaler = _fit_dense(_filled(wide, all_means), folds.where(F.col("fold") != fold).select("sample_id", "cluster"), c, mix, max_iter)
        return _predict_dense(_filled(parts.where(F.col("fold") == fold), own_means[fold]), model, scaler)

    with ThreadPoolExecutor(max(1, len(own_means))) as pool:
        done = [pool.submit(inheritable_thread_target(df.sparkSession)(one), f) for f in sorted(own_means)]
        return reduce(DataFrame.unionByName, [d.result() for d in done]).join(folds, "sample_id")


def _wide(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(sample_id, _v): the values of the features in their order, null where missing."""
    kept = df.where(F.col("feature").isin(list(features)) & F.col("value").isNotNull())
    m = kept.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_m"))
    return m.select("sample_id", F.transform(F.array(*[F.lit(f) for f in features]), lambda f: F.try_element_at(F.col("_m"), f)).alias("_v"))


def _means(wide: DataFrame, n: int) -> dict[object, list[float]]:
    """Mean of each place of `_v` per fold, 0 where no row has it."""
    out: dict[object, list[float]] = {}
    for r in wide.select("fold", F.posexplode("_v").alias("i", "x")).groupBy("fold", "i").agg(F.avg("x").alias("m")).collect():
        out.setdefault(r["fold"], [0.0] * n)[r["i"]] = 0.0 if r["m"] is None else r["m"]
    return out


def _filled(wide: DataFrame, means: list[float]) -> DataFrame:
    mean = F.array(*[F.lit(x) for x in means])
    return wide.select("sample_id", array_to_vector(F.zip_with("_v", mean, lambda v, m: F.coalesce(v, m))).alias("_raw"))


def _dense(df: DataFrame, features: Sequence[str]) -> DataFrame:
    wide = cut_lineage(_wide(df, features))
    return _filled(wide, _means(wide.withColumn("fold", F.lit(0)), len(features)).get(0, []))


def score_profiles(profiles: DataFrame, model: DataFrame, intercepts: DataFrame, minimum_coverage: float = 0.6, high: float = 0.55, moderate: float = 0.40, abstain: float = 0.25) -> DataFrame:
    """Class probabilities and a confidence class per profile from a coefficient table.

    `model` is (cluster, feature, coef, mean, scale); features a profile lacks contribute nothing, which
    is the reference mean. `intercepts` is (cluster, intercept).
    """
    features = model.select("feature").distinct()
    n = features.select(F.count(F.lit(1))).scalar()
    clean = profiles.where(F.col("value").isNotNull() & ~F.isnan("value")).select("profile_id", F.upper(F.trim("feature")).alias("feature"), "value")
    cov = clean.select("profile_id", "feature").distinct().join(features, "feature", "left_semi").groupBy("profile_id").agg(F.count(F.lit(1)).alias("found"))
    every = profiles.select("profile_id").distinct().join(cov, "profile_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    part = clean.join(model, "feature").groupBy("profile_id", "cluster").agg(F.sum(F.col("coef") * (F.col("value") - F.col("mean")) / F.col("scale")).alias("_s"))
    classes = intercepts.select(F.collect_list(F.struct("cluster", "intercept"))).scalar()
    grid = every.select("profile_id", "found", F.inline(classes)).join(part, ["profile_id", "cluster"], "left")
    p = softmax(grid.withColumn("logit", F.col("intercept") + F.coalesce("_s", F.lit(0.0))), ["profile_id"], "logit")
    best = p.groupBy("profile_id").agg(F.max("found").alias("found"), F.max_by("cluster", F.struct(F.round("probability", 12), -F.col("cluster"))).alias("top_cluster"), F.max("probability").alias("top_probability"),
                                       F.array_sort(F.collect_list(F.struct("cluster", "probability"))).alias("probabilities"))
    coverage = F.col("found") / F.greatest(n, F.lit(1))
    best = best.withColumn("coverage", coverage)
    t = F.col("top_probability")
    level = F.when(F.col("coverage") < minimum_coverage, "abstain").when(t >= high, "high").when(t >= moderate, "moderate").when(t < abstain, "abstain").otherwise("low")
    warning = F.when(F.col("coverage") < minimum_coverage, "coverage_too_low").when(t >= moderate, F.lit(None)).when(t < abstain, "probability_too_low").otherwise("diffuse")
    return best.withColumn("confidence", level).withColumn("warning", warning)


# ---- response, intervals, mixtures of parts -----------------------------------------------------------
def fit_response(rows: DataFrame, score: str, label: str):
    """Binary response on one score."""
    from pyspark.ml.feature import VectorAssembler

    asm = VectorAssembler(inputCols=[score], outputCol="features")
    train = asm.transform(rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double")))
    m = GeneralizedLinearRegression(family="binomial", link="logit").fit(train)
    return float(m.intercept), float(m.coefficients[0])


def response_probability(c: Column, intercept: float, slope: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(intercept) + F.lit(slope) * c)))


def applicability(regimens: DataFrame, cohorts: DataFrame, metrics: DataFrame, minimum: float = 0.60) -> DataFrame:
    """First represented cohort per regimen and whether its held-out AUROC clears the gate.

    `regimens` is (profile_id, drugs ARRAY); `cohorts` is (cohort, base ARRAY, options ARRAY, position);
    `metrics` is (cohort, auroc). Cohorts are a short list and travel as one array.
    """
    c = cohorts.join(metrics, "cohort", "left")
    spec = c.select(F.array_sort(F.collect_list(F.struct("position", "cohort", "base", "options", "auroc")))).scalar()
    low = F.transform("drugs", lambda d: F.lower(F.trim(d)))
    r = regimens.withColumn("_d", low).withColumn("_c", spec)
    hit = F.filter("_c", lambda x: (F.size(F.array_except(x["base"], F.col("_d"))) == 0) & F.arrays_overlap(x["options"], F.col("_d")))
    r = r.withColumn("_hit", F.get(hit, 0))
    return r.select("profile_id", F.col("_hit").isNotNull().alias("represented"), F.col("_hit.cohort").alias("cohort"), F.col("_hit.auroc").alias("held_out_auroc"), F.coalesce(F.col("_hit.auroc") >= minimum, F.lit(False)).alias("gate_passed"))


def parity(predictions: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation and largest difference of two probability columns."""
    return predictions.agg(F.corr(a, b).alias("correlation"), F.max(F.abs(F.col(a) - F.col(b))).alias("max_difference"), F.count(F.lit(1)).alias("n"))


def deconvolve(bulk: DataFrame, centroids: DataFrame, sweeps: int = 400) -> DataFrame:
    """Non-negative fractions of each sample over type centroids on the log1p scale, summing to 1.

    Spark reduces every sample to one product per type; the type-by-type matrix is small and shared, and
    the non-negative problem is solved for a whole batch at once by coordinate sweeps.
    """
    c = centroids.select("cell_type", "feature", F.log1p(F.greatest("value", F.lit(0.0))).alias("_c"))
    shared = bulk.select("feature").distinct()
    c = c.join(shared, "feature", "left_semi")
    types = [r[0] for r in c.select("cell_type").distinct().orderBy("cell_type").collect()]
    at = {t: i for i, t in enumerate(types)}
    gram = np.zeros((len(types), len(types)))
    cross = c.join(c.select(F.col("cell_type").alias("other"), "feature", F.col("_c").alias("_d")), "feature").groupBy("cell_type", "other").agg(F.sum(F.col("_c") * F.col("_d")).alias("s"))
    for r in cross.collect():
        gram[at[r["cell_type"]], at[r["other"]]] = r["s"]
    b = bulk.select("sample_id", "feature", F.log1p(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0))).alias("_b")).join(c, "feature").groupBy("sample_id", "cell_type").agg(F.sum(F.col("_b") * F.col("_c")).alias("_cb"))
    m = b.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("cell_type", "_cb"))).alias("_m"))
    vec = F.transform(F.array(*[F.lit(t) for t in types]), lambda t: F.coalesce(F.try_element_at(F.col("_m"), t), F.lit(0.0)))

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(v: pd.Series) -> pd.Series:
        rhs = np.array(v.tolist(), dtype=float)
        x = np.zeros_like(rhs)
        for _ in range(sweeps):
            before = x.copy()
            for j in range(rhs.shape[1]):
                if gram[j, j] > 0:
                    x[:, j] = np.maximum(0.0, x[:, j] - (x @ gram[:, j] - rhs[:, j]) / gram[j, j])
            if np.abs(x - before).max() < 1e-12:
                break
        total = x.sum(1, keepdims=True)
        return pd.Series(list(np.where(total > 0, x / np.where(total > 0, total, 1.0), x)))

    return m.withColumn("_x", solve(vec)).select("sample_id", F.posexplode("_x").alias("_i", "fraction")).select(
        "sample_id", F.element_at(F.array(*[F.lit(t) for t in types]), F.col("_i") + 1).alias("cell_type"), "fraction")


def ridge(rows: DataFrame, columns: Sequence[str], y: str, alpha: float = 1.0, weight: str | None = None):
    """Ridge coefficients and intercept of y on plain columns."""
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows.withColumn("label", F.col(y).cast("double")))
    n = x.count()
    lr = LinearRegression(regParam=alpha / n, elasticNetParam=0.0, standardization=False, solver="normal")
    if weight:
        lr = lr.setWeightCol(weight)
    m = lr.fit(x)
    return [float(v) for v in m.coefficients], float(m.intercept)


def linear(columns: Sequence[str], coefs: Sequence[float], intercept: float) -> Column:
    return sum((F.col(c) * float(w) for c, w in zip(columns, coefs)), F.lit(float(intercept)))


def conformal_intervals(train: DataFrame, calibration: DataFrame, test: DataFrame, columns: Sequence[str], y: str, level: float = 0.9, alpha: float = 1.0, **kw) -> DataFrame:
    """Split-conformal intervals for the test rows: fit on train, width from calibration residuals."""
    coefs, b = ridge(train, columns, y, alpha)
    pred = linear(columns, coefs, b)
    n = calibration.count()
    p = min(1.0, math.ceil((n + 1) * level) / n)
    q = exact_quantiles(calibration.select(F.abs(F.col(y) - pred).alias("_r")), [], "_r", {"_q": p}, **kw).scalar()
    return test.withColumn("predicted", pred).withColumn("lower", F.col("predicted") - q).withColumn("upper", F.col("predicted") + q)


def coverage(intervals: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """Empirical coverage overall and per group."""
    inside = F.col(y).between(F.col("lower"), F.col("upper")).cast("double")
    every = intervals.agg(F.lit("all").alias("part"), F.avg(inside).alias("coverage"), F.count(F.lit(1)).alias("n"))
    if by is None:
        return every
    return every.unionByName(intervals.groupBy(F.col(by).cast("string").alias("part")).agg(F.avg(inside).alias("coverage"), F.count(F.lit(1)).alias("n")))


def refit_weights(rows: DataFrame, columns: Sequence[str], y: str, prior: dict[str, float], alpha: float = 1.0, weight: str | None = None) -> dict[str, tuple[float, float]]:
    """Stream weights by ridge, negatives cut to 0, normalised: {column: (weight, shift from prior)}."""
    coefs, _ = ridge(rows, columns, y, alpha, weight)
    w = np.maximum(np.array(coefs), 0.0)
    w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1.0 / len(w))
    return {c: (float(v), float(v) - prior.get(c, 0.0)) for c, v in zip(columns, w)}


def abstention(widths: DataFrame, q: float = 0.98, **kw) -> DataFrame:
    """Width threshold from held-out full-view rows, with the share above it per view set.

    `widths` is (view_set, held_out, width).
    """
    tau = exact_quantiles(widths.where((F.col("view_set") == "full") & F.col("held_out")), [], "width", {"tau": q}, **kw).scalar()
    g = widths.groupBy("view_set").agg(F.avg((F.col("width") > tau).cast("double")).alias("abstention_rate"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("tau", tau)


def multi_view_encoder(views: dict[str, DataFrame], k: int, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Linear encoder: principal components per view as means, residual variance as uncertainty, combined.

    `views` maps a view name to (id, vec); a sample missing from a view has no estimate there.
    """
    from cohortgrid.operators.signatures import product_of_experts

    rows = None
    for name, df in views.items():
        proj = fit_projection(df, k, vec)
        resid = max(1e-6, 1.0 - float(proj.explained.sum()))
        part = proj.apply(df.select(id_col, vec)).select(F.col(id_col).alias("sample_id"), F.lit(name).alias("view"), F.posexplode("latent").alias("dim", "mu"),
                                                         F.lit(math.log(resid)).alias("logvar"), F.lit(True).alias("present"))
        rows = part if rows is None else rows.unionByName(part)
    return product_of_experts(rows)
