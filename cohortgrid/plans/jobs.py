"""End-to-end jobs composed from the operators. Each takes tables keyed by sample, profile or cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortgrid.functions.cleaning import config_key
from cohortgrid.operators import aggregates as A
from cohortgrid.operators import documents as D
from cohortgrid.operators import evaluation as V
from cohortgrid.operators import governance as G
from cohortgrid.operators import joins as J
from cohortgrid.operators import mixtures as M
from cohortgrid.operators import ml as ML
from cohortgrid.operators import signatures as S
from cohortgrid.operators import stats as T
from cohortgrid.operators import survival as K
from cohortgrid.operators import windows as W
from cohortgrid.operators.scans import attach_row, top_k
from cohortgrid.session import cut_lineage


def reversal_lists(arm_rows: DataFrame, perturbations: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compound lists reversing each key's arms: signature scores rolled up per compound and ranked within the key."""
    scores = S.set_difference(arm_rows, perturbations, keys).join(meta, "sig_id")
    return A.compound_rollup(scores, keys)


def profile_matrix(measurements: DataFrame, family: DataFrame, clusters: Sequence[int], quotas: dict[str, int]) -> DataFrame:
    """One-vs-rest tests with q, strongest rows per family, as a feature by cluster matrix."""
    tests = T.with_q_where_tested(T.welch_one_vs_rest(measurements))
    return A.effect_matrix(tests.drop("family").join(family, "feature"), clusters, quotas)


def feature_profiles(activity: DataFrame, expression: DataFrame, family_of: dict[str, str] | None = None) -> DataFrame:
    """Every activity by rank test and every non-constant feature by Welch test, q within family.

    `activity` is (sample_id, cluster, family, feature, value); `expression` is (sample_id, cluster, feature, value).
    """
    ranks = None
    for name in (family_of or {"pathway": "pathway", "tf": "tf"}).values():
        part = T.mann_whitney(activity.where(F.col("family") == name), name).select("feature", "family", "cluster", "effect", F.col("z").alias("statistic"), "p")
        ranks = part if ranks is None else ranks.unionByName(part)
    varying = expression.groupBy("feature").agg((F.max("value") > F.min("value")).alias("_v")).where("_v").select("feature")
    genes = T.welch_one_vs_rest(expression.join(varying, "feature", "left_semi")).select("feature", "family", "cluster", "effect", F.col("t").alias("statistic"), "p")
    return T.bh_q(ranks.unionByName(genes), ["family"], "p", ["feature", "cluster"])


def cluster_reversal(measurements: DataFrame, pairs: DataFrame, perturbations: DataFrame, meta: DataFrame, roles: DataFrame, role_lists: dict[str, Sequence[str]], n_side: int = 150, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """Reversal candidates per cluster against its normals, and the known-answer control.

    Signatures vs normal, their strongest features, correlation with every perturbation row, median per
    drug over at least two rows, best drugs per cluster.
    """
    sig = T.cluster_vs_normal(measurements, pairs).select("cluster", "feature", F.col("log2fc").alias("effect"))
    q = S.query_signature(sig, ["cluster"], "effect", n_side)
    scores = S.connectivity(q, perturbations, ["cluster"]).join(meta, "sig_id")
    med = A.exact_quantiles(scores, ["cluster", "drug"], "reversal_score", {"reversal_score": 0.5}, count="n_signatures").where(F.col("n_signatures") >= 2)
    ranked = top_k(med, ["cluster"], [F.round("reversal_score", 12).desc(), F.col("drug")], top)
    return ranked, G.known_answers(ranked.select("cluster", F.col("drug").alias("canonical")), roles, role_lists)


def assemble_cohort(vectors: DataFrame, follow_up: DataFrame, ks: Sequence[int] = tuple(range(2, 9)), dim: int = 16, n_boot: int = 50, seed: int = 0) -> dict[str, DataFrame]:
    """Latent, selection table, chosen k, all configurations, their survival tests and curves of the chosen one.

    `vectors` is (id, vec), `follow_up` is (id, time, event); rows without a vector are left out. Structure is
    chosen before any outcome is joined. All configurations and resamples are fitted side by side, and the silhouettes of all k
    share one comparison of points.
    """
    vectors = vectors.where(F.col("vec").isNotNull())
    proj = ML.fit_projection(vectors, dim)
    latent = cut_lineage(proj.apply(vectors).select("id", "latent"))
    fits = M.fit_all(latent, ks, M.KINDS, n_boot, seed=seed)
    method = F.when(F.col("kind") == "kmeans", "kmeans").otherwise("gmm")
    covariance = F.when(F.col("kind") != "kmeans", F.col("kind"))
    configs = cut_lineage(fits.assignments().withColumns({"method": method, "covariance_type": covariance}).withColumn("config_id", config_key(F.col("method"), F.col("covariance_type"), F.col("k"))))
    wide = configs.where("kind = 'full'").groupBy("id").pivot("k", list(ks)).agg(F.first("cluster"))
    sil = V.silhouettes(latent.join(wide, "id"), [str(k) for k in ks], "latent").select(F.col("labelling").cast("int").alias("k"), "silhouette")
    full = F.col("kind") == "full"
    selection = cut_lineage(fits.selection().where(full).select("k", "bic").join(sil, "k").join(fits.stability().where(full).select("k", "stability"), "k"))
    chosen = cut_lineage(V.choose_k(selection))
    surv = follow_up.join(configs.select("id", "config_id", "method", "covariance_type", "k", F.col("cluster").alias("grp")), "id")
    tests = K.sensitivity_logrank(surv, "config_id", list(range(max(ks))))
    picked = surv.join(chosen.select("method", "covariance_type", F.col("best_k").alias("k")), ["method", "covariance_type", "k"], "left_semi")
    curves = K.kaplan_meier(picked, ["grp"])
    return {"latent": latent, "selection": selection, "chosen": chosen, "assignments": configs, "logrank": tests, "curves": curves}


def transfer_test(z_target: DataFrame, centroids: DataFrame, reference: DataFrame, subtypes: DataFrame, follow_up: DataFrame, groups: Sequence[int], vocabulary: Sequence, n_perm: int = 1000, seed: int = 0) -> DataFrame:
    """External transfer gate: degeneracy guard, composition agreement, outcome separation, negative control; one row."""
    called = cut_lineage(T.assign_best(T.correlate_to_centroids(z_target, centroids)).select("sample_id", "cluster"))
    ref = A.composition(reference, groups, vocabulary)
    agree = T.matrix_agreement(ref, A.composition(called.join(subtypes, "sample_id"), groups, vocabulary))
    null_r = T.composition_null(ref, called, subtypes.select("sample_id", "subtype"), groups, vocabulary, n_perm, seed)
    comp = T.null_summary(null_r, agree.select(F.col("r").alias("statistic"))).select(F.col("observed").alias("composition_r"), F.col("p").alias("composition_p"))
    s = follow_up.join(called.withColumnRenamed("cluster", "grp"), "sample_id")
    obs = K.logrank(s, [], groups)
    followed = called.withColumnRenamed("cluster", "grp").join(follow_up, "sample_id", "left")
    null_s = K.logrank_null(followed, groups, n_perm, seed + 1)
    ctrl = T.null_summary(null_s, obs.select("statistic")).select(F.col("observed").alias("statistic"), F.col("null_p95"), F.col("exceeds_p95").alias("control_passed"))
    deg = A.degeneracy(called).agg(F.max("largest_share").alias("largest_share"), F.bool_or("degenerate").alias("degenerate"))
    out = agree.select("n_agree")
    for part in (comp, ctrl, obs.select(F.col("p").alias("logrank_p"), "n", "n_events"), deg):
        out = attach_row(out, part)
    primary = (F.col("n_agree") >= 2) & (F.col("composition_r") > 0.5) & (F.col("composition_p") < 0.05)
    return out.withColumn("primary_passed", primary).withColumn("passed", primary & (F.col("logrank_p") < 0.05) & F.col("control_passed") & ~F.col("degenerate"))


def analyse_profiles(assignment: DataFrame, z: DataFrame, centroids: DataFrame, cluster_lists: DataFrame, perturbations: DataFrame, meta: DataFrame, n_side: int = 150) -> DataFrame:
    """Both lists and their nominations for a table of profiles: one row per (profile, compound).

    List 1 is the profile's cluster list; list 2 reverses the profile's residual. Scoring one profile or
    a million is the same job.
    """
    res = S.residual(z, assignment, centroids)
    mine = S.arms(res, ["profile_id"], "residual", n_side, n_side)
    counts = cut_lineage(S.set_difference_counts(mine, perturbations, meta, ["profile_id"]))
    # A profile has one row per compound at most. Dealt by profile once, its rows stay where they are to the end.
    most = meta.select("drug").distinct().count()
    list2 = A.compound_rollup_counts(counts.repartition("profile_id"), ["profile_id"], at_most=most).select("profile_id", "canonical", F.col("percentile").alias("list2_percentile"), F.col("rank").alias("list2_rank"), "n_cell_lines", "consistency", "targets")
    listed = cut_lineage(cluster_lists.select("cluster", "canonical", F.col("percentile").alias("list1_percentile"), F.col("rank").alias("list1_rank")))
    d = list2.join(assignment.select("profile_id", "cluster"), "profile_id").join(listed, ["cluster", "canonical"])
    d = d.select("profile_id", "canonical", "cluster", "list1_percentile", "list1_rank", "list2_percentile", "list2_rank", "n_cell_lines", "consistency", "targets")
    d = G.robustness(d.withColumn("weaker_percentile", F.least("list1_percentile", "list2_percentile")).withColumn("rank_product", F.sqrt(F.col("list1_percentile") * F.col("list2_percentile"))))
    order = [-F.round("weaker_percentile", 12), -F.round("rank_product", 12), F.col("canonical")]
    return W.ranked(d, ["profile_id"], order, "nomination_rank", at_most=most)


def refresh_derived(profiles: DataFrame, previous: DataFrame, clusters: Sequence[int], quotas: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Takeaways recomputed from current profiles, and the rows that changed against the previous ones."""
    matrix = A.effect_matrix(profiles, clusters, quotas)
    kept = profiles.join(matrix.select("feature", "family"), ["feature", "family"], "left_semi")
    now = D.cluster_takeaways(kept)
    gone = previous.exceptAll(now).withColumn("change", F.lit("was"))
    return now, gone.unionByName(now.exceptAll(previous).withColumn("change", F.lit("now")))


def enrich_neighbours(samples: DataFrame, lines: DataFrame, k: int = 5, dim: int = 10, n_axes: int = 5) -> DataFrame:
    """Joint projection of samples and lines, nearest lines per sample, fingerprints on a shared scale, subtype match.

    `samples` is (id, vec, subtype), `lines` is (id, vec, subtype).
    """
    both = samples.select("id", "vec").unionByName(lines.select("id", "vec"))
    proj = ML.fit_projection(both, dim)
    a = cut_lineage(proj.apply(samples).select("id", F.col("latent").alias("vec"), "subtype"))
    b = cut_lineage(proj.apply(lines).select("id", F.col("latent").alias("vec"), "subtype"))
    near = J.nearest_references(a, b, k)
    j = near.join(a.select(F.col("id").alias("query_id"), F.col("vec").alias("_a"), F.col("subtype").alias("sample_subtype")), "query_id").join(
        b.select(F.col("id").alias("ref_id"), F.col("vec").alias("_b"), F.col("subtype").alias("line_subtype")), "ref_id")
    f = S.fingerprints(j, "_a", "_b", n_axes, shared_by=["query_id"])
    return f.select("query_id", "ref_id", "similarity", "rank", "fingerprint", (F.col("sample_subtype") == F.col("line_subtype")).alias("subtype_match"))
