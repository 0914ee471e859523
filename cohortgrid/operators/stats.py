"""Group tests, correlations and permutation nulls, each as grouped DataFrame work.

Rank statistics come from counts per (feature, value, cluster): a value's rows are counted before
anything is ordered, so repeated values never travel, and the ordering itself is spread over value
ranges (see scans). Test tails are taken on the aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortgrid.functions.tails import FEW_RANKS, rank_sum_pvalue, t_pvalue, z_pvalue
from cohortgrid.operators.draws import shuffled_counts, shuffled_products
from cohortgrid.operators.scans import Scan, attach_row, average_ranks, bh_q, exact_quantiles, finite, keep_first, ranked, running
from cohortgrid.session import cut_lineage


def _finite(df: DataFrame, column: str) -> DataFrame:
    return df.where(finite(column))


def every_cell(df: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Each key with every group of the table, so that a group without finite values is tested too."""
    groups = df.where(F.col(group).isNotNull()).select(F.array_sort(F.collect_set(group))).scalar()
    return df.select(*keys).distinct().select(*keys, F.explode(groups).alias(group))


def rank_sums(df: DataFrame, keys: Sequence[str], value: str, group: str, **kw) -> DataFrame:
    """Per key and group: size, rank sum, value sum; with the key's size, value sum and tie term."""
    d = _finite(df, value).groupBy(*keys, value, group).agg(F.count(F.lit(1)).alias("_n"))
    d = d.groupBy(*keys, value).agg(F.sum("_n").alias("_t"), F.collect_list(F.struct(F.col(group), F.col("_n"))).alias("_by"))
    t = F.col("_t").cast("double")
    r = running(d, keys, [F.col(value)], {"_upto": Scan("sum", F.col("_t"))},
                {"n_all": F.col("_t"), "tie_term": t * t * t - t, "sum_all": t * F.col(value)}, **kw)
    rank = F.col("_upto") - (F.col("_t") - 1) / 2.0
    each = r.select(*keys, value, rank.alias("_rank"), "n_all", "tie_term", "sum_all", F.inline("_by"))
    return each.groupBy(*keys, group).agg(
        F.sum("_n").alias("n_in"), F.sum(F.col("_n") * F.col("_rank")).alias("rank_sum"), F.sum(F.col("_n") * F.col(value)).alias("sum_in"),
        F.max("n_all").alias("n_all"), F.max("tie_term").alias("tie_term"), F.max("sum_all").alias("sum_all"))


def mann_whitney(df: DataFrame, family: str, group: str = "cluster", minimum: int = 3, **kw) -> DataFrame:
    """One-vs-rest Mann-Whitney per (feature, group) with Cliff's delta as effect, U and normal score z.

    p is exact where no values tie and a side has at most 8 rows; elsewhere it is the normal tail with
    tie and continuity corrections. Only finite values count. Under `minimum` rows on a side, none
    included: effect 0, p 1.
    """
    s = every_cell(df, ["feature"], group).join(rank_sums(df, ["feature"], "value", group, **kw), ["feature", group], "left")
    w = Window.partitionBy("feature")
    s = s.withColumns({c: F.coalesce(F.max(c).over(w), F.lit(0)) for c in ("n_all", "tie_term", "sum_all")} | {c: F.coalesce(c, F.lit(0)) for c in ("n_in", "rank_sum", "sum_in")})
    n1, n = F.col("n_in").cast("double"), F.col("n_all").cast("double")
    n2 = n - n1
    enough = (n1 >= minimum) & (n2 >= minimum)
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1)))
    z = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / F.sqrt(F.nullif(var, F.lit(0.0)))
    out = s.select("feature", F.lit(family).alias("family"), group, "n_in", (F.col("n_all") - F.col("n_in")).alias("n_out"),
                   F.when(enough, F.try_divide(2 * u, n1 * n2) - 1).otherwise(0.0).alias("effect"), F.try_divide(F.col("sum_in"), n1).alias("mean_in"),
                   F.try_divide(F.col("sum_all") - F.col("sum_in"), n2).alias("mean_out"), u.alias("u"), F.when(enough & (var > 0), z).alias("z"),
                   F.when(enough & (F.col("tie_term") == 0) & (F.least(n1, n2) <= FEW_RANKS), u).alias("_u"))
    return out.withColumn("p", F.coalesce(rank_sum_pvalue("n_in", "n_out", "_u"), z_pvalue("z"), F.lit(1.0))).drop("_u")


def with_q(tests: DataFrame, group: str = "cluster", keys: Sequence[str] = ("family",), **kw) -> DataFrame:
    return bh_q(tests, keys, "p", ["feature", group], **kw)


def group_moments(df: DataFrame, keys: Sequence[str], group: str, value: str = "value") -> DataFrame:
    """Size, mean and squared deviations per (keys, group) and of the rest of the key."""
    g = _finite(df, value).groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(F.lit(1))).alias("m2"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("_N", F.sum("n").over(w)).withColumn("_M", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("_N"))
    g = g.withColumn("_T", F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_M"), 2)).over(w))
    rest_n = F.col("_N") - F.col("n")
    rest_mean = F.when(rest_n > 0, (F.col("_M") * F.col("_N") - F.col("n") * F.col("mean")) / rest_n)
    g = g.withColumn("rest_n", rest_n).withColumn("rest_mean", rest_mean)
    rest_m2 = F.col("_T") - F.col("m2") - F.col("n") * F.col("rest_n") / F.col("_N") * F.pow(F.col("mean") - F.col("rest_mean"), 2)
    return g.withColumn("rest_m2", F.greatest(rest_m2, F.lit(0.0))).drop("_N", "_M", "_T")


def welch(g: DataFrame) -> DataFrame:
    """Welch t and Satterthwaite df from (n, mean, m2) against (rest_n, rest_mean, rest_m2)."""
    n1, n2 = F.col("n").cast("double"), F.col("rest_n").cast("double")
    v1, v2 = F.try_divide(F.col("m2"), (n1 - 1) * n1), F.try_divide(F.col("rest_m2"), (n2 - 1) * n2)
    se = F.sqrt(v1 + v2)
    den = F.try_divide(v1 * v1, n1 - 1) + F.try_divide(v2 * v2, n2 - 1)
    df = F.when(den > 0, (v1 + v2) * (v1 + v2) / den).otherwise(n1 + n2 - 2)
    t = F.when(se > 0, (F.col("mean") - F.col("rest_mean")) / se)
    return g.withColumn("t", t).withColumn("df", df)


def welch_one_vs_rest(df: DataFrame, family: str = "gene", group: str = "cluster", minimum: int = 3) -> DataFrame:
    """Mean difference, Welch t, df and p of each group against the rest, per feature.

    A zero standard error gives p 1 and no t, and such rows stay out of the q values. Only finite
    values count; under `minimum` rows on a side, none included: effect 0, p 1.
    """
    g = every_cell(df, ["feature"], group).join(welch(group_moments(df, ["feature"], group)), ["feature", group], "left")
    everything = F.coalesce(F.max(F.col("n") + F.col("rest_n")).over(Window.partitionBy("feature")), F.lit(0))
    g = g.withColumn("rest_n", F.coalesce("rest_n", everything)).withColumn("n", F.coalesce("n", F.lit(0)))
    enough = (F.col("n") >= minimum) & (F.col("rest_n") >= minimum)
    out = g.select("feature", F.lit(family).alias("family"), group, F.when(enough, F.col("mean") - F.col("rest_mean")).otherwise(0.0).alias("effect"),
                   F.when(enough, F.col("t")).alias("t"), F.when(enough, F.col("df")).alias("df"), F.col("n").alias("n_in"), F.col("rest_n").alias("n_out"))
    return out.withColumn("p", F.coalesce(t_pvalue("t", "df"), F.lit(1.0)))


def with_q_where_tested(tests: DataFrame, group: str = "cluster", keys: Sequence[str] = ("family",), **kw) -> DataFrame:
    """q over rows with a statistic; others keep a null q."""
    done = bh_q(tests.where(F.col("t").isNotNull()), keys, "p", ["feature", group], **kw)
    return done.unionByName(tests.where(F.col("t").isNull()).withColumn("q", F.lit(None).cast("double")))


def cluster_vs_normal(df: DataFrame, pairs: DataFrame, minimum: int = 3) -> DataFrame:
    """Per (cluster, feature): mean difference to the normals, paired t on matched pairs, Welch on the others.

    `df` is (sample_id, patient, grp, cluster, feature, value); `pairs` is (patient, tumour_id, normal_id).
    A patient with two normals gives two pairs.
    """
    tumour, normal = df.where(F.col("grp") == "tumour"), df.where(F.col("grp") == "normal")
    t = tumour.groupBy("cluster", "feature").agg(F.avg("value").alias("_mt"))
    n = normal.groupBy("feature").agg(F.count(F.lit(1)).alias("rest_n"), F.avg("value").alias("rest_mean"), (F.var_pop("value") * F.count(F.lit(1))).alias("rest_m2"))
    d = (
        pairs.join(tumour.select(F.col("sample_id").alias("tumour_id"), "cluster", "feature", F.col("value").alias("_a")), "tumour_id")
        .join(normal.select(F.col("sample_id").alias("normal_id"), "feature", F.col("value").alias("_b")), ["normal_id", "feature"])
    )
    delta = F.col("_a") - F.col("_b")
    paired = d.groupBy("cluster", "feature").agg(F.count(F.lit(1)).alias("n_paired"), F.avg(delta).alias("_md"), F.stddev_samp(delta).alias("_sd"))
    loose = tumour.join(pairs.select("patient").distinct(), "patient", "left_anti")
    u = loose.groupBy("cluster", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count(F.lit(1))).alias("m2"))
    j = t.join(n, "feature").join(paired, ["cluster", "feature"], "left").join(u, ["cluster", "feature"], "left")
    j = welch(j.withColumn("n", F.coalesce("n", F.lit(0)))).withColumn("n_paired", F.coalesce("n_paired", F.lit(0)))
    tp = F.when((F.col("n_paired") >= minimum) & (F.col("_sd") > 0), F.col("_md") / (F.col("_sd") / F.sqrt("n_paired")))
    tu = F.when((F.col("n") >= minimum) & (F.col("rest_n") >= minimum), F.col("t"))
    out = j.select("cluster", "feature", (F.col("_mt") - F.col("rest_mean")).alias("log2fc"), "n_paired", F.col("n").alias("n_unpaired"),
                   tp.alias("t_paired"), (F.col("n_paired") - 1).alias("df_paired"), tu.alias("t_unpaired"), F.col("df").alias("df_unpaired"))
    return out.withColumn("p_paired", F.coalesce(t_pvalue("t_paired", F.col("df_paired").cast("double")), F.lit(1.0))).withColumn(
        "p_unpaired", F.coalesce(t_pvalue("t_unpaired", "df_unpaired"), F.lit(1.0)))


def adjusted_one_vs_rest(df: DataFrame, group: str = "cluster", stratum: str = "subtype") -> DataFrame:
    """Least squares of each feature on intercept, group membership and stratum indicators.

    Indicators are removed by centring within strata, which leaves sums per (feature, stratum, group):
    coef = sum(w d) / sum(w) with w = n1 n0 / n, d = difference of means within the stratum.
    """
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("Unknown"))
    g = df.withColumn("_s", s).groupBy("feature", "_s", group).agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_y"), (F.var_pop("value") * F.count(F.lit(1))).alias("_m2"))
    w = Window.partitionBy("feature", "_s")
    g = g.withColumn("_ns", F.sum("_n").over(w)).withColumn("_ys", F.sum("_y").over(w))
    within = F.sum(F.col("_m2") + F.col("_n") * F.pow(F.col("_y") / F.col("_n") - F.col("_ys") / F.col("_ns"), 2)).over(w)
    g = g.withColumn("_ss", within)
    strata = g.select("feature", "_s", "_ns", "_ss").distinct().groupBy("feature").agg(F.sum("_ss").alias("_tss"), F.sum("_ns").alias("_n_all"), F.count(F.lit(1)).alias("_k"))
    n1 = F.col("_n").cast("double")
    n0 = F.col("_ns") - n1
    weight = F.when(n0 > 0, n1 * n0 / F.col("_ns")).otherwise(0.0)
    diff = F.when(n0 > 0, F.col("_y") / n1 - (F.col("_ys") - F.col("_y")) / n0).otherwise(0.0)
    c = g.groupBy("feature", group).agg(F.sum(weight * diff).alias("_num"), F.sum(weight).alias("_den")).join(strata, "feature")
    coef = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(0.0)
    dof = F.greatest(F.col("_n_all") - F.col("_k") - 1, F.lit(1)).cast("double")
    c = c.withColumn("coef", coef).withColumn("df", dof)
    rss = F.greatest(F.col("_tss") - F.col("coef") * F.col("_num"), F.lit(0.0))
    se = F.sqrt(rss / F.col("df") / F.col("_den"))
    out = c.withColumn("t", F.when((F.col("_den") > 0) & (se > 0), F.col("coef") / se).otherwise(0.0))
    return out.select("feature", group, "coef", "t", "df").withColumn("p", t_pvalue(F.abs("t"), "df"))


def correlate_to_centroids(samples: DataFrame, centroids: DataFrame, group: str = "cluster", sample: str = "sample_id") -> DataFrame:
    """Pearson r of every sample with every centroid over shared features."""
    c = centroids.select("feature", group, F.col("value").alias("_c"))
    return samples.select(sample, "feature", "value").join(c, "feature").groupBy(sample, group).agg(F.coalesce(F.corr("value", "_c"), F.lit(0.0)).alias("r"))


def assign_best(scores: DataFrame, group: str = "cluster", sample: str = "sample_id", score: str = "r") -> DataFrame:
    """Best scoring group per sample; equal scores go to the lower group."""
    return keep_first(scores, [sample], [F.round(score, 12).desc(), F.col(group)])


def spearman(pairs: DataFrame, x: str, y: str, keys: Sequence[str] = (), minimum: int = 3, **kw) -> DataFrame:
    """Rank correlation per key with n; null under `minimum` rows or when a side is constant."""
    k = list(keys)
    p = _finite(_finite(pairs, x), y).select(*k, F.col(x).alias("_x"), F.col(y).alias("_y"))
    # Both ranks are taken of the counted pairs, which are worked out once.
    counted = cut_lineage(p.groupBy(*k, "_x", "_y").agg(F.count(F.lit(1)).alias("_n")))
    rx = average_ranks(counted, k, "_x", "_n", **kw).select(*k, "_x", F.col("avg_rank").alias("_rx"))
    ry = average_ranks(counted, k, "_y", "_n", **kw).select(*k, "_y", F.col("avg_rank").alias("_ry"))
    j = counted.join(rx, [*k, "_x"]).join(ry, [*k, "_y"])
    n = F.sum("_n")
    sx, sy = F.sum(F.col("_n") * F.col("_rx")), F.sum(F.col("_n") * F.col("_ry"))
    mid = (n + 1) / 2.0
    sxy = F.sum(F.col("_n") * F.col("_rx") * F.col("_ry")) - n * mid * mid
    sxx = F.sum(F.col("_n") * F.col("_rx") * F.col("_rx")) - n * mid * mid
    syy = F.sum(F.col("_n") * F.col("_ry") * F.col("_ry")) - n * mid * mid
    agg = j.groupBy(*k).agg(n.alias("n"), F.when((n >= minimum) & (sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).alias("rho")) if k else j.agg(
        n.alias("n"), F.when((n >= minimum) & (sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).alias("rho"))
    return agg


def spearman_split(pairs: DataFrame, x: str, y: str, flag: str, **kw) -> DataFrame:
    """Rank correlation over all rows, the flagged rows and the others."""
    split = pairs.select(x, y, F.explode(F.array(F.lit("all"), F.when(F.col(flag), "in").otherwise("out"))).alias("part"))
    return spearman(split, x, y, ["part"], **kw)


def target_sensitivity(screen: DataFrame, activity: DataFrame, minimum: int = 20, **kw) -> DataFrame:
    """Rank correlation of mean absolute activity of a row's targets with its negative response.

    `screen` is (row_id, sample_id, response, targets ARRAY); `activity` is (sample_id, node, activity). Rows
    that share a row_id share their targets. Activity is summed up once per sample and list of targets,
    whatever the rows that have them; scores equal to 12 digits are ties.
    """
    each = screen.select("sample_id", "targets").distinct().withColumn("node", F.explode("targets"))
    sums = cut_lineage(each.join(activity, ["sample_id", "node"]).groupBy("sample_id", "targets").agg(F.sum(F.abs("activity")).alias("_s"), F.count("activity").alias("_c")))
    hit = screen.join(sums, ["sample_id", "targets"]).groupBy("row_id").agg(F.round(F.sum("_s") / F.nullif(F.sum("_c"), F.lit(0)), 12).alias("score"))
    j = cut_lineage(screen.join(hit, "row_id").select("sample_id", "score", (-F.col("response")).alias("_neg")))
    rho = spearman(j, "score", "_neg", (), minimum, **kw)
    extra = j.agg(F.count_distinct("sample_id").alias("n_lines"), F.avg((F.col("score") > 0).cast("double")).alias("any_active"))
    return attach_row(rho, extra)


def shuffled(df: DataFrame, row: str, column: str, n: int, seed: int = 0, keep_order: Sequence[str] = (), **kw) -> DataFrame:
    """n shuffles of `column` over rows as (perm, row, column).

    Rows are numbered once by `row`; for each replicate the values are numbered by a hash of
    (replicate, row, seed). The two numberings meet by equality.
    """
    base = ranked(df.select(row, column), [], [F.col(row)], "_pos", **kw)
    reps = base.select(F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm"), row, column)
    order = reps.withColumn("_h", F.xxhash64("perm", row, F.lit(seed)))
    mixed = ranked(order, ["perm"], [F.col("_h"), F.col(row)], "_pos", **kw).select("perm", "_pos", column)
    return mixed.join(base.select(row, "_pos"), "_pos").select("perm", row, column)


def composition_null(reference: DataFrame, called: DataFrame, subtypes: DataFrame, groups: Sequence, vocabulary: Sequence, n_perm: int, seed: int = 0) -> DataFrame:
    """(perm, statistic): agreement with `reference` when the called clusters are shuffled over the samples, from the margins."""
    cells = called.join(subtypes, "sample_id", "left").groupBy("subtype").agg(F.count(F.lit(1)).alias("n"))
    have = called.agg(F.count(F.lit(1)), *[F.count_if(F.col("cluster") == g) for g in groups]).first()
    drawn = shuffled_counts(cells, ["subtype"], [*have[1:], have[0] - sum(have[1:])], n_perm, seed).where(F.col("subtype").isin(list(vocabulary)))
    each = drawn.select("perm", "subtype", F.inline(F.array(*[F.struct(F.lit(g).alias("cluster"), F.col(f"_c{i}").alias("_n")) for i, g in enumerate(groups)])))
    share = each.withColumn("share", F.col("_n") / F.nullif(F.sum("_n").over(Window.partitionBy("perm", "cluster")), F.lit(0)))
    return matrix_agreement(reference, share, keys=["perm"]).select("perm", F.col("r").alias("statistic"))


def draw_correlations(samples: DataFrame, centroids: DataFrame, draws: DataFrame) -> DataFrame:
    """Pearson r of every sample with every centroid over each draw of features: (draw, sample_id, cluster, r).

    Centroids and draws are small and go to the tasks. A sample's features are one row; the sums over all draws
    are products with the draws' 0/1 table, so no row is copied per draw. r is null where a side is constant.
    """
    cent = centroids.select("cluster", "feature", F.col("value").cast("double").alias("value")).toPandas()
    drawn = draws.select("draw", "feature").toPandas()
    names = sorted(set(cent["feature"]) & set(drawn["feature"]))
    place = {f: i for i, f in enumerate(names)}
    ids = sorted(drawn["draw"].unique())
    chosen = np.zeros((len(names), len(ids)))
    inside = drawn[drawn["feature"].isin(place)]
    np.add.at(chosen, (inside["feature"].map(place).to_numpy(int), np.searchsorted(ids, inside["draw"])), 1)
    table = {k: g[g["feature"].isin(place)] for k, g in cent.groupby("cluster")}
    kind = dict(samples.dtypes)["sample_id"]
    whole = samples.where(F.col("value").isNotNull()).groupBy("sample_id").agg(F.collect_list(F.struct("feature", F.col("value").cast("double").alias("value"))).alias("row"))

    def score(parts):
        for pdf in parts:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                z, seen = np.zeros((len(part), len(names))), np.zeros((len(part), len(names)))
                for i, row in enumerate(part["row"]):
                    for x in row:
                        j = place.get(x["feature"])
                        if j is not None:
                            z[i, j], seen[i, j] = x["value"], 1
                for k, g in table.items():
                    c, has = np.zeros(len(names)), np.zeros(len(names))
                    c[g["feature"].map(place)], has[g["feature"].map(place)] = g["value"], 1
                    # Values are taken from their means first, so that the sums stay small.
                    both = seen * has
                    shift, c0 = (z * both).sum(axis=1, keepdims=True) / np.maximum(both.sum(axis=1, keepdims=True), 1), c - c.mean()
                    x = (z - shift) * both
                    n, sx, sy = both @ chosen, x @ chosen, (both * c0) @ chosen
                    sxx, syy, sxy = (x * x) @ chosen, (both * c0 * c0) @ chosen, (x * c0) @ chosen
                    m = np.maximum(n, 1)
                    vx, vy = sxx - sx * sx / m, syy - sy * sy / m
                    ok = (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
                    r = np.where(ok, (sxy - sx * sy / m) / np.sqrt(np.where(ok, vx * vy, 1)), np.nan)
                    keep = n > 0
                    s, d = np.nonzero(keep)
                    value = pd.Series(r[keep]).astype(object).where(ok[keep], None)
                    yield pd.DataFrame({"draw": np.array(ids)[d], "sample_id": part["sample_id"].to_numpy()[s], "cluster": k, "r": value})

    return whole.mapInPandas(score, f"draw int, sample_id {kind}, cluster {dict(centroids.dtypes)['cluster']}, r double")


def spearman_null(pairs: DataFrame, row: str, x: str, y: str, n_perm: int, seed: int = 0, **kw) -> DataFrame:
    """Observed rank correlation with null mean, deviation and two-sided share |null| >= |rho|.

    The shuffles are drawn by position (see `shuffled_products`), the same at every size.
    """
    p = cut_lineage(_finite(_finite(pairs, x), y).select(row, x, y))
    obs = spearman(p, x, y, (), 10, **kw)
    middle = p.select((F.count(F.lit(1)) + 1) / 2).scalar()
    ranks = lambda c: average_ranks(p, [], c, **kw).select((F.col("avg_rank") - middle).alias("value"), F.col("n_ties").alias("n"))
    rx, ry = cut_lineage(ranks(x)), cut_lineage(ranks(y))
    across = [r.select(F.sum(F.col("n") * F.col("value") ** 2)).scalar() for r in (rx, ry)]
    null = shuffled_products(rx, ry, n_perm, seed).select(F.when((across[0] > 0) & (across[1] > 0), F.col("xy") / F.sqrt(across[0] * across[1])).alias("null"))
    rho = obs.select("rho").scalar()
    s = null.agg(F.avg("null").alias("null_mean"), F.stddev_pop("null").alias("null_sd"), F.avg((F.abs("null") >= F.abs(rho)).cast("double")).alias("p"))
    return attach_row(s, obs)


def null_summary(null: DataFrame, observed: DataFrame, value: str = "statistic", plus_one: bool = True, **kw) -> DataFrame:
    """Observed value against replicate values: p with or without +1, median, 95th percentile, maximum."""
    obs = observed.select(value).scalar()
    add = 1 if plus_one else 0
    s = null.where(F.col(value).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_null"), F.count_if(F.col(value) >= obs).alias("n_ge"), F.max(value).alias("null_max"), F.avg(value).alias("null_mean"))
    q = exact_quantiles(null, [], value, {"null_median": 0.5, "null_p95": 0.95}, **kw)
    return attach_row(s, q).withColumn("observed", obs).withColumn("p", (F.col("n_ge") + add) / (F.col("n_null") + add)).withColumn("exceeds_p95", F.col("observed") > F.col("null_p95"))


def matrix_agreement(a: DataFrame, b: DataFrame, group: str = "cluster", label: str = "subtype", value: str = "share", keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r of two group-by-label tables and the number of groups with the same majority label."""
    k = list(keys)
    j = b.select(*k, group, label, F.col(value).alias("_b")).join(a.select(group, label, F.col(value).alias("_a")), [group, label]).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    major = j.groupBy(*k, group).agg(F.max_by(F.col(label), F.struct("_a", F.col(label))).alias("_ma"), F.max_by(F.col(label), F.struct("_b", F.col(label))).alias("_mb"))
    agree = major.groupBy(*k).agg(F.count_if(F.col("_ma") == F.col("_mb")).alias("n_agree"))
    r = j.groupBy(*k).agg(F.corr("_a", "_b").alias("r"))
    if k:
        return r.join(agree, k)
    return attach_row(r, agree)


def direction_check(signatures: DataFrame, genes: Sequence[str], value: str = "log2fc", group: str = "cluster") -> DataFrame:
    """Mean of a gene list per group (0 when none is present) and whether all groups are above zero."""
    m = signatures.groupBy(group).agg(F.coalesce(F.avg(F.when(F.col("feature").isin(list(genes)), F.col(value))), F.lit(0.0)).alias("mean_value"))
    return m.withColumn("passed", m.select(F.every(F.col("mean_value") > 0)).scalar())


def direction_angle(centroids: DataFrame, sizes: DataFrame, normal: DataFrame, group: str = "cluster") -> DataFrame:
    """Angle in degrees between (centroid - normal) and (centroid - mean of the other rows), per group.

    `centroids` is (group, feature, value), `sizes` is (group, n), `normal` is (feature, value).
    """
    c = centroids.join(sizes, group)
    w = Window.partitionBy("feature")
    c = c.withColumn("_N", F.sum("n").over(w)).withColumn("_S", F.sum(F.col("n") * F.col("value")).over(w))
    c = c.withColumn("_rest", (F.col("_S") - F.col("n") * F.col("value")) / (F.col("_N") - F.col("n")))
    j = c.join(normal.select("feature", F.col("value").alias("_normal")), "feature")
    a, b = F.col("value") - F.col("_normal"), F.col("value") - F.col("_rest")
    g = j.groupBy(group).agg(F.sum(a * b).alias("_ab"), F.sum(a * a).alias("_aa"), F.sum(b * b).alias("_bb"))
    cos = F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))
    return g.select(group, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).alias("degrees"))


def feature_agreement(a: DataFrame, b: DataFrame, minimum: int = 10, floor: float = 0.3, **kw) -> DataFrame:
    """Rank correlation per feature between two assays of the same samples, with the share reaching the floor."""
    j = a.select("sample_id", "feature", F.col("value").alias("_x1")).join(b.select("sample_id", "feature", F.col("value").alias("_x2")), ["sample_id", "feature"])
    rho = spearman(j, "_x1", "_x2", ["feature"], minimum, **kw).where(F.col("rho").isNotNull())
    return rho.withColumn("share_passing", rho.select(F.avg((F.col("rho") >= floor).cast("double"))).scalar())
