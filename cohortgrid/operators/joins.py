"""Lookups, list joins, graph neighbourhoods and nearest-reference search.

No join here carries a broadcast hint: dictionaries are joined as they are, and the optimizer
broadcasts a side only when its measured size is under `spark.sql.autoBroadcastJoinThreshold`;
larger sides are shuffled, with skewed partitions split at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortgrid.functions import cleaning as C
from cohortgrid.functions.vocabulary import CATEGORY_ORDER
from cohortgrid.operators.blocks import meet, unit_rows
from cohortgrid.operators.scans import Scan, exact_quantiles, keep_first, medians, ranked, running, top_k


def attach_first(ids: DataFrame, table: DataFrame, id_key: Column, table_key: Column, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Left join with the first table row per key, keeping every id row."""
    first = keep_first(table.withColumn("_k", table_key), ["_k"], order).select("_k", *columns)
    return ids.withColumn("_k", id_key).join(first, "_k", "left").drop("_k")


def matched_pairs(samples: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(patient, tumour_id, normal_id): the first tumour of a patient with each of that patient's normals."""
    tumours = keep_first(samples.where(F.col("grp") == "tumour"), ["patient"], order).select("patient", F.col("sample_id").alias("tumour_id"))
    normals = samples.where(F.col("grp") == "normal").select("patient", F.col("sample_id").alias("normal_id"))
    return tumours.join(normals, "patient")


def shared_features(a: DataFrame, b: DataFrame, minimum: int) -> DataFrame:
    """Features present on both sides with their count and whether that is enough to go on."""
    shared = a.select("feature").intersect(b.select("feature"))
    n = shared.select(F.count(F.lit(1))).scalar()
    return shared.select("feature", n.alias("n_shared"), F.when(n >= minimum, "available").otherwise("unavailable").alias("status"))


def resolve_ids(rows: DataFrame, dictionary: DataFrame, systems: Sequence[tuple[Column, str]], target: str) -> DataFrame:
    """Resolve ids by the first system that knows the row.

    `systems` pairs a key expression of `rows` with a key column of `dictionary`. The highest target
    wins where a dictionary key is repeated.
    """
    out, found = rows, []
    for i, (expr, column) in enumerate(systems):
        d = dictionary.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"_k{i}")).agg(F.max(target).alias(f"_t{i}"))
        out = out.withColumn(f"_k{i}", expr).join(d, f"_k{i}", "left").drop(f"_k{i}")
        found.append(F.col(f"_t{i}"))
    return out.withColumn(target, F.coalesce(*found)).drop(*[f"_t{i}" for i in range(len(systems))])


def registry_keys(registry: DataFrame) -> DataFrame:
    """(kind, key, canonical): one row per usable key, canonical names before synonyms."""
    name = registry.select(F.lit("canonical").alias("kind"), F.col("canonical").alias("key"), "canonical", F.lit(0).alias("_p"))
    syn = registry.select(F.lit("canonical").alias("kind"), F.explode("synonyms").alias("key"), "canonical", F.lit(1).alias("_p"))
    pert = registry.select(F.lit("lincs_pert_id").alias("kind"), F.explode("lincs_pert_ids").alias("key"), "canonical", F.lit(0).alias("_p"))
    inchi = registry.select(F.lit("inchi_key").alias("kind"), F.explode("inchi_keys").alias("key"), "canonical", F.lit(0).alias("_p"))
    every = name.unionByName(syn).unionByName(pert.withColumn("key", F.upper("key"))).unionByName(inchi.withColumn("key", F.upper("key")))
    return keep_first(every, ["kind", "key"], [F.col("_p"), F.col("canonical")]).drop("_p")


def lookup_registry(rows: DataFrame, registry: DataFrame, columns: Sequence[str], name: str = "name") -> DataFrame:
    """Registry row by structural key, then perturbagen id, then name or synonym, with the key that matched."""
    keys = registry_keys(registry)
    systems = [("inchi_key", F.upper("inchi_key")), ("lincs_pert_id", F.upper("pert_id")), ("canonical", C.compound_name_short(F.col(name)))]
    out = rows
    for kind, expr in systems:
        one = keys.where(F.col("kind") == kind).select(F.col("key").alias("_key"), F.col("canonical").alias(f"_{kind}"))
        out = out.withColumn("_key", expr).join(one, "_key", "left").drop("_key")
    hit = F.coalesce(*[F.col(f"_{k}") for k, _ in systems])
    match = F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), F.lit(k)) for k, _ in systems])
    out = out.withColumn("_hit", hit).withColumn("match_key", match).drop(*[f"_{k}" for k, _ in systems])
    picked = registry.select(F.col("canonical").alias("_hit"), *columns)
    return out.join(picked, "_hit", "left").withColumnRenamed("_hit", "registry_canonical")


def first_dimension(rows: DataFrame, dimension: DataFrame, row_name: Column, dim_name: Column, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Attach a dimension on the normalised name, first dimension row wins, empty names never match."""
    d = dimension.withColumn("_n", C.compound_name(dim_name)).where(F.col("_n") != "")
    first = keep_first(d, ["_n"], order).select("_n", *columns)
    return rows.withColumn("_n", C.compound_name(row_name)).join(first, "_n", "left").withColumnRenamed("_n", "canonical")


def best_per_name(ranked_list: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    return keep_first(ranked_list, ["canonical"], order or [F.col("rank"), F.col("drug")])


def dual_list(list1: DataFrame, list2: DataFrame) -> DataFrame:
    """Inner join of two ranked lists on the canonical name, best row of each."""
    keep = ["canonical", "drug", "percentile", "rank", "reversal_score", "targets", "source", "n_signatures", "n_cell_lines", "consistency"]
    a, b = best_per_name(list1), best_per_name(list2)
    a = a.select("canonical", *[F.col(c).alias(f"list1_{c}") for c in keep[1:]])
    b = b.select("canonical", *[F.col(c).alias(f"list2_{c}") for c in keep[1:]])
    return a.join(b, "canonical")


def near_consensus(list1: DataFrame, list2: DataFrame, floor: float = 0.8, per_side: int | None = None, total: int | None = None) -> DataFrame:
    """Strong on one list and absent from the other, best first; the two limits are the report's size, if it has one."""
    def side(a, b, name):
        only = best_per_name(a).join(b.select("canonical"), "canonical", "left_anti").where(F.col("percentile") >= floor)
        return top_k(only, [], [-F.col("percentile"), F.col("canonical")], per_side, "_r").select(
            "drug", "canonical", F.lit(name).alias("side"), "percentile")

    both = side(list1, list2, "list1_only").unionByName(side(list2, list1, "list2_only"))
    best = both.orderBy("side", F.col("percentile").desc(), "canonical")
    return best if total is None else best.limit(total)


def pair_key(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("drug_a"), F.greatest(a, b).alias("drug_b")]


def join_pairs(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """Join two tables of unordered pairs (a, b, ...) whichever way round each was written."""
    p = predicted.select(*pair_key(F.col("a"), F.col("b")), *[c for c in predicted.columns if c not in ("a", "b")])
    o = observed.select(*pair_key(F.col("a"), F.col("b")), *[c for c in observed.columns if c not in ("a", "b")])
    return p.join(o, ["drug_a", "drug_b"])


def pairs_within(pairs: DataFrame, members: DataFrame, key: str = "canonical") -> DataFrame:
    """Pairs whose two names are both members."""
    names = members.select(F.col(key).alias("_m")).distinct()
    return pairs.join(names, pairs["drug_a"] == names["_m"], "left_semi").join(names, F.col("drug_b") == names["_m"], "left_semi")


def enumerate_pairs(names: DataFrame, name: str, target: str) -> DataFrame:
    """Every i < j with different targets, over a dictionary of names.

    The result itself is quadratic, so this is for dictionaries. Each row lists the positions after
    its own and meets them by equality, so the work is spread by position.
    """
    d = ranked(names.select(name, target).distinct(), [], [F.col(name), F.col(target)], "_i").withColumn("_i", F.col("_i").cast("int"))
    n = d.select(F.count(F.lit(1)).cast("int")).scalar()
    left = d.select(F.col(name).alias("drug_a"), F.col(target).alias("target_a"),
                    F.explode(F.when(F.col("_i") < n, F.sequence(F.col("_i") + 1, n)).otherwise(F.array().cast("array<int>"))).alias("_i"))
    right = d.select("_i", F.col(name).alias("drug_b"), F.col(target).alias("target_b"))
    return left.join(right, "_i").where(F.col("target_a") != F.col("target_b")).drop("_i")


def comparator_table(comparators: DataFrame, list1: DataFrame, list2: DataFrame, reference: DataFrame) -> DataFrame:
    """Curated names with their ranks on both lists and in the group reference; names found nowhere drop out.

    `position` gives the report order: category, dual support (strongest first), name.
    """
    a = best_per_name(list1).select("canonical", F.col("drug").alias("d1"), F.col("rank").alias("r1"), F.col("percentile").alias("p1"))
    b = best_per_name(list2).select("canonical", F.col("drug").alias("d2"), F.col("rank").alias("r2"), F.col("percentile").alias("p2"))
    r = keep_first(reference, ["canonical"], [F.col("drug_rank"), F.col("drug")]).select(
        "canonical", F.col("drug").alias("d3"), F.col("drug_rank").alias("r3"), F.col("percentile").alias("p3"))
    j = comparators.join(a, "canonical", "left").join(b, "canonical", "left").join(r, "canonical", "left")
    j = j.where(F.coalesce("r1", "r2", "r3").isNotNull())
    both = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    order = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("category")), F.lit(0))
    out = j.select(
        F.coalesce("d1", "d2", "d3").alias("drug"), "canonical", "category",
        F.coalesce("r1", "r3").alias("list1_rank"), F.col("r2").alias("list2_rank"),
        F.coalesce("p1", "p3").alias("list1_percentile"), F.col("p2").alias("list2_percentile"),
        F.when(both, F.least("p1", "p2")).alias("dual_support_percentile"), both.alias("present_in_both_lists"),
        F.when(order > 0, order).otherwise(99).alias("_order"))
    w = Window.orderBy("_order", F.coalesce(F.col("dual_support_percentile"), F.lit(-1.0)).desc(), F.lower("drug"))
    return out.withColumn("position", F.row_number().over(w)).drop("_order")


def nearest_references(queries: DataFrame, references: DataFrame, k: int = 5, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """The k references with the highest cosine per query: (query_id, ref_id, similarity, rank), exact.

    See `meet`: every query is compared with every reference as matrix products, and each meeting hands
    on k rows at most.
    """
    ref_type, query_type = dict(references.dtypes)[id_col], dict(queries.dtypes)[id_col]
    q = queries.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    r = references.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))

    def score(part: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        refs = refs.sort_values("id", kind="stable")
        ids, mat, qm = refs["id"].to_numpy(), unit_rows(refs["vec"]), unit_rows(part["vec"])
        sim = qm @ mat.T
        near = np.round(sim, 12)
        near[np.isnan(near)] = -np.inf
        if k < len(refs):
            # Those above the k-th value, then the first of those equal to it, in the order of the ids.
            least = np.partition(near, len(refs) - k, axis=1)[:, [len(refs) - k]]
            above, equal = near > least, near == least
            rows, cols = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True))))
        else:
            rows, cols = np.indices(near.shape).reshape(2, -1)
        return pd.DataFrame({"query_id": part["id"].to_numpy()[rows], "ref_id": ids[cols], "similarity": sim[rows, cols]})

    def nearest(parts: list[pd.DataFrame]) -> pd.DataFrame:
        found = pd.concat(parts, ignore_index=True)
        near = found["similarity"].round(12).fillna(-np.inf)
        ordered = found.assign(_near=-near).sort_values(["query_id", "_near", "ref_id"], kind="stable")
        return ordered[ordered.groupby("query_id", sort=False).cumcount() < k].drop(columns="_near")

    best = meet(q, r, score, f"query_id {query_type}, ref_id {ref_type}, similarity double", merge=nearest)
    return top_k(best, ["query_id"], [F.round("similarity", 12).desc(), F.col("ref_id")], k)


def interpolate_at(rows: DataFrame, knots: DataFrame, x: str, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Value of a knot table (x, seq, y) at each row's x: linear between knots, flat beyond the ends."""
    k = list(keys)
    a = knots.select(*k, F.col("x").cast("double").alias("_x"), F.lit(0).alias("_kind"), F.col("seq").cast("long").alias("_seq"),
                     F.struct(F.col("x").cast("double").alias("x"), F.col("y").alias("y")).alias("_knot"), F.lit(None).cast("long").alias("_row"))
    keyed = rows.withColumn("_row", F.xxhash64(F.struct(*[F.col(c) for c in rows.columns])))
    return _interpolate(keyed, a, x, k, **kw)


def _interpolate(keyed: DataFrame, a: DataFrame, x: str, k: list[str], **kw) -> DataFrame:
    payload = [c for c in keyed.columns if c not in k and c != "_row"]
    b = keyed.select(*k, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_kind"), F.col("_row").alias("_seq"),
                     F.lit(None).cast("struct<x:double,y:double>").alias("_knot"), "_row", F.struct(*payload).alias("_payload"))
    both = b.unionByName(a, allowMissingColumns=True)
    s = running(both, k, [F.col("_x"), F.col("_kind"), F.col("_seq")],
                {"_prev": Scan("last", F.col("_knot")), "_next": Scan("last", F.col("_knot"), back=True)}, **kw)
    p, n = F.col("_prev"), F.col("_next")
    value = F.when(p.isNull(), n["y"]).when(n.isNull(), p["y"]).when(n["x"] == p["x"], p["y"]).otherwise(
        p["y"] + (n["y"] - p["y"]) * (F.col("_x") - p["x"]) / (n["x"] - p["x"]))
    return s.where(F.col("_kind") == 1).select(*k, "_payload.*", value.alias("value"))


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct signed edges with both ends in the node set."""
    keep = nodes.select(F.col("node").alias("_n")).distinct()
    inside = edges.join(keep, F.col("source") == F.col("_n"), "left_semi").join(keep, F.col("target") == F.col("_n"), "left_semi")
    return inside.select("source", "target", "sign").distinct()


def two_layer_subgraph(edges: DataFrame, core: DataFrame, max_edges: int | None = None) -> DataFrame:
    """Edges among the core and the sources that point into it; core edges first, then most referenced."""
    c = core.select("node").distinct()
    incoming = edges.join(c, F.col("target") == F.col("node"), "left_semi").select(F.col("source").alias("node"))
    nodes = c.unionByName(incoming).distinct()
    keep = edges.join(nodes, F.col("source") == F.col("node"), "left_semi").join(nodes, F.col("target") == F.col("node"), "left_semi")
    marked = (
        keep.join(c.select(F.col("node").alias("source"), F.lit(1).alias("_s")), "source", "left")
        .join(c.select(F.col("node").alias("target"), F.lit(1).alias("_t")), "target", "left")
        .withColumn("in_core", F.col("_s").isNotNull() & F.col("_t").isNotNull())
    )
    one = marked.groupBy("source", "target", "sign").agg(F.max("n_references").alias("n_references"), F.max("in_core").alias("in_core"))
    order = [F.when(F.col("in_core"), 0).otherwise(1), -F.col("n_references"), F.col("source"), F.col("target"), F.col("sign")]
    return top_k(one, [], order, max_edges, "position")


def attach_screen(neighbours: DataFrame, screen: DataFrame, drugs: DataFrame, pk: DataFrame) -> DataFrame:
    """Median curve parameters per (neighbour line, drug), joined on the entity key and the compound name.

    `screen` has line_name, drug_name, ln_ic50, min_conc, max_conc, auc; `pk` has drug_name, cmax_nm.
    Only rows of the neighbours' lines and of the drugs asked for are summed up.
    """
    n = neighbours.withColumn("entity", C.entity_key(F.col("line_id")))
    wanted = drugs.select(C.compound_name(F.col("drug")).alias("canonical")).distinct()
    s = screen.select(C.entity_key(F.col("line_name")).alias("entity"), C.compound_name(F.col("drug_name")).alias("canonical"),
                      "ln_ic50", "min_conc", "max_conc", "auc").join(wanted, "canonical", "left_semi").join(n.select("entity").distinct(), "entity", "left_semi")
    med = medians(s, ["entity", "canonical"], ["ln_ic50", "min_conc", "max_conc", "auc"])
    cmax = keep_first(pk.withColumn("canonical", C.compound_name(F.col("drug_name"))), ["canonical"], [F.col("cmax_nm").asc_nulls_last()]).select("canonical", "cmax_nm")
    return n.join(med, "entity").join(cmax, "canonical", "left").select(
        *neighbours.columns, "canonical", C.ln_um_to_nm(F.col("ln_ic50")).alias("ic50_nm"),
        (F.col("min_conc") * 1000.0).alias("min_conc_nm"), (F.col("max_conc") * 1000.0).alias("max_conc_nm"), "auc", "cmax_nm")


def tissue_ic50(screen: DataFrame, tissue: str, minimum: int = 3, **kw) -> DataFrame:
    """Median IC50 (nM) per drug over one tissue, or over all tissues where it has under `minimum` rows."""
    s = screen.withColumn("canonical", C.compound_name(F.col("drug_name"))).withColumn("_in", F.upper("tissue") == tissue)
    n = s.groupBy("canonical").agg(F.count_if("_in").alias("n_tissue"))
    use = s.join(n, "canonical").where((F.col("n_tissue") < minimum) | F.col("_in")).withColumn("_nm", C.ln_um_to_nm(F.col("ln_ic50")))
    med = exact_quantiles(use, ["canonical"], "_nm", {"ic50_nm": 0.5}, **kw)
    return n.join(med, "canonical").withColumn("used_tissue", F.col("n_tissue") >= minimum)
