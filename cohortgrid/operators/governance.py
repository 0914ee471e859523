"""Gates, audits, evidence classes and the compound registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortgrid.functions import cleaning as C
from cohortgrid.functions.vocabulary import CONTEXT_DRUGS, DEVELOPMENT_LABELS, ENDOCRINE_AGENTS, HER2_AGENTS, OTHER_KNOWN_DRUGS, STRESS_DRUGS, STRESS_MARKERS
from cohortgrid.operators.joins import dual_list, lookup_registry
from cohortgrid.operators.scans import keep_first, ranked, top_k

_NONE = "array<string>"


def evaluate_gates(measures: DataFrame, ids: DataFrame) -> DataFrame:
    """Status per gate: synthetic, insufficient_data, provisional_pass, pass or fail, in that precedence.

    `measures` is (gate, value, threshold, direction, n, min_n, smoke_test, insufficient, cohort_gate);
    `ids` is (gate, sample_id). A cohort gate without sample ids cannot pass.
    """
    syn = ids.groupBy("gate").agg(F.count_if(C.is_synthetic(F.col("sample_id"))).alias("n_synthetic"), F.count(F.lit(1)).alias("n_checked"))
    j = measures.join(syn, "gate", "left").withColumns({"n_synthetic": F.coalesce("n_synthetic", F.lit(0)), "n_checked": F.coalesce("n_checked", F.lit(0))})
    reached = F.when(F.col("direction") == "gte", F.col("value") >= F.col("threshold")).when(F.col("direction") == "lte", F.col("value") <= F.col("threshold"))
    reached = F.coalesce(reached, F.lit(False)) & ~(F.col("cohort_gate") & (F.col("n_checked") == 0))
    thin = F.coalesce("insufficient", F.lit(False)) | (F.col("min_n").isNotNull() & F.coalesce(F.col("n") < F.col("min_n"), F.lit(True)))
    status = F.when(F.col("n_synthetic") > 0, "synthetic").when(thin, "insufficient_data").when(reached & F.col("smoke_test"), "provisional_pass").when(reached, "pass").otherwise("fail")
    out = j.withColumn("status", status)
    return out.withColumn("passed", F.col("status").isin("pass", "provisional_pass"))


def audit_configurations(configs: DataFrame, registered_k: DataFrame) -> DataFrame:
    """Errors per configuration and endpoint: exploratory flag off the rule, p on an exploratory one, no p on the registered one.

    `configs` is (config_id, method, covariance_type, k, exploratory, endpoint, has_p); `registered_k` is
    one row (k). A missing registered configuration is an error of its own.
    """
    k = registered_k.select("k").scalar()
    rule = ~((F.col("method") == "gmm") & F.coalesce(F.col("covariance_type") == "full", F.lit(False)) & F.coalesce(F.col("k") == k, F.lit(False)))
    c = configs.withColumn("_rule", rule)
    e1 = c.where(F.col("exploratory") != F.col("_rule")).select(F.concat(F.lit("exploratory_mismatch:"), F.col("config_id")).alias("error"))
    at = F.concat(F.col("config_id"), F.lit(":"), F.col("endpoint"))
    e2 = c.where(F.col("exploratory") & F.col("has_p")).select(F.concat(F.lit("p_value_on_exploratory:"), at).alias("error"))
    e3 = c.where(~F.col("exploratory") & ~F.col("has_p")).select(F.concat(F.lit("missing_preregistered_p:"), at).alias("error"))
    e4 = c.agg(F.count_if(~F.col("_rule")).alias("_n"), F.count(F.lit(1)).alias("_a")).where((F.col("_n") == 0) & (F.col("_a") > 0)).select(F.lit("missing_preregistered_config").alias("error"))
    return e1.unionByName(e2).unionByName(e3).unionByName(e4).distinct()


def audit_samples(samples: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Errors per sample from (sample_id, state, abstained, has_reversal, has_prognostic, has_neighbours, encoder, cohort_encoder, reversal_gate_passed)."""
    three = F.col("state") == 3
    errors = F.array_compact(F.array(
        F.when(F.coalesce("sample_id", F.lit("")) == "", "patient_id"), F.when(three & ~F.col("abstained"), "state3_without_abstention"), F.when(three & F.col("has_reversal"), "state3_has_reversal"),
        F.when(three & F.col("has_prognostic"), "state3_has_prognostic"), F.when(three & F.col("has_neighbours"), "state3_has_nearest_lines"),
        F.when(~F.col("encoder").eqNullSafe(F.col("cohort_encoder")), "encoder_mismatch"), F.when(~F.col("reversal_gate_passed") & F.col("has_reversal"), "reversal_present_after_a4_fail")))
    return samples.select(*keep, "sample_id", errors.alias("errors"))


def robustness(hits: DataFrame) -> DataFrame:
    """Robustness flags, notes and the artifact vote of dual-list hits.

    Two of five votes, or weak support together with a single line or low consistency, make an artifact.
    """
    text = F.lower(F.array_join("targets", " "))
    h = hits.withColumns({
        "weak_dual_support": F.least("list1_percentile", "list2_percentile") < 0.55,
        "low_coverage": F.coalesce(F.col("coverage") < 0.5, F.lit(False)) if "coverage" in hits.columns else F.lit(False),
        "single_cell_line": F.coalesce(F.col("n_cell_lines") <= 1, F.lit(False)),
        "low_consistency": F.coalesce(F.col("consistency") < 0.4, F.lit(False)),
        "generic_stress_pattern": F.col("canonical").isin(STRESS_DRUGS) | F.coalesce(text.rlike("|".join(STRESS_MARKERS)), F.lit(False)),
        "missing_target_support": F.size("targets") <= 0})
    votes = sum((F.col(c).cast("int") for c in ("weak_dual_support", "single_cell_line", "low_consistency", "generic_stress_pattern", "low_coverage")), F.lit(0))
    h = h.withColumn("artifact_votes", votes)
    h = h.withColumn("likely_artifact", (F.col("artifact_votes") >= 2) | (F.col("weak_dual_support") & (F.col("single_cell_line") | F.col("low_consistency"))))
    flags = ["weak_dual_support", "low_coverage", "single_cell_line", "low_consistency", "generic_stress_pattern", "missing_target_support", "likely_artifact"]
    return h.withColumn("notes", F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags])))


def indication(canonical: Column, context: Sequence[str] = tuple(CONTEXT_DRUGS), other: Sequence[str] = tuple(OTHER_KNOWN_DRUGS)) -> Column:
    return F.when(canonical.isin(list(context)), "breast_context").when(canonical.isin(list(other)), "repurposing_hypothesis").otherwise("unclassified_or_investigational")


def evidence_tier(artifact: Column, bucket: Column, trial: Column | None = None) -> Column:
    t = F.lit(False) if trial is None else trial
    return F.when(artifact, "tier_d_artifact_or_insufficient").when(t, "tier_a_potential_trial_match").when(bucket == "breast_context", "tier_b_breast_preclinical_or_investigational").otherwise("tier_c_novel_repurposing_hypothesis")


def nominate(list1: DataFrame, list2: DataFrame, **kw) -> DataFrame:
    """Overlap of two lists ranked by the weaker percentile, then the geometric mean, with support class and class rank."""
    d = dual_list(list1, list2)
    p1, p2 = F.col("list1_percentile"), F.col("list2_percentile")
    d = d.select(
        "canonical", F.coalesce("list1_drug", "canonical").alias("drug"), "list1_percentile", "list2_percentile", F.least(p1, p2).alias("weaker_percentile"), F.greatest(p1, p2).alias("stronger_percentile"),
        F.sqrt(F.greatest(p1, F.lit(0.0)) * F.greatest(p2, F.lit(0.0))).alias("rank_product"), "list1_rank", "list2_rank", "list1_source", "list2_source",
        F.array_sort(F.array_union(F.coalesce("list1_targets", F.array().cast(_NONE)), F.coalesce("list2_targets", F.array().cast(_NONE)))).alias("targets"),
        F.coalesce("list2_n_signatures", "list1_n_signatures").alias("n_signatures"), F.coalesce("list2_n_cell_lines", "list1_n_cell_lines").alias("n_cell_lines"), F.coalesce("list2_consistency", "list1_consistency").alias("consistency"))
    d = robustness(d)
    d = d.withColumn("indication_bucket", indication(F.col("canonical"))).withColumn("evidence_tier", evidence_tier(F.col("likely_artifact"), F.col("indication_bucket")))
    strong = (F.col("list1_source") == "compact_gctx") & (F.col("list2_source") == "compact_gctx") & (F.coalesce("n_cell_lines", F.lit(0)) >= 2) & (F.coalesce("consistency", F.lit(0.0)) >= 0.5)
    d = d.withColumn("support_class", F.when(F.col("likely_artifact"), "excluded_low_confidence").when(strong, "breast_cell_line_supported").otherwise("suggestive"))
    from cohortgrid.operators.windows import class_ranks

    return class_ranks(d, "support_class", [-F.round("weaker_percentile", 12), -F.round("rank_product", 12), F.col("canonical")], **kw)


def display_lanes(overlap: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry annotation and lane per overlap row; ranks are untouched.

    `overlap` has canonical, pert_id, inchi_key, likely_artifact; `registry` adds human_development_status,
    entity_type, display_action, display_gate_reason to its keys.
    """
    cols = ["human_development_status", "entity_type", "display_action", "display_gate_reason"]
    j = lookup_registry(overlap, registry, cols, "canonical")
    anon = C.is_anonymous(F.col("canonical"), F.col("pert_id"))
    none = F.col("registry_canonical").isNull()
    status = F.when(anon, "non_drug_perturbagen").when(none, "unresolved").otherwise(F.coalesce("human_development_status", F.lit("unresolved")))
    action = F.when(F.col("likely_artifact") | anon | none, "technical_excluded").otherwise(F.coalesce("display_action", F.lit("technical_excluded")))
    reason = F.when(F.col("likely_artifact"), "likely_artifact_flag").when(anon, "anonymous_lincs_identifier").when(none, "unresolved_not_in_registry").otherwise(F.coalesce("display_gate_reason", F.lit("unresolved_not_in_registry")))
    match = F.when(anon, "anonymous_id").when(none, "none").otherwise(F.col("match_key"))
    entity = F.when(anon, "non_therapeutic_perturbagen").when(none, "unresolved").otherwise(F.coalesce("entity_type", F.lit("unresolved")))
    j = j.withColumn("_status", status).withColumn("_action", action).withColumn("_reason", reason).withColumn("_match", match).withColumn("_entity", entity)
    labels = F.create_map(*[F.lit(x) for kv in DEVELOPMENT_LABELS.items() for x in kv])
    lane = F.when(F.col("_action") == "default_visible", "visible").when(F.col("_action") == "exploratory_only", "exploratory").otherwise("technical_excluded")
    return j.select(*overlap.columns, F.col("_status").alias("human_development_status"), F.coalesce(F.try_element_at(labels, F.col("_status")), F.lit(DEVELOPMENT_LABELS["unresolved"])).alias("human_development_label"),
                    F.col("_entity").alias("entity_type"), F.col("_action").alias("display_action"), F.col("_reason").alias("display_gate_reason"), F.col("_match").alias("registry_match_key"), lane.alias("lane"))


def lane_summary(lanes: DataFrame) -> DataFrame:
    return lanes.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(F.col("lane") == "visible").alias("n_default_visible"), F.count_if(F.col("lane") == "exploratory").alias("n_exploratory_only"),
                     F.count_if(F.col("lane") == "technical_excluded").alias("n_technical_excluded"))


def build_registry(seed: DataFrame, external: DataFrame, discontinued: DataFrame, approvals: DataFrame, ids: DataFrame) -> DataFrame:
    """Seed rows, enriched where the name exists, overridden by the latest approval, with id arrays merged.

    `seed`: (canonical, entity_type, human_development_status, display_action). `external`: (name, max_phase,
    withdrawn, chembl_id). `discontinued`: (name). `approvals`: the seed columns with (reviewer, reviewed_at).
    `ids`: (name, pert_id, inchi_key).
    """
    name = C.compound_name_short(F.col("name"))
    e = external.withColumn("canonical", name).groupBy("canonical").agg(F.max("max_phase").alias("max_clinical_phase"), F.bool_or(F.coalesce("withdrawn", F.lit(False))).alias("_w"), F.array_sort(F.collect_set("chembl_id")).alias("chembl_ids"))
    off = discontinued.select(name.alias("canonical"), F.lit(True).alias("_off")).distinct()
    a = keep_first(approvals.withColumn("canonical", C.compound_name_short(F.col("canonical"))), ["canonical"], [F.col("reviewed_at").desc(), F.col("reviewer")])
    a = a.select("canonical", *[F.col(c).alias(f"_a_{c}") for c in ("entity_type", "human_development_status", "display_action")], F.col("reviewer").alias("reviewed_by"), "reviewed_at", F.lit(True).alias("_approved"))
    r = seed.join(e, "canonical", "left").join(off, "canonical", "left")
    w = F.coalesce("_w", F.lit(False))
    r = r.withColumns({
        "withdrawn_or_discontinued": w | F.coalesce("_off", F.lit(False)), "entity_type": F.when(w, "withdrawn").otherwise(F.col("entity_type")),
        "human_development_status": F.when(w, "withdrawn").otherwise(F.col("human_development_status")), "display_action": F.when(w, "technical_excluded").otherwise(F.col("display_action"))})
    r = r.join(a, "canonical", "full")
    for c in ("entity_type", "human_development_status", "display_action"):
        r = r.withColumn(c, F.coalesce(f"_a_{c}", c))
    i = ids.withColumn("canonical", name).groupBy("canonical").agg(
        F.array_sort(F.collect_set(F.when(F.coalesce("pert_id", F.lit("")) != "", F.col("pert_id")))).alias("lincs_pert_ids"),
        F.array_sort(F.collect_set(F.when(~F.coalesce("inchi_key", F.lit("")).isin("", "nan"), F.col("inchi_key")))).alias("inchi_keys"))
    r = r.join(i, "canonical", "left")
    empty = F.array().cast(_NONE)
    return r.select("canonical", F.coalesce("entity_type", F.lit("unresolved")).alias("entity_type"), F.coalesce("human_development_status", F.lit("unresolved")).alias("human_development_status"),
                    F.coalesce("display_action", F.lit("technical_excluded")).alias("display_action"), F.coalesce("withdrawn_or_discontinued", F.lit(False)).alias("withdrawn_or_discontinued"), "max_clinical_phase",
                    *[F.coalesce(c, empty).alias(c) for c in ("chembl_ids", "lincs_pert_ids", "inchi_keys")], "reviewed_by")


def unresolved_queue(tables: DataFrame, registry: DataFrame, in_regimen: DataFrame, top: int | None = None, **kw) -> DataFrame:
    """Names in the top ranks of any cluster table that the registry does not know, or that are identifiers only."""
    ranks = tables if top is None else tables.where(F.col("drug_rank") <= top)
    n = ranks.groupBy(C.compound_name_short(F.col("drug")).alias("canonical")).agg(F.count(F.lit(1)).alias("frequency"))
    known = registry.select("canonical").unionByName(registry.select(F.explode("synonyms").alias("canonical"))).distinct().withColumn("_known", F.lit(True))
    reg = in_regimen.select(C.compound_name_short(F.col("drug")).alias("canonical"), F.lit(True).alias("_in")).distinct()
    anon = C.is_anonymous(F.col("canonical"))
    q = n.join(known, "canonical", "left").where(F.col("_known").isNull() | anon).join(reg, "canonical", "left")
    q = q.select("canonical", "frequency", F.coalesce("_in", F.lit(False)).alias("in_regimen"), anon.alias("anonymous"))
    q = q.withColumn("proposed_entity_type", F.when(F.col("anonymous"), "non_therapeutic_perturbagen").otherwise("unresolved"))
    return ranked(q, [], [F.when(F.col("in_regimen"), 0).otherwise(1), -F.col("frequency"), F.col("canonical")], "priority_rank", **kw)


TIER_RANK = {"established": 2, "investigational": 1, "not_established": 0}


def strongest_tier(entries: DataFrame) -> DataFrame:
    """Strongest tier per symbol from (symbol, tier, source, kind); the earlier source (by position) wins ties."""
    rank = F.create_map(*[F.lit(x) for kv in TIER_RANK.items() for x in kv])
    e = entries.where(F.trim("symbol") != "").withColumn("_r", F.try_element_at(rank, F.col("tier")))
    return keep_first(e, ["symbol"], [F.col("_r").desc(), F.col("position")]).drop("_r", "position")


def tier_features(rows: DataFrame, entries: DataFrame, default: str = "not_established") -> DataFrame:
    e = entries.select(F.col("symbol").alias("feature"), F.col("tier").alias("evidence_tier"), F.col("source").alias("evidence_source"))
    return rows.join(e, "feature", "left").withColumn("evidence_tier", F.coalesce("evidence_tier", F.lit(default)))


def tier_compounds(rows: DataFrame, curated: DataFrame, phases: DataFrame, phase_tiers: dict[str, str], name: str = "drug") -> DataFrame:
    """Compound tier: curated list first, then the development phase, else unresolved. First phase row per name wins."""
    soc = curated.select(C.compound_name(F.col("drug")).alias("canonical")).where(F.col("canonical") != "").distinct().withColumn("_soc", F.lit(True))
    p = keep_first(phases.withColumn("canonical", C.compound_name(F.col("name"))).where(F.col("canonical") != ""), ["canonical"], [F.col("position")]).select("canonical", F.trim("phase").alias("phase"))
    tiers = F.create_map(*[F.lit(x) for kv in phase_tiers.items() for x in kv])
    j = rows.withColumn("canonical", C.compound_name(F.col(name))).join(soc, "canonical", "left").join(p, "canonical", "left")
    by_phase = F.try_element_at(tiers, F.lower("phase"))
    return j.withColumn("evidence_tier", F.when(F.col("_soc"), "standard_of_care").otherwise(F.coalesce(by_phase, F.lit("unresolved")))).withColumn(
        "evidence_reason", F.when(F.col("_soc"), "curated_list").when(by_phase.isNotNull(), "development_phase").otherwise("no_status_found")).drop("_soc")


def known_answers(rankings: DataFrame, roles: DataFrame, role_lists: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Per group with a role list, the listed names found in its ranking; groups without a list pass.

    `rankings` is (cluster, canonical), `roles` is (cluster, role).
    """
    lists = role_lists or {"er_high": ENDOCRINE_AGENTS, "her2_amplified": HER2_AGENTS}
    known = F.create_map(*[x for r, v in lists.items() for x in (F.lit(r), F.array(*[F.lit(i) for i in v]))])
    r = roles.withColumn("_names", F.try_element_at(known, F.col("role")))
    want = r.select("cluster", F.explode("_names").alias("canonical"))
    hit = want.join(rankings.select("cluster", F.lower("canonical").alias("canonical")).distinct(), ["cluster", "canonical"], "left_semi").groupBy("cluster").agg(F.array_sort(F.collect_list("canonical")).alias("hits"))
    j = r.join(hit, "cluster", "left").withColumn("hits", F.coalesce("hits", F.array().cast(_NONE)))
    return j.select("cluster", "role", "hits", (F.col("_names").isNull() | (F.size("hits") >= 1)).alias("passed"))


def approve(decisions: DataFrame) -> DataFrame:
    """Accepted or the reason not, from (canonical, reviewer, citations ARRAY)."""
    error = F.when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "reviewer_required").when(F.coalesce(F.size("citations"), F.lit(0)) <= 0, "citation_required")
    return decisions.withColumn("error", error).withColumn("accepted", F.col("error").isNull()).withColumn("canonical", C.compound_name_short(F.col("canonical")))


def glossary(latest: DataFrame, panels: DataFrame, unvalidated: DataFrame) -> DataFrame:
    """Panels with their latest gate, revised when the note says so; panels without a gate are appended as unvalidated.

    `latest` is (notebook, gate, value, n, threshold, status, passed, note); `panels` is (notebook, gate, panel).
    """
    revised = F.lower(F.coalesce("note", F.lit(""))).contains("revised")
    g = panels.join(latest, ["notebook", "gate"]).select(
        "panel", F.col("gate").alias("metric"), "value", F.col("n").cast("long").alias("n"), "threshold", F.coalesce("status", F.when(F.col("passed"), "pass").otherwise("fail")).alias("status"), revised.alias("revised"), F.when(revised, F.col("note")).alias("revision_note"))
    u = unvalidated.select("panel", F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("threshold"), F.lit("unvalidated").alias("status"),
                           F.lit(False).alias("revised"), F.lit(None).cast("string").alias("revision_note"))
    return g.unionByName(u)


VIEWS = {"full_modality": ["rna", "cna", "methylation"], "missing_view": ["rna", "cna"], "abstain": ["rna"]}


def sample_states(samples: DataFrame) -> DataFrame:
    """State 1 (full), 2 (partial) or 3 (abstains) with reason, views and sections to show, from (sample_id, fraction, role)."""
    verdict = C.sample_verdict(F.col("fraction"))
    views = F.create_map(*[x for r, v in VIEWS.items() for x in (F.lit(r), F.array(*[F.lit(i) for i in v]))])
    s = samples.withColumn("verdict", verdict)
    out = (F.col("verdict") == "insufficient") | (F.col("role") == "abstain")
    part = (F.col("role") == "missing_view") | (F.col("verdict") == "marginal")
    state = F.when(out, 3).when(part, 2).otherwise(1)
    reason = F.when(out, F.when(F.col("verdict") == "insufficient", "insufficient_tumour_fraction").otherwise("posterior_width")).when(part, F.when(F.col("verdict") == "marginal", "marginal_tumour_fraction").otherwise("missing_modality"))
    s = s.withColumn("state", state).withColumn("reason_code", reason).withColumn("views", F.coalesce(F.try_element_at(views, F.col("role")), F.try_element_at(views, F.lit("full_modality"))))
    base = ["quality", "characteristics"]
    more = ["nearest_lines", "reversal", "prognosis"]
    return s.withColumn("sections", F.when(F.col("state") == 3, F.array(*[F.lit(x) for x in base])).otherwise(F.array(*[F.lit(x) for x in base + more])))


FAMILY_LIMITS = {"pathway": 6, "tf": 5, "gene": 8}


def evidence_context(samples: DataFrame, profiles: DataFrame, neighbours: DataFrame, reversal: DataFrame, q: float = 0.05, names_per_tier: int = 8) -> DataFrame:
    """Nested evidence per sample: strongest significant features per family, neighbours, reversal names per tier with counts.

    `samples` is (sample_id, cluster); `profiles` is (cluster, family, feature, effect, q); `neighbours` is
    (sample_id, ref_id, similarity, rank); `reversal` is (cluster, tier, drug, rank). All lists have stated limits.
    """
    tops = None
    for family, k in FAMILY_LIMITS.items():
        part = top_k(profiles.where((F.col("family") == family) & (F.col("q") < q)), ["cluster"], [F.abs("effect").desc(), F.col("feature")], k, "_r")
        tops = part if tops is None else tops.unionByName(part)
    feats = tops.groupBy("cluster", "family").agg(F.array_sort(F.collect_list(F.struct("_r", "feature", "effect"))).alias("items")).groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("family", "items"))).alias("features"))
    named = top_k(reversal, ["cluster", "tier"], [F.col("rank"), F.col("drug")], names_per_tier, "_r").groupBy("cluster", "tier").agg(F.array_sort(F.collect_list(F.struct("_r", "drug"))).alias("_names"))
    counts = reversal.groupBy("cluster", "tier").agg(F.count(F.lit(1)).alias("n"))
    rev = named.join(counts, ["cluster", "tier"]).groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("tier", F.struct("n", F.transform("_names", lambda x: x["drug"]).alias("names"))))).alias("reversal_by_tier"))
    near = neighbours.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref_id", "similarity"))).alias("neighbours"))
    return samples.join(feats, "cluster", "left").join(rev, "cluster", "left").join(near, "sample_id", "left")
