"""Registered queries against their SQL. All of them with COHORTGRID_ALL=1, else one or two per area."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
SOME = (
    "src_09_pair_scores flt_07_compound_name flt_17_impute jn_05_registry_lookup jn_12_nearest_references jn_13_interpolate agg_04_compound_rollup agg_10_set_variation win_05_empirical_percentile win_06_bh_q"
    " set_04_signed_edges sta_01_mann_whitney sta_04_cluster_vs_normal sta_07_spearman sur_01_kaplan_meier sur_02_logrank sig_05_residual_arms sig_12_priority mlm_06_signature_classifier evl_04_adjusted_rand"
    " sig_06_connectivity sig_07_set_difference mlm_02_invariants txt_10_container_sizes txt_11_container_counts"
    " txt_03_dedup txt_11_unsupported_numbers gov_06_nominations str_04_gate_board job_03_cluster_reversal"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("COHORTGRID_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows_and_names(spark):
    out = entry.entry(spark)
    assert out.columns[:3] == ["family", "position", "feature"]
    assert out.count() == 14 + 10 + 30


@pytest.mark.parametrize("name", ["agg_13_silencing", "sta_03_welch", "win_03_rank_percentile", "gov_06_nominations"])
def test_answers_do_not_depend_on_partitions(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["sur_01_kaplan_meier", "sur_04_ipcw", "win_06_bh_q", "agg_05_median_ranking", "sta_02_cliffs_delta", "sig_12_priority"])
def test_scans_over_many_ranges_match_sql(spark, con, name):
    """The same queries with every scan dealt into many ranges, as large inputs are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
