"""Registered queries against their SQL on DuckDB."""

import pytest
from compare import connect, compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORDERED = (
    "false_discovery_rate", "empirical_p_value", "two_sample_ks", "mann_whitney", "mad_sigma_clip", "stride_downsample", "sky_passes", "binned_monotonicity",
    "dimming_events", "nearest_in_time", "early_late_shift", "rank_with_ties", "residual_structure", "false_positive_rate", "subset_statistics", "temporal_clustering",
)
PLAIN = (
    "angular_separation", "normal_tail_functions", "poisson_tail", "campaign_targets", "scored_report_reader", "nearest_match", "appeared_disappeared", "gamma_host_association",
    "neutrino_host_excess", "merge_channel_lists", "matched_controls", "morans_i", "spatial_scan", "infrared_excess", "convergence_score", "survey_ranking", "unexplainability",
    "overall_risk", "review_verdict", "taxonomy", "report_watcher", "cross_poll_dedup",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry_is_complete():
    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names)
    assert len(names) >= 246


def test_entry_returns_ranked_targets(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 21))


@pytest.mark.parametrize("name", PLAIN)
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ORDERED)
def test_ordered_queries_match_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""
