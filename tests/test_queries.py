"""Registry contract and a cross-section of queries against their SQL."""

import pytest

import __spark_entry__ as entry
from freshet.plans import load
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.01"
SAMPLE = (
    "cal_season_totals", "sig_fdc_metrics", "sig_threshold_events", "sig_series_mean", "bfl_stats", "qc_year_deviation",
    "qc_data_quality", "mr_event_response", "mr_lag_correlations", "grd_series_grades", "met_extreme_periods", "met_climate_class",
    "wb_paired_ratios", "trd_seasonal_mann_kendall", "hom_pettitt", "drt_spei_rank", "ing_gap_runs", "ing_blocks_to_daily",
    "spa_nested_pairs", "spa_match_sites", "att_area_weighted", "rel_stage_consistency", "clu_adjusted_rand", "val_table_diff",
    "src_release_flow", "str_daily_extremes", "met_fractional_weights", "trd_variance_breakpoints", "flt_attribute_columns", "str_month_upsert",
    "met_phase_network", "met_precipitation_table", "rel_subset_spearman", "rel_window_medians", "val_percentile_gates", "val_budyko_attribute",
    "sig_slope_agreement", "src_complete_calendar", "src_station_files", "str_station_files",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, con, name):
    message, n = compare(spark, con, load()[name], SF)
    assert message is None and n > 0


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) < set(q) and len(q) > 200
    assert entry.entry(spark).count() > 0
