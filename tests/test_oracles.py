"""Registered queries against their SQL on the smallest scale (a spread over all families)."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, duck

SF = "/root/testdata/sf0.001"
SPREAD = [
    "W02_rolling_results", "W06_momentum_points", "W11_form_windows", "W15_streak_gate", "W16_differentials",
    "D05_home_defaults", "D10_h2h_gate", "D20_travel_defaults", "D25_seasonal_trend", "D23_end_season_pressure",
    "D51_advanced_defaults", "D01_home_advantage_league", "J08_league_last_50", "S04_flatten_documents",
    "S09_save_matches", "P08_clean_report", "A01_team_table", "A12_column_medians", "F04_parse_dates",
    "X03_match_records", "X05_odds_rows", "Q01_build_registry", "Q02_find_team", "M09_blocked_folds",
    "M12_log_loss_auc", "B03_backtest", "T01_incremental_ingest",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SPREAD)
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert len(entry.entry(spark).columns) > 10
