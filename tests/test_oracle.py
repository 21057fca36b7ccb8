"""Registered queries against their SQL on the smallest tables.

`python tests/oracle.py` runs all of them at sf0.01.
"""

import pytest

import __spark_entry__ as entry
from oracle import connect, difference

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# One per operator family; the others share their code.
CHECKED = (
    "scan_games", "four_factors", "rolling_std", "ewm_mean", "win_pattern3", "three_in_four", "latest_features",
    "standings_asof", "signed_streak", "h2h_asof", "h2h_latest", "contest_table", "elo_ratings", "elo_current",
    "chrono_split", "backfill_results", "stats_overall", "stats_by_home_prob", "stats_trailing", "profitable_filters",
    "filter_matches", "stats_payload", "history_current_streak", "history_best_worst_streak", "ranked_predictions",
    "classification_report", "ece", "prob_summary", "model_agreement", "odds_features", "odds_merge",
    "odds_fuzzy_match", "json_scoreboard", "live_standings", "repair_team_ids", "results_fallback",
    "linescore_results", "incr_features", "incr_matchups", "stream_elo", "stream_dedupe",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_117_columns(spark):
    frame = entry.entry(spark)
    assert len(frame.columns) == 117
    assert frame.count() > 0
