"""Incremental upkeep over all statistics, every column against SQL."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from oracle import connect, difference
from paircast.constants import ROLLED_STATS
from paircast.operators import games as G
from paircast.operators.form import form_features, halo_rows
from paircast.operators.preparation import default_for
from paircast.session import stored
from paircast.streaming import incremental as I
from paircast.workload import contest_queries, load_all
from paircast.workload.log_queries import FLAGS, FORM_SQL, MEAN_SQL, MOMENTUM_SQL, STD_SQL, _ewm_sum
from paircast.workload.registry import ORACLES, QUERIES, i8, r6, tidy

load_all()

FORM = (*MEAN_SQL, *STD_SQL, *MOMENTUM_SQL)
EWM = [f"{s}_ewm" for s in ROLLED_STATS]
EWM_SQL = f"SELECT c.game_id, c.team_id, {', '.join(f'{_ewm_sum(s)} AS {s}_ewm' for s in ROLLED_STATS)} FROM seq c LEFT JOIN seq p ON p.team_id = c.team_id AND p.rn BETWEEN c.rn - 250 AND c.rn - 1 GROUP BY c.game_id, c.team_id"


def all_columns(form_sql, value, flags=FLAGS):
    shown = [i8(value(c), c) if c in flags else r6(value(c), c) for c in (*FORM, *EWM)]
    return f"WITH {form_sql}, means AS ({EWM_SQL}) SELECT {i8('game_id')}, {i8('team_id')}, {', '.join(shown)} FROM form JOIN means USING (game_id, team_id)"


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def by_row(df, names):
    return {(r.team_id, r.game_id): {c: r[c] for c in names} for r in df.select("team_id", "game_id", *names).collect()}


def test_runs_from_a_state_equal_a_rebuild(spark, log):
    # Few statistics with gaps; one team stops, one starts late.
    gap = lambda c, k: F.when(F.pmod(F.col("game_id"), F.lit(k)) != 0, F.col(c)).alias(c)
    days = log.agg(F.percentile(F.unix_date("game_date"), F.array(F.lit(0.4), F.lit(0.7)))).first()[0]
    first, second = (dt.date(1970, 1, 1) + dt.timedelta(int(d)) for d in days)
    kept = log.filter(((F.col("team_id") != 3) | (F.col("game_date") <= first)) & ((F.col("team_id") != 4) | (F.col("game_date") > first)))
    kept = kept.withColumns({"pts": gap("pts", 3), "reb": F.when(F.col("game_date") <= first, F.col("reb"))})
    full = form_features(G.advanced_metrics(G.four_factors(kept)))
    at_first = kept.filter(F.col("game_date") <= first)
    features, state = form_features(G.advanced_metrics(G.four_factors(at_first))), I.feature_state(at_first)
    for begin, end in ((first, second), (second, dt.date(2200, 1, 1))):
        state = tuple(stored(part, "state") for part in state)
        features, state = I.extend_features(features, state, kept.filter(F.col("game_date") <= end), begin)
    names = [c for c in full.columns if c not in log.columns]
    assert any(c.endswith("_ewm") for c in names) and len(names) > 60
    got, want = by_row(features, names), by_row(full, names)
    assert got.keys() == want.keys()
    close = lambda a, b: a == b or (None not in (a, b) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))
    assert [(k, c) for k in want for c in names if not close(got[k][c], want[k][c])] == []
    tails = state[0].groupBy("team_id").count().collect()
    assert max(r["count"] for r in tails) == halo_rows() and state[1].count() == len(tails)


def test_every_default(spark, con, sf_dir):
    run = lambda spark, sf_dir: tidy(contest_queries.defaulted(spark, sf_dir), "game_id", "team_id", *FORM, *EWM)
    assert difference(spark, con, sf_dir, run, all_columns(FORM_SQL, lambda c: f"coalesce({c}, {default_for(c)})", ())) is None


@pytest.mark.parametrize("name", ["feature_refresh", "incr_features", "season_replace", "incr_season_refresh", "feature_defaults"])
def test_query_equals_sql(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


def test_rows_of_an_entity_meet_in_parts(spark, log, monkeypatch):
    """The carries come from parts of an entity's rows, joined, and are those of all its rows at once."""
    from paircast.operators import form

    rich = G.advanced_metrics(G.four_factors(log))
    monkeypatch.setattr(form, "BLOCK_ROWS", 10**6)
    want = {r.team_id: r.asDict(recursive=True) for r in form.ewm_carries(rich).collect()}
    monkeypatch.setattr(form, "BLOCK_ROWS", 7)
    keys, sums = [], form._ewm_sums
    monkeypatch.setattr(form, "_ewm_sums", lambda rows, by, stats: keys.append(by) or sums(rows, by, stats))
    got = {r.team_id: r.asDict(recursive=True) for r in form.ewm_carries(rich).collect()}
    assert keys == [["team_id", "_part"]] and got.keys() == want.keys() and len(got) > 3
    for team, row in want.items():
        assert got[team]["tail_rows"] == row["tail_rows"]
        for name, carry in row.items():
            if name.startswith("carry_"):
                assert {k: got[team][name][k] for k in ("n", "behind")} == {k: carry[k] for k in ("n", "behind")}
                assert all(carry[k] == got[team][name][k] or math.isclose(carry[k], got[team][name][k], rel_tol=1e-12) for k in ("mean", "weight"))
