"""What the form of contests moves between tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircast.operators import games as G
from paircast.operators.form import form_features
from paircast.plans.contest_table import contest_table, matched_sides, meetings, narrow_log
from paircast.workload import tables as T


def exchanges(spark, make):
    """Partitioning and column names of every exchange of a plan, with no join by broadcast."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        nodes, found = [make()._jdf.queryExecution().executedPlan()], []
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Exchange":
                found.append((node.outputPartitioning().toString(), [node.output().apply(i).name() for i in range(node.output().size())]))
        return found
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_rolled_columns_are_moved_once(spark, log):
    found = exchanges(spark, lambda: contest_table(log, T.conference()))
    wide = [by for by, names in found if any("_roll_" in n for n in names)]
    assert len(wide) == 1 and wide[0].startswith("hashpartitioning(game_id")
    assert not any(set(names) & {"efg_pct", "pace", "matchup", "season"} for by, names in found if "_block" in by or "team_id" in by)


def test_readers_of_some_columns_move_only_those(spark, log):
    found = exchanges(spark, lambda: contest_table(log, T.conference()).select("game_id", "home_pts_roll_mean"))
    assert [[n for n in names if "_roll_" in n] for _, names in found if any("_roll_" in n for n in names)] == [["pts_roll_mean"]]


def test_exponential_means_move_plain_rows(spark, log):
    kept = narrow_log(log)
    found = exchanges(spark, lambda: form_features(kept, rolling=False, momentum=False, derive=G.with_ratios))
    rows = [names for _, names in found if "_own" in names]
    assert len(rows) == 1 and set(rows[0]) <= {*kept.columns, "seq", "_block", "_own", "_pos", "_fresh"}


def test_blocks_of_a_halo_only(spark):
    """The last 21 rows of a block are copied to the next one, which has no rows of its own here."""
    log = spark.range(2048).select(F.lit("a").alias("team_id"), F.col("id").alias("game_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 9).cast("int")).alias("game_date"), F.col("id").cast("double").alias("pts"))
    rows = form_features(log, stats=("pts",), rolling=False, momentum=False).orderBy("game_id").collect()
    assert len(rows) == 2048 and rows[4].pts_ewm is None
    assert abs(rows[2047].pts_ewm - (2046 - 4.5)) < 1e-6


def test_late_ratios_change_nothing(spark, log):
    early = form_features(G.with_ratios(log), stats=("pts", "pace"))
    late = form_features(log, stats=("pts", "pace"), derive=G.with_ratios)
    assert early.columns == late.columns
    assert sorted(map(str, early.collect())) == sorted(map(str, late.collect()))


def test_table_keeps_contests_with_an_unready_extra_row(spark, log):
    """A team's first row comes again under a later contest: it is not ready, so that contest still has its two sides."""
    first = log.orderBy("game_date", "game_id").first()
    later = contest_table(log, T.conference()).orderBy(F.desc("game_date"), F.desc("game_id")).first()
    extra = log.filter((F.col("game_id") == first.game_id) & (F.col("team_id") == first.team_id)).withColumns(
        {"game_id": F.lit(later.game_id), "team_id": F.lit(99).cast("long")}
    )
    both = log.unionByName(extra)
    row = contest_table(both, T.conference()).filter(F.col("game_id") == later.game_id).first()
    assert row is not None and (row.home_team_id, row.away_team_id) == (later.home_team_id, later.away_team_id)
    assert row.home_pts_roll_mean == later.home_pts_roll_mean
    each = meetings(narrow_log(both)).filter(F.col("game_id") == later.game_id).collect()
    assert len(each) == 2 and len(set(each)) == 2


def test_missing_values_drop_contests_before_or_after_pairing(spark, log):
    features = form_features(log, ewm=False, derive=G.with_ratios)
    holed = features.withColumn("days_rest", F.when(F.col("game_id") % 5 != 0, F.col("days_rest")))
    names = ("home_days_rest", "away_days_rest")
    whole = matched_sides(holed).filter(" and ".join(f"{c} is not null" for c in names))
    picked = matched_sides(holed, complete=True)
    assert 0 < picked.count() < matched_sides(holed).count()
    assert sorted(map(str, picked.collect())) == sorted(map(str, whole.collect()))
