"""Standings before each day, and at one day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paircast.constants import STANDINGS_DEFAULTS
from paircast.operators.sequence import with_sequence


def daily_records(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per entity and day: wins, losses and the place of the last win and loss.

    Only rows with a result count; places run over the entity's whole history.
    Everything later works on this day table, whose size is bounded by the
    calendar and not by the log.
    """
    won, lost = F.col("wl") == "W", F.col("wl") == "L"
    decided = log.filter(won | lost).select(*keys, "game_date", "game_id", "wl")
    return (
        with_sequence(decided, keys, "game_date", ["game_id"])
        .groupBy(*keys, "game_date")
        .agg(
            F.sum(won.cast("int")).alias("day_wins"),
            F.sum(lost.cast("int")).alias("day_losses"),
            F.max(F.when(won, F.col("seq"))).alias("day_last_win"),
            F.max(F.when(lost, F.col("seq"))).alias("day_last_loss"),
        )
    )


def _signed_streak(last_win: Column, last_loss: Column) -> Column:
    """Rows since the last opposite result, negative for losses."""
    return F.coalesce(last_win, F.lit(0)) - F.coalesce(last_loss, F.lit(0))


def _win_pct(wins: Column, losses: Column) -> Column:
    played = wins + losses
    return F.when(played > 0, wins / F.when(played > 0, played)).otherwise(0.5)


def _ranked_cells(cells: DataFrame, day: list[str]) -> DataFrame:
    """Ranks and distance to the lead for every distinct record of a day.

    `cells` counts the entities with a record (conf, wins, losses, n): however
    many entities share a record, they are one row here, and a rank is a prefix
    sum over the counts.
    """
    cells = cells.withColumn("win_pct", _win_pct(F.col("wins"), F.col("losses")))

    def rank(*by: str) -> Column:
        down = Window.partitionBy(*by).orderBy(F.col("win_pct").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        level = Window.partitionBy(*by, "win_pct")
        return (F.sum("n").over(down) - F.sum("n").over(level) + 1).cast("int")

    conference = Window.partitionBy(*day, "conf")
    lead = F.max("wins").over(conference) - F.col("wins")
    behind = F.col("losses") - F.min("losses").over(conference)
    return cells.withColumns({"conf_rank": rank(*day, "conf"), "league_rank": rank(*day), "games_back": (lead + behind) / 2})


def _with_cells(records: DataFrame, ranked: DataFrame, day: list[str]) -> DataFrame:
    """Every record with the ranks of its cell."""
    keys = [*day, "conf", "wins", "losses"]
    table = ranked.select(*[F.col(c).alias(f"_{c}") for c in keys], "win_pct", "conf_rank", "league_rank", "games_back")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "conf" else F.col(c) == F.col(f"_{c}") for c in keys]
    return records.join(table, same).drop(*[f"_{c}" for c in keys])


def _records(log: DataFrame, keys: list[str]) -> DataFrame:
    """The change log: each entity's record after every day that changed it."""
    so_far = Window.partitionBy(*keys).orderBy("game_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily_records(log, keys).select(
        *keys,
        F.col("game_date").alias("since"),
        F.sum("day_wins").over(so_far).alias("wins"),
        F.sum("day_losses").over(so_far).alias("losses"),
        _signed_streak(F.max("day_last_win").over(so_far), F.max("day_last_loss").over(so_far)).alias("streak"),
    )


def _spans(log: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Records with the days they hold for (since, until]; an empty one, since ever, comes first."""
    empty = log.select(*keys).distinct().select(*keys, F.lit(None).cast("date").alias("since"), *[F.lit(0).cast("long").alias(c) for c in ("wins", "losses", "streak")])
    every = empty.unionByName(records.withColumns({c: F.col(c).cast("long") for c in ("wins", "losses", "streak")}))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("since"))
    return every.withColumn("until", F.lead("since").over(order))


def _on_days(spans: DataFrame, log: DataFrame, days: DataFrame, extra: list[str]) -> DataFrame:
    """A row for each of `days` that a span holds for."""
    bounds = log.groupBy(*extra).agg(F.min("game_date").alias("_first"), F.max("game_date").alias("_last"))
    if extra:
        spans = spans.join(bounds, extra)
    else:
        row = bounds.select(F.struct("_first", "_last")).scalar()
        spans = spans.withColumns({"_first": row["_first"], "_last": row["_last"]})
    begin, end = F.greatest(F.date_add("since", 1), "_first"), F.coalesce("until", "_last")
    held = spans.withColumns({"_begin": begin, "_end": end}).filter("_begin <= _end")
    each = held.withColumn("game_date", F.explode(F.sequence("_begin", "_end"))).drop("since", "until", "_first", "_last", "_begin", "_end")
    return each.join(days, [*extra, "game_date"], "left_semi")


def own_days(log: DataFrame, cohort: str | None = None) -> DataFrame:
    """The days on which an entity has a row itself, which is all that a table of contests asks for."""
    return log.select(*([cohort] if cohort else []), "team_id", "game_date").distinct()


def standings_asof(log: DataFrame, conference: Column, cohort: str | None = None, asked: DataFrame | None = None) -> DataFrame:
    """The table before the contests of a day, for the asked entities and days.

    `asked` has distinct (cohort,) team_id and game_date; each looks up the
    last change of its entity before that day, so rows grow with the changes and
    what is asked. Without it every entity ever seen gets every day of the
    log. Ranks come from the counts of entities by record, kept by their
    changes as well, so no window holds all entities of a day.

    `cohort` (a league or a season) restarts the records and keeps the number
    of entity-days per table proportional to the cohort's own calendar.
    """
    extra = [cohort] if cohort else []
    keys = [*extra, "team_id"]
    day = [*extra, "game_date"]
    changes = _records(log, keys)
    spans = _spans(log, changes, keys).withColumn("conf", conference)
    days = (log if asked is None else asked).select(*day).distinct()
    if asked is None:
        records = _on_days(spans, log, days, extra).withColumn("conf", conference)
    else:
        records = _looked_up(changes, asked, keys).withColumn("conf", conference)
    cell = [*extra, "conf", "wins", "losses"]
    enter = spans.select(*cell, F.col("since").alias("since"), F.lit(1).alias("n"))
    leave = spans.filter("until is not null").select(*cell, F.col("until").alias("since"), F.lit(-1).alias("n"))
    moves = enter.unionByName(leave).groupBy(*cell, "since").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*cell).orderBy(F.asc_nulls_first("since"))
    counts = moves.withColumns({"until": F.lead("since").over(order), "n": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    ranked = _ranked_cells(_on_days(counts.filter("n > 0"), log, days, extra), day)
    return _with_cells(records, ranked, day)


def _looked_up(changes: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Asked (keys, game_date) with the record of the last change before that day."""
    blank = F.lit(None).cast("struct<wins:bigint,losses:bigint,streak:bigint>")
    record = F.struct(*[F.col(c).cast("long").alias(c) for c in ("wins", "losses", "streak")])
    # On one day the question comes before the change.
    questions = asked.select(*keys, "game_date", F.lit(0).alias("_change"), blank.alias("_record"))
    events = questions.unionByName(changes.select(*keys, F.col("since").alias("game_date"), F.lit(1).alias("_change"), record.alias("_record")))
    order = Window.partitionBy(*keys).orderBy("game_date", "_change").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = events.withColumn("_record", F.last("_record", ignorenulls=True).over(order)).filter("_change = 0")
    return carried.select(*keys, "game_date", *[F.coalesce(f"_record.{c}", F.lit(0).cast("long")).alias(c) for c in ("wins", "losses", "streak")])


def standings_at_date(log: DataFrame, day: str, conference: Column) -> DataFrame:
    """The table from contests before one day, only entities that played."""
    past = log.filter(F.col("game_date") < F.lit(day).cast("date"))
    decided = daily_records(past, ["team_id"]).groupBy("team_id").agg(
        F.sum("day_wins").alias("wins"),
        F.sum("day_losses").alias("losses"),
        F.max("day_last_win").alias("_win"),
        F.max("day_last_loss").alias("_loss"),
    )
    seen = past.select("team_id").distinct().join(decided, "team_id", "left")
    records = seen.select(
        "team_id",
        F.coalesce("wins", F.lit(0)).alias("wins"),
        F.coalesce("losses", F.lit(0)).alias("losses"),
        _signed_streak(F.col("_win"), F.col("_loss")).alias("streak"),
    ).withColumn("conf", conference)
    cells = records.groupBy("conf", "wins", "losses").agg(F.count(F.lit(1)).alias("n"))
    return _with_cells(records, _ranked_cells(cells, []), [])


def with_own_standings(rows: DataFrame, standings: DataFrame) -> DataFrame:
    """Standings of each row's own entity and day, defaults where there are none.

    On the long log this is one join for both sides of a contest.
    """
    table = standings.select("game_date", "team_id", *[F.col(c).alias(f"_{c}") for c in STANDINGS_DEFAULTS])
    filled = [F.coalesce(f"_{c}", F.lit(value)).alias(c) for c, value in STANDINGS_DEFAULTS.items()]
    return rows.join(table, ["game_date", "team_id"], "left").select(*rows.columns, *filled)


def with_standings(contests: DataFrame, standings: DataFrame) -> DataFrame:
    """Home and away standings of each contest, defaults where there are none."""
    out = contests
    for side in ("home", "away"):
        columns = [F.col(c).alias(f"_{c}") for c in STANDINGS_DEFAULTS]
        table = standings.select("game_date", F.col("team_id").alias(f"{side}_team_id"), *columns)
        filled = [F.coalesce(f"_{c}", F.lit(value)).alias(f"{side}_{c}") for c, value in STANDINGS_DEFAULTS.items()]
        kept = out.columns
        out = out.join(table, ["game_date", f"{side}_team_id"], "left").select(*kept, *filled)
    return with_standings_diff(out)


def with_standings_diff(contests: DataFrame) -> DataFrame:
    return contests.withColumns(
        {
            "rank_diff": F.col("home_conf_rank") - F.col("away_conf_rank"),
            "win_pct_diff": F.col("home_win_pct") - F.col("away_win_pct"),
        }
    )
