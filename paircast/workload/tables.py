"""Inputs derived from the driver's tables, as DataFrames and as SQL text.

The tables hold orders, not contests. An order plays a contest: its line items
with status O are the home side, those with status F the away side, and sums
over them give the box score. Orders with one side only are contests that are
incomplete (or still to come).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paircast.functions.boxscore import season_label
from paircast.functions.prediction import array_mean, array_spread, confidence, confidence_tier
from paircast.operators.games import valid_contests
from paircast.session import shared_dir, stored
from paircast.sources.files import content_key, once, read_by_season, write_by_season

TEAMS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conference(team: str = "team_id") -> Column:
    return F.when(F.col(team) < TEAMS // 2, "East").otherwise("West")


def _side_sums(status: str) -> Column:
    here = F.col("l_linestatus") == status
    total = lambda c: F.sum(F.when(here, F.col(c).cast("long")))
    cents = lambda c: F.sum(F.when(here, F.floor(100 * F.col(c) + 0.5)))
    return F.struct(
        F.count_if(here).alias("n"),
        total("l_quantity").alias("q"),
        total("l_partkey").alias("p"),
        total("l_suppkey").alias("s"),
        cents("l_discount").alias("d"),
        cents("l_tax").alias("t"),
    )


def _code(team: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(team.cast("string"), 2, "0"))


def _points(g) -> Column:
    """Points from the sums of a side."""
    return 2 * (30 + g("p") % 20) + 5 + (g("p") + g("s")) % 15 + F.least(10 + g("d") % 25, 8 + g("t") % 20)


def _box(sums: str, is_home: bool | Column, team: Column, opponent: Column) -> Column:
    g = lambda c: F.col(f"{sums}.{c}")
    fgm, fg3m, fta = 30 + g("p") % 20, 5 + (g("p") + g("s")) % 15, 10 + g("d") % 25
    ftm = F.least(fta, 8 + g("t") % 20)
    fga, fg3a = 75 + g("q") % 25, 20 + g("s") % 25
    oreb, dreb = 5 + (g("q") + g("n")) % 12, 25 + (g("p") + g("n")) % 20
    versus = F.when(is_home, " vs. ").otherwise(" @ ") if isinstance(is_home, Column) else F.lit(" vs. " if is_home else " @ ")
    return F.struct(
        team.alias("team_id"),
        F.concat(F.lit("Team "), F.lpad(team.cast("string"), 2, "0")).alias("team_name"),
        _code(team).alias("team_abbr"),
        F.concat(_code(team), versus, _code(opponent)).alias("matchup"),
        _points(g).alias("pts"),
        fgm.alias("fgm"),
        fga.alias("fga"),
        (fgm / fga).alias("fg_pct"),
        fg3m.alias("fg3m"),
        fg3a.alias("fg3a"),
        (fg3m / fg3a).alias("fg3_pct"),
        ftm.alias("ftm"),
        fta.alias("fta"),
        (ftm / fta).alias("ft_pct"),
        oreb.alias("oreb"),
        dreb.alias("dreb"),
        (oreb + dreb).alias("reb"),
        (15 + g("s") % 18).alias("ast"),
        (4 + (g("s") + g("n")) % 9).alias("stl"),
        (2 + (g("p") + g("q")) % 8).alias("blk"),
        (8 + (g("q") + g("t")) % 12).alias("tov"),
    )


def _order_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with line items: key, day, both ids and the sums of both sides.

    Line items are folded per order before the shuffle; orders arrive on the
    same key, so this costs one exchange per table.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        _side_sums("O").alias("_h"), _side_sums("F").alias("_a")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("game_date"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("game_id"),
        "game_date",
        season_label(F.col("game_date")).alias("season"),
        (F.col("o_custkey") % TEAMS).alias("home_team_id"),
        ((F.col("o_custkey") + 1 + F.col("o_orderkey") % (TEAMS - 1)) % TEAMS).alias("away_team_id"),
        "_h",
        "_a",
    )


def contest_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: key, day, both ids and the two box scores (or null)."""
    home, away = F.col("home_team_id"), F.col("away_team_id")
    return _order_sums(spark, sf_dir).select(
        "game_id",
        "game_date",
        "season",
        "home_team_id",
        "away_team_id",
        F.when(F.col("_h.n") > 0, _box("_h", True, home, away)).alias("home"),
        F.when(F.col("_a.n") > 0, _box("_a", False, away, home)).alias("away"),
    )


def game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long log: one row per side of a contest.

    Sides become rows while they are sums, so the box score is written once:
    with both sides in one expression the generated method passes the 8,000
    bytes up to which the JVM compiles, and runs interpreted.
    """
    side = lambda own, other, team, opponent, is_home: F.struct(
        F.col(own).alias("own"), F.col(other).alias("other"), F.col(team).alias("team"), F.col(opponent).alias("opponent"), F.lit(is_home).alias("is_home")
    )
    both = F.array(side("_h", "_a", "home_team_id", "away_team_id", True), side("_a", "_h", "away_team_id", "home_team_id", False))
    rows = _order_sums(spark, sf_dir).select("game_id", "game_date", "season", F.explode(both).alias("_r")).filter("_r.own.n > 0")
    at_home, points = F.col("_r.is_home"), lambda sums: _points(lambda c: F.col(f"_r.{sums}.{c}"))
    scored = rows.withColumn("_margin", F.when(F.col("_r.other.n") > 0, points("own") - points("other")))
    margin = F.col("_margin")
    won = F.when(at_home, margin >= 0).otherwise(margin > 0)
    boxed = scored.select(
        "game_id",
        "game_date",
        "season",
        _box("_r.own", at_home, F.col("_r.team"), F.col("_r.opponent")).alias("_box"),
        margin.cast("double").alias("plus_minus"),
        F.when(margin.isNotNull(), F.when(won, "W").otherwise("L")).alias("wl"),
    )
    return boxed.select("game_id", "game_date", "season", "_box.*", "plus_minus", "wl")


def stored_log(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The log (or some of its columns) as a table, for plans that read it several times."""
    log = game_log(spark, sf_dir)
    return stored(log.select(*columns) if columns else log, "game-log")


def form_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored log without labels, which form features would carry along."""
    return stored_log(spark, sf_dir).drop("season", "team_name", "team_abbr")


#: What standings need of the log.
RESULTS = ("game_id", "game_date", "team_id", "wl")


def stored_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid contests as a table: ratings order them, which reads them several times."""
    return stored(valid_contests(game_log(spark, sf_dir)), "contests")


def season_log(spark: SparkSession, sf_dir: str, **asked) -> DataFrame:
    """The log stored by season, made once for the input files; `asked` as in `read_by_season`."""
    log = game_log(spark, sf_dir)
    folder = f"{shared_dir(spark).rstrip('/')}/season-log-{content_key(log)}"
    path = once(spark, folder, lambda out: write_by_season(log, out, replace_all=True))
    return read_by_season(spark, path, log.schema, **asked)


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team dimension: nations; contest ids beyond it are exhibition teams."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_name").alias("full_name"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("nickname"),
    )


MODELS = ("p1", "p2", "p3", "p4")
PRIMES = (7919, 104729, 1299709, 15485863)


def scored_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided contests with four pseudo-model probabilities (thousandths).

    Half of the contests have models that differ, half have close ones; all
    lean towards the real margin so that confident rows are usually right.
    """
    sides = contest_sides(spark, sf_dir).filter("home is not null and away is not null")
    game = F.col("game_id")
    margin = F.col("home.pts") - F.col("away.pts")
    clip = lambda v: F.greatest(F.lit(50), F.least(F.lit(949), v))
    lean = 500 + 8 * margin
    wide = [clip(lean + (game * p) % 400 - 200) for p in PRIMES]
    close = [clip(lean + (game * PRIMES[0]) % 300 - 150 + (game % 8) * step) for step in (0, 5, -5, 10)]
    mixed = [F.when(game % 2 == 0, w).otherwise(c) for w, c in zip(wide, close)]
    return sides.select(
        "game_id",
        "game_date",
        "season",
        "home_team_id",
        "away_team_id",
        F.col("home.team_name").alias("home_team"),
        F.col("away.team_name").alias("away_team"),
        F.when(margin >= 0, 1).otherwise(0).alias("label"),
        *[(m / 1000).alias(name) for m, name in zip(mixed, MODELS)],
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored contests with the ensemble's view, before saving."""
    probs = F.array(*MODELS)
    return (
        scored_contests(spark, sf_dir)
        .withColumn("home_win_prob", F.round(array_mean(probs), 6))
        .withColumn("model_agreement", F.round(1 - array_spread(probs), 6))
        .withColumn("confidence", F.round(confidence(F.col("home_win_prob")), 6))
        .withColumn("tier", confidence_tier(F.col("confidence")))
        .withColumn("predicted_winner", F.when(F.col("home_win_prob") > 0.5, F.col("home_team")).otherwise(F.col("away_team")))
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction history; every tenth contest is still pending."""
    pending = F.col("game_id") % 10 == 0
    winner = F.when(F.col("label") == 1, F.col("home_team")).otherwise(F.col("away_team"))
    return predictions(spark, sf_dir).select(
        F.col("game_date").alias("date"),
        "game_id",
        "away_team",
        "home_team",
        F.col("predicted_winner").alias("prediction"),
        F.when(~pending, winner).alias("winner"),
        "confidence",
        "home_win_prob",
        "model_agreement",
        "tier",
        F.when(~pending, (F.col("predicted_winner") == winner).cast("int")).alias("correct"),
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests to come: the one-sided orders."""
    one_sided = contest_sides(spark, sf_dir).filter("home is null or away is null")
    return one_sided.select("game_id", "game_date", "season", "home_team_id", "away_team_id")


def nested_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes per two-sided order: one bookmaker per line item.

    Line 7 quotes a price of 0 and line 1 has no head-to-head market.
    """
    lines = table(spark, sf_dir, "lineitem")
    outcome = lambda name, price: F.struct(F.col(name).alias("name"), price.alias("price"))
    offer = lambda c: F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.round(1.2 + 10 * F.col(c), 2))
    named = (
        contest_sides(spark, sf_dir)
        .filter("home is not null and away is not null")
        .select("game_id", "game_date", F.col("home.team_name").alias("home_team"), F.col("away.team_name").alias("away_team"))
    )
    book = F.struct(
        F.col("l_suppkey").cast("string").alias("key"),
        F.concat(F.lit("Book "), F.col("l_suppkey").cast("string")).alias("title"),
        F.array(
            F.struct(
                F.when(F.col("l_linenumber") == 1, "spreads").otherwise("h2h").alias("key"),
                F.array(outcome("home_team", offer("l_discount")), outcome("away_team", offer("l_tax"))).alias("outcomes"),
            ),
            F.struct(
                F.lit("totals").alias("key"),
                F.array(outcome("home_team", F.col("l_quantity"))).alias("outcomes"),
            ),
        ).alias("markets"),
    )
    return (
        lines.join(named, F.col("l_orderkey") == F.col("game_id"))
        .groupBy("game_id", "game_date", "home_team", "away_team")
        .agg(F.collect_list(book).alias("bookmakers"))
        .select(
            F.col("game_id").cast("string").alias("id"),
            F.lit("contest").alias("sport_key"),
            F.lit("Contest").alias("sport_title"),
            F.concat(F.col("game_date").cast("string"), F.lit("T12:00:00Z")).alias("commence_time"),
            "home_team",
            "away_team",
            "bookmakers",
        )
    )


# --- the same inputs as SQL text -------------------------------------------

_SEASON_SQL = (
    "CAST(year({d}) - CASE WHEN month({d}) >= 10 THEN 0 ELSE 1 END AS VARCHAR) || '-' || "
    "lpad(CAST((year({d}) + CASE WHEN month({d}) >= 10 THEN 1 ELSE 0 END) % 100 AS VARCHAR), 2, '0')"
)


def season_sql(day: str) -> str:
    return _SEASON_SQL.format(d=day)


LOG_SQL = f"""
sums AS MATERIALIZED (
  SELECT l_orderkey AS game_id, l_linestatus AS side, count(*) AS n,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(l_partkey) AS BIGINT) AS p,
         CAST(sum(l_suppkey) AS BIGINT) AS s,
         CAST(sum(CAST(round(100 * l_discount) AS BIGINT)) AS BIGINT) AS d,
         CAST(sum(CAST(round(100 * l_tax) AS BIGINT)) AS BIGINT) AS t
  FROM lineitem GROUP BY 1, 2),
ids AS (
  SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date,
         o_custkey % 30 AS home_team_id, (o_custkey + 1 + o_orderkey % 29) % 30 AS away_team_id
  FROM orders),
raw AS (
  SELECT i.game_id, i.game_date, {season_sql('i.game_date')} AS season, i.home_team_id, i.away_team_id,
         s.side = 'O' AS at_home,
         CASE WHEN s.side = 'O' THEN i.home_team_id ELSE i.away_team_id END AS team_id,
         CASE WHEN s.side = 'O' THEN i.away_team_id ELSE i.home_team_id END AS other_id,
         30 + p % 20 AS fgm, 75 + q % 25 AS fga, 5 + (p + s) % 15 AS fg3m, 20 + s % 25 AS fg3a,
         least(10 + d % 25, 8 + t % 20) AS ftm, 10 + d % 25 AS fta,
         5 + (q + n) % 12 AS oreb, 25 + (p + n) % 20 AS dreb,
         15 + s % 18 AS ast, 4 + (s + n) % 9 AS stl, 2 + (p + q) % 8 AS blk, 8 + (q + t) % 12 AS tov
  FROM sums s JOIN ids i USING (game_id)),
box AS (
  SELECT *, 2 * fgm + fg3m + ftm AS pts, oreb + dreb AS reb, fgm / fga AS fg_pct, fg3m / fg3a AS fg3_pct,
         ftm / fta AS ft_pct,
         'Team ' || lpad(CAST(team_id AS VARCHAR), 2, '0') AS team_name,
         'T' || lpad(CAST(team_id AS VARCHAR), 2, '0') AS team_abbr,
         'T' || lpad(CAST(team_id AS VARCHAR), 2, '0') || CASE WHEN at_home THEN ' vs. ' ELSE ' @ ' END
             || 'T' || lpad(CAST(other_id AS VARCHAR), 2, '0') AS matchup
  FROM raw),
log AS MATERIALIZED (
  SELECT b.* EXCLUDE (other_pts), CAST(pts - other_pts AS DOUBLE) AS plus_minus,
         CASE WHEN other_pts IS NULL THEN NULL WHEN pts > other_pts OR (pts = other_pts AND at_home) THEN 'W' ELSE 'L' END AS wl
  FROM (SELECT *, CASE WHEN at_home THEN min(CASE WHEN NOT at_home THEN pts END) OVER (PARTITION BY game_id)
                       ELSE min(CASE WHEN at_home THEN pts END) OVER (PARTITION BY game_id) END AS other_pts FROM box) b)"""

CONTESTS_SQL = f"""{LOG_SQL},
contests AS MATERIALIZED (
  SELECT game_id, any_value(game_date) AS game_date, any_value(season) AS season,
         min(team_id) FILTER (at_home) AS home_team_id, min(team_id) FILTER (NOT at_home) AS away_team_id,
         min(wl) FILTER (at_home) AS home_wl, min(wl) FILTER (NOT at_home) AS away_wl,
         min(plus_minus) FILTER (at_home) AS home_plus_minus, min(plus_minus) FILTER (NOT at_home) AS away_plus_minus,
         min(team_name) FILTER (at_home) AS home_team, min(team_name) FILTER (NOT at_home) AS away_team,
         min(pts) FILTER (at_home) AS home_pts, min(pts) FILTER (NOT at_home) AS away_pts
  FROM log GROUP BY game_id HAVING count(*) = 2)"""


def _clip_sql(expr: str) -> str:
    return f"greatest(50, least(949, {expr}))"


def _model_sql(i: int) -> str:
    lean = "500 + 8 * (home_pts - away_pts)"
    wide = _clip_sql(f"{lean} + (game_id * {PRIMES[i]}) % 400 - 200")
    step = (0, 5, -5, 10)[i]
    close = _clip_sql(f"{lean} + (game_id * {PRIMES[0]}) % 300 - 150 + (game_id % 8) * ({step})")
    return f"(CASE WHEN game_id % 2 = 0 THEN {wide} ELSE {close} END) / 1000 AS p{i + 1}"


TIER_SQL = (
    "CASE WHEN confidence >= 0.5 THEN 'EXCELLENT' WHEN confidence >= 0.4 THEN 'STRONG' "
    "WHEN confidence >= 0.3 THEN 'GOOD' WHEN confidence >= 0.2 THEN 'MODERATE' "
    "WHEN confidence >= 0.1 THEN 'RISKY' ELSE 'SKIP' END"
)

SCORED_SQL = f"""{CONTESTS_SQL},
scored AS MATERIALIZED (
  SELECT game_id, game_date, season, home_team_id, away_team_id, home_team, away_team,
         CASE WHEN home_pts >= away_pts THEN 1 ELSE 0 END AS label,
         {', '.join(_model_sql(i) for i in range(4))}
  FROM contests)"""

PREDICTIONS_SQL = f"""{SCORED_SQL},
pred0 AS (
  SELECT *, round((p1 + p2 + p3 + p4) / 4, 6) AS home_win_prob,
         round(1 - sqrt(greatest((p1*p1 + p2*p2 + p3*p3 + p4*p4) / 4 - ((p1+p2+p3+p4)/4) * ((p1+p2+p3+p4)/4), 0)), 6) AS model_agreement
  FROM scored),
pred1 AS (SELECT *, round(abs(home_win_prob - 0.5) * 2, 6) AS confidence FROM pred0),
predictions AS (
  SELECT *, {TIER_SQL} AS tier,
         CASE WHEN home_win_prob > 0.5 THEN home_team ELSE away_team END AS predicted_winner
  FROM pred1)"""

HISTORY_SQL = f"""{PREDICTIONS_SQL},
history AS (
  SELECT game_date AS date, game_id, away_team, home_team, predicted_winner AS prediction,
         CASE WHEN game_id % 10 <> 0 THEN CASE WHEN label = 1 THEN home_team ELSE away_team END END AS winner,
         confidence, home_win_prob, model_agreement, tier,
         CASE WHEN game_id % 10 <> 0 THEN
           CASE WHEN predicted_winner = CASE WHEN label = 1 THEN home_team ELSE away_team END THEN 1 ELSE 0 END END AS correct
  FROM predictions),
done AS (SELECT * FROM history WHERE correct IS NOT NULL)"""

TEAMS_SQL = """
teams AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS full_name, 'N' || CAST(n_nationkey AS VARCHAR) AS nickname FROM nation)"""

SCHEDULE_SQL = f"""{LOG_SQL},
schedule AS (
  SELECT game_id, game_date, season, home_team_id, away_team_id FROM raw
  WHERE game_id IN (SELECT game_id FROM raw GROUP BY game_id HAVING count(*) = 1))"""
