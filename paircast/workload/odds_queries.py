"""Quotes: flattening, features, keys, merging and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircast.constants import ODDS_COLUMNS
from paircast.functions import prediction as P
from paircast.operators import odds as O
from paircast.sources import schemas as S
from paircast.streaming.incremental import refresh_odds
from paircast.workload import tables as T
from paircast.workload.registry import i8, query, r6, tidy


def _quotes(spark, sf_dir):
    """Nested quotes as they arrive: a JSON text parsed with the explicit schema."""
    raw = T.nested_odds(spark, sf_dir).select(F.to_json(F.struct("*")).alias("payload"))
    return raw.select(F.from_json("payload", S.ODDS).alias("_q")).select("_q.*")


_PRICE = "CASE WHEN l_linenumber = 7 THEN 0 ELSE round(1.2 + 10 * {c}, 2) END"
QUOTES_SQL = f"""{T.CONTESTS_SQL},
books AS (SELECT c.game_id, c.game_date, c.home_team, c.away_team, l_suppkey, l_linenumber, l_quantity,
  CAST({_PRICE.format(c='l_discount')} AS DOUBLE) AS home_price, CAST({_PRICE.format(c='l_tax')} AS DOUBLE) AS away_price
  FROM lineitem JOIN contests c ON l_orderkey = c.game_id)"""


@query(
    "scan_odds",
    f"""WITH {QUOTES_SQL}, flat AS (
      SELECT game_id, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'spreads' ELSE 'h2h' END AS market, home_team AS name, home_price AS price FROM books
      UNION ALL SELECT game_id, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'spreads' ELSE 'h2h' END, away_team, away_price FROM books
      UNION ALL SELECT game_id, l_suppkey, 'totals', home_team, l_quantity FROM books)
    SELECT CAST(game_id AS VARCHAR) AS id, CAST(l_suppkey AS VARCHAR) AS bookmaker, market, name, {r6('price')} FROM flat""",
)
def scan_odds(spark, sf_dir):
    return tidy(
        _quotes(spark, sf_dir)
        .select("id", F.explode("bookmakers").alias("_b"))
        .select("id", F.col("_b.key").alias("bookmaker"), F.explode("_b.markets").alias("_m"))
        .select("id", "bookmaker", F.col("_m.key").alias("market"), F.explode("_m.outcomes").alias("_o"))
        .select("id", "bookmaker", "market", "_o.name", "_o.price")
    )


_h2h = lambda s: f"CASE WHEN l_linenumber <> 1 AND {s}_price > 0 THEN {s}_price END"
_SIDE_FEATURES = ", ".join(
    f"avg({_h2h(s)}) AS {s}_avg_odds, max({_h2h(s)}) AS {s}_best_odds, min({_h2h(s)}) AS {s}_worst_odds, "
    f"max({_h2h(s)}) - min({_h2h(s)}) AS {s}_odds_spread, 1 / avg({_h2h(s)}) AS {s}_implied_prob"
    for s in ("home", "away")
)
FEATURES_SQL = f"""{QUOTES_SQL},
features AS (SELECT game_id, game_date, home_team, away_team, {_SIDE_FEATURES}, count(*) AS bookmaker_count FROM books GROUP BY 1, 2, 3, 4)"""
_FEATURE_LIST = ", ".join(i8(c) if c == "bookmaker_count" else r6(c) for c in ODDS_COLUMNS)
_KEYS = ["id", "commence_time", "home_team", "away_team"]


def _features(spark, sf_dir):
    rows = O.odds_features(_quotes(spark, sf_dir), _KEYS)
    return rows.select(
        F.col("id").cast("long").alias("game_id"), F.to_date("commence_time").alias("game_date"), "home_team", "away_team", *ODDS_COLUMNS
    )


@query("odds_features", f"WITH {FEATURES_SQL} SELECT {i8('game_id')}, {_FEATURE_LIST} FROM features")
def odds_features(spark, sf_dir):
    return tidy(_features(spark, sf_dir), "game_id", *ODDS_COLUMNS)


@query(
    "odds_keyed",
    f"""WITH {FEATURES_SQL}, k AS (SELECT *, lower(home_team) || '_vs_' || lower(away_team) AS game_key FROM features)
    SELECT game_date, game_key, {i8('arg_max(game_id, game_id)', 'ordinal')}, {i8('arg_max(bookmaker_count, game_id)', 'bookmaker_count')} FROM k GROUP BY game_date, game_key""",
)
def odds_keyed(spark, sf_dir):
    rows = _features(spark, sf_dir).withColumnRenamed("game_id", "ordinal")
    return tidy(O.odds_keyed(rows), "game_date", "game_key", "ordinal", "bookmaker_count")


_MERGED_SQL = f"""{FEATURES_SQL},
known AS (SELECT *, row_number() OVER (PARTITION BY game_date, home_team, away_team ORDER BY {', '.join(f'{c} NULLS FIRST' for c in ODDS_COLUMNS)}) AS k
  FROM features WHERE game_id % 4 <> 0),
merged AS (SELECT c.game_id, {', '.join(f'k.{c}' for c in ODDS_COLUMNS)} FROM contests c
  LEFT JOIN known k ON k.k = 1 AND k.game_date = c.game_date AND k.home_team = c.home_team AND k.away_team = c.away_team)"""


def _merged(spark, sf_dir):
    shouted = lambda c: F.concat(F.lit(" "), F.upper(c), F.lit(" ")).alias(c)
    odds = _features(spark, sf_dir).filter("game_id % 4 <> 0").select("game_date", shouted("home_team"), shouted("away_team"), *ODDS_COLUMNS)
    games = T.scored_contests(spark, sf_dir).select("game_id", "game_date", "home_team", "away_team")
    blank = {c: F.lit(None).cast("long" if c == "bookmaker_count" else "double") for c in ODDS_COLUMNS}
    return O.merge_odds(games.withColumns(blank), odds)


@query("odds_merge", f"WITH {_MERGED_SQL} SELECT {i8('game_id')}, {_FEATURE_LIST} FROM merged")
def odds_merge(spark, sf_dir):
    return tidy(_merged(spark, sf_dir), "game_id", *ODDS_COLUMNS)


@query("odds_match_rate", f"WITH {_MERGED_SQL} SELECT count(home_avg_odds) AS matched, count(*) AS total, {r6('100 * count(home_avg_odds) / count(*)', 'match_rate')} FROM merged")
def odds_match_rate(spark, sf_dir):
    return tidy(O.match_rate(_merged(spark, sf_dir)))


# Display names of two words; quotes repeat them exactly, shorten them to the
# second word after an article, or name somebody else.
_NAME = "'C' || CAST({t} % 7 AS VARCHAR) || ' Team' || CAST({t} AS VARCHAR)"
_SHORT = "'The Team' || CAST({t} AS VARCHAR)"


def joined_text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


FUZZY_SQL = f"""{T.CONTESTS_SQL},
named AS (SELECT game_id, game_date, {_NAME.format(t='home_team_id')} AS home_team, {_NAME.format(t='away_team_id')} AS away_team,
  home_team_id, away_team_id FROM contests),
quoted AS (SELECT game_date, game_id AS ordinal, lower(CASE game_id % 3 WHEN 0 THEN home_team WHEN 1 THEN {_SHORT.format(t='home_team_id')} ELSE 'Nobody' END) AS h,
  lower(CASE game_id % 3 WHEN 0 THEN away_team WHEN 1 THEN {_SHORT.format(t='away_team_id')} ELSE 'Nobody' END) AS a FROM named),
keyed AS (SELECT *, h || '_vs_' || a AS game_key FROM quoted),
exact AS (SELECT DISTINCT game_date, game_key FROM keyed),
shared AS (
  SELECT n.game_id, arg_min(k.game_key, (k.ordinal, k.game_key)) AS game_key FROM named n JOIN keyed k ON k.game_date = n.game_date
  WHERE len(list_intersect(list_filter(string_split(lower(n.home_team), ' '), lambda w: w NOT IN ('the', 'a', 'an')), string_split(k.h, ' '))) >= 1
    AND len(list_intersect(list_filter(string_split(lower(n.away_team), ' '), lambda w: w NOT IN ('the', 'a', 'an')), string_split(k.a, ' '))) >= 1
  GROUP BY n.game_id)"""


@query(
    "odds_fuzzy_match",
    f"""WITH {FUZZY_SQL} SELECT {i8('n.game_id', 'game_id')}, coalesce(e.game_key, s.game_key) AS matched_key,
    CASE WHEN e.game_key IS NOT NULL THEN 'exact' WHEN s.game_key IS NOT NULL THEN 'partial' ELSE 'none' END AS match_kind
    FROM named n LEFT JOIN exact e ON e.game_date = n.game_date AND e.game_key = lower(n.home_team) || '_vs_' || lower(n.away_team)
    LEFT JOIN shared s ON s.game_id = n.game_id""",
)
def odds_fuzzy_match(spark, sf_dir):
    contests = T.scored_contests(spark, sf_dir).select("game_id", "game_date", "home_team_id", "away_team_id")
    games = contests.select(
        "game_id", "game_date", joined_text("C", F.col("home_team_id") % 7, " Team", F.col("home_team_id")).alias("home_team"),
        joined_text("C", F.col("away_team_id") % 7, " Team", F.col("away_team_id")).alias("away_team"), "home_team_id", "away_team_id",
    )
    kind = F.col("game_id") % 3
    shown = lambda name, key: F.lower(
        F.when(kind == 0, F.col(name)).when(kind == 1, joined_text("The Team", F.col(key))).otherwise("Nobody")
    )
    key = F.concat(shown("home_team", "home_team_id"), F.lit("_vs_"), shown("away_team", "away_team_id"))
    odds = games.select("game_date", F.col("game_id").alias("ordinal"), key.alias("game_key"))
    return tidy(O.fuzzy_match(games, odds), "game_id", "matched_key", "match_kind")


@query("team_name_match", f"SELECT {i8('p_partkey')}, p_name FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_name), 'ring')")
def team_name_match(spark, sf_dir):
    parts = T.table(spark, sf_dir, "part")
    return tidy(parts.filter(O.name_contains_word("The small Ring", F.col("p_name"))), "p_partkey", "p_name")


@query("team_search", f"SELECT {i8('p_partkey')}, p_name FROM part WHERE contains(lower(p_name), 'gear') ORDER BY p_partkey LIMIT 1")
def team_search(spark, sf_dir):
    return tidy(O.first_named(T.table(spark, sf_dir, "part"), "p_name", "Gear", ["p_partkey"]), "p_partkey", "p_name")


@query(
    "team_name_matches",
    f"""WITH searches AS (SELECT DISTINCT 'The ' || p_name AS search FROM part),
    words AS (SELECT DISTINCT search, unnest(string_split(lower(search), ' ')) AS word FROM searches)
    SELECT DISTINCT search, {i8('p_partkey')} FROM words JOIN part ON contains(lower(p_name), word) WHERE word <> 'the'""",
)
def team_name_matches(spark, sf_dir):
    """Every distinct name as a search against all names."""
    parts = T.table(spark, sf_dir, "part")
    searches = parts.select(F.concat(F.lit("The "), F.col("p_name")).alias("search"))
    return tidy(O.names_containing(searches, "search", parts, "p_partkey", "p_name"))


@query(
    "team_searches",
    f"""WITH searches AS (SELECT DISTINCT upper(substr(p_name, 2, 1 + p_partkey % 7)) AS search FROM part)
    SELECT search, {i8('min(p_partkey)', 'p_partkey')} FROM searches JOIN part ON contains(lower(p_name), lower(search)) GROUP BY search""",
)
def team_searches(spark, sf_dir):
    """Pieces of names, of 1 to 7 characters, each with the first name that contains it."""
    parts = T.table(spark, sf_dir, "part")
    searches = parts.select(F.upper(F.expr("substr(p_name, 2, cast(1 + p_partkey % 7 as int))")).alias("search"))
    return tidy(O.first_names_containing(searches, "search", parts, "p_partkey", "p_name"))



_AMERICAN = "(l_partkey % 601 - 300)"


@query(
    "odds_american_to_decimal",
    f"""SELECT {i8('l_orderkey')}, {i8('l_linenumber')}, {i8(_AMERICAN, 'american')},
    {r6(f'CASE WHEN {_AMERICAN} > 0 THEN {_AMERICAN} / 100 + 1 WHEN {_AMERICAN} < 0 THEN 100 / abs({_AMERICAN}) + 1 END', 'price')} FROM lineitem""",
)
def american(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 601 - 300).alias("american"))
    return tidy(rows.withColumn("price", P.american_to_decimal(F.col("american"))))


@query(
    "implied_prob",
    f"SELECT {i8('l_orderkey')}, {i8('l_linenumber')}, {r6('CASE WHEN l_discount > 0 THEN 1 / (1 + 10 * l_discount) END', 'implied')} FROM lineitem",
)
def implied(spark, sf_dir):
    price = F.when(F.col("l_discount") > 0, 1 + 10 * F.col("l_discount")).otherwise(0.0)
    return tidy(T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.implied_probability(price).alias("implied")))


@query("overround", f"WITH {FEATURES_SQL} SELECT {i8('game_id')}, {r6('1 / home_avg_odds + 1 / away_avg_odds - 1', 'overround')} FROM features")
def overround(spark, sf_dir):
    return tidy(_features(spark, sf_dir).select("game_id", P.overround(F.col("home_avg_odds"), F.col("away_avg_odds")).alias("overround")))


@query(
    "value_edge",
    f"""WITH {FEATURES_SQL}, {T.PREDICTIONS_SQL[len(T.CONTESTS_SQL) + 1:]}, edge AS (
      SELECT f.game_id, p.home_win_prob * 100 - f.home_implied_prob * 100 AS value_diff FROM features f JOIN predictions p USING (game_id)
      WHERE f.home_avg_odds > 1 AND f.away_avg_odds > 1)
    SELECT {i8('game_id')}, {r6('value_diff')} FROM edge WHERE abs(value_diff) > 0.1""",
)
def value_edge(spark, sf_dir):
    priced = _features(spark, sf_dir).join(T.predictions(spark, sf_dir).select("game_id", "home_win_prob"), "game_id")
    return tidy(O.value_edge(priced), "game_id", "value_diff")


@query("missing_dates", f"WITH {T.CONTESTS_SQL} SELECT DISTINCT game_date FROM contests WHERE day(game_date) % 3 <> 0")
def missing_dates(spark, sf_dir):
    games = T.scored_contests(spark, sf_dir)
    return O.dates_to_fetch(games, games.filter(F.dayofmonth("game_date") % 3 == 0))


@query("incr_odds", f"WITH {FEATURES_SQL} SELECT {i8('game_id')}, game_date, {r6('home_avg_odds')}, day(game_date) % 3 = 0 AS was_cached FROM features")
def incr_odds(spark, sf_dir):
    fetched = _features(spark, sf_dir)
    in_cache = F.dayofmonth("game_date") % 3 == 0
    merged = refresh_odds(
        fetched.filter(in_cache).withColumn("was_cached", F.lit(True)), fetched.withColumn("was_cached", F.lit(False)), T.scored_contests(spark, sf_dir)
    )
    return tidy(merged, "game_id", "game_date", "home_avg_odds", "was_cached")
