"""Prediction history: upkeep, breakdowns, streaks, filters and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paircast.constants import (
    AGREEMENT_BUCKETS,
    AGREEMENT_BUCKETS_COARSE,
    CONFIDENCE_BUCKETS,
    CONFIDENCE_BUCKETS_COARSE,
    HOME_PROB_BUCKETS,
    TIERS,
    TRAILING_PERIODS,
    WEEKDAYS,
)
from paircast.functions import prediction as P
from paircast.operators import history as H
from paircast.operators import stats as S
from paircast.workload import tables as T
from paircast.workload.registry import i8, query, r6, tidy

NOW = "1998-03-01 12:00:00"
_DAY = "DATE '1998-01-10'"


@query("scan_history", f"WITH {T.HISTORY_SQL} SELECT date, {i8('game_id')}, away_team, home_team, prediction, winner, {r6('confidence')}, {r6('home_win_prob')}, {r6('model_agreement')}, tier, {i8('correct')} FROM history")
def scan_history(spark, sf_dir):
    return tidy(T.history(spark, sf_dir))


@query("history_status", f"WITH {T.HISTORY_SQL} SELECT {i8('game_id')}, correct IS NOT NULL AS completed FROM history")
def history_status(spark, sf_dir):
    return tidy(T.history(spark, sf_dir).select("game_id", H.is_completed().alias("completed")))


@query(
    "history_new_rows",
    f"""WITH {T.HISTORY_SQL}, old AS (SELECT * FROM history WHERE date < {_DAY})
    SELECT p.game_date AS date, p.away_team, p.home_team, p.predicted_winner AS prediction, p.tier
    FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.date = p.game_date AND o.away_team = p.away_team AND o.home_team = p.home_team)""",
)
def history_new_rows(spark, sf_dir):
    old = T.history(spark, sf_dir).filter("date < date'1998-01-10'")
    rows = H.history_rows(T.predictions(spark, sf_dir).withColumnRenamed("game_date", "date"))
    return tidy(H.new_rows(rows, old), "date", "away_team", "home_team", "prediction", "tier")


RESULTS_SQL = f"""{T.HISTORY_SQL},
results AS (SELECT game_date AS date, away_team, home_team, max(CASE WHEN label = 1 THEN home_team ELSE away_team END) AS winner FROM scored GROUP BY 1, 2, 3),
filled AS (
  SELECT h.date, h.game_id, CASE WHEN t.date IS NOT NULL AND r.winner IS NOT NULL THEN r.winner ELSE h.winner END AS winner,
         CASE WHEN t.date IS NOT NULL AND r.winner IS NOT NULL THEN CASE WHEN h.prediction = r.winner THEN 1 ELSE 0 END ELSE h.correct END AS correct
  FROM history h LEFT JOIN results r ON r.date = h.date AND r.away_team = h.away_team AND r.home_team = h.home_team
  LEFT JOIN (SELECT DISTINCT date FROM history WHERE winner IS NULL) t ON t.date = h.date)"""


def _results(spark, sf_dir):
    winner = F.when(F.col("label") == 1, F.col("home_team")).otherwise(F.col("away_team"))
    return T.scored_contests(spark, sf_dir).select(F.col("game_date").alias("date"), "away_team", "home_team", winner.alias("winner"))


@query("backfill_results", f"WITH {RESULTS_SQL} SELECT date, {i8('game_id')}, winner, {i8('correct')} FROM filled")
def backfill_results(spark, sf_dir):
    return tidy(H.backfill(T.history(spark, sf_dir), _results(spark, sf_dir)), "date", "game_id", "winner", "correct")


@query(
    "save_gate",
    f"""WITH {T.PREDICTIONS_SQL}, last AS (SELECT max(game_date) AS day FROM predictions)
    SELECT {i8('game_id')}, game_date FROM predictions, last WHERE NOT (game_id % 3 = 0 AND game_date <> last.day)""",
)
def save_gate(spark, sf_dir):
    predictions = T.predictions(spark, sf_dir)
    today = predictions.agg(F.max("game_date")).scalar()
    return tidy(H.save_gate(predictions, F.col("game_id") % 3 == 0, F.col("game_date"), today), "game_id", "game_date")


# --- breakdowns ------------------------------------------------------------


@query(
    "stats_overall",
    f"""WITH {T.HISTORY_SQL} SELECT count(correct) AS total, {i8('sum(correct)', 'correct')}, count(*) - count(correct) AS pending,
    {r6('sum(correct) / count(correct) * 100', 'accuracy')}, min(CASE WHEN correct IS NOT NULL THEN date END) AS date_min,
    max(CASE WHEN correct IS NOT NULL THEN date END) AS date_max FROM history""",
)
def stats_overall(spark, sf_dir):
    return tidy(S.overall(T.history(spark, sf_dir)))


_COMMON_SQL = f"count(*) AS total, {i8('sum(correct)', 'correct')}, {r6('sum(correct) / count(*) * 100', 'accuracy')}, CAST(sum(correct) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS record"
_COMMON = ("label", "total", "correct", "accuracy", "record")


def bucket_sql(value: str, buckets) -> str:
    parts = []
    for low, high, label in buckets:
        tests = [f"{value} >= CAST({low} AS DOUBLE)"] * (low is not None) + [f"{value} < CAST({high} AS DOUBLE)"] * (high is not None)
        parts.append(f"WHEN {' AND '.join(tests)} THEN '{label}'")
    return f"CASE {' '.join(parts)} END"


@query("stats_by_tier", f"WITH {T.HISTORY_SQL} SELECT tier AS label, {_COMMON_SQL}, {r6('(sum(correct) * CAST(0.41 AS DOUBLE) - (count(*) - sum(correct))) / count(*) * 100', 'roi')} FROM done GROUP BY tier")
def stats_by_tier(spark, sf_dir):
    return tidy(S.by_tier(T.history(spark, sf_dir)), *_COMMON, "roi")


def _bucket_query(name, fn, column, buckets, extra_sql="", extra=()):
    @query(
        name,
        f"WITH {T.HISTORY_SQL} SELECT label, {_COMMON_SQL}{extra_sql} FROM (SELECT *, {bucket_sql(column, buckets)} AS label FROM done) WHERE label IS NOT NULL GROUP BY label",
    )
    def run(spark, sf_dir):
        return tidy(fn(T.history(spark, sf_dir)), *_COMMON, *extra)


_bucket_query("stats_by_confidence", S.by_confidence, "confidence", CONFIDENCE_BUCKETS, f", {r6('avg(home_win_prob) * 100', 'avg_prob')}", ("avg_prob",))
_bucket_query("stats_by_confidence_coarse", S.by_confidence_coarse, "confidence", CONFIDENCE_BUCKETS_COARSE)
_bucket_query("stats_by_agreement", S.by_agreement, "model_agreement", AGREEMENT_BUCKETS)
_bucket_query("stats_by_agreement_coarse", S.by_agreement_coarse, "model_agreement", AGREEMENT_BUCKETS_COARSE)
_bucket_query(
    "stats_by_home_prob", S.by_home_prob, "home_win_prob", HOME_PROB_BUCKETS,
    f", {r6('avg(CASE WHEN winner = home_team THEN 1 ELSE 0 END) * 100', 'home_win_rate')}", ("home_win_rate",),
)


@query(
    "stats_trailing",
    f"""WITH {T.HISTORY_SQL}, periods(days, label) AS (VALUES (3, 'Last 3 days'), (7, 'Last 7 days'), (14, 'Last 14 days'), (30, 'Last 30 days'))
    SELECT label, {_COMMON_SQL} FROM done JOIN periods ON CAST(date AS TIMESTAMP) >= TIMESTAMP '{NOW}' - to_days(days) GROUP BY label""",
)
def stats_trailing(spark, sf_dir):
    return tidy(S.by_trailing(T.history(spark, sf_dir), NOW), *_COMMON)


@query("stats_by_weekday", f"WITH {T.HISTORY_SQL} SELECT label, {_COMMON_SQL} FROM (SELECT *, dayname(date) AS label FROM done) GROUP BY label")
def stats_by_weekday(spark, sf_dir):
    return tidy(S.by_weekday(T.history(spark, sf_dir)), *_COMMON)


@query("roi_minus110", f"WITH {T.HISTORY_SQL} SELECT tier, {r6('avg(correct)', 'accuracy')}, count(*) AS total, {r6('(100 * sum(correct) - 110 * (count(*) - sum(correct))) / (110 * count(*)) * 100', 'roi')} FROM done GROUP BY tier")
def roi_minus110(spark, sf_dir):
    return tidy(S.tier_returns_minus110(T.history(spark, sf_dir)), "tier", "accuracy", "total", "roi")


# --- filters ---------------------------------------------------------------

_CANDIDATES = ", ".join(
    f"({i}, '{name}', '{rule}', CAST({level} AS DOUBLE), {str(fav).lower()})" for i, (name, rule, level, fav) in enumerate(S.filter_candidates(), 1)
)
_FITS = """(c.tier IN ('ALL', 'FAV') OR c.tier = h.tier) AND (NOT c.is_fav OR h.home_win_prob >= 0.75 OR h.home_win_prob <= 0.25)
   AND (c.min_agree = 0 OR h.model_agreement >= c.min_agree)"""
FILTERS_SQL = f"""{T.HISTORY_SQL},
candidates(ordinal, name, tier, min_agree, is_fav) AS (VALUES {_CANDIDATES}),
counted AS (SELECT c.ordinal, c.name, c.tier, c.min_agree, c.is_fav, count(*) AS n_games, sum(h.correct) AS hits
  FROM done h JOIN candidates c ON {_FITS} GROUP BY ALL),
filters AS (SELECT *, hits / n_games * 100 AS accuracy, (hits * CAST(0.41 AS DOUBLE) - (n_games - hits)) / n_games * 100 AS roi
  FROM counted WHERE n_games >= 5 AND hits / n_games * 100 > 70.9)"""
_FILTER_COLUMNS = f"name, {i8('n_games')}, {r6('accuracy')}, {r6('roi')}, {i8('ordinal')}"


@query("profitable_filters", f"WITH {FILTERS_SQL} SELECT {_FILTER_COLUMNS}, tier, {r6('min_agree')}, is_fav FROM filters")
def profitable_filters(spark, sf_dir):
    return tidy(S.profitable_filters(T.history(spark, sf_dir)), "name", "n_games", "accuracy", "roi", "ordinal", "tier", "min_agree", "is_fav")


@query("top_filters", f"WITH {FILTERS_SQL} SELECT {_FILTER_COLUMNS} FROM filters ORDER BY accuracy DESC, ordinal LIMIT 10")
def top_filters(spark, sf_dir):
    best = S.top_filters(S.profitable_filters(T.history(spark, sf_dir)))
    return tidy(best, "name", "n_games", "accuracy", "roi", "ordinal")


MATCHES_SQL = f"""{FILTERS_SQL},
matches AS (SELECT h.game_id, c.name, row_number() OVER (PARTITION BY h.game_id ORDER BY c.accuracy DESC, c.ordinal) AS filter_rank
  FROM predictions h JOIN filters c ON {_FITS})"""


def _matches(spark, sf_dir):
    return S.filter_matches(T.predictions(spark, sf_dir), S.profitable_filters(T.history(spark, sf_dir)), ["game_id"])


@query("filter_matches", f"WITH {MATCHES_SQL} SELECT {i8('game_id')}, name, {i8('filter_rank')} FROM matches")
def filter_matches(spark, sf_dir):
    return tidy(_matches(spark, sf_dir), "game_id", "name", "filter_rank")


@query(
    "recommended_union",
    f"WITH {MATCHES_SQL} SELECT {i8('game_id')} FROM (SELECT game_id FROM predictions WHERE confidence >= 0.3 UNION SELECT game_id FROM matches)",
)
def recommended_union(spark, sf_dir):
    picks = H.tier_picks(T.predictions(spark, sf_dir))
    return tidy(S.recommended(picks, _matches(spark, sf_dir), ["game_id"]))


_RANKED = "row_number() OVER (PARTITION BY game_date ORDER BY confidence DESC, game_id)"


def _ranked(spark, sf_dir):
    return H.ranked_by_confidence(T.predictions(spark, sf_dir))


@query("ranked_predictions", f"WITH {T.PREDICTIONS_SQL} SELECT game_date, {i8(_RANKED, 'place')}, {i8('game_id')}, {r6('confidence')}, tier FROM predictions")
def ranked_predictions(spark, sf_dir):
    return tidy(_ranked(spark, sf_dir), "game_date", "place", "game_id", "confidence", "tier")


@query("tier_picks", f"WITH {T.PREDICTIONS_SQL} SELECT game_date, {i8(_RANKED, 'place')}, {i8('game_id')}, tier FROM predictions WHERE confidence >= 0.3")
def tier_picks(spark, sf_dir):
    # The best rows of a day come first, so places are unchanged by the filter.
    return tidy(H.tier_picks(_ranked(spark, sf_dir)), "game_date", "place", "game_id", "tier")


# --- streaks ---------------------------------------------------------------

STREAK_SQL = f"""{T.HISTORY_SQL},
numbered AS (SELECT correct, row_number() OVER (ORDER BY date, game_id) AS rn,
  row_number() OVER (ORDER BY date, game_id) - row_number() OVER (PARTITION BY correct ORDER BY date, game_id) AS island FROM done),
islands AS (SELECT correct, island, count(*) AS n, max(rn) AS last_rn FROM numbered GROUP BY 1, 2)"""


@query("history_current_streak", f"WITH {STREAK_SQL} SELECT CASE WHEN correct = 1 THEN 'W' ELSE 'L' END AS streak_type, {i8('n', 'length')} FROM islands ORDER BY last_rn DESC LIMIT 1")
def current_streak(spark, sf_dir):
    return tidy(S.current_streak(T.history(spark, sf_dir), ["game_id"]))


@query("history_best_worst_streak", f"WITH {STREAK_SQL} SELECT {i8('coalesce(max(CASE WHEN correct = 1 THEN n END), 0)', 'best_win')}, {i8('coalesce(max(CASE WHEN correct = 0 THEN n END), 0)', 'worst_loss')} FROM islands")
def longest_streaks(spark, sf_dir):
    return tidy(S.longest_streaks(T.history(spark, sf_dir), ["game_id"]))


# Every field of the payload: blocks, filters, the best filter and the head, as rows.
_BLOCK_ROW = "label:string,record:string,accuracy:double,roi:double,avg_prob:double,home_win_rate:double"
_FILTER_ROW = "name:string,games:bigint,accuracy:double,roi:double"
_BLOCKS = {
    "tier_rows": "tier",
    "confidence_rows": bucket_sql("confidence", CONFIDENCE_BUCKETS),
    "agreement_rows": bucket_sql("model_agreement", AGREEMENT_BUCKETS),
    "home_prob_rows": bucket_sql("home_win_prob", HOME_PROB_BUCKETS),
    "time_rows": "span",
    "day_rows": "dayname(date)",
}
_LABELS = {
    "tier_rows": [t for t, _ in TIERS],
    "confidence_rows": [b[2] for b in CONFIDENCE_BUCKETS],
    "agreement_rows": [b[2] for b in AGREEMENT_BUCKETS],
    "home_prob_rows": [b[2] for b in HOME_PROB_BUCKETS],
    "time_rows": [label for _, label in TRAILING_PERIODS],
    "day_rows": list(WEEKDAYS),
}


def _block_sql(block: str, label: str) -> str:
    labels = ", ".join(f"'{name}'" for name in _LABELS[block])
    source = "recent" if block == "time_rows" else "done"
    return f"""SELECT '{block}' AS block, {label} AS label, list_position([{labels}], {label}) AS ordinal, count(*) AS n, sum(correct) AS hits,
    avg(home_win_prob) AS prob, avg(CASE WHEN winner = home_team THEN 1 ELSE 0 END) AS home FROM {source} WHERE {label} IS NOT NULL GROUP BY ALL"""


def _tenths(value: str, name: str, only: str = "TRUE") -> str:
    return f"CASE WHEN {only} THEN {r6(f'round_even({value}, 1)', '_x').removesuffix(' AS _x')} END AS {name}"


_PAYLOAD_SQL = f"""WITH {FILTERS_SQL}, periods(days, span) AS (VALUES {', '.join(f"({d}, '{label}')" for d, label in TRAILING_PERIODS)}),
recent AS (SELECT * FROM done JOIN periods ON CAST(date AS TIMESTAMP) >= TIMESTAMP '{NOW}' - to_days(days)),
blocks AS ({' UNION ALL '.join(_block_sql(block, label) for block, label in _BLOCKS.items())}),
best AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC, ordinal) AS place FROM filters),
head AS (SELECT count(correct) AS n, sum(correct) AS hits, count(*) - count(correct) AS waiting, min(CASE WHEN correct IS NOT NULL THEN date END) AS since,
         max(CASE WHEN correct IS NOT NULL THEN date END) AS until FROM history)
SELECT block, row_number() OVER (PARTITION BY block ORDER BY ordinal) AS place, label, CAST(hits AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS record,
  {_tenths('hits / n * 100', 'accuracy')}, {_tenths('(hits * CAST(0.41 AS DOUBLE) - (n - hits)) / n * 100', 'roi', "block = 'tier_rows'")},
  {_tenths('prob * 100', 'avg_prob', "block = 'confidence_rows'")}, {_tenths('home * 100', 'home_win_rate', "block = 'home_prob_rows'")}, CAST(NULL AS BIGINT) AS games FROM blocks
UNION ALL SELECT shown, place, name, NULL, {_tenths('accuracy', 'accuracy')}, {_tenths('roi', 'roi')}, NULL, NULL, {i8('n_games', 'games')}
  FROM best JOIN (VALUES ('filter_rows', 10), ('best_filter', 1)) AS part(shown, most) ON place <= most
UNION ALL SELECT 'overall', 1, CAST(since AS VARCHAR) || ' to ' || CAST(until AS VARCHAR), CAST(hits AS VARCHAR) || '/' || CAST(n AS VARCHAR) || '/' || CAST(waiting AS VARCHAR),
  {_tenths('hits / n * 100', 'accuracy')}, NULL, NULL, NULL, {i8('n', 'games')} FROM head"""


@query("stats_payload", _PAYLOAD_SQL)
def stats_payload(spark, sf_dir):
    schema = "struct<" + ",".join(
        [
            "has_data:boolean,overall:struct<total:bigint,pending:bigint,correct:bigint,accuracy:double,date_min:string,date_max:string>",
            *[f"{block}:array<struct<{_BLOCK_ROW}>>" for block in _BLOCKS],
            f"filter_rows:array<struct<{_FILTER_ROW}>>,best_filter:struct<{_FILTER_ROW}>",
        ]
    ) + ">"
    parsed = S.stats_payload(T.history(spark, sf_dir), NOW).select(F.from_json("payload", schema).alias("_p")).select("_p.*")
    none = lambda kind: F.lit(None).cast(kind)

    def row(block, place, label, record, accuracy, roi, avg_prob, home_win_rate, games):
        parts = {"label": label, "record": record, "accuracy": accuracy, "roi": roi, "avg_prob": avg_prob, "home_win_rate": home_win_rate, "games": games}
        return F.struct(F.lit(block).alias("block"), place.cast("long").alias("place"), *[part.alias(name) for name, part in parts.items()])

    def of_block(block):
        return F.transform(block, lambda r, i: row(block, i + 1, r["label"], r["record"], r["accuracy"], r["roi"], r["avg_prob"], r["home_win_rate"], none("long")))

    def of_filter(block, r, place):
        return row(block, place, r["name"], none("string"), r["accuracy"], r["roi"], none("double"), none("double"), r["games"])

    head = F.col("overall")
    counts = F.concat_ws("/", *[head[name].cast("string") for name in ("correct", "total", "pending")])
    days = F.concat(head["date_min"], F.lit(" to "), head["date_max"])
    single = [
        F.when(F.col("has_data"), row("overall", F.lit(1), days, counts, head["accuracy"], none("double"), none("double"), none("double"), head["total"])),
        F.when(F.col("best_filter").isNotNull(), of_filter("best_filter", F.col("best_filter"), F.lit(1))),
    ]
    rows = F.concat(
        F.array_compact(F.array(*single)), F.transform("filter_rows", lambda r, i: of_filter("filter_rows", r, i + 1)), *[of_block(b) for b in _BLOCKS]
    )
    return tidy(parsed.select(F.explode(rows).alias("_r")).select("_r.*"))


# --- row-wise predictions ---------------------------------------------------


@query("confidence", f"WITH {T.SCORED_SQL} SELECT {i8('game_id')}, {r6('abs(p1 - 0.5) * 2', 'confidence')} FROM scored")
def confidence(spark, sf_dir):
    return tidy(T.scored_contests(spark, sf_dir).select("game_id", P.confidence(F.col("p1")).alias("confidence")))


@query("confidence_tier", f"WITH {T.PREDICTIONS_SQL} SELECT {i8('game_id')}, {T.TIER_SQL} AS tier FROM predictions")
def confidence_tier(spark, sf_dir):
    return tidy(T.predictions(spark, sf_dir).select("game_id", P.confidence_tier(F.col("confidence")).alias("tier")))


@query("predict_label", f"WITH {T.SCORED_SQL} SELECT {i8('game_id')}, CASE WHEN p1 > 0.5 THEN 'HOME' ELSE 'AWAY' END AS side, CAST(CASE WHEN p1 > 0.6 THEN 1 ELSE 0 END AS BIGINT) AS strict_label FROM scored")
def predict_label(spark, sf_dir):
    p1 = F.col("p1")
    return tidy(T.scored_contests(spark, sf_dir).select("game_id", P.predicted_side(p1).alias("side"), P.predicted_label(p1, 0.6).alias("strict_label")))


@query("favorites", f"WITH {T.PREDICTIONS_SQL} SELECT {i8('game_id')}, {r6('home_win_prob')} FROM predictions WHERE home_win_prob >= 0.75 OR home_win_prob <= 0.25")
def favorites(spark, sf_dir):
    return tidy(T.predictions(spark, sf_dir).filter(P.strong_favorite(F.col("home_win_prob"))), "game_id", "home_win_prob")


@query("prediction_flags", f"WITH {T.PREDICTIONS_SQL} SELECT {i8('game_id')}, confidence >= 0.3 AS is_high_confidence, home_win_prob > 0.5 AS is_home_favorite FROM predictions")
def prediction_flags(spark, sf_dir):
    return tidy(
        T.predictions(spark, sf_dir).select(
            "game_id",
            (F.col("confidence") >= 0.3).alias("is_high_confidence"),
            (P.predicted_side(F.col("home_win_prob")) == "HOME").alias("is_home_favorite"),
        )
    )
