"""Breakdowns of a completed prediction history.

Each breakdown is one scan with a map-side partial aggregate over a handful
of groups; overlapping groups (periods, filters) are expanded only after the
rows are folded to days or cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paircast.constants import (
    AGREEMENT_BUCKETS,
    AGREEMENT_BUCKETS_COARSE,
    BREAK_EVEN_ACCURACY,
    CONFIDENCE_BUCKETS,
    CONFIDENCE_BUCKETS_COARSE,
    HOME_PROB_BUCKETS,
    MIN_FILTER_GAMES,
    TIERS,
    TRAILING_PERIODS,
    WEEKDAYS,
    WIN_PROFIT,
)
from paircast.functions.prediction import (
    bucket_of,
    confidence_tier,
    record,
    roi_minus110,
    roi_percent,
    strong_favorite,
)
from paircast.operators.history import as_flag, completed, is_completed, with_numbers
from paircast.operators.sequence import with_running_counts, with_sequence


def _n() -> Column:
    return F.count(F.lit(1))


def _hits() -> Column:
    return F.sum("correct")


def _accuracy() -> Column:
    return _hits() / _n() * 100


def overall(history: DataFrame) -> DataFrame:
    done = is_completed()
    hits = F.sum(F.when(done, F.expr("try_cast(correct as int)")))
    total = F.count_if(done)
    return history.agg(
        total.alias("total"),
        hits.alias("correct"),
        F.count_if(~done).alias("pending"),
        (hits / F.when(total > 0, total) * 100).alias("accuracy"),
        F.min(F.when(done, F.col("date"))).alias("date_min"),
        F.max(F.when(done, F.col("date"))).alias("date_max"),
    )


def _rank_of(label: Column, labels) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in labels]), label)


def _by_label(rows: DataFrame, label: Column, labels, *extra: Column) -> DataFrame:
    return (
        rows.withColumn("label", label)
        .filter("label is not null")
        .groupBy("label")
        .agg(_n().alias("total"), _hits().alias("correct"), _accuracy().alias("accuracy"), *extra)
        .withColumn("ordinal", _rank_of(F.col("label"), labels))
        .withColumn("record", record(F.col("correct"), F.col("total")))
    )


def by_tier(history: DataFrame) -> DataFrame:
    names = [name for name, _ in TIERS]
    rows = completed(history).filter(F.col("tier").isin(names))
    return _by_label(rows, F.col("tier"), names, roi_percent(_hits(), _n(), WIN_PROFIT).alias("roi"))


def _bucketed(history: DataFrame, column: str, buckets, *extra: Column) -> DataFrame:
    return _by_label(completed(history), bucket_of(F.col(column), buckets), [b[2] for b in buckets], *extra)


def by_confidence(history: DataFrame) -> DataFrame:
    return _bucketed(history, "confidence", CONFIDENCE_BUCKETS, (F.avg("home_win_prob") * 100).alias("avg_prob"))


def by_confidence_coarse(history: DataFrame) -> DataFrame:
    return _bucketed(history, "confidence", CONFIDENCE_BUCKETS_COARSE)


def by_agreement(history: DataFrame) -> DataFrame:
    return _bucketed(history, "model_agreement", AGREEMENT_BUCKETS)


def by_agreement_coarse(history: DataFrame) -> DataFrame:
    return _bucketed(history, "model_agreement", AGREEMENT_BUCKETS_COARSE)


def _home_won() -> Column:
    return F.coalesce(F.col("winner") == F.col("home_team"), F.lit(False)).cast("int")


def by_home_prob(history: DataFrame) -> DataFrame:
    return _bucketed(history, "home_win_prob", HOME_PROB_BUCKETS, (F.avg(_home_won()) * 100).alias("home_win_rate"))


def by_trailing(history: DataFrame, now: str) -> DataFrame:
    """Last 3, 7, 14 and 30 days before `now`; periods overlap, so days are expanded."""
    days = completed(history).groupBy("date").agg(_n().alias("n"), _hits().alias("hits"))
    instant = F.lit(now).cast("timestamp_ntz")
    member = lambda span: F.col("date").cast("timestamp_ntz") >= instant - F.make_dt_interval(F.lit(span))
    periods = F.array_compact(F.array(*[F.when(member(span), F.lit(label)) for span, label in TRAILING_PERIODS]))
    return (
        days.withColumn("label", F.explode(periods))
        .groupBy("label")
        .agg(F.sum("n").alias("total"), F.sum("hits").alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("total") * 100)
        .withColumn("ordinal", _rank_of(F.col("label"), [label for _, label in TRAILING_PERIODS]))
        .withColumn("record", record(F.col("correct"), F.col("total")))
    )


def weekday_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(day) + 1)


def by_weekday(history: DataFrame) -> DataFrame:
    return _by_label(completed(history), weekday_name(F.col("date")), WEEKDAYS)


def filter_candidates() -> list[tuple[str, str, float, bool]]:
    """The 32 candidate filters as (name, tier rule, minimum agreement, favourites only)."""
    label = lambda level: f"{level * 100:.0f}%+ agree"
    tiers = [(f"{t} + {label(a)}", t, a, False) for t, _ in TIERS for a in (0.90, 0.92, 0.95, 0.98)]
    favorites = [("75%+ favorites", "FAV", 0.0, True)]
    favorites += [(f"75%+ fav + {label(a)}", "FAV", a, True) for a in (0.92, 0.95, 0.98)]
    return tiers + favorites + [(f"All tiers + {label(a)}", "ALL", a, False) for a in (0.90, 0.92, 0.95, 0.98)]


def matching_filters(tier: Column, prob: Column, agreement: Column) -> Column:
    """Names of the candidate filters that a prediction satisfies."""
    tests = []
    for name, rule, level, only_favorites in filter_candidates():
        test = F.lit(True)
        if rule not in ("ALL", "FAV"):
            test = test & (tier == rule)
        if only_favorites:
            test = test & strong_favorite(prob)
        if level > 0:
            test = test & (agreement >= level)
        tests.append(F.when(test, F.lit(name)))
    return F.array_compact(F.array(*tests))


def candidate_stats(history: DataFrame) -> DataFrame:
    """Counts per candidate filter.

    Rows are folded to cells (tier, favourite, agreement level) first: at most
    a few dozen rows reach the expansion into overlapping filters.
    """
    levels = [(0.98, None, "0.98"), (0.95, 0.98, "0.95"), (0.92, 0.95, "0.92"), (0.90, 0.92, "0.90"), (None, 0.90, "0")]
    cells = (
        completed(history)
        .groupBy(
            "tier",
            F.coalesce(strong_favorite(F.col("home_win_prob")), F.lit(False)).alias("_favorite"),
            bucket_of(F.col("model_agreement"), levels).cast("double").alias("_level"),
        )
        .agg(_n().alias("_n"), _hits().alias("_hits"))
    )
    as_prob = F.when(F.col("_favorite"), 1.0).otherwise(0.5)
    return (
        cells.withColumn("name", F.explode(matching_filters(F.col("tier"), as_prob, F.col("_level"))))
        .groupBy("name")
        .agg(F.sum("_n").alias("n_games"), F.sum("_hits").alias("hits"))
        .withColumn("accuracy", F.col("hits") / F.col("n_games") * 100)
    )


def profitable_filters(
    history: DataFrame, min_games: int = MIN_FILTER_GAMES, min_accuracy: float = BREAK_EVEN_ACCURACY
) -> DataFrame:
    names = [name for name, *_ in filter_candidates()]
    rules = F.create_map(
        *[
            x
            for name, rule, level, fav in filter_candidates()
            for x in (F.lit(name), F.struct(F.lit(rule).alias("tier"), F.lit(level).alias("min_agree"), F.lit(fav).alias("is_fav")))
        ]
    )
    return (
        candidate_stats(history)
        .filter((F.col("n_games") >= min_games) & (F.col("accuracy") > min_accuracy))
        .withColumn("roi", roi_percent(F.col("hits"), F.col("n_games"), WIN_PROFIT))
        .withColumn("_rule", rules[F.col("name")])
        .select("name", "n_games", "accuracy", "_rule.*", "roi", _rank_of(F.col("name"), names).alias("ordinal"))
    )


def top_filters(filters: DataFrame, n: int = 10) -> DataFrame:
    return filters.orderBy(F.desc("accuracy"), "ordinal").limit(n)


def filter_matches(predictions: DataFrame, filters: DataFrame, key: list[str]) -> DataFrame:
    """Active filters of each prediction, best first.

    The test against the 32 candidates runs inside the row; only names that
    match are joined, against a table of at most 32 rows.
    """
    tier = confidence_tier(F.col("confidence"))
    named = predictions.withColumn(
        "name", F.explode(matching_filters(tier, F.col("home_win_prob"), F.col("model_agreement")))
    )
    active = filters.select("name", "accuracy", "n_games", "roi", "ordinal")
    ranked = Window.partitionBy(*key).orderBy(F.desc("accuracy"), "ordinal")
    return named.join(F.broadcast(active), "name").withColumn("filter_rank", F.row_number().over(ranked))


def recommended(tier_picks: DataFrame, filter_picks: DataFrame, key: list[str]) -> DataFrame:
    """Contests picked by tier or by filter, each once."""
    return tier_picks.select(*key).union(filter_picks.select(*key)).distinct()


def tier_returns_minus110(history: DataFrame) -> DataFrame:
    return (
        completed(history)
        .groupBy("tier")
        .agg(F.avg("correct").alias("accuracy"), _n().alias("total"), _hits().alias("_hits"))
        .withColumn("roi", roi_minus110(F.col("_hits"), F.col("total")))
        .drop("_hits")
    )


def current_streak(history: DataFrame, order: list[str]) -> DataFrame:
    """Result and length of the newest run, from two maxima over the sequence."""
    rows = with_sequence(completed(history), [], "date", order)
    last = lambda value: F.coalesce(F.max(F.when(F.col("correct") == value, F.col("seq"))), F.lit(0))
    gap = rows.agg(last(1).alias("_hit"), last(0).alias("_miss"))
    return gap.select(
        F.when(F.col("_hit") > F.col("_miss"), "W").otherwise("L").alias("streak_type"),
        F.abs(F.col("_hit") - F.col("_miss")).alias("length"),
    )


def longest_streaks(history: DataFrame, order: list[str]) -> DataFrame:
    """Longest runs of hits and of misses.

    Rows of a run share the number of opposite results before them, so a run
    is one group of a partially aggregated count, however long it is.
    """
    rows = completed(history).select("date", *order, "correct")
    tests = {"_hits": F.col("correct") == 1, "_misses": F.col("correct") == 0}
    counted = with_running_counts(rows, [], "date", order, tests)
    opposite = F.when(F.col("correct") == 1, F.col("_misses")).otherwise(F.col("_hits"))
    runs = counted.groupBy("correct", opposite.alias("_run")).agg(_n().alias("length"))
    longest = lambda value: F.coalesce(F.max(F.when(F.col("correct") == value, F.col("length"))), F.lit(0))
    return runs.agg(longest(1).alias("best_win"), longest(0).alias("worst_loss"))


def stats_payload(history: DataFrame, now: str) -> DataFrame:
    """All breakdowns as one JSON record from a single scan of the history.

    Each row joins the group of the whole history and, when it is completed,
    one group for its entry in every block, period and filter; partial
    aggregation folds them to less than a hundred groups before the shuffle,
    and the record is put together from those.
    """
    instant = F.lit(now).cast("timestamp_ntz")
    member = lambda span: F.col("date").cast("timestamp_ntz") >= instant - F.make_dt_interval(F.lit(span))
    blocks = {
        "tier_rows": ([t for t, _ in TIERS], [F.col("tier")]),
        "confidence_rows": ([b[2] for b in CONFIDENCE_BUCKETS], [bucket_of(F.col("confidence"), CONFIDENCE_BUCKETS)]),
        "agreement_rows": ([b[2] for b in AGREEMENT_BUCKETS], [bucket_of(F.col("model_agreement"), AGREEMENT_BUCKETS)]),
        "home_prob_rows": ([b[2] for b in HOME_PROB_BUCKETS], [bucket_of(F.col("home_win_prob"), HOME_PROB_BUCKETS)]),
        "time_rows": ([p[1] for p in TRAILING_PERIODS], [F.when(member(d), F.lit(label)) for d, label in TRAILING_PERIODS]),
        "day_rows": (list(WEEKDAYS), [weekday_name(F.col("date"))]),
    }
    names = [name for name, *_ in filter_candidates()]
    group = lambda block, label: F.struct(F.lit(block).alias("block"), label.alias("label"))
    entries = [
        F.when(label.isin(labels), group(block, label)) for block, (labels, labels_of_row) in blocks.items() for label in labels_of_row
    ]
    fitting = matching_filters(F.col("tier"), F.col("home_win_prob"), F.col("model_agreement"))
    own = F.concat(
        F.array(group("overall", F.lit("all"))),
        F.array_compact(F.array(*entries)),
        F.transform(fitting, lambda name: group("filter_rows", name)),
    )
    of_done = lambda value: F.when(F.col("_done"), value)
    groups = (
        with_numbers(history)
        .withColumns({"_done": is_completed(), "_flag": as_flag(), "_home_won": _home_won()})
        .withColumn("_g", F.explode(F.filter(own, lambda g: F.col("_done") | (g["block"] == "overall"))))
        .groupBy("_g")
        .agg(
            F.count_if("_done").alias("n"),
            F.count_if(~F.col("_done")).alias("waiting"),
            F.sum(of_done(F.col("_flag"))).alias("hits"),
            F.avg(of_done(F.col("home_win_prob"))).alias("prob"),
            F.avg(of_done(F.col("_home_won"))).alias("home"),
            F.min(of_done(F.col("date"))).alias("since"),
            F.max(of_done(F.col("date"))).alias("until"),
        )
        .select("_g.*", "n", "waiting", "hits", "prob", "home", "since", "until", (F.col("hits") / F.when(F.col("n") > 0, F.col("n")) * 100).alias("rate"))
    )
    tenths = lambda value: F.bround(value, 1)
    common = [F.col("label"), record(F.col("hits"), F.col("n")).alias("record"), tenths(F.col("rate")).alias("accuracy")]
    roi = tenths(roi_percent(F.col("hits"), F.when(F.col("n") > 0, F.col("n")), WIN_PROFIT)).alias("roi")
    extra = {
        "tier_rows": [roi],
        "confidence_rows": [tenths(F.col("prob") * 100).alias("avg_prob")],
        "home_prob_rows": [tenths(F.col("home") * 100).alias("home_win_rate")],
    }

    def listed(test: Column, order: list[Column], row: list[Column]) -> Column:
        entry = F.struct(*[part.alias(f"_{i}") for i, part in enumerate(order)], F.struct(*row).alias("row"))
        return F.transform(F.array_sort(F.collect_list(F.when(test, entry))), lambda e: e["row"])

    of_block = lambda block: F.col("block") == block
    lists = [
        listed(of_block(block), [_rank_of(F.col("label"), labels)], [*common, *extra.get(block, [])]).alias(block)
        for block, (labels, _) in blocks.items()
    ]
    worth = of_block("filter_rows") & (F.col("n") >= MIN_FILTER_GAMES) & (F.col("rate") > BREAK_EVEN_ACCURACY)
    best = [F.col("label").alias("name"), F.col("n").alias("games"), tenths(F.col("rate")).alias("accuracy"), roi]
    filters = listed(worth, [-F.col("rate"), _rank_of(F.col("label"), names)], best)
    whole = lambda value: F.max(F.when(of_block("overall"), value))
    head = F.struct(
        F.coalesce(whole(F.col("n")), F.lit(0)).alias("total"),
        F.coalesce(whole(F.col("waiting")), F.lit(0)).alias("pending"),
        whole(F.col("hits")).alias("correct"),
        tenths(whole(F.col("rate"))).alias("accuracy"),
        whole(F.col("since")).cast("string").alias("date_min"),
        whole(F.col("until")).cast("string").alias("date_max"),
    )
    record_of = groups.agg(head.alias("overall"), *lists, F.slice(filters, 1, 10).alias("filter_rows"))
    has_data = (F.col("overall.total") > 0).alias("has_data")
    return record_of.select(
        F.to_json(F.struct(has_data, "overall", *blocks, "filter_rows", F.get("filter_rows", F.lit(0)).alias("best_filter"))).alias("payload")
    )
