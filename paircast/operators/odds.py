"""Price quotes: flattening, keys, exact merge and fuzzy match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paircast.constants import ARTICLES, ODDS_COLUMNS
from paircast.functions.prediction import implied_probability


def odds_features(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Average, best, worst, spread and implied probability per contest and side.

    The nested arrays of a row are reduced in place by array functions: no row
    is exploded and nothing is shuffled. `bookmaker_count` counts every
    bookmaker, also those that only quote other markets.
    """
    outcomes = F.flatten(
        F.flatten(
            F.transform(
                F.coalesce("bookmakers", F.array()),
                lambda book: F.transform(
                    F.filter(F.coalesce(book["markets"], F.array()), lambda market: market["key"] == "h2h"),
                    lambda market: F.coalesce(market["outcomes"], F.array()),
                ),
            )
        )
    )
    out = quotes.withColumn("_outcomes", outcomes)
    columns = {}
    for side in ("home", "away"):
        team = F.col(f"{side}_team")
        name_fits = lambda o, team=team, side=side: (
            (o["name"] == team) if side == "home" else (o["name"] == team) & (o["name"] != F.col("home_team"))
        )
        prices = F.transform(
            F.filter("_outcomes", lambda o: (o["price"] > 0) & name_fits(o)), lambda o: o["price"]
        )
        columns[f"_{side}_prices"] = prices
    out = out.withColumns(columns)
    result = {}
    for side in ("home", "away"):
        prices = F.col(f"_{side}_prices")
        quoted = F.size(prices) > 0
        mean = F.when(quoted, F.aggregate(prices, F.lit(0.0), lambda acc, p: acc + p) / F.when(quoted, F.size(prices)))
        best, worst = F.array_max(prices), F.array_min(prices)
        result[f"{side}_avg_odds"] = mean
        result[f"{side}_best_odds"] = best
        result[f"{side}_worst_odds"] = worst
        result[f"{side}_odds_spread"] = best - worst
        result[f"{side}_implied_prob"] = implied_probability(mean)
    result["bookmaker_count"] = F.coalesce(F.size("bookmakers"), F.lit(0)).cast("long")
    return out.withColumns(result).select(*keys, *ODDS_COLUMNS)


def odds_keyed(features: DataFrame, day: str = "game_date", ordinal: str = "ordinal") -> DataFrame:
    """One row per day and lower-case home_vs_away key; the last quote wins."""
    key = F.concat(F.lower("home_team"), F.lit("_vs_"), F.lower("away_team"))
    keyed = features.withColumn("game_key", key)
    newest = F.max_by(F.struct(*[c for c in features.columns if c != day]), F.col(ordinal))
    return keyed.groupBy(day, "game_key").agg(newest.alias("_row")).select(day, "game_key", "_row.*")


def _norm(column: str) -> Column:
    return F.lower(F.trim(column))


def merge_odds(games: DataFrame, odds: DataFrame) -> DataFrame:
    """Prices per contest by date and normalised names; a matched price wins.

    Quotes are made unique per key first, so a repeated quote cannot multiply
    contests.
    """
    keys = {"_day": F.to_date("game_date"), "_home": _norm("home_team"), "_away": _norm("away_team")}
    present = [c for c in ODDS_COLUMNS if c in odds.columns]
    packed = odds.withColumns(keys).groupBy(*keys).agg(
        F.min_by(F.struct(*present), F.struct("game_date", *present)).alias("_odds")
    )
    joined = games.withColumns(keys).join(packed, list(keys), "left")
    merged = {
        c: F.coalesce(F.col(f"_odds.{c}"), F.col(c)) if c in games.columns else F.col(f"_odds.{c}") for c in present
    }
    return joined.withColumns(merged).drop(*keys, "_odds")


def match_rate(merged: DataFrame) -> DataFrame:
    matched = F.count("home_avg_odds")
    return merged.agg(
        matched.alias("matched"),
        F.count(F.lit(1)).alias("total"),
        (100 * F.avg(F.col("home_avg_odds").isNotNull().cast("int"))).alias("match_rate"),
    )


def _words(name: Column) -> Column:
    words = F.filter(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: w != "")
    return F.array_distinct(F.array_except(words, F.array(*[F.lit(a) for a in ARTICLES])))


def fuzzy_match(games: DataFrame, odds: DataFrame, game_key: str = "game_id") -> DataFrame:
    """Quote per contest of a day: the exact key, else the first sharing words.

    Both sides must share a word. Word pairs become join keys, and the quotes
    keep only their first row per day and word pair before the join, so a word
    that many names share cannot multiply rows.
    """
    named = F.split("game_key", "_vs_")
    usable = odds.select("game_date", "game_key", "ordinal", named.alias("_names")).filter(F.size("_names") == 2)
    tokens = (
        usable.withColumn("_home_word", F.explode(_words(F.col("_names")[0])))
        .withColumn("_away_word", F.explode(_words(F.col("_names")[1])))
        .groupBy("game_date", "_home_word", "_away_word")
        .agg(F.min(F.struct("ordinal", "game_key")).alias("_first"))
    )
    partial = (
        games.select(game_key, "game_date", "home_team", "away_team")
        .withColumn("_home_word", F.explode(_words(F.col("home_team"))))
        .withColumn("_away_word", F.explode(_words(F.col("away_team"))))
        .join(tokens, ["game_date", "_home_word", "_away_word"])
        .groupBy(game_key)
        .agg(F.min("_first").alias("_partial"))
    )
    exact = odds.groupBy("game_date", "game_key").agg(F.lit(True).alias("_exact"))
    own_key = F.concat(F.lower("home_team"), F.lit("_vs_"), F.lower("away_team"))
    return (
        games.withColumn("game_key", own_key)
        .join(exact, ["game_date", "game_key"], "left")
        .join(partial, game_key, "left")
        .withColumn("matched_key", F.when(F.col("_exact"), F.col("game_key")).otherwise(F.col("_partial.game_key")))
        .withColumn(
            "match_kind",
            F.when(F.col("_exact"), "exact").when(F.col("_partial").isNotNull(), "partial").otherwise("none"),
        )
        .drop("_exact", "_partial", "game_key")
    )


def name_contains_word(search: str, name: Column) -> Column:
    """Whether any word of the search, articles aside, occurs in the name."""
    words = [w for w in search.lower().split() if w not in ARTICLES]
    test = F.lit(False)
    for word in words:
        test = test | F.lower(name).contains(word)
    return test


def first_named(df: DataFrame, name: str, search: str, order: list) -> DataFrame:
    """The first row whose name contains the search text."""
    return df.filter(F.lower(F.col(name)).contains(search.lower())).orderBy(*order).limit(1)


#: Longest substring in the name index, postings intersected for a word, and parts of a frequent posting list.
GRAM, RAREST, SALTS = 3, 3, 16


def _grams(text: Column, size: Column) -> Column:
    """The distinct substrings of a size; of no characters, the empty one."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: text.substr(i, size))))


def _texts(names: DataFrame, key: str, name: str) -> DataFrame:
    return names.select(F.col(key).alias("_id"), F.lower(name).alias("_name")).filter("_name is not null and _id is not null")


def _holding(words: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Pairs of distinct lower-case words (`word`) and the names that contain them (`_name`), with the name's smallest key (`_id`).

    Rows of one name are searched once. No join here is broadcast: planned by
    the size of compressed files, names and postings would pass through the
    driver. Names are indexed by their substrings of up to GRAM characters. A word asks
    for those of its own that the fewest names hold; names in all of these
    postings are compared with the word. A posting list is split in SALTS
    parts, so that a substring of a third of all names is no single task.
    """
    word, text = F.col("word"), F.col("_name")
    texts = _texts(names, key, name).groupBy("_name").agg(F.min("_id").alias("_id"))
    asked = words.distinct().withColumn("_gram", F.explode(_grams(word, F.least(F.length(word), F.lit(GRAM)))))
    held = F.array_compact(F.array(*[_grams(text, F.lit(size)) for size in range(GRAM + 1)]))
    postings = texts.select("_id", F.explode(F.flatten(held)).alias("_gram")).join(asked.select("_gram").distinct().hint("merge"), "_gram", "left_semi")
    sizes = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_held"))
    by_size = Window.partitionBy("word").orderBy(F.coalesce("_held", F.lit(0)), "_gram")
    chosen = (
        asked.join(sizes.hint("merge"), "_gram", "left")
        .withColumn("_place", F.row_number().over(by_size))
        .filter(F.col("_place") <= RAREST)
        .withColumn("_needed", F.count(F.lit(1)).over(Window.partitionBy("word")))
    )
    candidates = (
        chosen.select("word", "_gram", "_needed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_part"))
        .join(postings.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(SALTS).cast("long"))).hint("merge"), ["_gram", "_part"])
        .groupBy("word", "_id")
        .agg(F.count(F.lit(1)).alias("_met"), F.first("_needed").alias("_needed"))
        .filter("_met >= _needed")
    )
    return candidates.join(texts.hint("merge"), "_id").filter(F.contains(text, word)).select("word", "_name", "_id")


def names_containing(searches: DataFrame, search: str, names: DataFrame, key: str, name: str) -> DataFrame:
    """For every text of a search column, the keys of the names that hold any of its words, articles aside.

    One row per distinct text and key. A null text or name matches nothing, nor
    does a text of articles only.
    """
    asked = searches.select(search).distinct().withColumn("word", F.explode(_words(F.col(search))))
    held = asked.join(_holding(asked.select("word"), names, key, name).hint("merge"), "word").select(search, "_name").distinct()
    return held.join(_texts(names, key, name).hint("merge"), "_name").select(search, F.col("_id").alias(key)).distinct()


def first_names_containing(searches: DataFrame, search: str, names: DataFrame, key: str, name: str) -> DataFrame:
    """For every text of a search column, the smallest key whose name contains the whole text.

    Texts that no name contains have no row, nor has a null; every name
    contains the empty text.
    """
    asked = searches.select(search).filter(F.col(search).isNotNull()).distinct().withColumn("word", F.lower(search))
    first = _holding(asked.select("word"), names, key, name).groupBy("word").agg(F.min("_id").alias(key))
    return asked.join(first.hint("merge"), "word").drop("word")


def value_edge(priced: DataFrame, prob: str = "home_win_prob") -> DataFrame:
    """Model minus market, in percentage points, where it is worth showing."""
    edge = F.col(prob) * 100 - F.col("home_implied_prob") * 100
    return (
        priced.filter((F.col("home_avg_odds") > 1) & (F.col("away_avg_odds") > 1))
        .withColumn("value_diff", edge)
        .filter(F.abs("value_diff") > 0.1)
    )


def dates_to_fetch(games: DataFrame, cached: DataFrame) -> DataFrame:
    """Days of contests without cached prices."""
    wanted = games.select(F.to_date("game_date").alias("game_date")).distinct()
    return wanted.join(cached.select(F.to_date("game_date").alias("game_date")).distinct(), "game_date", "left_anti")
