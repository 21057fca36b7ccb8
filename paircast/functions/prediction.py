"""Column functions on probabilities, confidences and prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from paircast.constants import FAVORITE_HIGH, FAVORITE_LOW, TIERS


def confidence(prob: Column) -> Column:
    """Distance from a coin toss, scaled to 0..1."""
    return F.abs(prob - 0.5) * 2


def confidence_tier(conf: Column) -> Column:
    edges = [(name, low) for name, low in TIERS if low is not None]
    floor = next(name for name, low in TIERS if low is None)
    chain = reduce(
        lambda acc, tier: acc.when(conf >= tier[1], tier[0]),
        edges[1:],
        F.when(conf >= edges[0][1], edges[0][0]),
    )
    return chain.otherwise(floor)


def predicted_side(prob: Column, threshold: float = 0.5) -> Column:
    """HOME only when strictly above the threshold."""
    return F.when(prob > threshold, "HOME").otherwise("AWAY")


def predicted_label(prob: Column, threshold: float = 0.5) -> Column:
    return F.when(prob > threshold, 1).otherwise(0)


def strong_favorite(prob: Column) -> Column:
    return (prob >= FAVORITE_HIGH) | (prob <= FAVORITE_LOW)


def american_to_decimal(price: Column) -> Column:
    """Decimal price of an American one; there is none for a price of 0."""
    return F.when(price > 0, price / 100 + 1).when(price < 0, 100 / F.abs(price) + 1)


def implied_probability(price: Column) -> Column:
    return F.when(price > 0, 1 / price)


def overround(home_price: Column, away_price: Column) -> Column:
    return 1 / home_price + 1 / away_price - 1


def bucket_of(value: Column, buckets) -> Column:
    """Label of the half-open bucket [low, high) that holds the value."""
    chain = None
    for low, high, label in buckets:
        test = F.lit(True)
        if low is not None:
            test = test & (value >= low)
        if high is not None:
            test = test & (value < high)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain


def array_mean(probs: Column) -> Column:
    return F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p) / F.size(probs)


def weighted_mean(probs: Column, weights: list[float] | None) -> Column:
    """Mean under normalised weights; weights of another length are ignored."""
    if not weights:
        return array_mean(probs)
    scale = float(sum(weights))
    shares = F.array(*[F.lit(w / scale) for w in weights])
    weighted = F.aggregate(F.zip_with(probs, shares, lambda p, s: p * s), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(probs) == len(weights), weighted).otherwise(array_mean(probs))


def array_spread(probs: Column) -> Column:
    """Population standard deviation over the models."""
    centre = array_mean(probs)
    squares = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p * p) / F.size(probs)
    return F.sqrt(F.greatest(squares - centre * centre, F.lit(0.0)))


def model_agreement(probs: Column) -> Column:
    return 1 - array_spread(probs)


def majority_vote(votes: Column) -> Column:
    return F.when(array_mean(votes) >= 0.5, 1).otherwise(0)


def record(correct: Column, total: Column) -> Column:
    """Display form c/n."""
    return F.concat_ws("/", correct.cast("string"), total.cast("string"))


def roi_percent(wins: Column, total: Column, profit: float) -> Column:
    """Return in percent of stakes when a win pays `profit` and a loss costs 1."""
    return (wins * profit - (total - wins)) / total * 100


def roi_minus110(wins: Column, total: Column) -> Column:
    """Return at American odds of -110: stake 110 to win 100."""
    return (100 * wins - 110 * (total - wins)) / (110 * total) * 100
