"""From the contest table to training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paircast.constants import NON_FEATURES, SERVING_DEFAULTS
from paircast.operators.sequence import with_sequence


def feature_columns(columns: list[str], exclude: tuple[str, ...] = ()) -> list[str]:
    """Feature names: everything that is neither a key nor the label."""
    return [c for c in columns if c not in NON_FEATURES and c not in exclude]


def validate_frame(df: DataFrame, required: tuple[str, ...] = ()) -> bool:
    """Raise unless the frame has rows, a label and the required columns."""
    if df is None or df.isEmpty():
        raise ValueError("frame is empty")
    if "home_win" not in df.columns:
        raise ValueError("frame lacks the label home_win")
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"frame lacks columns {missing}")
    return True


def chronological_split(contests: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Mark the newest ceil(test_size * n) contests as test rows.

    The rank comes from day chunks; only the table of days is ordered globally.
    """
    ordered = with_sequence(contests, [], "game_date", ["game_id"], "time_rank")
    total = contests.agg(F.count(F.lit(1)).alias("_n")).scalar()
    train = total - F.ceil(total * test_size)
    return ordered.withColumn("n_train", train).withColumn("is_test", F.col("time_rank") > F.col("n_train"))


def recency_weight(rank: Column, n: Column, decay: float = 1.2) -> Column:
    """exp of an even ramp from -decay for the oldest row to 0 for the newest."""
    return F.exp(F.when(n > 1, -decay + decay * (rank - 1) / F.when(n > 1, n - 1)).otherwise(-decay))


def with_recency_weights(split: DataFrame, decay: float = 1.2) -> DataFrame:
    """Weights of the training rows of a chronological split."""
    return split.filter("not is_test").withColumn(
        "sample_weight", recency_weight(F.col("time_rank"), F.col("n_train"), decay)
    )


def default_for(column: str) -> float:
    """Serving default of a column: the first key its name contains, else 0."""
    return next((value for key, value in SERVING_DEFAULTS if key in column.lower()), 0.0)


def feature_vector(rows: DataFrame, features: list[str], name: str = "feature_array") -> DataFrame:
    """Ordered feature array: a missing value is 0, an absent column its default."""
    values = [
        F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in rows.columns else F.lit(default_for(c))
        for c in features
    ]
    return rows.withColumn(name, F.array(*values))


def differentials(rows: DataFrame) -> DataFrame:
    """diff_x = home_x - away_x for every pair of matching columns."""
    names = [c[5:] for c in rows.columns if c.startswith("home_") and f"away_{c[5:]}" in rows.columns]
    return rows.withColumns({f"diff_{n}": F.col(f"home_{n}") - F.col(f"away_{n}") for n in names})


def top_features(importances: DataFrame, n: int = 40) -> DataFrame:
    return importances.orderBy(F.desc("importance"), F.desc("feature_index")).limit(n)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, as a partial aggregate over one struct."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, "_row.*").select(*df.columns)


def feature_profile(rows: DataFrame, label: str, feature: str) -> DataFrame:
    """Rows and range of a feature by label; a feature that tells the label apart shows up at once."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(feature).alias("low"), F.max(feature).alias("high"))
