"""Ordered helpers: the split form must equal the plain one, hot keys included."""

import statistics

import pytest
from pyspark.sql import Window, functions as F

from paircast.operators import form, sequence
from paircast.operators.sequence import exact_median, own_rows, with_halo_blocks, with_running_counts, with_sequence


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds most rows and one day holds a third of them."""
    return spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).alias("key"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 17).alias("day"),
        F.col("id").alias("game"),
        ((F.col("id") * 7919) % 101).alias("value"),
    )


@pytest.mark.parametrize("slices", [1, 4])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_sequence_equals_row_number(skewed, keys, slices):
    split = with_sequence(skewed, keys, "day", ["game"], slices=slices)
    plain = Window.partitionBy(*keys or [F.lit(0)]).orderBy("day", "game")
    assert split.count() == 3000
    assert split.withColumn("plain", F.row_number().over(plain)).filter("seq <> plain").count() == 0


@pytest.mark.parametrize("slices", [1, 4])
def test_running_count_equals_window_sum(skewed, slices):
    split = with_running_counts(skewed, ["key"], "day", ["game"], {"hits": F.col("value") > 50}, slices=slices)
    plain = Window.partitionBy("key").orderBy("day", "game").rowsBetween(Window.unboundedPreceding, 0)
    wrong = split.withColumn("plain", F.sum((F.col("value") > 50).cast("int")).over(plain)).filter("hits <> plain")
    assert wrong.count() == 0


def test_halo_blocks_complete_every_frame(skewed):
    rows = with_halo_blocks(with_sequence(skewed, ["key"], "day", ["game"]), halo=20, rows=64)
    block = Window.partitionBy("key", "_block").orderBy("seq").rowsBetween(-20, -1)
    whole = Window.partitionBy("key").orderBy("seq").rowsBetween(-20, -1)
    split = own_rows(rows.withColumn("split", F.sum("value").over(block)))
    assert split.count() == 3000
    compared = split.withColumn("plain", F.sum("value").over(whole))
    assert compared.filter("not (split <=> plain)").count() == 0


def test_halo_must_fit(skewed):
    with pytest.raises(ValueError):
        with_halo_blocks(skewed, halo=64, rows=64)


def test_form_does_not_depend_on_the_block_size(log, monkeypatch):
    from paircast.operators.games import advanced_metrics, four_factors

    rich = advanced_metrics(four_factors(log))
    wide = form.form_features(rich, stats=("pts", "efg_pct"))
    monkeypatch.setattr(form, "with_halo_blocks", lambda df, halo: with_halo_blocks(df, halo, rows=264))  # as short as the carry allows
    narrow = form.form_features(rich, stats=("pts", "efg_pct"))
    made = [c for c in wide.columns if c not in log.columns]
    rounded = lambda df: df.select("game_id", "team_id", *[F.round(F.col(c).cast("double"), 7).alias(c) for c in made])
    assert rounded(wide).exceptAll(rounded(narrow)).count() == 0


@pytest.mark.parametrize("kind", ["text", "number", "pair"])
def test_one_day_with_all_rows_is_split_evenly(spark, kind):
    """Ids of any type, 32 slices: no (key, day, slice) may hold 5 % of the rows."""
    order = ["code", "id"] if kind == "pair" else ["id"]
    made = {"text": F.concat(F.lit("g-"), F.hex("n")), "number": F.col("n") * F.col("n"), "pair": F.col("n")}[kind]
    rows = spark.range(20_000).withColumnRenamed("id", "n")
    rows = rows.select(F.lit(1).alias("key"), F.when(F.col("n") < 19_900, 7).alias("day"), F.lit("x").alias("code"), made.alias("id"))
    parts, chunks = sequence._sliced(rows, "day", order, 32)
    assert parts.groupBy("key", *chunks).count().agg(F.max("count")).first()[0] < 1000
    split = with_sequence(rows.filter("day is not null"), ["key"], "day", order, slices=32)
    plain = Window.partitionBy("key").orderBy("day", *order)
    assert split.withColumn("plain", F.row_number().over(plain)).filter("seq <> plain").count() == 0
    assert split.count() == 19_900


def test_slices_follow_the_partitions(spark):
    rows = spark.range(10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, want in ((8, 1), (64, 32), (5000, sequence.MOST_SLICES)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert sequence._slice_count(rows) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(
    "values",
    [
        [1.0], [1.0, 2.0], [3.0, 1.0, 2.0, 2.0], [0.5] * 9 + [0.1, 0.9], [0.5 + i * 2.0**-53 for i in range(0, 40, 2)],
        [-1e300, 1e300, -3.0, 0.0, 1e-310, 7.0], [0.25, 0.0, -0.0, -0.25], [float("inf"), 1.0, 2.0],
    ],
)
def test_exact_median(spark, values):
    rows = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "p double")
    assert exact_median(rows, "p").first()[0] == statistics.median(values)


def test_median_of_nothing(spark):
    assert exact_median(spark.createDataFrame([(None,)], "p double"), "p").first()[0] is None


def _series(spark, values, **options):
    """Form columns of one team whose points are the given values, in order."""
    from paircast.operators.form import form_features

    rows = [(1, i, "T01 vs. T02", "W", None if v is None else float(v)) for i, v in enumerate(values)]
    log = spark.createDataFrame(rows, "team_id long, game_id long, matchup string, wl string, pts double")
    log = log.withColumn("game_date", F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("game_id") / 7).cast("int")))
    out = form_features(log, stats=("pts",), momentum=False, **options).orderBy("game_id")
    return out.toPandas()


def test_form_against_pandas_over_block_edges(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    values = list(rng.normal(100, 10, 2600))
    values[1700:2300] = [None] * 600  # nothing for a while, over a block edge
    values[10] = float("nan")
    values[2400:] = [0.456] * 200  # a level that stays
    got = _series(spark, values)
    past = pd.Series([np.nan if v is None else v for v in values]).shift(1)
    for name, want in (("pts_ewm", past.ewm(span=10, min_periods=5).mean()), ("pts_roll_mean", past.rolling(20, min_periods=5).mean())):
        assert np.allclose(got[name], want, rtol=1e-9, equal_nan=True), name
    assert (got["pts_roll_std"][2430:] == 0).all()
    direct = [past[i - 19 : i + 1].std() if past[i - 19 : i + 1].count() >= 5 else np.nan for i in range(19, 2600)]
    assert np.allclose(got["pts_roll_std"][19:], direct, rtol=1e-6, atol=1e-9, equal_nan=True)


def test_long_windows(spark):
    import numpy as np
    import pandas as pd

    values = list(np.random.default_rng(4).normal(0, 1, 7000))
    got = _series(spark, values, window=2100)
    past = pd.Series(values).shift(1)
    assert np.allclose(got["pts_roll_mean"], past.rolling(2100, min_periods=5).mean(), atol=1e-9, equal_nan=True)
    assert np.allclose(got["pts_ewm"], past.ewm(span=10, min_periods=5).mean(), atol=1e-9, equal_nan=True)


def test_rolling_values_are_those_of_window_expressions(spark):
    rows = [
        (i, f"1997-01-{1 + i % 28:02d}", "ab"[i % 2], None if i % 11 == 0 else i % 40, float("nan") if i % 7 == 0 else 1e15 if i < 9 else 0.1 * (i % 13))
        for i in range(300)
    ]
    log = spark.createDataFrame(rows, "game_id int, day string, team_id string, pts int, pace double").withColumn("game_date", F.to_date("day")).drop("day")
    features = form.form_features(log, stats=("pts", "pace"), window=6, ewm=False, momentum=False)
    order = Window.partitionBy("team_id").orderBy("game_date", "game_id")
    expected = log.withColumns(form._rolling_columns(log, order, ("pts", "pace"), 6)).select(features.columns)
    assert sorted(map(str, features.collect())) == sorted(map(str, expected.collect()))
    assert "stddev_samp" not in features._jdf.queryExecution().executedPlan().toString()
