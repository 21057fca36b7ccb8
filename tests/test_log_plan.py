"""The derived log is cheap to make and made once."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from paircast.operators.sequence import with_sequence
from paircast.workload import tables as T

#: Bytes of a method up to which the JVM compiles it.
COMPILED = 8000


@pytest.fixture(scope="module")
def rows_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rows")
    day = dt.datetime(1997, 11, 1)
    orders = [(k, k % 7, day + dt.timedelta(days=k % 5)) for k in range(1, 21)]
    lines = [
        (k, 10 * k + n, n, n, 5.0 + n, 0.01 * n, 0.02 * n, status)
        for k in range(1, 21)
        for n, status in enumerate("OF" if k % 4 else "O", 1)
    ]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{path}/orders.parquet")
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_linestatus string"
    spark.createDataFrame(lines, schema).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_log_is_compiled_and_whole(spark, rows_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = T.game_log(spark, rows_dir)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    assert sizes and max(sizes) <= COMPILED

    log = T.game_log(spark, rows_dir)
    assert log.count() == 35  # every fourth order has one side
    assert log.filter("wl is null").count() == 5 and log.filter("plus_minus is null").count() == 5
    sides = T.contest_sides(spark, rows_dir)
    for side, word in (("home", " vs. "), ("away", " @ ")):
        own = sides.filter(f"{side} is not null").select("game_id", "game_date", "season", f"{side}.*")
        rows = log.filter(F.contains("matchup", F.lit(word))).select(*own.columns)
        assert sorted(map(str, own.collect())) == sorted(map(str, rows.collect()))


def test_results_are_of_one_contest(spark, rows_dir):
    pair = F.collect_set("wl").alias("results"), F.sum("plus_minus").alias("margin"), F.count(F.lit(1)).alias("n")
    for row in T.game_log(spark, rows_dir).groupBy("game_id").agg(*pair).collect():
        assert (sorted(row["results"]), row["margin"]) == ((["L", "W"], 0.0) if row["n"] == 2 else ([], None))
    level = T.game_log(spark, rows_dir).filter("plus_minus = 0")
    assert level.filter((F.col("wl") == "W") != F.contains("matchup", F.lit(" vs. "))).isEmpty()


def test_contests_are_stored_before_they_are_ordered(spark, rows_dir):
    ordered = with_sequence(T.stored_contests(spark, rows_dir), [], "game_date", ["game_id"])
    assert not any("lineitem" in name for name in ordered.inputFiles())
