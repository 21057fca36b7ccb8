"""Leak-safe form features: every frame ends before the current contest."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from paircast.constants import FORM_COLUMNS, ROLLED_STATS
from paircast.functions.boxscore import home_flag, win_flag
from paircast.operators.sequence import BLOCK_ROWS, own_rows, with_halo_blocks, with_sequence

EWM_MIN = 5
EWM_SPAN = 10
ROLL_MIN = 5


def _sequenced(log: DataFrame, entity: str, beside: DataFrame | None = None) -> DataFrame:
    return with_sequence(log, [entity], "game_date", ["game_id"], beside=beside)


def form_features(
    log: DataFrame,
    entity: str = "team_id",
    stats: tuple[str, ...] = ROLLED_STATS,
    window: int = 20,
    rolling: bool = True,
    ewm: bool = True,
    momentum: bool = True,
    carries: DataFrame | None = None,
    fresh: Column | None = None,
    derive: Callable[[DataFrame], DataFrame] | None = None,
    beside: DataFrame | None = None,
) -> DataFrame:
    """All form columns of every row from one partitioning and one sort.

    The log of an entity is cut into blocks with a halo (see `sequence`), so an
    entity with a third of all rows is spread over many tasks. `carries` has
    what exponential means take over from rows that are not given (see
    `ewm_carries`); then only `fresh` rows add to them. `derive` adds columns
    that are functions of a row, once the rows are in their blocks, so that
    they are not moved; columns of `beside` (one row per entity and day) come
    along.
    """
    derive = derive or _as_given
    given = derive(log)
    stats = tuple(s for s in stats if s in given.columns)
    halo = halo_rows(window)
    rows = with_halo_blocks(_sequenced(log, entity, beside), halo).withColumn("_fresh", F.lit(True) if fresh is None else fresh)
    carry = None
    if ewm:
        # Powers of the growth fit a double over BLOCK_ROWS rows, so longer blocks are parted.
        part = F.floor((F.col("_pos") - 1) / BLOCK_ROWS)
        own = derive(rows.filter("_own")).withColumn("_part", part).withColumn("_at", F.col("_pos") - F.col("_part") * BLOCK_ROWS).withColumn("_place", F.col("_at"))
        carry = _ewm_carry(own, entity, stats, carries)
    rows = derive(rows.repartition(entity, "_block"))
    order = Window.partitionBy(entity, "_block").orderBy("seq")
    columns, rolled = {}, {}
    if rolling:
        plain = tuple(s for s in stats if isinstance(given.schema[s].dataType, PLAIN_NUMBERS))
        rolled = {f"{s}_roll_{kind}": s in plain for s in stats for kind in ("mean", "std")}
        columns.update(_rolling_columns(given, order, [s for s in stats if s not in plain], window))
    if momentum:
        rows, extra = _momentum_columns(rows, order)
        columns.update(extra)
    out = rows.withColumns(columns)
    if momentum:
        out = out.withColumns(_rest_columns()).drop("_won", "_gap", "_dense")
    if any(rolled.values()) or ewm:
        out = _with_block_columns(out, entity, plain if rolling else (), window, stats if ewm else (), carry)
    out = own_rows(out).drop("seq", "_fresh")
    kept = [c for c in out.columns if c in given.columns or (beside is not None and c in beside.columns)]
    means = [f"{s}_ewm" for s in stats] if ewm else []
    return out.select(*kept, *rolled, *means, *[c for c in out.columns if c not in kept and c not in rolled and c not in means])


def _as_given(rows: DataFrame) -> DataFrame:
    return rows


#: Types whose mean and deviation Spark takes in doubles.
PLAIN_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _rolled(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sample deviation of the `window` rows before each row; NaN is missing.

    All frames take their rows in step, oldest first, with the updates that
    Spark's `avg` and `stddev_samp` make, so the values are the same to the bit.
    """
    height = len(values)
    padded = np.concatenate([np.full((window, values.shape[1]), np.nan), values])
    n, total, mean, m2 = (np.zeros(values.shape) for _ in range(4))
    with np.errstate(all="ignore"):
        for back in range(window):
            value = padded[back : back + height]
            known = ~np.isnan(value)
            total += np.where(known, value, 0.0)
            n += known
            delta = np.where(known, value - mean, 0.0)
            step = delta / np.maximum(n, 1.0)
            mean += step
            m2 += delta * (delta - step)
        return n, total / n, np.sqrt(m2 / (n - 1.0))


def _exponential(values: np.ndarray, carry: list, span: int = EWM_SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Values so far and exponential mean before each of a block's own rows; NaN is missing.

    A ratio of two running sums with the weight growth^place, so the common
    factor cancels; places restart every BLOCK_ROWS rows, which keeps the powers
    inside a double. `carry` has what the rows before the block left for each
    column. A missing value keeps its place in the weighting but enters neither
    sum.
    """
    growth = (span + 1.0) / (span - 1.0)
    counts, means = np.zeros(values.shape), np.full(values.shape, np.nan)
    n = np.array([c["n"] for c in carry], dtype=float)
    mean = np.array([np.nan if c["mean"] is None else c["mean"] for c in carry])
    kept = np.array([0.0 if c["weight"] is None else c["weight"] * growth ** float(c["place"]) for c in carry])
    with np.errstate(all="ignore"):
        for start in range(0, len(values), BLOCK_ROWS):
            part = values[start : start + BLOCK_ROWS]
            known = ~np.isnan(part)
            weight = known * (growth ** np.arange(1.0, len(part) + 1))[:, None]
            sums = [np.cumsum(np.vstack([np.zeros(part.shape[1]), v]), axis=0) for v in (known, weight, np.where(known, part, 0.0) * weight)]
            base = np.where(kept > 0, mean * kept, 0.0)
            ratio = np.where(sums[0] > 0, (sums[2] + base) / (sums[1] + kept), mean)
            counts[start : start + BLOCK_ROWS], means[start : start + BLOCK_ROWS] = n + sums[0][:-1], ratio[:-1]
            n, mean = n + sums[0][-1], ratio[-1]
            kept = (sums[1][-1] + kept) * growth ** -float(len(part))
    return counts, means


def _with_block_columns(rows: DataFrame, entity: str, plain, window: int, exponential, carry: DataFrame | None) -> DataFrame:
    """Add mean and deviation of the previous `window` rows and exponential means, block by block.

    The blocks are partitioned and sorted as the windows before left them, and
    meet the one row that each takes over. Statistics are columns of one
    matrix: a window expression would update every aggregate of every statistic
    for each row of each frame.
    """
    names = rows.columns
    made = [f"{s}_roll_{kind}" for s in plain for kind in ("mean", "std")] + [f"{s}_ewm" for s in exponential]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, T.DoubleType()) for name in made]])

    def matrix(table: pa.Table, stats) -> np.ndarray:
        columns = [table.column(s).cast(pa.float64()).to_numpy() for s in stats]
        return np.column_stack(columns) if columns else np.empty((table.num_rows, 0))

    def add(table: pa.Table, before: pa.Table | None = None) -> pa.Table:
        seq = table.column("seq").to_numpy()
        if (np.diff(seq) < 0).any():
            table = table.take(pa.array(np.argsort(seq, kind="stable")))
        n, mean, std = _rolled(matrix(table, plain), window)
        few = n < ROLL_MIN
        arrays = [pa.array(v[:, i], mask=few[:, i], from_pandas=False) for i in range(len(plain)) for v in (mean, std)]
        if before is not None and before.num_rows and table.num_rows:
            values, own = matrix(table, exponential), table.column("_own").to_numpy()
            values[~table.column("_fresh").to_numpy()] = np.nan
            n, mean = (np.full(values.shape, fill) for fill in (0.0, np.nan))
            n[own], mean[own] = _exponential(values[own], before.column("_carry")[0].as_py())
            arrays += [pa.array(mean[:, i], mask=n[:, i] < EWM_MIN, from_pandas=False) for i in range(len(exponential))]
        elif before is not None:  # nothing but a halo, of which no row stays
            arrays += [pa.nulls(table.num_rows, pa.float64()) for _ in exponential]
        return pa.Table.from_arrays([*table.select(names).columns, *arrays], names=[*names, *made])

    blocks = rows.groupBy(entity, "_block")
    if carry is None:
        return blocks.applyInArrow(lambda table: add(table), schema)
    return blocks.cogroup(carry.groupBy("_of", "_to")).applyInArrow(add, schema)


def _known(df: DataFrame, stat: str) -> Column:
    """A statistic as a number; NaN is missing, as null is."""
    kind = df.schema[stat].dataType.typeName()
    return F.nanvl(F.col(stat), F.lit(None).cast(kind)) if kind in ("double", "float") else F.col(stat)


def _rolling_columns(log: DataFrame, order, stats, window: int) -> dict:
    """Mean and sample deviation of the previous `window` rows, for statistics of other types (decimals).

    Every frame is added up by itself, so what lies before it leaves no trace:
    a constant frame after a jump has a deviation of exactly 0.
    """
    frame = order.rowsBetween(-window, -1)
    columns = {}
    for stat in stats:
        value = _known(log, stat)
        enough = F.count(value).over(frame) >= ROLL_MIN
        columns[f"{stat}_roll_mean"] = F.when(enough, F.avg(value).over(frame))
        columns[f"{stat}_roll_std"] = F.when(enough, F.stddev_samp(value).over(frame))
    return columns


def halo_rows(window: int = 20) -> int:
    """Rows before a row that its rolling and momentum columns look at."""
    return max(window + 1, 11)


def _ewm_value(df: DataFrame, stat: str) -> Column:
    return F.when(F.col("_fresh"), _known(df, stat))


def _growth(place: Column, span: int = EWM_SPAN) -> Column:
    return F.pow(F.lit((span + 1.0) / (span - 1.0)), place.cast("double"))


def _ewm_carry(rows: DataFrame, entity: str, stats, carries: DataFrame | None = None) -> DataFrame:
    """What each block (`_to`) of an entity (`_of`) takes over from the rows before it, from the blocks' own rows.

    `_carry` lists per statistic: values so far, and mean, weight and place (relative to the
    block) of the last one. A block's own sums are relative to its last value,
    so that a long gap loses nothing; of the blocks before, the last two with
    values count, as older weights have fallen by a whole block in between (a
    block of 200 rows is enough),
    far below the precision of a double.
    """
    by_block = [entity, "_block", "_part"]
    blocks = _ewm_sums(rows, by_block, stats)
    # One row per block from here on.
    order = Window.partitionBy(entity).orderBy("_block", "_part")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_begin", F.coalesce(F.sum("_rows").over(past), F.lit(0)))
    ends = {
        f"_e_{s}": F.when(F.col(f"_n_{s}") > 0, F.struct((F.col("_begin") + F.col(f"_last_{s}")).alias("place"), (F.col(f"_s_{s}") / F.col(f"_w_{s}")).alias("mean"), F.col(f"_w_{s}").alias("weight")))
        for s in stats
    }
    blocks = blocks.withColumns(ends)
    if carries is not None:
        # What came before the first row is a block of its own without rows.
        first = carries.select(entity, F.lit(-1).cast("long").alias("_block"), F.lit(0).cast("long").alias("_part"), F.lit(0).cast("long").alias("_begin"), *[F.col(f"carry_{s}.n").alias(f"_n_{s}") for s in stats], *[_carried_end(s).alias(f"_e_{s}") for s in stats])
        blocks = blocks.select(*first.columns).unionByName(first)
    blocks = blocks.withColumns({f"_b_{s}": F.last(f"_e_{s}", ignorenulls=True).over(past) for s in stats})
    # The end of a block joined to the last one before it.
    blocks = blocks.withColumns({f"_e_{s}": _chained(F.col(f"_b_{s}"), F.col(f"_e_{s}")) for s in stats})
    taken = {}
    for s in stats:
        end = F.last(f"_e_{s}", ignorenulls=True).over(past)
        taken[f"_t_{s}"] = F.struct(F.coalesce(F.sum(f"_n_{s}").over(past), F.lit(0)).alias("n"), end["mean"].alias("mean"), end["weight"].alias("weight"), (end["place"] - F.col("_begin")).alias("place"))
    # Later parts of a block go on from its first.
    first = blocks.withColumns(taken).filter("_part = 0 and _block >= 0")
    return first.select(F.col(entity).alias("_of"), F.col("_block").alias("_to"), F.array(*taken).alias("_carry"))


def _ewm_sums(rows: DataFrame, keys: list[str], stats) -> DataFrame:
    """Per key and statistic: values, their weighted sum and weight, relative to the place (`_at`) of the last one.

    One pass adds up relative to the begin of each key (`_place`), at most
    BLOCK_ROWS places back, over which the powers fit a double.
    """
    rows = rows.withColumn("_weight", _growth(F.col("_place")))
    sums = []
    for s in stats:
        value = _ewm_value(rows, s)
        known = value.isNotNull()
        sums += [F.count(value).alias(f"_n_{s}"), F.sum(value.cast("double") * F.col("_weight")).alias(f"_s_{s}"), F.sum(F.when(known, F.col("_weight"))).alias(f"_w_{s}"), F.max(F.when(known, F.col("_at"))).alias(f"_last_{s}")]
    summed = rows.groupBy(*keys).agg(F.max("_at").alias("_rows"), F.max(F.col("_at") - F.col("_place")).alias("_base"), *sums)
    return summed.withColumns({f"{part}_{s}": F.col(f"{part}_{s}") * _growth(F.col("_base") - F.col(f"_last_{s}")) for s in stats for part in ("_s", "_w")}).drop("_base")


def _ewm_joined(parts: DataFrame, entity: str, stats) -> DataFrame:
    """The sums of `_ewm_sums` per entity from those of its parts, whose places all count from the same row."""
    last = parts.groupBy(entity).agg(F.max("_rows").alias("_rows"), *[F.max(f"_last_{s}").alias(f"_most_{s}") for s in stats])
    sums = []
    for s in stats:
        weight = _growth(F.col(f"_last_{s}") - F.col(f"_most_{s}"))
        sums += [F.sum(f"_n_{s}").alias(f"_n_{s}"), F.sum(F.col(f"_s_{s}") * weight).alias(f"_s_{s}"), F.sum(F.col(f"_w_{s}") * weight).alias(f"_w_{s}"), F.max(f"_most_{s}").alias(f"_last_{s}")]
    return parts.drop("_rows").join(last, entity).groupBy(entity).agg(F.max("_rows").alias("_rows"), *sums)


def _chained(before: Column, end: Column) -> Column:
    """An end (place, mean, weight) that goes on from the one before it; missing where there is no end."""
    kept = F.coalesce(before["weight"] * _growth(before["place"] - end["place"]), F.lit(0.0))
    weight = end["weight"] + kept
    mean = (end["mean"] * end["weight"] + F.coalesce(before["mean"], F.lit(0.0)) * kept) / weight
    return F.when(end.isNotNull(), F.struct(end["place"].alias("place"), mean.alias("mean"), weight.alias("weight")))


def _carried_end(stat: str) -> Column:
    """A stored carry as an end, placed relative to the first given row; `tail_rows` rows precede the fresh ones."""
    c = F.col(f"carry_{stat}")
    return F.when(c["n"] > 0, F.struct((F.col("tail_rows") - c["behind"]).alias("place"), c["mean"].alias("mean"), c["weight"].alias("weight")))


def log_tails(log: DataFrame, entity: str = "team_id", window: int = 20) -> DataFrame:
    """The last rows of every entity, as many as a new row looks back at; ranked before the shuffle."""
    newest = Window.partitionBy(entity).orderBy(F.desc("game_date"), F.desc("game_id"))
    return log.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= halo_rows(window)).drop("_back")


def ewm_carries(log: DataFrame, entity: str = "team_id", stats: tuple[str, ...] = ROLLED_STATS, window: int = 20, carries: DataFrame | None = None, fresh: Column | None = None, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What exponential means go on from, one row per entity.

    Per statistic `carry_<s>`: values so far, mean and weight at the last one,
    and the rows since. `tail_rows` is the length of the entity's tail (see
    `log_tails`). With the carries of an earlier time, the log is that time's tails and the
    `fresh` rows after them.
    """
    derive = derive or _as_given
    stats = tuple(s for s in stats if s in derive(log).columns)
    rows = derive(_sequenced(log, entity)).withColumn("_fresh", F.lit(True) if fresh is None else fresh).withColumn("_at", F.col("seq"))
    # Rows meet in parts of BLOCK_ROWS, so that no task gets all rows of an entity; parts meet by entity.
    rows = rows.withColumn("_part", F.floor((F.col("seq") - 1) / BLOCK_ROWS))
    parts = _ewm_sums(rows.withColumn("_place", F.col("seq") - F.col("_part") * BLOCK_ROWS), [entity, "_part"], stats)
    ends = _ewm_joined(parts, entity, stats)
    if carries is not None:
        ends = ends.join(carries, entity, "left")
    out = {}
    for s in stats:
        n, last = F.col(f"_n_{s}"), F.col(f"_last_{s}")
        end = F.when(n > 0, F.struct(last.alias("place"), (F.col(f"_s_{s}") / F.col(f"_w_{s}")).alias("mean"), F.col(f"_w_{s}").alias("weight")))
        if carries is not None:
            n = n + F.coalesce(f"carry_{s}.n", F.lit(0))
            end = F.coalesce(_chained(_carried_end(s), end), _carried_end(s))
        out[f"carry_{s}"] = F.struct(n.alias("n"), end["mean"].alias("mean"), end["weight"].alias("weight"), (F.col("_rows") - end["place"]).alias("behind"))
    tail = F.least(F.col("_rows"), F.lit(halo_rows(window))).cast("long").alias("tail_rows")
    return ends.select(entity, tail, *[c.alias(name) for name, c in out.items()])


def _momentum_columns(rows: DataFrame, order) -> tuple[DataFrame, dict]:
    rows = rows.withColumns(
        {
            "_won": win_flag(F.col("wl")),
            "_gap": F.date_diff("game_date", F.lag("game_date").over(order)),
        }
    )
    last = lambda n: order.rowsBetween(-n, -1)
    won = F.col("_won")
    before = lambda n: F.lag(won, n).over(order)
    pattern = (
        F.when(F.col("seq") == 1, F.lit(None).cast("double"))
        .when(F.col("seq") == 2, F.lit(3.5))
        .otherwise((4 * F.coalesce(before(3), F.lit(0)) + 2 * before(2) + before(1)).cast("double"))
    )
    spread = F.when(F.count(won).over(last(10)) >= 3, F.stddev_samp(won).over(last(10)))
    return rows, {
        "win_streak": F.sum(won).over(last(5)).cast("double"),
        "recent_form": F.avg(won).over(last(5)),
        "win_pattern_3game": pattern,
        "momentum_trend": F.avg(won).over(last(3)) - F.avg(won).over(last(10)),
        "win_consistency": 1 - F.coalesce(spread, F.lit(0.5)),
        "is_home": home_flag(F.col("matchup")) if "matchup" in rows.columns else F.col("is_home"),
        "_dense": F.sum("_gap").over(order.rowsBetween(-2, 0)),
    }


def _rest_columns() -> dict:
    rest = F.greatest(F.least(F.coalesce(F.col("_gap"), F.lit(3)), F.lit(10)), F.lit(0))
    return {
        "days_rest": rest.cast("double"),
        "is_back_to_back": (rest == 1).cast("int"),
        "is_3_in_4": F.coalesce(F.col("_dense") <= 4, F.lit(False)).cast("int"),
    }


def form_column_names(columns: list[str]) -> list[str]:
    """Columns carried into the contest table: rolled ones and the fixed list."""
    return [c for c in columns if "_roll_" in c] + [c for c in FORM_COLUMNS if c in columns]


def latest_features(features: DataFrame, entity: str = "team_id") -> DataFrame:
    """The form row of each entity's last played contest.

    It describes the state before that contest, as serving always used it; see
    `next_contest_features` for the state after it. A partial aggregate picks
    the row, so a long history never gathers in one task.
    """
    names = form_column_names(features.columns)
    newest = F.max_by(F.struct("game_date", "game_id", *names), F.struct("game_date", "game_id"))
    return features.groupBy(entity).agg(newest.alias("_row")).select(entity, "_row.*")


def next_contest_features(log: DataFrame, schedule: DataFrame, entity: str = "team_id", **options) -> DataFrame:
    """Form of scheduled contests, from the history and the schedule rows together."""
    upcoming = schedule.withColumn("_upcoming", F.lit(True))
    history = log.withColumn("_upcoming", F.lit(False))
    both = history.unionByName(upcoming, allowMissingColumns=True)
    return form_features(both, entity, **options).filter("_upcoming").drop("_upcoming")
