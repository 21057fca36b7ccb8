"""Ordered computation over keys that may hold most of the rows.

A window partitioned by a hot key runs in one task. These helpers split every
key along its own order instead:

* a *chunk* is a column that never decreases along the order (here the day);
  ranks are taken inside a chunk and shifted by the chunk's offset, which comes
  from a table with one row per key and chunk. On a cluster the largest chunks
  are cut once more at quantiles of the order, whatever its type, so that one
  day with most of the rows is no single task either;
* a *block* is a fixed number of consecutive rows of a key, together with a
  halo of rows copied from the block before it, so that any frame that reaches
  back at most `halo` rows is complete inside one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 2048
MOST_SLICES = 64
SAMPLES_PER_SLICE = 64
BINS = 1024


def _slice_count(df: DataFrame) -> int:
    """Ranges per large chunk, in step with the partitions the session is sized for.

    Below 32 partitions an even share of all rows is as large as what slices
    would be made for. The result is the same with any number.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2
    return min(count, MOST_SLICES) if count >= 16 else 1


def _quantiles(df: DataFrame, chunk: str, order: list[str], slices: int) -> DataFrame:
    """Upper bounds of the slices of the `slices` largest chunks, at most `slices` squared values.

    All other chunks hold less than one part in `slices` of the rows. The
    bounds are quantiles of a sample by hash: one row of each of 64 hash
    classes per slice, so the sample depends on the rows alone and every reader
    of the plan cuts at the same places.
    """
    largest = df.groupBy(chunk).agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.desc("_rows"), chunk).limit(slices)
    at = F.struct(*order)
    picked = (
        df.join(F.broadcast(largest.select(F.col(chunk).alias("_chunk"))), F.col(chunk).eqNullSafe(F.col("_chunk")))
        .select("_chunk", at.alias("_at"), F.xxhash64(*order).alias("_hash"))
        .groupBy("_chunk", F.pmod("_hash", F.lit(SAMPLES_PER_SLICE * slices)).alias("_class"))
        .agg(F.min(F.struct("_hash", "_at")).alias("_least"))
    )
    ordered = F.array_sort(F.collect_list("_least._at"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), lambda i: F.get("_all", F.floor(i * F.size("_all") / slices).cast("int")))
    return picked.groupBy("_chunk").agg(ordered.alias("_all")).select("_chunk", F.array_distinct(cuts).alias("_cuts"))


def _sliced(df: DataFrame, chunk: str, order: list, slices: int | None) -> tuple[DataFrame, list[str]]:
    """Add a finer chunk from quantiles of the order columns; expressions among them and what follows are left out."""
    count = _slice_count(df) if slices is None else slices
    named = []
    for part in order:
        if not isinstance(part, str):
            break
        named.append(part)
    if count < 2 or not named:
        return df, [chunk]
    bounds = F.broadcast(_quantiles(df, chunk, named, count))
    passed = F.size(F.filter("_cuts", lambda cut: cut <= F.struct(*named)))
    return (
        df.join(bounds, F.col(chunk).eqNullSafe(F.col("_chunk")), "left")
        .withColumn("_slice", F.when(F.col("_cuts").isNull(), 0).otherwise(passed))
        .drop("_chunk", "_cuts"),
        [chunk, "_slice"],
    )


def _carried(df: DataFrame, keys: list[str], chunks: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Sums over the key's earlier chunks; one row per key and chunk.

    With slices the carry is taken in two steps (days, then ranges of a day),
    so that no ordered window grows beyond the calendar or the slice count.
    """
    sums = df.groupBy(*keys, *chunks).agg(*[amount.alias(name) for name, amount in amounts.items()])

    def earlier(name: str, by: list[str], order: str) -> Column:
        past = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(past), F.lit(0))

    if len(chunks) == 1:
        return sums.select(*keys, *chunks, *[earlier(n, keys, chunks[0]).alias(n) for n in amounts])
    coarse = sums.groupBy(*keys, chunks[0]).agg(*[F.sum(n).alias(n) for n in amounts])
    coarse = coarse.select(*keys, chunks[0], *[earlier(n, keys, chunks[0]).alias(f"{n}_coarse") for n in amounts])
    fine = sums.select(*keys, *chunks, *[earlier(n, [*keys, chunks[0]], chunks[1]).alias(n) for n in amounts])
    totals = [(F.col(n) + F.col(f"{n}_coarse")).alias(n) for n in amounts]
    return fine.join(coarse, [*keys, chunks[0]]).select(*keys, *chunks, *totals)


def with_sequence(df: DataFrame, keys: list[str], chunk: str, order: list, name: str = "seq", slices: int | None = None, beside: DataFrame | None = None) -> DataFrame:
    """Row number per key in (chunk, order), computed chunk by chunk.

    `beside` has at most one row per key and chunk; its other columns come
    along with the offsets, so they cost no exchange of the rows.
    """
    rows, chunks = _sliced(df, chunk, order, slices)
    inside = Window.partitionBy(*keys, *chunks).orderBy(*order)
    offsets = _carried(rows, keys, chunks, {"_offset": F.count(F.lit(1))})
    if beside is not None:
        offsets = offsets.join(beside, [*keys, chunk], "left")
    return (
        rows.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*keys, *chunks])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "_slice")
    )


def with_halo_blocks(df: DataFrame, halo: int, seq: str = "seq", rows: int | None = None) -> DataFrame:
    """Add `_block`, `_own` and `_pos`; the last `halo` rows of a block appear twice.

    `_own` marks the copy that belongs to the block; halo copies only feed the
    frames of the rows after them and are dropped by `own_rows`. `_pos` is the
    position relative to the start of the block, negative inside the halo. A
    block has BLOCK_ROWS rows, or twice the halo if that is more.
    """
    rows = max(BLOCK_ROWS, 2 * halo) if rows is None else rows
    if halo >= rows:
        raise ValueError("the halo must be shorter than a block")
    at = F.col(seq) - 1
    home = F.floor(at / rows)
    blocks = F.when(at % rows >= rows - halo, F.array(home, home + 1)).otherwise(F.array(home))
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumn("_own", F.col("_block") == F.floor((F.col(seq) - 1) / rows))
        .withColumn("_pos", F.col(seq) - F.col("_block") * rows)
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_block", "_own", "_pos")


def with_running_counts(df: DataFrame, keys: list[str], chunk: str, order: list, tests: dict[str, Column], slices: int | None = None) -> DataFrame:
    """Per key and test: rows up to and including this one that pass it."""
    rows, chunks = _sliced(df, chunk, order, slices)
    inside = Window.partitionBy(*keys, *chunks).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hits = {name: F.when(test, 1).otherwise(0) for name, test in tests.items()}
    carry = _carried(rows, keys, chunks, {f"_before_{n}": F.sum(hit) for n, hit in hits.items()})
    counted = rows.withColumns({n: F.sum(hit).over(inside) for n, hit in hits.items()}).join(carry, [*keys, *chunks])
    totals = {n: F.col(n) + F.col(f"_before_{n}") for n in tests}
    return counted.withColumns(totals).drop("_slice", *[f"_before_{n}" for n in tests])


def _nth(values: DataFrame, rank: int) -> float:
    """The value of a rank (from 1) among non-null doubles `_v`, with `_n` copies each, by rounds of histograms.

    The first round goes by sign and binary exponent, later ones cut what is
    left into equal ranges. Each round is one partial aggregate to a bounded
    number of bins and keeps the bin that holds the rank, between its own least
    and greatest value; it ends when they are the same. A range shrinks to one
    bin of BINS, so a double's 52 bits are used up after a handful of rounds.
    """
    size = F.floor(F.log2(F.abs("_v")))
    exponent = F.when(F.col("_v") > 0, size + 2000).when(F.col("_v") < 0, -size - 2000).otherwise(0)
    left, bin_of = values, F.when(F.abs("_v") == float("inf"), F.signum("_v") * 9999).otherwise(exponent)
    while True:
        bins = left.groupBy(bin_of.cast("long").alias("_bin")).agg(F.sum("_n").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        for found in sorted(bins.collect(), key=lambda row: row["low"]):
            if rank <= found["n"]:
                break
            rank -= found["n"]
        low, high = found["low"], found["high"]
        if low == high:
            return low
        left = values.filter(F.col("_v").between(low, high))
        bin_of = F.floor((F.col("_v") - low) / (high - low) * BINS)


def exact_median(df: DataFrame, value: str, name: str = "median") -> DataFrame:
    """Median over all rows by selection, one row; null where there is no value.

    Nothing is sorted or gathered: equal and nearly equal values are counted
    where they are. NaN counts as no value.
    """
    number = F.col(value).cast("double")
    values = df.select(number.alias("_v")).filter("_v is not null and not isnan(_v)").withColumn("_n", F.lit(1))
    count = values.count()
    ranks = {(count + 1) // 2, (count + 2) // 2} if count else set()
    found = [_nth(values, rank) for rank in ranks]
    middle = F.lit(sum(found) / len(found) if found else None).cast("double")
    return df.sparkSession.range(1).select(middle.alias(name))
