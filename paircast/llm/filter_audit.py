"""What five filters remove, alone and in every order, from additive counts.

Whether a document fails A to D is a function of its text; E fails for a text
that a smaller doc_id has. Duplicates are found in two steps. A counting Bloom
sketch comes first: every text sets a few counters of one page, tasks count
their own rows (the map side of an aggregation) and the shuffle merges the
sketches. A text with a counter that stayed at one is unique for certain and
goes no further. Only the texts left are shuffled, whole, for the smallest
doc_id of each. The flags make a mask of five bits; counts for every part and
mask are all that the 120 orders need, since what a step removes, keeps or
finds gone is a sum over masks.

The sketch has `COUNTERS` counters for every row, so a fixed share of unique
texts is not cleared (about one in thirty), whatever the size. Up to
`BROADCAST_PAGES` pages of 4 KB go to every executor; a larger sketch is joined
by page with the narrow table of flags, and its answer with the texts.

Cases: a null text is empty; a null source and an empty one are both part '';
rows with equal doc_id do not repeat each other; a null doc_id is neither
smaller than another nor has it a smaller one; a document counts as good or
toxic if any label row of its doc_id says so (labels without doc_id say
nothing); an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paircast.llm.common import NULL_ID, id_key
from paircast.session import stored

FILTERS = "ABCDE"
#: Bits of the mask by filter.
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
#: Sketch: counters for each row, counters that a text sets, bits of a page.
COUNTERS, PROBES, PAGE = 8, 3, 1 << 15
#: Pages of 4 KB in a broadcast sketch: 64 MB at most.
BROADCAST_PAGES = 1 << 14
#: A longer text is split into words a part at a time.
WORDS_BYTES = 1 << 22

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_CODE = re.compile(rb"[#$%&*|]")
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUATION = bytes(range(128, 192))

_FLAGS = pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), ("part", pa.string()), ("mask", pa.int32())])
_FLAGS_DDL = "_id long, _hash long, part string, mask int"


def _word_counts(blob: bytes) -> tuple[int, int]:
    """Words, distinct words; bytes.split() cuts at exactly the white space meant here."""
    if len(blob) <= WORDS_BYTES:
        words = blob.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(blob):
        cut = _SPACE.search(blob, at + WORDS_BYTES)
        words = blob[at : cut.start() if cut else len(blob)].split()
        n += len(words)
        seen.update(words)
        at = cut.end() if cut else len(blob)
    return n, len(seen)


def text_mask(blob: bytes) -> int:
    """The filters A to D that a text (as UTF-8) fails."""
    n, distinct = _word_counts(blob)
    points = len(blob) if blob.isascii() else len(blob.translate(None, _CONTINUATION))
    upper = len(blob.translate(None, _NOT_UPPER))
    failed = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * upper > 2 * points, "D": _CODE.search(blob) is not None}
    return sum(BIT[name] for name, bad in failed.items() if bad)


def _flag(batches):
    for batch in batches:
        masks = [text_mask(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_hash", "part")), pa.array(masks, pa.int32())], schema=_FLAGS)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(id_key().alias("_id"), text.alias("text"), F.xxhash64(text).alias("_hash"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))


def text_flags(docs: DataFrame) -> DataFrame:
    """_id, _hash (of the text), part and the mask of A to D for every row."""
    return _texts(docs).select("_id", "text", "_hash", "part").mapInArrow(_flag, _FLAGS_DDL)


def _page(pages: int) -> Column:
    return F.pmod(F.xxhash64("_hash", F.lit(1)), F.lit(pages)).cast("int").alias("page")


def _probes() -> list[Column]:
    """The places of a text's counters in its page."""
    spread = F.xxhash64("_hash", F.lit(2))
    return [F.shiftrightunsigned(spread, 15 * i).bitwiseAND(PAGE - 1).cast("int") for i in range(PROBES)]


def sketch(flags: DataFrame, pages: int) -> DataFrame:
    """Per page, the counters that reached two, as a bitmap of 4 KB: page, repeated.

    A text adds to each of its distinct places once a row. Pages without such
    a counter are left out.
    """
    counters = flags.select(_page(pages), F.explode(F.array_distinct(F.array(*_probes()))).alias("place")).groupBy("page", "place").agg(F.count(F.lit(1)).alias("n"))
    return counters.where("n > 1").groupBy("page").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("repeated"))


def _all_repeated() -> Column:
    """Whether every counter of a row's text is in the page's bitmap."""

    def bit(place: Column) -> Column:
        byte = F.conv(F.hex(F.col("repeated").substr(F.shiftright(place, 3) + F.lit(1), F.lit(1))), 16, 10).cast("int")
        return F.lit(1).bitwiseAND(F.call_function("shiftright", byte, place.bitwiseAND(7))) == 1

    return reduce(Column.__and__, map(bit, _probes()))


def possible_repeats(docs: DataFrame, flags: DataFrame, broadcast_pages: int = BROADCAST_PAGES) -> DataFrame:
    """_id, _hash and text of the rows whose text the sketch cannot clear."""
    pages = max(1, -(-COUNTERS * flags.count() // PAGE))
    bitmaps = stored(sketch(flags, pages), "audit-sketch")
    texts = _texts(docs).select("_id", "_hash", "text", _page(pages))
    if pages <= broadcast_pages:
        return texts.join(F.broadcast(bitmaps), "page").where(_all_repeated()).select("_id", "_hash", "text")
    # The texts stay where they are until the narrow table knows which of them are wanted.
    wanted = flags.select("_id", "_hash", _page(pages)).join(bitmaps, "page").where(_all_repeated()).select("_id", "_hash").distinct()
    return texts.select("_id", "_hash", "text").join(wanted, ["_id", "_hash"], "left_semi")


def repeats(docs: DataFrame, flags: DataFrame, broadcast_pages: int = BROADCAST_PAGES) -> DataFrame:
    """Distinct _id, _hash of the rows whose whole text a smaller doc_id has.

    Texts are grouped whole, with the smallest id taken before the shuffle;
    rows then find their group by SHA-256, never by sending texts again.
    """
    some = stored(possible_repeats(docs, flags, broadcast_pages).where(F.col("_id") != NULL_ID).select("_id", "_hash", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "audit-possible")
    least = some.groupBy("text").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.first("digest").alias("digest")).where("least < most").select("digest", "least")
    return some.select("_id", "_hash", "digest").join(least, "digest").where("_id > least").select("_id", "_hash").distinct()


def mask_counts(docs: DataFrame, labels: DataFrame, broadcast_pages: int = BROADCAST_PAGES) -> DataFrame:
    """Rows for every part and mask of failed filters: part, mask, n, good, toxic."""
    flags = stored(text_flags(docs), "audit-flags")
    repeated = repeats(docs, flags, broadcast_pages).withColumn("again", F.lit(BIT["E"]))
    marks = labels.where("doc_id is not null").groupBy(id_key().alias("_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = flags.join(repeated, ["_id", "_hash"], "left").join(marks, "_id", "left")
    return rows.groupBy("part", (F.col("mask") + F.coalesce("again", F.lit(0))).alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def _steps(filters: str) -> list[tuple]:
    """For every order, step and mask, whether the step keeps, removes or finds gone a row with that mask."""
    orders = list(permutations(filters))
    out = []
    for order in orders:
        for k, name in enumerate(order):
            before, own = sum(BIT[x] for x in order[:k]), BIT[name]
            for mask in range(1 << len(filters)):
                fails, gone = bool(mask & own), bool(mask & before)
                # Of the failed filters, each comes first in the same number of orders.
                share = len(orders) // mask.bit_count() if fails else 0
                out.append(("".join(order), k + 1, mask, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == own), share))
    return out


def interaction_audit(docs: DataFrame, labels: DataFrame, broadcast_pages: int = BROADCAST_PAGES) -> DataFrame:
    """One row per part, order of the filters and step, with that step's counts."""
    counts = mask_counts(docs, labels, broadcast_pages)
    # 120 orders x 5 steps x 32 masks: the same small table at every size.
    steps = docs.sparkSession.createDataFrame(_steps(FILTERS), "filter_order string, step int, mask int, _keeps int, _removes int, _finds int, _alone int, _share int")
    cells = counts.join(F.broadcast(steps), "mask").groupBy("part", "filter_order", "step")

    def total(flag: str, of: str = "n") -> Column:
        return F.sum(F.col(flag) * F.col(of)).cast("long")

    return cells.agg(
        total("_keeps").alias("kept"),
        total("_removes").alias("removed"),
        total("_finds").alias("redundant"),
        total("_alone").alias("unique_fails"),
        total("_removes", "good").alias("good_lost"),
        total("_removes", "toxic").alias("toxic_lost"),
        total("_share").alias("shapley"),
    )
