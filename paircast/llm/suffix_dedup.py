"""Removal of long repeated byte strings by bucket-pointer refinement.

Every byte inside a string of `window` bytes that starts at two places goes.
The suffixes at hand are not all suffixes but those at anchors: each window
has the place of its least q-gram as anchor, so equal windows have equal
anchors at the same distance.

1. Anchors fall into initial buckets by their q-gram. A bucket id of 2k bytes
   is made of the bucket ids of k bytes at an offset and k bytes later, from
   single bytes up. Buckets with one place are settled: nothing repeats there.
2. The windows before an anchor are split into cells of neighbouring windows.
   A cell's bucket is refined by the bucket of what all its windows share
   (its core) and by that of everything they cover. Two places in one bucket:
   all windows of these cells repeat. Alone in its core: none does. Only where
   one core has several refined buckets, one cell of each (any cell of a
   bucket stands for all of them) goes on, cut into smaller cells, down to
   single windows. Each level reuses the outcome of the one before.

Grouping is by bucket id with partial aggregation, so a passage shared by a
third of all documents is counted, never gathered. Bucket ids of a level are
128-bit content hashes. Texts that no level asks for are not shuffled: a
bitmap of fixed size, by document hash, leaves them out (where it fills up,
more texts move, and the result is the same).

Cases: a null text is empty; texts shorter than the window stay as they are;
rows that repeat a document (equal doc_id and text) are one document and no
repetition of each other; an empty table gives an empty result; other columns
are kept by `without_repeats` and ignored by `repeated_spans`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from paircast.llm.common import CODE, PORTION_BYTES, U64, blobs_of, portions, record, row_key, with_row
from paircast.session import stored

WINDOW = 400
GRAM = 32
#: Windows in a cell, level by level; the last is 1.
LEVELS = (128, 16, 1)
#: Bits of the map of wanted documents: 512 KB, whatever the corpus.
MAP_BITS = 22

_KEYS = ["_id", "_hash"]
_CELLS = pa.schema([("core", pa.int64()), ("whole", pa.int64()), ("_id", pa.int64()), ("_hash", pa.int64()), ("parent", pa.int64()), ("start", pa.int64())])
_CELLS_DDL = "core long, whole long, _id long, _hash long, parent long, start long"


def gram_ids(data: bytes, gram: int) -> np.ndarray:
    """Bucket id of the `gram` bytes from each offset (a power of two), doubled from single bytes."""
    ids = CODE[np.frombuffer(data, np.uint8)]
    span = 1
    while span < gram:
        if len(ids) <= span:
            return np.zeros(0, np.uint64)
        ids = ids[:-span] * U64(0xC2B2AE3D27D4EB4F) + ids[span:]
        ids ^= ids >> U64(29)
        span *= 2
    return ids


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width`."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return values if span == width else np.minimum(values[: len(values) - (width - span)], values[width - span :])


def anchors(blobs: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Per anchor: text, offset, first and last window start that it serves, bucket id."""
    data = b"".join(blobs)
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none, none
    ids = gram_ids(data, gram)
    bits = U64(len(data).bit_length())
    # Ordered by hash, then by place: the leftmost of equal q-grams wins.
    keys = ((ids >> bits) << bits) | np.arange(len(ids), dtype=np.uint64)
    place = (_slide(keys, window - gram + 1) & ((U64(1) << bits) - U64(1))).astype(np.int64)
    sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
    begin = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - window + 1, 0)
    doc = np.repeat(np.arange(len(blobs)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[doc]
    if not len(starts):
        return none, none, none, none, none
    at = place[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    doc = doc[new]
    return doc, at[new] - begin[doc], starts[new] - begin[doc], starts[last] - begin[doc], ids[at[new]].view(np.int64)


def _find_anchors(window: int, gram: int):
    schema = pa.schema([("bucket", pa.int64()), ("_id", pa.int64()), ("_hash", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches):
        for batch in batches:
            blobs = blobs_of(batch.column("text"))
            ids, hashes = (batch.column(k).to_numpy() for k in _KEYS)
            for part in portions(blobs, PORTION_BYTES):
                doc, place, first, last, bucket = anchors(blobs[part], window, gram)
                yield record(schema, bucket=bucket, _id=ids[part][doc], _hash=hashes[part][doc], place=place, first=first, last=last)

    return run


def _cell(blob: bytes, start: int, size: int, window: int) -> tuple[int, int]:
    """Bucket ids of a cell's core and of all it covers; the part outside the text is told apart."""
    a, b = max(start, 0), min(start + size - 1, len(blob) - window)
    view = memoryview(blob)
    outside = (a - start) * 4096 + start + size - 1 - b
    core = xxhash.xxh3_64_intdigest(view[start + size - 1 : start + window], seed=size)
    return _signed(core), _signed(xxhash.xxh3_64_intdigest(view[a : b + window], seed=outside + (size << 32)))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _first_cells(size: int, window: int):
    """Cells of `size` windows that end at an anchor or a multiple of `size` before it."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for i, h, packed, found in zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "packed", "anchors"))):
                blob = unpack.decompress(packed)
                for f in found:
                    place, first, last = f["place"], f["first"], f["last"]
                    for k in range((place - last) // size, (place - first) // size + 1):
                        start = place - size * (k + 1) + 1
                        rows.append((*_cell(blob, start, size, window), i, h, start, start))
                if len(rows) > 1 << 16:
                    yield _cells(rows)
                    rows = []
            yield _cells(rows)

    return run


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_CELLS)
    return record(_CELLS, **{f.name: list(c) for f, c in zip(_CELLS, columns)})


_CONTEXT = pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), ("parent", pa.int64()), ("skipped", pa.int64()), ("context", pa.binary())])
_CONTEXT_DDL = "_id long, _hash long, parent long, skipped long, context binary"


def _contexts(size: int, window: int):
    """The bytes that the windows of a cell cover."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for i, h, packed, starts in zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "packed", "starts"))):
                blob = unpack.decompress(packed)
                for start in starts:
                    a, b = max(start, 0), min(start + size - 1, len(blob) - window)
                    rows.append((i, h, start, a - start, blob[a : b + window]))
            columns = zip(*rows) if rows else [[]] * len(_CONTEXT)
            yield record(_CONTEXT, **{f.name: list(c) for f, c in zip(_CONTEXT, columns)})

    return run


def _smaller_cells(size: int, window: int):
    """Cells of `size` windows within the cells (`start`, `cell` windows) of a context."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, h, parent, skipped, context, starts, cell in zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "parent", "skipped", "context", "starts", "cell"))):
                # The context is a text of its own, whose offset 0 is the text's parent + skipped.
                shift = parent + skipped
                for start in starts:
                    for s in range(start - shift, start - shift + cell, size):
                        if s + size > 0 and s <= len(context) - window:
                            rows.append((*_cell(context, s, size, window), i, h, parent, s + shift))
            yield _cells(rows)

    return run


def _wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_id, _hash, packed) of at least the wanted documents, texts packed for the shuffle."""
    bit = F.pmod(F.col("_hash"), F.lit(1 << MAP_BITS)).cast("int").alias("bit")
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[[r[0] for r in wanted.select(bit).distinct().toLocalIterator()]] = True  # at most 2 ** MAP_BITS numbers
    packed_bits = np.packbits(bits)
    schema = pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        own = np.unpackbits(packed_bits).astype(bool)
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keep = np.flatnonzero(own[np.mod(batch.column("_hash").to_numpy(), 1 << MAP_BITS)])
            some = batch.take(pa.array(keep))
            yield record(schema, _id=some.column("_id"), _hash=some.column("_hash"), packed=[pack.compress(b) for b in blobs_of(some.column("text"))])

    texts = docs.select(*row_key(), "text").mapInArrow(run, "_id long, _hash long, packed binary")
    return texts


def _resolved(cells: DataFrame) -> DataFrame:
    """Cells that repeat, and one cell of each bucket whose core has several; others are settled."""
    cells = cells.withColumn("at", F.xxhash64(*_KEYS, "start"))
    buckets = cells.groupBy("core", "whole").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    several = buckets.groupBy("core").agg((F.count("*") > 1).alias("several"))
    known = cells.join(buckets.join(several, "core"), ["core", "whole"])
    flags = known.select(
        *_KEYS, "parent", "start", (F.col("least") < F.col("most")).alias("repeats"), (F.col("several") & (F.col("at") == F.col("least"))).alias("goes_on")
    )
    return stored(flags.where("repeats or goes_on"), "suffix-cells")


def _remove(window: int):
    schema = pa.schema([("_id", pa.int64()), ("_hash", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64()))])

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i, h, packed, marks in zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "packed", "marks"))):
                blob = unpack.decompress(packed)
                spans: list[int] = []
                for start, size in sorted((m["start"], m["size"]) for m in marks):
                    a, b = max(start, 0), min(start + size - 1, len(blob) - window) + window
                    if spans and a <= spans[-1]:
                        spans[-1] = max(spans[-1], b)
                    else:
                        spans += [a, b]
                cuts = [0, *spans, len(blob)]
                kept = b"".join(blob[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                yield record(schema, _id=[i], _hash=[h], n_removed=[len(blob) - len(kept)], n_spans=[len(spans) // 2], kept=[kept], spans=[spans])

    return run


def _marked(docs: DataFrame, window: int, gram: int, levels: tuple[int, ...]) -> DataFrame:
    """(_id, _hash, marks): cells (start, size) of repeated windows for each document that has any."""
    texts = docs.select(*row_key(), "text")
    found = stored(texts.mapInArrow(_find_anchors(window, gram), "bucket long, _id long, _hash long, place long, first long, last long"), "suffix-anchors")
    at = F.xxhash64(*_KEYS, "place")
    shared = found.groupBy("bucket").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a < b").select("bucket")
    rest = found.join(shared, "bucket").groupBy(*_KEYS).agg(F.collect_set(F.struct("place", "first", "last")).alias("anchors"))
    rest = stored(rest, "suffix-buckets")
    size = levels[0]
    cells = _wanted_texts(docs, rest).join(rest, _KEYS).mapInArrow(_first_cells(size, window), _CELLS_DDL)
    flags = _resolved(stored(cells, "suffix-level"))
    marks = flags.where("repeats").select(*_KEYS, "start", F.lit(size).alias("size"))
    open_cells = flags.where("goes_on")
    starts = open_cells.groupBy(*_KEYS).agg(F.collect_set("start").alias("starts"))
    context = None
    for smaller in levels[1:]:
        if context is None:
            context = _wanted_texts(docs, starts).join(starts, _KEYS).mapInArrow(_contexts(size, window), _CONTEXT_DDL)
            context = stored(context, "suffix-contexts")
        by_context = open_cells.groupBy(*_KEYS, "parent").agg(F.collect_set("start").alias("starts")).withColumn("cell", F.lit(size))
        cells = context.join(by_context, [*_KEYS, "parent"]).mapInArrow(_smaller_cells(smaller, window), _CELLS_DDL)
        size = smaller
        flags = _resolved(stored(cells, "suffix-level"))
        marks = marks.unionByName(flags.where("repeats").select(*_KEYS, "start", F.lit(size).alias("size")))
        open_cells = flags.where("goes_on")
    return marks.groupBy(*_KEYS).agg(F.collect_set(F.struct("start", "size")).alias("marks"))


_REMOVED_DDL = "_id long, _hash long, n_removed long, n_spans long, kept binary, spans array<long>"


def _removed(docs: DataFrame, window: int, gram: int, levels: tuple[int, ...]) -> DataFrame:
    marks = stored(_marked(docs, window, gram, levels), "suffix-marks")
    return _wanted_texts(docs, marks).dropDuplicates(_KEYS).join(marks, _KEYS).mapInArrow(_remove(window), _REMOVED_DDL)


def _check(window: int, gram: int, levels: tuple[int, ...]) -> None:
    if gram & (gram - 1) or gram > window or levels[-1] != 1 or levels[0] > window or any(a % b for a, b in zip(levels, levels[1:])):
        raise ValueError("gram is a power of two within the window; levels divide one another down to 1")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the spans (byte offsets, flattened)."""
    _check(window, gram, levels)
    schema = pa.schema([("doc_id", pa.int64()), ("_id", pa.int64()), ("_hash", pa.int64()), ("n_bytes", pa.int64()), ("whole_sha256", pa.string())])

    def digests(batches):
        for batch in batches:
            blobs = blobs_of(batch.column("text"))
            yield record(
                schema, doc_id=batch.column("doc_id").cast(pa.int64()), _id=batch.column("_id"), _hash=batch.column("_hash"),
                n_bytes=[len(b) for b in blobs], whole_sha256=[hashlib.sha256(b).hexdigest() for b in blobs],
            )

    base = docs.select("doc_id", *row_key(), "text").mapInArrow(digests, "doc_id long, _id long, _hash long, n_bytes long, whole_sha256 string")
    cut = _removed(docs, window, gram, levels).withColumn("cut_sha256", F.sha2("kept", 256)).drop("kept")
    return base.join(cut, _KEYS, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<long>")).alias("spans"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """docs, all columns, with the repeated strings cut out of text and n_chars brought up to date.

    Where a cut goes through a character, the rest of that character goes too.
    """
    _check(window, gram, levels)

    @F.pandas_udf("string")
    def decoded(kept):
        return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    cut = _removed(docs, window, gram, levels).select(*_KEYS, decoded("kept").alias("_kept"))
    fresh = {"text": F.coalesce("_kept", "_row.text"), "n_chars": F.when(F.col("_kept").isNull(), F.col("_row.n_chars") if "n_chars" in docs.columns else None).otherwise(F.char_length("_kept"))}
    return with_row(docs).join(cut, _KEYS, "left").select(*[fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
