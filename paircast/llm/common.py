"""What the corpus operators share: byte-level words, hashes and batches.

Texts are handled as UTF-8 bytes in numpy, a few megabytes at a time, inside
Arrow batches that Spark deals out. A null text counts as empty unless an
operator says otherwise.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text worked on at once; one longer text makes a batch of its own.
BATCH_BYTES = 3 << 19
#: The same where several arrays hold eight bytes for each byte of text: they stay below 30 MB and in the caches.
PORTION_BYTES = 1 << 18
#: Bytes of an Arrow batch where operators follow each other in the same workers.
ARROW_BYTES = "4m"
#: Stands for a null doc_id in joins, which would lose nulls.
NULL_ID = -(2**63)

U64 = np.uint64
#: glibc's call that returns freed memory, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
#: A random 64-bit code for every byte value.
CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes from here on: rows alone (10,000) say nothing of what long texts take beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def id_key() -> Column:
    """doc_id as a join key that keeps nulls."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def row_key() -> list[Column]:
    """Names a document in joins: its id and a hash of its text.

    Rows equal in both are one document stored more than once.
    """
    return [id_key().alias("_id"), F.xxhash64("text").alias("_hash")]


def with_row(docs: DataFrame) -> DataFrame:
    """Each row of docs as one struct `_row` beside its key, so that no name of docs meets one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key())


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up[:n], self.down[:n]
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, out=up), np.cumprod(down, out=down)
        if n <= 2 * BATCH_BYTES:  # those of one very long text are not kept
            self.up, self.down = up, down
        return up, down


_powers = _Powers()


def _table(word_byte) -> np.ndarray:
    """Lower-case byte for each byte of a word, 0 for the bytes between words."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if word_byte(low):
            table[b] = low or 255  # 255 is no byte of UTF-8
    return table


#: Words are digits, letters and everything beyond ASCII.
ALNUM = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Words are whatever stands between white space.
SPACED = _table(lambda b: b != 32 and not 9 <= b <= 13)


class Words:
    """The words of some texts: place, document, 64-bit hash."""

    def __init__(self, blobs: list[bytes], table: np.ndarray) -> None:
        self.buffer = b" ".join(blobs) + b" "
        self.low = table[np.frombuffer(self.buffer, np.uint8)]
        inside = np.zeros(len(self.low) + 1, np.int8)
        inside[1:] = self.low != 0
        edges = np.flatnonzero(np.diff(inside))
        self.start, self.end = edges[::2], edges[1::2]
        sizes = np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))
        self.doc_start = np.concatenate([[0], np.cumsum(sizes)])
        #: index of each document's first word, and the end
        self.first = np.searchsorted(self.start, self.doc_start)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(blobs)), self.counts)
        up, down = _powers.get(len(self.low))
        sums = np.zeros(len(self.low) + 1, np.uint64)
        np.cumsum(CODE[self.low] * up, out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start]) if len(self.start) else np.zeros(0, np.uint64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of `size` words in one document."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total *= U64(0xD6E8FEB86659FD93)
            total += self.hash[k : k + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, mix(total[at] + U64(size))

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def words_of(text: str, table: np.ndarray) -> list[bytes]:
    w = Words([text.encode()], table)
    return [w.word(i) for i in range(len(w.start))]


def give_back() -> None:
    """Return memory that earlier batches and tasks of this worker have freed to the system.

    Workers live on between tasks and stages beside the executor's heap.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def blobs_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    give_back()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def portions(blobs: list[bytes], limit: int = BATCH_BYTES) -> Iterator[slice]:
    """Runs of texts of about `limit` bytes."""
    begin = size = 0
    for i, b in enumerate(blobs):
        if size and size + len(b) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(b) + 1
    if begin < len(blobs):
        yield slice(begin, len(blobs))


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from columns by name, in the order of the schema."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema], schema=schema
    )


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(modulus: int, *values: int) -> Column:
    """Whether crc32 of doc_id as text leaves one of the remainders; null ids count as text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(modulus)).isin(*values)
