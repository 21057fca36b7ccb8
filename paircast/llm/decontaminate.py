"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

The windows of all benchmark items go into a sorted hash set; a scan of the
documents looks up the windows of their words, compares the words of each hit
(so that hashes never decide) and marks the words inside. The set is broadcast
in blocks of at most `block` windows, which bounds a broadcast whatever the
benchmark's size; with several blocks the documents are scanned once for each
and their marks are united.

Cases: null or empty texts have no words and are not contaminated; items with
a null or wordless text have no windows; items repeated under one id count
once; a null item_id counts as the text 'null'; rows that repeat a document
each get their result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paircast.llm.common import ALNUM, U64, Words, blobs_of, id_key, portions, record, row_key, with_row

WINDOW = 13
#: Windows in one broadcast: about 200 bytes each, so 100 MB at most.
BLOCK_WINDOWS = 500_000

_WINDOWS = "size int, hash long, words binary, item string"
_MARKS = pa.schema(
    [("doc_id", pa.int64()), ("_hash", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]
)
_MARKS_DDL = "doc_id long, _hash long, n_words long, runs array<long>, items array<string>"


def _benchmark_windows(window: int):
    schema = pa.schema([("size", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("item", pa.string())])

    def run(batches):
        for batch in batches:
            items = batch.column("item").to_pylist()
            blobs = blobs_of(batch.column("text"))
            for part in portions(blobs):
                w = Words(blobs[part], ALNUM)
                rows = {"size": [], "hash": [], "words": [], "item": []}
                for i, item in enumerate(items[part]):
                    n = int(w.counts[i])
                    size = min(n, window)
                    for k in range(w.first[i], w.first[i] + n - size + 1) if n else ():
                        one = Words([b" ".join(w.word(j) for j in range(k, k + size))], ALNUM)
                        rows["size"].append(size)
                        rows["hash"].append(int(one.windows(size)[1].view(np.int64)[0]))
                        rows["words"].append(one.buffer[:-1])
                        rows["item"].append(item)
                yield record(schema, **rows)

    return run


def _scan(windows: dict[int, tuple[np.ndarray, list[bytes], list[tuple[str, ...]]]]):
    """windows: by size, sorted hashes with their words and items."""

    def run(batches):
        flags = {}
        for size, (hashes, _, _) in windows.items():
            flags[size] = np.zeros(1 << 20, bool)
            flags[size][(hashes >> U64(44)).astype(np.int64)] = True
        for batch in batches:
            blobs = blobs_of(batch.column("text"))
            for part in portions(blobs):
                w = Words(blobs[part], ALNUM)
                n_docs = len(w.counts)
                runs: list[list[int]] = [[] for _ in range(n_docs)]
                items: list[set[str]] = [set() for _ in range(n_docs)]
                cover = np.zeros(len(w.hash) + 1, np.int32)
                for size, (hashes, texts, owners) in windows.items():
                    at, h = w.windows(size)
                    may = np.flatnonzero(flags[size][(h >> U64(44)).astype(np.int64)])
                    at, h = at[may], h[may]
                    low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                    for i in np.flatnonzero(low < high):
                        k = int(at[i])
                        words = b" ".join(w.word(j) for j in range(k, k + size))
                        for j in range(low[i], high[i]):
                            if texts[j] == words:
                                cover[k] += 1
                                cover[k + size] -= 1
                                items[w.doc[k]].update(owners[j])
                hit = np.cumsum(cover[:-1]) > 0
                step = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
                # A run that reaches over a document's end is cut there.
                cuts = np.unique(np.concatenate([np.flatnonzero(step), w.first[:-1], w.first[1:]]))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if hit[a]:
                        d = int(w.doc[a])
                        runs[d] += [int(a - w.first[d]), int(b - w.first[d])]
                yield record(
                    _MARKS,
                    doc_id=batch.column("doc_id").cast(pa.int64())[part.start : part.stop],
                    _hash=batch.column("_hash")[part.start : part.stop],
                    n_words=w.counts,
                    runs=runs,
                    items=[sorted(x) for x in items],
                )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated and the word ranges hit.

    `runs` lists [first word, end) ranges, flattened; contaminated: at least one
    word in twenty is hit.
    """
    source = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    table = (
        source.mapInArrow(_benchmark_windows(window), _WINDOWS)
        .groupBy("size", "hash", "words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    n = table.count()
    blocks = max(1, -(-n // block))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key()[1])
    marks = []
    for b in range(blocks):
        part = table if blocks == 1 else table.where(F.pmod("hash", F.lit(blocks)) == b)
        by_size: dict[int, list] = {}
        for r in part.toLocalIterator():
            by_size.setdefault(r["size"], []).append((r["hash"] % 2**64, bytes(r["words"]), tuple(r["items"])))
        held = {}
        for size, rows in by_size.items():
            rows.sort(key=lambda r: r[0])
            held[size] = (np.array([r[0] for r in rows], np.uint64), [r[1] for r in rows], [r[2] for r in rows])
        marks.append(texts.mapInArrow(_scan(held), _MARKS_DDL))
    found = marks[0]
    if blocks > 1:
        found = _united(marks)
    found = found.withColumn("n_hit", F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "items",
        "runs",
        F.col("_hash").alias("text_hash"),
    )


def _united(marks: list[DataFrame]) -> DataFrame:
    """Marks of all blocks by document; a repeated document comes back as often as it was there."""
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    grouped = every.groupBy("doc_id", "_hash").agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_set("runs")).alias("all_runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count("*") / F.lit(len(marks))).cast("int").alias("copies"),
    )

    @F.pandas_udf("array<long>")
    def merged(column):
        return column.map(_merge)

    return grouped.select("doc_id", "_hash", "n_words", merged("all_runs").alias("runs"), "items", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def _merge(flat_runs) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(flat_runs[::2], flat_runs[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], int(b))
        else:
            out += [int(a), int(b)]
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs, all columns, without the contaminated rows."""
    found = contamination(docs, benchmark, **options).where("contaminated")
    bad = found.select(id_key().alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return with_row(docs).join(bad, ["_id", "_hash"], "left_anti").select("_row.*")


def cut_spans(text: str | None, runs) -> str | None:
    """The text without the words of `runs`, from the first to the last byte of each run."""
    if not text or not len(runs):
        return text
    blob = text.encode()
    w = Words([blob], ALNUM)
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2]):
        out.append(blob[at : w.start[a]])
        at = int(w.end[b - 1])
    return (b"".join(out) + blob[at:]).decode("utf-8", "ignore")
