"""Token ids in binary files with Elias-Fano document boundaries.

Documents are range-sorted by doc_id; every partition encodes its texts and
writes files of one concatenated id array (16 bits an id where the vocabulary
allows it), followed by the doc_ids and the document boundaries, both
Elias-Fano coded, and a fixed trailer. A file ends after `file_ids` ids. The
manifest lists the files in order of doc_id; only files of finished tasks are
in it, so a lost or repeated task leaves at most a file that nobody reads.
Files go through pyarrow's file systems below the given folder, which all
executors must share.

Cases: a null text is empty (its only id is the end id); null doc_ids come
first and stay null; rows that repeat a document are all written; an empty
table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paircast.llm.common import partitions, record
from paircast.llm.elias_fano import EliasFano
from paircast.llm.tokens import encode_whole
from paircast.session import scratch_path, stored

MAGIC = b"PCTOKEN1"
#: magic, ids, documents, null doc_ids, smallest doc_id, bytes of an id, bytes of both codes
_TRAILER = struct.Struct("<8sQQQqBQQ")
FILE_IDS = 1 << 25

_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])
_MANIFEST_DDL = "part int, file int, path string, n_ids long, n_docs long"
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_ROWS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Writer:
    """One file; ids are written as they come, boundaries at the end."""

    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width
        self.system, self.place = fs.FileSystem.from_uri(path)
        self.system.create_dir(self.place.rpartition("/")[0], recursive=True)
        self.stream = self.system.open_output_stream(self.place)
        self.doc_ids: list[int] = []
        self.bounds = [0]
        self.nulls = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.stream.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.bounds.append(self.bounds[-1] + len(ids))
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self) -> None:
        first = self.doc_ids[0] if self.doc_ids else 0
        names = EliasFano.encode(np.array([i - first for i in self.doc_ids], np.uint64)).to_bytes()
        bounds = EliasFano.encode(np.array(self.bounds, np.uint64)).to_bytes()
        self.stream.write(names + bounds)
        self.stream.write(_TRAILER.pack(MAGIC, self.bounds[-1], len(self.bounds) - 1, self.nulls, first, self.width, len(names), len(bounds)))
        self.stream.close()


class Reader:
    """Random access to a file: `document(i)` reads that document's ids only."""

    def __init__(self, path: str) -> None:
        system, place = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        magic, self.n_ids, self.n_docs, self.nulls, self.first, self.width, n_names, n_bounds = _TRAILER.unpack(self.file.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        codes = self.file.read_at(n_names + n_bounds, self.n_ids * self.width)
        self.names, self.bounds = EliasFano.from_bytes(codes[:n_names]), EliasFano.from_bytes(codes[n_names:])

    def ids(self, begin: int, end: int) -> np.ndarray:
        data = self.file.read_at((end - begin) * self.width, begin * self.width)
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds.select(i, 2)
        return self.ids(int(begin), int(end))

    def doc_ids(self, first: int, count: int) -> list[int | None]:
        nulls = max(0, min(self.nulls - first, count))
        at = max(first - self.nulls, 0)
        return [None] * nulls + (self.names.select(at, count - nulls) + self.first).tolist()

    def close(self) -> None:
        self.file.close()


def _write(folder: str, tokenizer: str, end_id: int, width: int, file_ids: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        out: Writer | None = None
        done: list[Writer] = []
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist()):
                if out is None:
                    out = Writer(f"{folder}/{part:07d}-{len(done):05d}-{uuid.uuid4().hex}.bin", width)
                out.add(doc_id, np.frombuffer(encode_whole(tokenizer, text) + end, "<u4"))
                if out.bounds[-1] >= file_ids:
                    out.close()
                    done.append(out)
                    out = None
        if out is not None:
            out.close()
            done.append(out)
        yield record(
            _MANIFEST, part=[part] * len(done), file=range(len(done)), path=[w.path for w in done], n_ids=[w.bounds[-1] for w in done], n_docs=[len(w.bounds) - 1 for w in done]
        )

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, width: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Write token files below a shared folder; returns the stored manifest with each file's first id."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.asc("doc_id")).sortWithinPartitions("doc_id")
    manifest = stored(ordered.mapInArrow(_write(folder, tokenizer, end_id, width, file_ids), _MANIFEST_DDL), "token-manifest")
    # One row per file: small however large the corpus is.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(group_ids: int = 1 << 20):
    def run(batches):
        for batch in batches:
            for path, first_id in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist()):
                reader = Reader(path)
                at = 0
                while at < reader.n_docs:
                    bounds = reader.bounds.select(at, min(4096, reader.n_docs - at) + 1)
                    n = max(1, int(np.searchsorted(bounds, bounds[0] + group_ids, "right")) - 1)
                    bounds = bounds[: n + 1]
                    ids = reader.ids(int(bounds[0]), int(bounds[-1]))
                    cuts = bounds - bounds[0]
                    yield record(
                        _ROWS,
                        doc_id=reader.doc_ids(at, n),
                        start=bounds[:-1] + first_id,
                        n_tokens=np.diff(bounds),
                        ids_crc32=[zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])],
                    )
                    at += n
                reader.close()

    return run


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    spread = manifest.select("path", "first_id").repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(_read(), _ROWS_DDL)


def token_folder(spark: SparkSession) -> str:
    folder = scratch_path(spark, "token-files")
    return folder if "://" in folder else folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") else f"file://{folder}"
