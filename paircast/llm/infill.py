"""Fill-in-the-middle texts from seekable compressed frames.

A text is stored as independent zstandard frames of at most `frame_bytes` bytes
with the units and code points that end before each of them. A cut after
some unit decompresses the one frame in which that unit ends; all other frames
of a prefix, middle or suffix go into the output as they are, still
compressed, and only the two parts of a cut frame are compressed anew. Digests
stream the frames in their order, so a worker holds one frame at a time besides the
compressed text. The exact text comes back from the output alone: the three
marks are looked up in it, and the parts between them put in order.

Cases: a null text is empty and stays plain; a null doc_id counts as the text
'null' in the hash; rows that repeat a document each get their result; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from paircast.llm.common import SPACED, record
from paircast.session import stored

FRAME_BYTES = 1 << 16
#: Bytes of finished rows in one Arrow batch.
OUT_BYTES = 1 << 22
SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

_COUNT = pa.list_(pa.int64())
_STORE = pa.schema([("doc_id", pa.int64()), ("frames", pa.list_(pa.binary())), ("units", _COUNT), ("points", _COUNT), ("marked", pa.bool_())])
_STORE_DDL = "doc_id long, frames array<binary>, units array<long>, points array<long>, marked boolean"
_FORMS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))]
)
_FORMS_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
_DIGESTS = pa.schema([*list(_FORMS)[:-1], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
_DIGESTS_DDL = _FORMS_DDL.replace("output array<binary>", "output_sha256 string, restored_sha256 string")


def _points(blob: np.ndarray) -> int:
    return int(np.count_nonzero((blob & 0xC0) != 0x80))


def _ends(blob: bytes, more: bool) -> np.ndarray:
    """Byte offsets in a piece of text after which a unit's last word byte stands.

    `more`: a word at the end of the piece goes on in the next one.
    """
    inside = np.zeros(len(blob) + 1, np.int8)
    inside[:-1] = SPACED[np.frombuffer(blob, np.uint8)] != 0
    ends = np.flatnonzero(np.diff(inside) == -1) + 1
    return ends[:-1] if more and len(ends) and ends[-1] == len(blob) else ends


class Codec:
    """The contexts of a task; each is costly to make."""

    def __init__(self) -> None:
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.decompress = zstandard.ZstdDecompressor().decompress


def cut_frames(blob: bytes, codec: Codec, frame_bytes: int = FRAME_BYTES) -> tuple[list[bytes], list[int], list[int]]:
    """Independent frames of a text, and the units and code points that end before each frame and in all.

    Frames end between code points, not necessarily between units. White space
    at the end of the text is a unit of its own.
    """
    frames, units, points = [], [0], [0]
    at = 0
    while at < len(blob):
        end = min(at + frame_bytes, len(blob))
        while end < len(blob) and end > at and blob[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:  # a frame smaller than a code point
            end = next((i for i in range(at + 1, len(blob)) if blob[i] & 0xC0 != 0x80), len(blob))
        piece = blob[at:end]
        frames.append(codec.compress(piece))
        units.append(units[-1] + len(_ends(piece, end < len(blob) and bool(SPACED[blob[end]]))))
        points.append(points[-1] + _points(np.frombuffer(piece, np.uint8)))
        at = end
    if blob and not SPACED[blob[-1]]:
        units[-1] += 1
    return frames, units, points


def _store(frame_bytes: int):
    def run(batches):
        codec = Codec()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                blob = text.as_buffer().to_pybytes() if text.is_valid else b""
                rows.append((doc_id, *cut_frames(blob, codec, frame_bytes), any(m in blob for m in MARKS)))
                size += sum(map(len, rows[-1][1]))
                if size > OUT_BYTES:
                    yield record(_STORE, **dict(zip(_STORE.names, zip(*rows))))
                    rows, size = [], 0
            if rows:
                yield record(_STORE, **dict(zip(_STORE.names, zip(*rows))))

    return run


def frame_store(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Every text as independent frames: doc_id, frames, units and points before each frame and in all, marked.

    `marked`: the text holds one of the marks, so it must stay plain.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store(frame_bytes), _STORE_DDL)


class Cutter:
    """Cuts one stored text after a number of units."""

    def __init__(self, frames: list[bytes], units: list[int], points: list[int], codec: Codec) -> None:
        self.frames, self.units, self.points, self.codec = frames, units, points, codec

    def place(self, unit: int) -> tuple[int, int, int]:
        """Frame, byte in it and code points of the text where `unit` units have ended."""
        if unit == 0:
            return 0, 0, 0
        if unit >= self.units[-1]:
            return len(self.frames), 0, self.points[-1]
        # The unit ends in the last frame before which fewer units have ended.
        k = bisect_left(self.units, unit) - 1
        blob = self.codec.decompress(self.frames[k])
        at = int(_ends(blob, False)[unit - self.units[k] - 1])
        return k, at, self.points[k] + _points(np.frombuffer(blob[:at], np.uint8))

    def part(self, begin: tuple[int, int, int], end: tuple[int, int, int]) -> list[bytes]:
        """Frames of the text between two places; whole frames are not decompressed."""
        (a, x, _), (b, y, _) = begin, end
        if a == b:
            return self._piece(a, x, y)
        head = self._piece(a, x, None) if x else self.frames[a : a + 1]
        return head + self.frames[a + 1 : b] + self._piece(b, 0, y)

    def _piece(self, k: int, begin: int, end: int | None) -> list[bytes]:
        if k == len(self.frames) or begin == end:
            return []
        piece = self.codec.decompress(self.frames[k])[begin:end]
        return [self.codec.compress(piece)] if piece else []


def form_of(h3: int, h4: int, empty: bool, marked: bool, rate: int = RATE, spm: int = SPM) -> str:
    if empty or marked or h3 % 100 >= rate:
        return "plain"
    return "spm" if h4 % 100 < spm else "psm"


def rearranged(frames: list[bytes], units: list[int], points: list[int], marked: bool, hashes: list[int], codec: Codec, rate: int = RATE, spm: int = SPM) -> tuple:
    """n, form, prefix_chars, middle_chars and the frames of the output."""
    n = units[-1]
    form = form_of(hashes[2], hashes[3], not frames, marked, rate, spm)
    if form == "plain":
        return n, form, None, None, frames
    cutter = Cutter(frames, units, points, codec)
    low, high = sorted((hashes[0] % (n + 1), hashes[1] % (n + 1)))
    start, first, second, end = (cutter.place(u) for u in (0, low, high, n))
    prefix, middle, suffix = cutter.part(start, first), cutter.part(first, second), cutter.part(second, end)
    marks = [codec.compress(m) for m in MARKS]
    if form == "psm":
        output = [marks[0], *prefix, marks[1], *suffix, marks[2], *middle]
    else:
        output = [marks[1], *suffix, marks[0], *prefix, marks[2], *middle]
    return n, form, first[2], second[2] - first[2], output


def _rearrange(rate: int, spm: int):
    def run(batches):
        codec = Codec()
        for batch in batches:
            rows, size = [], 0
            columns = [batch.column(c).to_pylist() for c in (*_STORE.names, "hashes")]
            for doc_id, frames, units, points, marked, hashes in zip(*columns):
                rows.append((doc_id, *rearranged(frames, units, points, marked, hashes, codec, rate, spm)))
                size += sum(map(len, rows[-1][-1]))
                if size > OUT_BYTES:
                    yield record(_FORMS, **dict(zip(_FORMS.names, zip(*rows))))
                    rows, size = [], 0
            if rows:
                yield record(_FORMS, **dict(zip(_FORMS.names, zip(*rows))))

    return run


def hashes(seed: int) -> Column:
    """The first four 8-digit groups of sha256('seed:doc_id') as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))).alias("hashes")


def infilled(store: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """Stored texts, rearranged: doc_id, n, form, prefix_chars, middle_chars and the output's frames."""
    return store.select(*_STORE.names, hashes(seed)).mapInArrow(_rearrange(rate, spm), _FORMS_DDL)


class Output:
    """An output text that is read from its frames, a frame at a time."""

    def __init__(self, frames: list[bytes], codec: Codec) -> None:
        self.frames, self.codec = frames, codec
        self.begin = np.cumsum([0, *(zstandard.frame_content_size(f) for f in frames)]).tolist()

    def read(self, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
        end = self.begin[-1] if end is None else end
        k = max(bisect_right(self.begin, begin) - 1, 0)
        while k < len(self.frames) and self.begin[k] < end:
            own = self.begin[k]
            yield self.codec.decompress(self.frames[k])[max(begin - own, 0) : end - own]
            k += 1

    def find(self, *marks: bytes) -> list[int]:
        """Where the marks first stand, in this order, one after the other."""
        found: list[int] = []
        tail, at = b"", 0  # what may be the beginning of a mark, and its place
        for piece in self.read():
            piece = tail + piece
            look = 0
            while len(found) < len(marks) and (hit := piece.find(marks[len(found)], look)) >= 0:
                found.append(at + hit)
                look = hit + len(marks[len(found) - 1])
            keep = max(look, len(piece) - max(map(len, marks)) + 1)
            tail, at = piece[keep:], at + keep
        if len(found) < len(marks):
            raise ValueError("an output without its marks")
        return found

    def restored(self, form: str) -> Iterator[bytes]:
        """The original text from the output's text and its form."""
        if form == "plain":
            yield from self.read()
            return
        first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
        a, b, c = self.find(first, second, MIDDLE)
        one, two, middle = (a + len(first), b), (b + len(second), c), (c + len(MIDDLE), None)
        prefix, suffix = (one, two) if form == "psm" else (two, one)
        for part in (prefix, middle, suffix):
            yield from self.read(*part)


def _sha256(pieces: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def _digest(batches):
    codec = Codec()
    for batch in batches:
        kept = [batch.column(c) for c in _FORMS.names[:-1]]
        made, restored = [], []
        for form, frames in zip(batch.column("form").to_pylist(), batch.column("output")):
            output = Output(frames.as_py(), codec)
            made.append(_sha256(output.read()))
            restored.append(made[-1] if form == "plain" else _sha256(output.restored(form)))
        yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.string()), pa.array(restored, pa.string())], schema=_DIGESTS)


def digests(forms: DataFrame) -> DataFrame:
    """forms with output_sha256 and restored_sha256 in place of the frames."""
    return forms.select(*_FORMS.names).mapInArrow(_digest, _DIGESTS_DDL)


def restore(frames: list[bytes], form: str) -> str:
    """One document's text from its output frames."""
    return b"".join(Output(frames, Codec()).restored(form)).decode()


def infill_digests(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the frame store, rearrange the texts from it, and digest what comes out."""
    return digests(infilled(stored(frame_store(docs, frame_bytes), "infill-frames")))
