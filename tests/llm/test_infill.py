import hashlib
import random
import re

from corpora import awkward, frame
from hypothesis import given, settings, strategies as st

from paircast.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
CODEC = infill.Codec()
TEXT = st.lists(st.sampled_from(["a", "word", " ", "\n", "  ", "é", "你好", "\t", "<P", ">", "<S>", "\x85", "\x00", "𝄞", "x" * 9]), max_size=30).map("".join)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    """By the definition, without frames."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(output), sha(text)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 12), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.sampled_from([0, 90]))
def test_any_frames_and_cuts(text, frame_bytes, h1, h2, h4):
    blob = text.encode()
    frames, units, points = infill.cut_frames(blob, CODEC, frame_bytes)
    assert b"".join(map(CODEC.decompress, frames)) == blob
    own = UNIT.findall(text)
    assert (units[-1], points[-1]) == (len(own), len(text)) and "".join(own) == text
    marked = any(m in blob for m in infill.MARKS)
    n, form, prefix_chars, middle_chars, output = infill.rearranged(frames, units, points, marked, [h1, h2, 0, h4], CODEC)
    assert infill.restore(output, form) == text
    if form == "plain":
        assert marked or not text
        return
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (own[:low], own[low:high], own[high:]))
    assert (prefix_chars, middle_chars) == (len(prefix), len(middle))
    want = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 == 0 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    assert b"".join(infill.Output(output, CODEC).read()).decode() == want


def test_a_cut_decompresses_one_frame():
    text = " ".join(f"w{i}" for i in range(5000))
    frames, units, points = infill.cut_frames(text.encode(), CODEC, 1000)
    assert len(frames) > 20
    opened = []

    class Counting(infill.Codec):
        def __init__(self):
            super().__init__()
            own = self.decompress
            self.decompress = lambda f: opened.append(f) or own(f)

    *_, output = infill.rearranged(frames, units, points, False, [1200, 3100, 0, 0], Counting())
    assert len(set(opened)) == 2
    assert sum(f in frames for f in output) == len(frames) - 2  # all others are taken over as they are


def test_rate_of_forms():
    rng = random.Random(1)
    forms = [infill.form_of(rng.getrandbits(32), rng.getrandbits(32), False, False) for _ in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.5) < 0.04 and abs(forms.count("spm") / 4000 - 0.4) < 0.04


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def test_awkward_documents(spark):
    docs = awkward() + [(100 + i, t, "en") for i, t in enumerate(["has <P> in it", "<M>", "tail  ", " lead", "a b", "<P <S <M"] * 3)]
    for frame_bytes in (7, infill.FRAME_BYTES):
        rows = infill.infill_digests(frame(spark, docs, clash=True), frame_bytes).collect()
        assert sorted(map(tuple, rows), key=key) == sorted((expected(d[0], d[1]) for d in docs), key=key)


def test_empty_table(spark):
    assert infill.infill_digests(frame(spark, [])).collect() == []
