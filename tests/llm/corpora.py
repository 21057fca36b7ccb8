"""Small tables with every awkward case: nulls, empties, long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
#: Columns whose names the operators use for their own results.
CLASHING = ("n_words", "component_id", "sequence_id", "score", "hash", "_hash", "start", "length", "size", "key")


def frame(spark, rows, clash: bool = False):
    """rows: (doc_id, text, lang)."""
    full = [(i, t, lang, "src0", None if t is None else len(t)) for i, t, lang in rows]
    df = spark.createDataFrame(full, DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward(seed: int = 1):
    """Nulls, empties, unicode, repeats, near copies, shared passages and a long text."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    passage = sentence(rng, 110)
    near = base.split()
    near[60] = "changed"
    rows = [
        (5, base, "en"),
        (3, base, "en"),
        (9, " ".join(near), "en"),
        (5, base, "en"),  # a repeated row
        (11, None, "en"),
        (12, "", None),
        (13, "   \n\t ", "fr"),
        (14, "Ünï çødé ßtraße — 你好 " * 5, "de"),
        (None, "no id here, only a text of some words", None),
        (15, "one", "en"),
        (16, "ONE", "en"),
        (17, "aaaa" * 400, "en"),
        (18, sentence(rng, 30) + " " + passage + " " + sentence(rng, 25), "en"),
        (19, sentence(rng, 12) + "\n" + passage + "\n" + sentence(rng, 33), "en"),
        (20, sentence(rng, 40000, 5000), "en"),
        (21, "tail \x00 byte\x00", "en"),
        (-4, sentence(rng, 50), None),
    ]
    return rows
