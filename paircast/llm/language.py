"""Language identification by compression.

For every language a zstandard raw-content dictionary is built from a bounded
sample of labelled rows. A text, lower-cased and without digits and marks, is
cut into blocks; each block is compressed with every dictionary, and the
language whose dictionary leaves the fewest bytes wins. Blocks keep a long
text from becoming its own dictionary. A narrow relative margin to the
runner-up marks a prediction as rejected; a text too short to leave EVIDENCE
compressed bytes has no margin to speak of and is not.

Cases: null texts and texts without a letter are `und`, score 0, rejected;
equal sizes go to the language with more labelled rows, then by name; without
labelled rows everything is `und`; rows are judged one by one, so repeats and
other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from paircast.llm.common import give_back, with_row

UNKNOWN = "und"
#: The sample: rows for each language, characters of each row.
SAMPLE_ROWS, SAMPLE_CHARS = 256, 512
BLOCK = 4096
#: Smallest relative margin of the best to the second size that is not narrow, and the least bytes to judge it.
MARGIN, EVIDENCE = 0.004, 64

_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")
_SETTINGS = {"window_log": 19, "chain_log": 17, "hash_log": 17, "search_log": 4, "min_match": 4, "strategy": zstandard.STRATEGY_LAZY2}


def normal(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """A dictionary's content for each language from at most `rows` slices of `chars` characters.

    labelled: text, lang. Rows are taken in the order of a hash of the text,
    the slice of a row begins at a place that the hash gives.
    """
    h = F.xxhash64("text")
    room = F.greatest(F.char_length("text") - chars, F.lit(0)) + 1
    cut = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", h.alias("h"), F.expr("text").substr((F.pmod(h, room) + 1).cast("int"), F.lit(chars)).alias("slice")
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "slice"))
    known = {r["lang"]: r["count"] for r in cut.groupBy("lang").count().collect()}  # one row per language
    out: dict[str, list] = {}
    for r in cut.withColumn("n", rank).where(F.col("n") <= rows).select("lang", "n", "slice").collect():  # at most `rows` per language
        out.setdefault(r["lang"], []).append((r["n"], r["slice"]))
    order = sorted(out, key=lambda lang: (-known[lang], lang))
    return {lang: normal("\n".join(s for _, s in sorted(out[lang]))) for lang in order}


class Sizer:
    """Compressed sizes of a text, one for each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = list(dictionaries)
        self.compressors = []
        settings = zstandard.ZstdCompressionParameters(**_SETTINGS, write_checksum=0, write_content_size=0, write_dict_id=0)
        for content in dictionaries.values():
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=own, compression_params=settings))

    def sizes(self, text: str) -> np.ndarray:
        blob = normal(text)
        blocks = [blob[i : i + BLOCK] for i in range(0, len(blob), BLOCK)]
        return np.array([sum(len(c.compress(b)) for b in blocks) for c in self.compressors], float)


def classifier(dictionaries: dict[str, bytes], margin: float = MARGIN, evidence: int = EVIDENCE):
    """A column function: text -> struct(lang, score, rejected)."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizer = Sizer(dictionaries)
        for texts in batches:
            give_back()
            rows = []
            for text in texts:
                if text is None or not sizer.names or not _LETTER.search(text):
                    rows.append((UNKNOWN, 0.0, True))
                    continue
                sizes = sizer.sizes(text)
                best = int(np.argmin(sizes))
                second = np.delete(sizes, best).min() if len(sizes) > 1 else np.inf
                narrow = sizes[best] >= evidence and second - sizes[best] < margin * second
                # A byte more or less counts half a nat.
                rows.append((sizer.names[best], float(1 / np.exp((sizes[best] - sizes) / 2).sum()), bool(narrow)))
            yield pd.DataFrame(rows, columns=["lang", "score", "rejected"])

    return judge


def identify(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """doc_id, lang_pred, score and rejected per row of docs."""
    judged: Column = classifier(fit(labelled), **options)("text")
    return docs.select("doc_id", judged.alias("_j")).select(
        "doc_id", F.col("_j.lang").alias("lang_pred"), F.col("_j.score").alias("score"), F.col("_j.rejected").alias("rejected")
    )


def without_rejected(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """docs, all columns, without the rows whose language is rejected."""
    judged = classifier(fit(labelled), **options)("_row.text")
    return with_row(docs).select("_row", judged.alias("_language")).where(~F.col("_language.rejected")).select("_row.*")
