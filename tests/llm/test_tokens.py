import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpora import awkward, frame
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from paircast.llm import token_files, tokens
from paircast.llm.elias_fano import EliasFano

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PARTS = ["a", "B", "word", " ", "  ", "\n", "\t", "'s", "é", "é", "́", "1", "23", ".", ",", "...", ").", "--", " ", " ", "Σ", "ς", "你", "\x85", "\x1c", "<|endoftext|>", "­", "​", "ß", "İ", "×", "²", "/", "@", "ÀÉ", "ẞ", "Ā", "Ⱥ", "ǅ"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_same_ids_as_the_library(name, parts):
    text = "".join(parts)
    want = library_cache(name).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.encode(public_tokenizers.path(name), text), "<u4").tolist() == want


_LIBRARY = {}


def library_cache(name):
    return _LIBRARY.setdefault(name, library(name) if name not in _LIBRARY else None)


def test_elias_fano_round_trip():
    rng = random.Random(5)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for top in (0, 1, 50, 10**6, 10**12):
            values = sorted(rng.randrange(top + 1) for _ in range(n))
            code = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.uint64)).to_bytes())
            assert code.select(0, n).tolist() == values
            for _ in range(20 if n else 0):
                a = rng.randrange(n)
                c = rng.randrange(1, n - a + 1)
                assert code.select(a, c).tolist() == values[a : a + c]
            if n == 3000:  # near the lower bound of 2 + log2(u / n) bits, samples included
                assert 8 * len(code.to_bytes()) < n * (2.3 + np.log2((top + 1) / n + 1) + 32 / 256 + 1)


def test_files_round_trip(spark, tmp_path):
    docs = awkward()
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_files.write_tokens(frame(spark, docs, clash=True), path, 2, f"file://{tmp_path}/t", file_ids=300)
    assert manifest.count() > 3
    rows = token_files.read_tokens(manifest).orderBy("start").collect()
    t = library("byte_bpe_50k.json")
    want, start = {}, 0
    for doc_id, text, _ in docs:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in rows] == sorted((d[0] for d in docs), key=lambda i: (i is not None, i or 0))
    for r in rows:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    reader = token_files.Reader(manifest.orderBy("first_id").first().path)
    assert reader.document(0).tolist() == reader.ids(0, int(reader.bounds.select(1)[0])).tolist()


def test_empty_table(spark, tmp_path):
    manifest = token_files.write_tokens(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/t")
    assert token_files.read_tokens(manifest).count() == 0


def test_registered_query(spark, sf_dir):
    from paircast.llm.queries import QUERIES

    t = library("byte_bpe_50k.json")
    start = 0
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(t.encode(d.text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(got[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_words_of_letters_go_straight_to_the_merges(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = tokens._Ids(library("byte_bpe_50k.json"))
    asked = []

    class Asked:
        def encode(self, text, **options):
            asked.append(text)
            return library_cache("byte_bpe_50k.json").encode(text, **options)

    ids.tokenizer = Asked()
    monkeypatch.setattr(tokens, "_ids", lambda path: ids)
    text = "Étude naïve\nŒuvre chez ré\nWord after word, l'été"
    got = np.frombuffer(tokens.encode(path, text), "<u4").tolist()
    assert got == library_cache("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    assert sorted(asked) == ["\n", " l'été", ","]


def test_texts_that_the_plain_cut_must_not_meet():
    odd = re.compile("(?:^|[ \n])(?=[ \n]|$)|[^ \n!-~¡-ɏ]|İ|(?<![A-Za-z0-9À-ÖØ-öø-ɏ.,])[.,]")
    deal = random.Random(7)
    for _ in range(20000):
        text = "".join(deal.choices("ab Z9.,\n!×÷éİįıɏɐ ́\t-¡", k=deal.randint(1, 7)))
        assert tokens._odd(text) == bool(odd.search(text)), repr(text)
