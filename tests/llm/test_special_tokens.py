"""Against the tokenizer files as the library loads them, nothing switched."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from corpora import frame
from hypothesis import given, settings, strategies as st
from test_tokens import FILES, PARTS
from tokenizers import Tokenizer

from paircast.llm import packing, token_files, tokens

LIBRARY = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in FILES}
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext", "|>", "<"]
TEXTS = [None, "", "plain text", "a <|endoftext|> b", "<|endoftext|>", "<|ENDOFTEXT|> b", "one<|endoftext|><|startoftext|>two, three", "last"]


def library_ids(name, text):
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS + SPECIAL * 3), max_size=14))
def test_same_ids_as_the_unmodified_library(name, parts):
    text = "".join(parts)
    assert np.frombuffer(tokens.encode_whole(public_tokenizers.path(name), text), "<u4").tolist() == library_ids(name, text)


def test_files_hold_special_tokens(spark, tmp_path):
    name, start = "byte_bpe_50k.json", 0
    manifest = token_files.write_tokens(frame(spark, [(i, t, "en") for i, t in enumerate(TEXTS)]), public_tokenizers.path(name), 2, f"file://{tmp_path}/t")
    rows = token_files.read_tokens(manifest).orderBy("start").collect()
    for r, text in zip(rows, TEXTS, strict=True):
        ids = np.array([*library_ids(name, text), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packed_documents_hold_special_tokens(spark):
    name = "word_bpe_49k.json"
    rows = packing.packed_documents(frame(spark, [(i, t, "en") for i, t in enumerate(TEXTS)]), public_tokenizers.path(name)).collect()
    want = {i: np.array([*library_ids(name, t), 0], "<u4") for i, t in enumerate(TEXTS)}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {i: (len(ids), zlib.crc32(ids.tobytes())) for i, ids in want.items()}
