from __future__ import annotations

import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.tokenize import TOKENIZER_DIR, encode_array, load, token_ids


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return lambda texts: [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


TEXT = st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x85 　'’s.,-é—🙂漢12ab"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_ids_equal_the_library(library, texts):
    assert encode_array(pa.array(texts, pa.string())).to_pylist() == library(texts)


def test_defined_and_long_texts(library):
    texts = [None, "", " ", "  \n ", "a" * 20000, "Haus " * 20000, "<|endoftext|> don't", " ", "x\r\n\r\n y"]
    got = encode_array(pa.array(texts, pa.string())).to_pylist()
    assert got[:2] == [[], []] and got == library(texts)
    assert encode_array(pa.array(texts, pa.string()).slice(5, 3)).to_pylist() == library(texts[5:8])


def test_ids_decode_to_the_text():
    encoder, _ = load()
    text = "Die Straße — „Ödön“ hörte\r\n\r\n  1922 Grüße 🙂"
    assert encoder.decode(encode_array(pa.array([text])).to_pylist()[0]) == text


def test_certain_cuts_are_certain():
    encoder, cut = load()
    for token in encoder.token_byte_values():
        assert not any(cut[a * 256 + b] for a, b in zip(token, token[1:]))


def test_table(spark, library):
    rows = [(1, "a b", "k"), (1, "a b", "k"), (2, None, "k"), (None, "", "k"), (3, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.ids) for r in token_ids(df, "doc_id", "text").collect()), key=str)
    assert got == sorted(((r[0], ids) for r, ids in zip(rows, library([r[1] for r in rows]))), key=str)
    assert token_ids(df.limit(0), "doc_id", "text").collect() == []
