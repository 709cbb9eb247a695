import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from helpers import EDGE, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from probeweave.llm import tokenfile
from probeweave.llm.common import Steps

PATH = public_tokenizers.path("word_bpe_49k.json")
IDS = st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(IDS, st.integers(1, 90)), max_size=40))
def test_round_trip(parts):
    ids = np.array([i for i, n in parts for _ in range(n if i % 3 == 0 else 1)], dtype=np.uint64)
    assert (tokenfile.unpack(tokenfile.pack(ids), len(ids)) == ids).all()


def test_words_are_as_full_as_the_cuts_allow():
    assert len(tokenfile.pack(np.arange(2**14, 2**14 + 400))) == 8 * 100
    assert len(tokenfile.pack(np.zeros(10_000, np.uint64))) == 8
    assert len(tokenfile.pack(np.full(1, 2**63, np.uint64))) == 16


@pytest.mark.parametrize("text", [t for _, t, _, _ in EDGE if t and len(t) < 10_000] + ["It's we'll 'S x²y ½ª µ", "áb", "ΑΣ ΟΔΟΣ", "K Å ſ", "don't\x85stop\xa0now", "ĲŉǅİI", "a<|endoftext|>b", "<| x", "\x1f\x1c a"])
def test_words_as_the_tokenizer_encodes_them(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(tokenfile.WordEncoder(PATH).encode(text), "<u4").tolist() == want


def check(spark, table):
    path = Steps(spark, "test").path()
    tokenfile.write_tokens(docs(spark, table), path, PATH)
    got = sorted(tokenfile.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    tokenizer, start = Tokenizer.from_file(PATH), 0
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in table), key=lambda i: (i is not None, i or 0))
    left = {}
    for i, t, *_ in table:
        left.setdefault(i, []).append(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]))
    for r in got:
        ids = tuple(np.frombuffer(r["ids"], "<u4").tolist())
        left[r["doc_id"]].remove(ids)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_of_edge_rows(spark):
    check(spark, EDGE)


def test_files_of_the_small_table(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 500)
    check(spark, [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()])


def test_empty_table(spark):
    path = Steps(spark, "test").path()
    tokenfile.write_tokens(docs(spark, []), path, PATH)
    assert tokenfile.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("text", ["Hello World  foo", "It's we'll\n x", "a<|endoftext|>b", "Ünïcödé 中文"])
def test_any_other_tokenizer_encodes_whole_texts(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(tokenfile.WordEncoder(path).encode(text), "<u4").tolist() == want
    assert tokenfile.WordEncoder(PATH).wordwise and not tokenfile.WordEncoder(path).wordwise
