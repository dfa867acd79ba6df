"""Token counts and BPE ids against the library itself."""

import hashlib
import sys
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelwright.llm import bpe, token_counts
from reelwright.llm.common import tokenizer

from .conftest import AWKWARD

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def test_counts_on_documents_and_awkward_rows(awkward, documents):
    for docs in (awkward, documents.select("doc_id", "text")):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = sorted(((-1 if i is None else i), len((t or "").encode()), len(library(BYTES, t))) for i, t in texts)
        got = token_counts.count_tokens(docs, BYTES, 1024).collect()
        assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_every_proved_string_is_one_token():
    whole = token_counts.prove_whole_tokens(BYTES)
    assert 40_000 < len(whole) <= 50_257
    model = tokenizer(BYTES).model
    assert all(len(model.tokenize(v)) == 1 for v in list(whole)[:2000])


def test_ids_and_round_trip_on_documents_and_awkward_rows(awkward, documents):
    for docs in (awkward, documents.select("doc_id", "text")):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = []
        for i, t in texts:
            ids = library(WORDS, t)
            want.append(((-1 if i is None else i), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), tokenizer(WORDS).decode(ids, skip_special_tokens=False)))
        got = bpe.encode(docs, WORDS, decode=True).collect()
        assert sorted(((-1 if r.doc_id is None else r.doc_id), hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in got) == sorted(want)


def test_decode_column(spark, awkward):
    ids = bpe.encode(awkward, WORDS, decode=True)
    assert ids.filter(bpe.decode("ids", WORDS) != ids.decoded).count() == 0


def test_empty_tables(empty):
    assert token_counts.count_tokens(empty, BYTES, 1024).count() == 0
    assert bpe.encode(empty, WORDS, decode=True).count() == 0


@pytest.mark.parametrize("path", [WORDS])
def test_forced_boundaries_are_certain(path):
    """No vocabulary token holds a pair at which words are cut."""
    inner = bpe.inner_pairs(path)
    for v in tokenizer(path).get_vocab():
        assert len(bpe.cut_at_boundaries(v.removesuffix("</w>"), inner)) == 1 or v.startswith("<|")


def test_single_code_points_inside_the_sure_ranges():
    """Where the operators cut by themselves, every code point gives what the library gives, alone and between letters."""
    e = bpe.encoder(WORDS)
    merged = token_counts._Merged(token_counts.prove_whole_tokens(BYTES), BYTES)
    for c in map(chr, range(sys.maxunicode)):
        if unicodedata.category(c) == "Cs":
            continue
        text = f"a{c}b {c}{c} 1{c}'s "
        if bpe.UNSURE.search(text) is None:
            assert e.ids(text) == np.array(library(WORDS, text), "<u4").tobytes(), hex(ord(c))
        if token_counts.UNSURE.search(text) is None and ord(c) < 0x3000:
            assert sum(map(merged.__getitem__, token_counts._pieces(text, BYTES))) == len(library(BYTES, text)), hex(ord(c))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert bpe.encoder(WORDS).ids(text) == np.array(library(WORDS, text), "<u4").tobytes()
    assert bpe.decoded(bpe.encoder(WORDS).ids(text), WORDS) == tokenizer(WORDS).decode(library(WORDS, text), skip_special_tokens=False)


def test_awkward_rows_are_all_there(awkward):
    assert awkward.count() == len(AWKWARD)
