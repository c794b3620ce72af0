import hashlib
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Library

from quire.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, odd, empty):
    got = bpe.encode_documents(odd, PATH, with_ids=True).collect()
    assert len(got) == odd.count() and bpe.encode_documents(empty, PATH).count() == 0
    texts = {(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()}
    want = set()
    for i, t in texts:
        ids, text = expected(t)
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids)))
    assert {(*r[:4], tuple(r.ids)) for r in got} == want
    back = bpe.decode_documents(bpe.encode_documents(odd, PATH, with_ids=True), PATH)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, expected(t)[1]) for i, t in texts}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aabbtheIN'sdll!!<|> \n\tİΣς\x1c\x85é́½")), max_size=60))
def test_any_text(text):
    tok = bpe.tokenizer(PATH)
    ids, decoded = expected(text)
    assert tok.encode(text) == ids and tok.decode(ids) == decoded


def test_cache_bound(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    tok, r = bpe.Tokenizer(PATH), random.Random(1)
    texts = [" ".join("".join(r.choice("abc") for _ in range(5)) for _ in range(20)) + " <|endoftext|>" for _ in range(30)]
    assert [tok.encode(t) for t in texts] == [expected(t)[0] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aab'sΣé́ \n\t!1字<|>"), max_size=80), st.integers(1, 9))
def test_pieces_of_long_texts(text, size):
    """A text taken in pieces has the ids of the whole."""
    tok, whole = bpe.tokenizer(PATH), bpe.PIECE
    try:
        bpe.PIECE = size
        assert tok.encode(text) == expected(text)[0]
    finally:
        bpe.PIECE = whole


def test_hashes_in_parts(monkeypatch):
    tok = bpe.tokenizer(PATH)
    ids = np.array([*tok.encode("some words, taken in parts"), 10**6], np.int32)  # the last one is unknown
    want = tuple(hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), tok.decode(ids.tolist())))
    for size in (1, 2, 100):
        monkeypatch.setattr(bpe, "AT_ONCE", size)
        assert tok.hashes(ids) == want
