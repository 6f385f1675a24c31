"""BPE against the tokenizers library, and its round trip."""

from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmith.llm import bpe, queries

TEXTS = ["", "plain words here", "<|endoftext|>a <|endoftext|>", "ab" * 900, "a" * 5000, "日本語 1234 ½", "it's  we'll \t\n x", "é" * 700, "\u0897\u1c89 new letters", "x\u001c\u0085y", "🙂🙂 ok", " " * 300 + "end"]


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    with open(path, encoding="utf-8") as f:
        return bpe.Bpe(f.read()), Tokenizer.from_file(path)


def same(both, text):
    own, library = both
    ids = array("I")
    ids.frombytes(own.encode(text))
    want = library.encode(text, add_special_tokens=False).ids
    assert list(ids) == want
    assert own.decode(ids.tobytes()) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_like_library(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(both, text):
    same(both, text)


def test_every_settled_code_point(both):
    own, _ = both
    from tokenizers.pre_tokenizers import ByteLevel

    library = ByteLevel(add_prefix_space=False)
    for c in [*range(0x558), *range(0x2010, 0x2070), *range(0x20A0, 0xA7CE)]:
        text = f"a{chr(c)}{chr(c)}1 {chr(c)}b"
        assert own.words(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)], hex(c)


@given(st.binary(min_size=1, max_size=400))
@settings(max_examples=100, deadline=None)
def test_heap_merges_like_scan(both, word):
    own, _ = both
    by_heap = own.merge_long(word)
    long, bpe.LONG = bpe.LONG, 10**9
    try:
        assert own.merge(word) == by_heap
    finally:
        bpe.LONG = long


def test_rows(spark, docs, both):
    rows = bpe.encode(docs([(1, None), (2, ""), (3, "hello there"), (3, "hello there"), (None, "x")]), queries.vocabulary()).collect()
    assert len(rows) == 5 and {r.decoded for r in rows} == {"", "hello there", "x"}
    assert bpe.encode(docs([]), queries.vocabulary()).count() == 0
    tokens = bpe.encode(docs([(3, "hello there")]), queries.vocabulary(), roundtrip=False)
    assert tokens.columns == ["doc_id", "token_bytes"]
    assert bpe.decode(tokens, queries.vocabulary()).first().decoded == "hello there"


def test_query(spark, sf_dir, both):
    own, library = both
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op1_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
