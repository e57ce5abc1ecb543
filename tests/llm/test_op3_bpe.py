import hashlib

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import rows_of
from tokenizers import Tokenizer

from signalloom.llm import bpe

NAMES = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def expected(library, rows):
    out = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edge_cases(edge, edge_docs, library):
    assert rows_of(bpe.encode_documents(edge_docs), *NAMES) == expected(library, edge)


def test_whole_small_table(spark, real, library):
    assert rows_of(bpe.op3_bpe(spark, SMALL), *NAMES) == expected(library, real)


def test_empty_table(empty_docs):
    assert bpe.encode_documents(empty_docs, with_ids=True).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    library = Tokenizer.from_file(bpe.default_tokenizer()) if not hasattr(test_any_text, "t") else test_any_text.t
    test_any_text.t = library
    coder = bpe.encoder(bpe.default_tokenizer())
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == ids
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "the", "ing", " ", "  ", "e", "er", "1", "é", "日"]), max_size=40))
def test_repetitive_text(parts):
    test_any_text.hypothesis.inner_test("".join(parts))
