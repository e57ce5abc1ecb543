import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import rows_of
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from signalloom.llm import token_counts as t


def unigram(pieces, unk, byte_fallback=True):
    """The library's own unigram model over the same vocabulary; blanks become word borders."""
    made = Tokenizer(models.Unigram(pieces, unk, byte_fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement=t.BORDER, prepend_scheme="always", split=True)
    return made


@pytest.fixture(scope="module")
def library():
    return unigram(*t.vocabulary(t.default_model()))


def test_edge_cases(edge, edge_docs, library):
    want = sorted(((d, len(library.encode(x or "").ids)) for d, x in edge), key=repr)
    assert rows_of(t.count_tokens(edge_docs), "doc_id", "n_tokens") == want


def test_whole_small_table(spark, real, library):
    want = sorted(((d, len(library.encode(x or "").ids)) for d, x in real), key=repr)
    assert rows_of(t.op7_token_counts(spark, SMALL), "doc_id", "n_tokens") == want


TINY = [("<unk>", 0.0), (t.BORDER, -2.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aba", -6.0), (t.BORDER + "a", -4.0), ("bb", -3.5)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc ▁é", max_size=30))
def test_ties_and_unknowns(text):
    library = unigram(TINY, 0, False)
    assert t.Counter(TINY).text(text) == len(library.encode(text).ids)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    if not hasattr(test_any_text, "t"):
        test_any_text.t = unigram(*t.vocabulary(t.default_model()))
    assert t.counter(t.default_model()).text(text) == len(test_any_text.t.encode(text).ids)


def test_empty_table(empty_docs):
    assert t.count_tokens(empty_docs).collect() == []
