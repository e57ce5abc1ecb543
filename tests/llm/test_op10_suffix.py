import random

from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import frame, rows_of

from signalloom.llm import ranges
from signalloom.llm import suffix_dedup as s

NAMES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_edge_cases(edge, edge_docs):
    assert rows_of(s.remove_repeats(edge_docs), *NAMES) == sorted(s.brute(edge), key=repr)


def test_many_groups_and_buckets(edge, edge_docs, monkeypatch):
    monkeypatch.setattr(ranges, "GROUP_BYTES", 30_000)
    monkeypatch.setattr(ranges, "BUCKET_HASHES", 300)
    monkeypatch.setattr(s, "ARRAY_BYTES", 40_000)
    monkeypatch.setattr(s, "CHUNK_BYTES", 1_000)
    assert rows_of(s.remove_repeats(edge_docs, with_text=True), *NAMES) == sorted(s.brute(edge), key=repr)


def test_whole_small_table(spark, real):
    assert rows_of(s.op10_suffix_dedup(spark, SMALL), *NAMES) == sorted(s.brute(real), key=repr)


def test_random_overlaps(spark):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(120)))) for i in range(60)]
    docs += [(100 + i, "ab" * (10 + i)) for i in range(8)]
    assert rows_of(s.remove_repeats(frame(spark, docs), length=12, gram=4), *NAMES) == sorted(s.brute(docs, 12), key=repr)


def test_empty_table(empty_docs):
    assert s.remove_repeats(empty_docs).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=30), min_size=1, max_size=6, unique=True))
def test_maximal_repeats_of_small_runs(texts):
    """Every group: one string, at all its places, that no other common letter on either side could lengthen."""
    runs = [t.encode() for t in texts]
    least = 8
    occurrences = {}
    for r, data in enumerate(runs):
        for i in range(len(data)):
            for j in range(i + least, len(data) + 1):
                occurrences.setdefault(data[i:j], []).append((r, i))
    want = set()
    for string, places in occurrences.items():
        left = {runs[r][i - 1] if i else (r, "start") for r, i in places}
        right = {runs[r][i + len(string)] if i + len(string) < len(runs[r]) else (r, "end") for r, i in places}
        if len(places) > 1 and (len(left) > 1 or any(isinstance(x, tuple) for x in left)) and (len(right) > 1 or any(isinstance(x, tuple) for x in right)):
            want.add((len(string), tuple(sorted(places))))
    assert {(n, tuple(sorted(p))) for n, p in s.maximal_repeats(runs, least)} == want
