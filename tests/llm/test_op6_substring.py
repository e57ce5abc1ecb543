import random

from conftest import SMALL
from llm.conftest import frame, rows_of

from signalloom.llm import ranges
from signalloom.llm import substring_dedup as s

NAMES = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_edge_cases(edge, edge_docs):
    assert rows_of(s.remove_repeats(edge_docs), *NAMES) == sorted(s.brute(edge), key=repr)


def test_many_groups_and_buckets(spark, edge, edge_docs, monkeypatch):
    monkeypatch.setattr(ranges, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(ranges, "BUCKET_HASHES", 2_000)
    assert rows_of(s.remove_repeats(edge_docs, with_text=True), *NAMES) == sorted(s.brute(edge), key=repr)


def test_whole_small_table(spark, real):
    assert rows_of(s.op6_substring_dedup(spark, SMALL), *NAMES) == sorted(s.brute(real), key=repr)


def test_random_overlaps(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(80)))) for i in range(60)]
    assert rows_of(s.remove_repeats(frame(spark, docs), window=4), *NAMES) == sorted(s.brute(docs, 4), key=repr)


def test_rows_without_id_come_last(spark):
    text = " ".join(f"v{i}" for i in range(20))
    found = {r["doc_id"]: r["n_removed"] for r in s.remove_repeats(frame(spark, [(None, text), (3, text)])).collect()}
    assert found == {3: 0, None: 20}


def test_empty_table(empty_docs):
    assert s.remove_repeats(empty_docs).collect() == []
