import random

import pyarrow.parquet as pq
from conftest import SMALL
from llm.conftest import rows_of

from pyspark.sql import functions as F

from signalloom.llm import decontaminate as d

NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def digested(found):
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), d.contaminated().alias("contaminated"))


def items_of(edge):
    text = dict(edge)
    return [("b", text[16]), ("a", text[16].upper().replace(" ", "!")), ("short", "one two"), ("none", ""), ("void", None), ("long", text[6]), ("word", "w7"), ("x", " ".join(text[10].split()[500:513])), (None, "one")]


def test_edge_cases(spark, edge, edge_docs):
    items = items_of(edge)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(d.brute(edge, items), key=repr)
    assert rows_of(digested(d.search(edge_docs, bench)), *NAMES) == want
    assert rows_of(digested(d.search(edge_docs, bench, block_bytes=200)), *NAMES) == want  # many blocks of items


def test_whole_small_table(spark, real):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    patterns = {}
    for i, t in items:
        w = d.words(t)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            patterns.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    lengths = {len(p) for p in patterns}
    want = {}
    for doc, t in real:  # a dictionary of windows instead of all comparisons
        w, hit, names = d.words(t), set(), set()
        for k in lengths:
            for s in range(len(w) - k + 1):
                if (p := tuple(w[s : s + k])) in patterns:
                    hit |= set(range(s, s + k))
                    names |= patterns[p]
        want[doc] = (len(w), len(hit), len(names))
    found = {r[0]: r[1:4] for r in rows_of(d.op5_decontaminate(spark, SMALL), *NAMES)}
    assert found == want


def test_random_words_with_many_ties(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(40)]
    items = [(str(i), " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 18)))) for i in range(12)]
    found = d.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert rows_of(digested(found), *NAMES) == sorted(d.brute(docs, items), key=repr)


def test_texts_without_item_id_are_searched_but_are_no_items(spark):
    text = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(None, text)], "item_id string, text string")
    found = d.search(spark.createDataFrame([(1, text), (2, "other")], "doc_id bigint, text string"), bench).collect()
    assert {(r["doc_id"], r["n_hit"], len(r["items"])) for r in found} == {(1, 20, 0), (2, 0, 0)}


def test_empty_tables(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert d.search(empty_docs, none).collect() == []
    assert all(r["n_hit"] == 0 and r["items"] == [] for r in d.search(edge_docs, none).collect())
