import zlib

import numpy as np
import pyarrow.parquet as pq
from llm.conftest import rows_of

from signalloom.llm import toxicity

MIDDLE, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{LARGER}/labels.parquet").to_pylist()}
    rows = toxicity.op2_toxicity(spark, LARGER).collect()
    assert len(rows) == pq.read_metadata(f"{LARGER}/documents.parquet").num_rows
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    judged = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    yes, no = [s for s, y in judged if y], [s for s, y in judged if not y]
    assert yes and no
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    assert auc >= 0.95, auc


def test_a_pair_that_no_single_term_gives_away(spark):
    """Either word alone is harmless in half of the rows; only both together are toxic."""
    docs, labels = [], []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        docs.append((i, f"{'zork' if a else 'plain'} filler {'group' if b else 'table'} end"))
        labels.append((i, a & b))
    docs, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels))
    assert all(r["predicted"] == int(r["doc_id"] % 2 and r["doc_id"] // 2 % 2) for r in found.collect())


def test_edge_cases(spark, edge, edge_docs):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    machine = toxicity.train(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    found = rows_of(toxicity.score(edge_docs, machine), "doc_id", "score")
    assert sorted(d for d, _ in found) == sorted(d for d, _ in edge)
    score = dict(found)
    assert score[1] == score[2] == score[3] and score[6] == score[7] == score[9]


def test_empty_tables(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    machine = toxicity.train(edge_docs, none)
    assert toxicity.score(empty_docs, machine).collect() == []
    assert len({r["score"] for r in toxicity.score(edge_docs, machine).collect()}) == 1


def test_an_insult_whose_toxic_rate_alone_is_the_base_rate(spark):
    """Toxic only beside the group, which alone is harmless; elsewhere slurs make the same share of rows toxic."""
    docs, labels = [], []
    for i in range(2500):
        insult, group = i % 20 == 0, i // 20 % 9 == 0
        toxic = group if insult else i % 9 == 4
        words = [f"n{i * k % 97}" for k in range(1, 9)] + ["zork"] * insult + ["folk"] * group + ["slur"] * (toxic and not insult)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = toxicity.train(docs, labels)
    probes = [(0, "zork and folk"), (1, "zork"), (2, "folk"), (3, "slur"), (4, "")]
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(probes, "doc_id bigint, text string"), machine).collect()}
    assert found == {0: 1, 1: 0, 2: 0, 3: 1, 4: 0}


def test_a_wholly_toxic_term_of_few_rows_in_a_full_sample():
    """Six rows of 8,000 hold the term, and nothing else tells them from others."""
    y = (np.arange(8000) % 10 == 0).astype(float)
    rare = np.arange(0, 60, 10)
    row = np.concatenate((np.arange(8000), np.arange(0, 8000), rare))
    at = np.concatenate((np.zeros(8000, int), 1 + np.arange(8000) % 7, np.full(len(rare), 8)))
    order = np.argsort(row, kind="stable")
    machine = toxicity.Machine(np.arange(9))
    machine.fit(row[order], at[order], y)
    alone, none = machine.scores(np.array([0]), np.array([8]), 2)
    assert alone > 0.5 > none
