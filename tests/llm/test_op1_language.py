import zlib

from conftest import SMALL
from llm.conftest import frame

from signalloom.llm import language

import pyarrow.parquet as pq

MIDDLE = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    known = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{MIDDLE}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = language.op1_language(spark, MIDDLE).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(known)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    judged = [r["lang_pred"] == known[r["doc_id"]] for r in rows if r["held_out"] and known[r["doc_id"]] and r["lang_pred"] != language.UNKNOWN]
    assert len(judged) > 100 and sum(judged) / len(judged) >= 0.97


def test_edge_cases(spark, edge, edge_docs):
    model = language.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    found = {r["doc_id"]: r for r in language.predict(edge_docs, model).collect()}
    for d, t in edge:
        if t is None or not any(c.isalpha() for c in t):
            assert found[d]["lang_pred"] == "und" and found[d]["score"] == 0
        else:
            assert found[d]["lang_pred"] != "und"
    assert found[6]["lang_pred"] == found[7]["lang_pred"] and found[6]["score"] == found[7]["score"]


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = [(i, "alpha beta gamma" if held(i) else "uno dos tres", "xx" if held(i) else "es") for i in range(60)]
    model = language.train(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert model.families == ["romance"]


def test_nothing_to_learn_from(spark, empty_docs, edge_docs):
    assert language.train(empty_docs) is None
    assert language.predict(empty_docs, None).collect() == []
    assert {r["lang_pred"] for r in language.predict(edge_docs, None).collect()} == {"und"}


def test_family_comes_first(spark):
    model = language.train(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    assert len(model.families) > 1 and sum(map(len, model.members.values())) >= 4
    assert len(model.weights) == len(model.families) + sum(map(len, model.pairs.values()))
