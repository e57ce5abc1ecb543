"""Stages and run() on nulls in any column, empty and long texts, ties, repeated rows, clashing names and empty tables."""

import corpus_pipeline
import pytest

from signalloom.llm import bpe

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ", score string, lang_pred string, kept string, n_lines string, items string, spans string, key string, id string, a string"
OUT = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def rows_of(edge):
    langs = ["en", "de", None]
    return [(d, t, langs[i % 3], None if i % 2 else "s", None if i % 5 == 0 else len(t or ""), *"bcdefghij") for i, (d, t) in enumerate(edge)] + [(None, "a text of some words without an id", None, None, None, *[None] * 9)]


@pytest.fixture(scope="module")
def folder(spark, edge, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame(rows_of(edge), DOCS + CLASHING).write.parquet(f"{at}/documents.parquet")
    text = dict(edge)
    spark.createDataFrame([("i", text[16]), (None, "one two three"), ("v", None)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_every_stage_on_awkward_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert 0 < found.count() <= docs.count(), name


def test_run_on_awkward_rows(spark, folder, edge):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == OUT
    rows = found.collect()
    got = [r["doc_id"] for r in rows]
    no_letter = {d for d, t in edge if not any(c.isalpha() for c in t or "")}
    assert not no_letter & set(got) and None in got  # no language; no id, no copy
    # 6, 7 (twice) and 40 to 51 are one line, which 51 alone keeps: the others stay, empty; 51 is a near copy of 8
    assert got.count(7) == 2 and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in {6, 7, *range(40, 51)})
    assert 8 in got and 51 not in got and 60 not in got
    assert not {16, 17, 18} & set(got) and 5 not in got  # the benchmark's passage, and a short item without an id
    assert {10, 11} <= set(got)  # long texts stay


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS + CLASHING).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == OUT and found.collect() == []


def test_documents_of_one_id_that_repeat_stay_together(spark):
    docs = spark.createDataFrame([(1, "some words that nobody else has", "en", "s", 31)] * 2, DOCS)
    assert corpus_pipeline.one_of_each_group(spark, docs, "").count() == 2
    assert bpe.encode_documents(docs).count() == 2
