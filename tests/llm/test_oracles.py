"""The queries against their SQL, on the smallest tables and on the awkward rows; the SQL of op9 has its own test."""

import duckdb
import pytest
from conftest import SMALL
from llm.conftest import rows_of
from pyspark.sql import functions as F

from signalloom.llm import decontaminate, minhash, oracles, queries, substring_dedup, suffix_dedup

ITEMS = [("b", "one two three four"), ("a", "Same same SAME"), (None, "three"), ("void", None), ("none", "")]


def of_docs(name, docs):
    if name == "op5_decontaminate":
        found = decontaminate.search(docs, docs.sparkSession.createDataFrame(ITEMS, "item_id string, text string"))
        return found.select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
        )
    if name == "op8_minhash":
        return minhash.near_groups(docs, size=4)
    return {"op6_substring_dedup": substring_dedup, "op10_suffix_dedup": suffix_dedup}[name].remove_repeats(docs)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_small_tables(spark, duck, name):
    found = queries.QUERIES[name](spark, SMALL)
    with duck.cursor() as con:
        assert rows_of(found, *sorted(found.columns)) == sorted(con.execute(f"SELECT {', '.join(sorted(found.columns))} FROM ({oracles.SQL[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_awkward_rows(edge, edge_docs, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", edge)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    want = con.execute(oracles.SQL[name])
    names = [c[0] for c in want.description]
    assert rows_of(of_docs(name, edge_docs), *names) == sorted(want.fetchall(), key=repr)
