"""Every query against its SQL on the smallest tables: columns, rows and values, floats to nine digits."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import pytest
from conftest import SMALL

import __spark_entry__ as entry_point
from signalloom.plans import catalog


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SMALL)
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    ours, theirs = table(found.columns, [tuple(r) for r in found.collect()]), table(names, want.fetchall())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_conflicting_labels_of_copies(spark, tmp_path):
    """None of the given tables holds such copies, so these are made."""
    import duckdb

    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, None), (6, ""), (7, "c")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 1, 1), (5, 0, 0), (6, 0, 0), (7, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with duckdb.connect() as con:
        for t in ("documents", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = con.execute(catalog.SQL["q26_conflict_exclusion"])
        theirs = table([d[0] for d in want.description], want.fetchall())
    found = catalog.QUERIES["q26_conflict_exclusion"](spark, str(tmp_path))
    assert table(found.columns, [tuple(r) for r in found.collect()]) == theirs and len(theirs[1]) == 2


@pytest.mark.parametrize("name", ["q16_pair_theta_join"])
def test_rare_matches_against_sql(spark, name):
    """The smallest tables hold no match of these; the next larger ones do."""
    import duckdb

    larger = "/root/testdata/sf0.01"
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for t in os.listdir(larger):
            t = t.removesuffix(".parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet'")
        want = con.execute(catalog.SQL[name])
        theirs = table([d[0] for d in want.description], want.fetchall())
    found = catalog.QUERIES[name](spark, larger)
    ours = table(found.columns, [tuple(r) for r in found.collect()])
    assert ours == theirs and ours[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql_it_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() >= 0


def test_driver_contract(spark):
    assert entry_point.entry(spark).columns
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_the_rest_stands_without_the_text_operators(tmp_path):
    """The entry module imports and lists the other queries where the optional parts are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/signalloom", tmp_path / "signalloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not [k for k in q if k[:2] == 'op']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_empty_intervals_overlap_nothing(spark):
    """Six spans of no length at sf0.1 once divided 0 by 0."""
    from signalloom.operators import intervals

    left = spark.createDataFrame([("u", 1, 5, 5), ("u", 2, 0, 10)], "u string, i int, l_start bigint, l_stop bigint")
    right = spark.createDataFrame([("u", 7, 4, 6), ("u", 8, 5, 5)], "u string, j int, r_start bigint, r_stop bigint")
    assert [(r["i"], r["j"], r["overlap"]) for r in intervals.overlap_join(left, right, ["u"], 4).collect()] == [(2, 7, 2)]
