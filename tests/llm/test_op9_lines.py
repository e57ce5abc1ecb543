import hashlib
from collections import defaultdict

from conftest import SMALL
from llm.conftest import frame, rows_of

from signalloom.llm import line_dedup as ld
from signalloom.llm import shared

NAMES = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
FOLD = str.maketrans(ld.string.ascii_uppercase, ld.string.ascii_lowercase)


def brute(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(ld.BLANKS).translate(FOLD)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    common = {k: max(ds) for k, ds in holders.items() if len(k) >= 40 and len(ds) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d >= common.get(key(x), d)]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(docs):
    from pyspark.sql import functions as F

    found = ld.dedup_lines(docs, shared.scratch(docs.sparkSession, "lines"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def test_edge_cases(spark, edge):
    rows = edge[:-1]
    assert rows_of(run(frame(spark, rows)), *NAMES) == brute(rows)


def test_repeated_rows_share_one_fate(spark, edge_docs, edge):
    found = [r for r in run(edge_docs).collect() if r["doc_id"] == 7]
    assert len(found) == 2 and len({tuple(r) for r in found}) == 1


def test_whole_small_table(spark, real):
    assert rows_of(ld.op9_line_dedup(spark, SMALL), *NAMES) == brute(real)


def test_sql_agrees(spark, duck):
    assert rows_of(ld.op9_line_dedup(spark, SMALL), *NAMES) == sorted(duck.execute(f"SELECT {', '.join(NAMES)} FROM ({ld.SQL})").fetchall(), key=repr)


def test_rows_without_id_keep_their_lines(spark):
    line = "x" * 50
    found = {r["doc_id"]: r["n_dropped"] for r in run(frame(spark, [(None, line), *((i, line) for i in range(6))])).collect()}
    assert found == {None: 0, 5: 0} | {i: 1 for i in range(5)}


def test_empty_table(empty_docs):
    assert run(empty_docs).collect() == []


def test_runs_are_levelled(spark):
    runs = ld.LineRuns(spark, shared.scratch(spark, "runs"), buckets=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, i, 0) for i in range(k, k + 10)], "doc_id bigint, a bigint, b bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    keys = [(r["a"], r["b"]) for run in runs.runs() for r in run.collect()]
    assert sorted(keys) == [(i, 0) for i in range(14)]  # runs are disjoint
    assert {r["a"]: r["n_docs"] for r in runs.totals().collect()} == {i: sum(k <= i < k + 10 for k in range(5)) for i in range(14)}


def test_main_path_has_no_python(spark):
    plan = ld.op9_line_dedup(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repeated_rows_count_as_one_document(spark, edge_docs, edge, duck):
    assert rows_of(run(edge_docs), *NAMES) == brute(edge)
    line, other = "x" * 50, "y" * 50
    rows = [(1, line)] * 4 + [(2, line)] + [(None, line)] * 4 + [(i, other) for i in range(3, 8)] * 2
    found = {(r["doc_id"], r["n_dropped"]) for r in run(frame(spark, rows)).collect()}
    with duck.cursor() as con:
        con.execute("CREATE TEMP TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        want = {(d, bool(n)) for d, n in con.execute(f"SELECT doc_id, n_dropped FROM ({ld.SQL})").fetchall()}
    assert {(d, bool(n)) for d, n in found} == want and (1, 0) in found and (3, 1) in found
