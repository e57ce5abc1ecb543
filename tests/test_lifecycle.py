"""Corpus runs, sidecars, indexes, snapshots and scalar functions on made rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from signalloom.functions import scalar
from signalloom.operators import graph, history, lifecycle, linking


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_run_status_and_provenance(spark):
    c = spark.createDataFrame([("a/x.wav", "1", True, 10.0), ("a/y.wav", "2", True, 9999.0), ("b/z.wav", "3", True, 5.0), ("c.wav", None, False, None), ("d.wav", "4", True, None)],
                              "relative_path string, sha256 string, present boolean, duration_seconds double")
    e = spark.createDataFrame([("a/x.wav", "1", "k", "v1"), ("d.wav", "4", "k", "v1")], "relative_path string, sha256 string, input string, config string")
    e = lifecycle.provenance_id(e, ["sha256", "config"]).withColumn("run_id", F.when(F.col("sha256") == "4", "run_other").otherwise(F.col("run_id")))
    done = lifecycle.provenance_status(e, ["config", "sha256"])
    assert rows(done, "relative_path", "provenance") == {("a/x.wav", "validated"), ("d.wav", "invalid")}
    found = lifecycle.run_status(c, done, ["b/*"], 3600)
    assert rows(found, "relative_path", "status") == {("a/x.wav", "skipped_complete"), ("a/y.wav", "deferred"), ("b/z.wav", "excluded"), ("c.wav", "missing"), ("d.wav", "planned")}
    assert lifecycle.run_status(c, done, [], 3600, first=2).count() == 2
    t = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    assert lifecycle.tree_digest(t).first() == lifecycle.tree_digest(t.orderBy("path")).first()
    assert rows(lifecycle.unchanged(t, t.withColumn("sha256", F.when(F.col("path") == "a", "9").otherwise(F.col("sha256"))), "path"), "path", "before", "after") == {("a", "1", "9")}


@pytest.mark.parametrize(("pattern", "text", "want"), [("*.wav", "a/b.wav", True), ("a/?.wav", "a/bb.wav", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.b", "axb", False), ("a+(b", "a+(b", True)])
def test_globs(spark, pattern, text, want):
    assert spark.createDataFrame([(text,)], "p string").select(lifecycle.excluded(F.col("p"), [pattern])).first()[0] is want


def test_manifests_index_and_summaries(spark):
    r = spark.createDataFrame([("a", "1", "focus", None), ("b", "1", None, "x"), ("c", "2", None, None), ("d", None, None, None)], "relative_path string, sha256 string, category string, intent string")
    m = lifecycle.recording_manifests(r, spark.createDataFrame([("1", "sleep", None)], "sha256 string, category string, intent string"))
    assert {(x["relative_path"], x["category"], x["label_source"], tuple(x["duplicates"])) for x in m.collect()} == {("a", "sleep", "curated", ("b",)), ("b", "sleep", "curated", ("a",)), ("c", None, "none", ()), ("d", None, "none", ())}
    s = lambda *x: spark.createDataFrame(list(x), "relative_path string, sidecar_sha256 string, error string")
    i = lifecycle.index(r, s(("a", "1", None)), s(("b", "9", None)), s(), s(("a", "1", None), ("c", "2", "broken")))
    assert rows(i, "relative_path", "manifest_status", "provider_status", "evidence_status", "index_status") == {
        ("a", "validated", "missing", "validated", "indexed"), ("b", "missing", "invalid", "missing", "invalid"), ("c", "missing", "missing", "invalid", "invalid"), ("d", "missing", "missing", "missing", "pending")}
    assert [(x["field"], x["value"], x["n"]) for x in lifecycle.status_counts(i).where("field = 'index_status'").collect()] == [("index_status", "invalid", 2), ("index_status", "indexed", 1), ("index_status", "pending", 1)]
    assert rows(lifecycle.canonical_rows(i, [F.when(F.col("index_status") == "indexed", 0).otherwise(1)]), "relative_path") == {("a",), ("c",), ("d",)}
    assert lifecycle.facets(r, ["category"]).first()["category"] == ["focus", "unknown"]
    assert rows(lifecycle.warnings(r, {"no digest": F.col("sha256").isNull(), "no path": F.col("relative_path").isNull()}), "warning", "n") == {("no digest", 1)}
    d = spark.createDataFrame([("s1", "1"), ("s2", "2"), ("s3", "3")], "source string, source_sha256 string")
    assert rows(lifecycle.fresh(d, spark.createDataFrame([("s1", "1"), ("s2", "8")], "source string, sha256 string")), "source", "stale") == {("s1", False), ("s2", True), ("s3", True)}


def test_evidence(spark):
    df = spark.createDataFrame([("r", 1.5, 0.9), ("r", math.nan, 1.7), ("q", 2.0, 0.5)], "rec string, hz double, c double")
    e = lifecycle.evidence(df, "peak", ["rec"], {"frequency": (F.col("hz"), "Hz"), "twice": (F.col("hz") * 2, "Hz")}, F.col("c"))
    assert {(x["subject"], x["confidence"], x["measurements"][0]["value"], x["measurements"][1]["value"]) for x in e.collect()} == {('{"rec":"r"}', 0.9, 1.5, 3.0), ('{"rec":"r"}', None, None, None), ('{"rec":"q"}', 0.5, 2.0, 4.0)}
    assert e.select(lifecycle.measurement_map(F.col("measurements")).alias("m")).where("m['twice'] = 4").count() == 1
    s = {x["subject"]: x for x in lifecycle.evidence_summary(e.union(e), ["subject"]).collect()}
    assert s['{"rec":"r"}']["n_objects"] == 4 and s['{"rec":"r"}']["n_distinct"] == 2 and s['{"rec":"r"}']["strongest"]["peak"]["confidence"] == 0.9
    x = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("x",), ("-2",), (None,)], "v string")
    assert [r[0] for r in x.select(lifecycle.finite(F.col("v"), 0.0)).collect()] == [1.5, None, None, None, None, None]


def test_snapshots_and_families(spark):
    r = spark.createDataFrame([("1", "a", "x"), ("1", "b", "y"), (None, "c", "x")], "sha string, path string, cat string")
    s = history.snapshot(r, "sha", "path", ["cat"])
    assert {(x["sha"], tuple(x["paths"]), x["cross_context"]) for x in s.collect()} == {("1", ("a", "b"), True), ("path:c", ("c",), False)}
    ids = {history.snapshot_id(x, "sha", "paths", "cat").first()["snapshot_id"] for x in (s, s.repartition(3))}
    assert len(ids) == 1 and history.snapshot_id(s.where("sha = '1'"), "sha", "paths", "cat").first()["snapshot_id"] not in ids
    f = lambda *x: spark.createDataFrame([(m, f) for f, ms in x for m in ms], "m string, f string")
    o = history.family_overlap(f(("p", "abcde"), ("q", "fgh")), f(("x", "abcd"), ("y", "fgz"), ("z", "w"), ("v", "eqrst")), "m", "f")
    assert rows(o, "family", "before_family", "status") == {("x", "p", "stable"), ("y", "q", "shifted"), ("z", None, "new"), ("v", "p", "reconfigured")}
    snaps = spark.createDataFrame([(2, "b"), (1, "z"), (2, "a")], "captured_at int, snapshot_id string")
    assert [(x["snapshot_id"], x["previous_id"]) for x in history.ordered(snaps).orderBy("position").collect()] == [("z", None), ("a", "z"), ("b", "a")]


def test_graph_lists(spark):
    lists = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 2, ["b", "c"]), ("s", 3, []), ("t", 1, ["a"]), ("u", 1, []), ("u", 2, ["a"])], "source string, observation int, targets array<string>")
    assert rows(graph.list_drift(lists), "source", "n_pairs", "mean_jaccard", "status") == {("s", 1, 1 / 3, "assessed"), ("t", 0, None, "not_repeated"), ("u", 0, None, "insufficient_nonempty_repeats")}
    assert rows(graph.list_edges(lists.where("source = 't'"), ["observation"]), "observation", "source", "target", "rank") == {(1, "t", "a", 1)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 9], "a bigint, b bigint")
    assert {r["id"]: r["component"] for r in graph.connected(chain).collect()} == {i: 0 if i < 10 else 10 for i in range(21)}


def test_scalars_and_masks(spark):
    x = spark.createDataFrame([(3.5,), (-3.5,), (0.5,)], "v double").select(scalar.wrap_phase(F.col("v"))).collect()
    assert [round(r[0], 6) for r in x] == [round(v, 6) for v in (3.5 - 2 * math.pi, 2 * math.pi - 3.5, 0.5)]
    s = spark.createDataFrame([(0.8, 0.6, 10.0, False), (0.8, 0.6, 50.0, True)], "l double, r double, d double, h boolean")
    assert [r[0] for r in s.select(scalar.candidate_score(F.col("l"), F.col("r"), F.col("d"), F.col("h"))).collect()] == [0.56, 0.014]
    m = spark.createDataFrame([("a", [1]), ("b", [2])], "c string, p array<int>")
    assert [r["p"] for r in linking.masked(m, "c", "a", "p").collect()] == [[1], []]
    e = spark.createDataFrame([(25.0, 30.0, None), (10.0, 30.0, None), (25.0, 50.0, 2)], "a double, b double, h int")
    assert [r[0] for r in e.select(linking.eligible(F.col("a"), F.col("b"), F.col("h"))).collect()] == [True, False, False]
