"""Kernels, linking and sampled series on made signals."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pandas as pd
import pytest

from signalloom.functions import kernels as k
from signalloom.operators import clustering, graph, linking, signal


def test_phase_of_two_tones():
    t = np.arange(10_000) / 2000
    tone = lambda f, p=0.0: np.sin(2 * np.pi * f * t + p)
    same = k.phase_difference(tone(100), tone(100, np.pi / 2), 2000, 100, 100, 10, 0.5)
    assert abs(same["difference_hz"]) < 0.01 and same["raw_locking"] > 0.99 and abs(same["offset"] - np.pi / 2) < 0.01
    turning = k.phase_difference(tone(100), tone(102), 2000, 100, 102, 10, 0.5)
    assert abs(turning["difference_hz"] - 2) < 0.01 and turning["raw_locking"] < 0.2 and turning["locking"] > 0.99
    with pytest.raises(ValueError):
        k.bandpass(np.zeros(10), 100, 1, 2)
    with pytest.raises(ValueError):
        k.bandpass(np.zeros(100), 100, 10, 60)


def test_envelope_of_a_modulated_carrier():
    t = np.arange(80_000) / 4000
    env, rate = k.envelope((1 + 0.6 * np.sin(2 * np.pi * 3 * t)) * np.sin(2 * np.pi * 100 * t), 4000, 80, 120, 200)
    assert rate == 200 and abs(k.depth(env) - 0.6) < 0.12 and abs(k.modulation_peaks(env, rate)[0][0] - 3) < 0.2
    assert k.modulation_peaks(env[:10], rate) == [] and k.depth(np.zeros(0)) == 0


def test_peaks_distance_and_prominence():
    assert k.peaks(np.array([0, 1, 1, 1, 0, 3, 0, 2, 0.0])).tolist() == [2, 5, 7]
    assert k.peaks(np.array([0, 1, 1, 1, 0, 3, 0, 2, 0.0]), 3).tolist() == [2, 5]
    assert k.peaks(np.array([0, 5, 4.9, 5.1, 0.0]), 1, 0.5).tolist() == [3]
    assert k.peaks(np.zeros(5)).tolist() == []


def test_onsets_keep_their_distance_to_the_last_one_taken():
    active = np.isin(np.arange(20), [0, 2, 4, 9, 11])
    assert k.spaced_onsets(active, 1).tolist() == [0, 2, 4, 9, 11]
    assert k.spaced_onsets(active, 3).tolist() == [0, 4, 9]


def series(spark, rate, **channels):
    rows = [pd.DataFrame({"s": n, "i": np.arange(len(v[0])), "left": v[0], "right": v[1] if len(v) > 1 else np.nan}) for n, v in channels.items()]
    df = pd.concat(rows)
    df["right"] = df["right"].astype(float)
    return spark.createDataFrame(df, "s string, i bigint, left double, right double").selectExpr("s", "i", "left", "nanvl(right, null) AS right")


@pytest.fixture(scope="module")
def staged(spark):
    t = np.arange(15 * 2000) / 2000
    tone = np.sin(2 * np.pi * 440 * t)
    own = np.where(t < 5, tone, np.where(t < 10, (0.55 + 0.45 * np.sin(2 * np.pi * 10 * t)) * tone, ((t * 10) % 1 < 0.25) * tone))
    return series(spark, 2000, st=(own, np.where(t < 5, np.sin(2 * np.pi * 450 * t), own)))


def test_stages_and_what_they_are(staged):
    found = signal.stages(staged, ["s"], 2000)
    assert [(r["start_seconds"], r["end_seconds"]) for r in found.orderBy("stage").collect()] == [(0, 5), (5, 10), (10, 15)]
    kinds = {r["stage"]: r["construction"] for r in signal.stage_classes(signal.staged(staged, ["s"], found, 2000), ["s", "stage"], 2000, high=900).collect()}
    assert kinds == {1: "binaural_construction", 2: "smooth_amplitude_modulation", 3: "hard_gated_pulse"}


def test_a_ramp_and_frames(spark):
    t = np.arange(12 * 2000) / 2000
    x = (1 + 0.7 * np.sin(2 * np.pi * np.cumsum(4 + 16 / 12 * t) / 2000)) * np.sin(2 * np.pi * 220 * t)
    frames = signal.framed(series(spark, 2000, r=(x,)), ["s"], 2000, 2.0, 0.5)
    sizes = frames.groupBy("frame").count().collect()
    assert len(sizes) == 21 and {r["count"] for r in sizes} == {4000}
    w = signal.ridge_windows(frames, ["s", "frame", "start_seconds", "end_seconds"], 2000, (185.0, 255.0), 1.0, 40.0)
    (r,) = signal.ramp(w, ["s"], 2.0).collect()
    assert r["classification"] == "continuous_modulation_ramp" and abs(r["slope"] - 16 / 12) < 0.12 and r["rmse"] < 0.35 and r["direction"] == "increasing"


@pytest.mark.parametrize("tracks_first", [True, False])
def test_linking_against_a_plain_walk(spark, tracks_first):
    rng = np.random.default_rng(4)
    rows = [(s, int(w), n, float(f)) for s in "ab" for w in range(40) if w % 9 for n, f in enumerate(rng.choice(np.arange(1, 30, 0.5), rng.integers(0, 5)))]
    found = linking.linked(spark.createDataFrame(rows, "s string, w bigint, k int, f double").repartition(5), ["s"], "w", "k", "f", 1.0, 2, tracks_first)
    got = {(r["s"], r["w"], r["k"]): r["track_id"] for r in found.collect()}
    want = {}
    for s in "ab":
        tracks: list[list] = []
        for w, own in itertools.groupby((r for r in rows if r[0] == s), key=lambda r: r[1]):
            own = list(own)
            live = [t for t in tracks if w - t[-1][0] - 1 <= 2]
            free, used = dict(enumerate(own)), set()
            pairs = [(t, None) for t in live] if tracks_first else [(None, n) for n in free]
            for t, n in pairs:
                options = [(abs(free[j][3] - t[-1][1]), j, t) for j in free] if tracks_first else [(abs(own[n][3] - u[-1][1]), i, u) for i, u in enumerate(live) if id(u) not in used]
                options = [o for o in options if o[0] <= 1.0]
                if options:
                    o = min(options, key=lambda o: o[:2])
                    j = o[1] if tracks_first else n
                    want[s, w, own[j][2]] = tracks.index(o[2])
                    o[2].append((w, own[j][3]))
                    free.pop(j)
                    used.add(id(o[2]))
            for j in sorted(free):
                want[s, w, own[j][2]] = len(tracks)
                tracks.append([(w, own[j][3])])
    assert got == want and len(got) == len(rows)


@pytest.mark.parametrize("tracks_first", [True, False])
def test_linking_takes_time_in_proportion(tracks_first):
    """Windows of 20,000 peaks: each against each would be 400 million comparisons a window."""
    values = np.random.default_rng(5).exponential(50, (4, 20_000)).tolist()
    linker = linking.Linker(3.0, 2, tracks_first)
    began = time.process_time()
    ids = [linker.window(w, own) for w, own in enumerate(values)]
    assert time.process_time() - began < 20
    assert all(len(set(own)) == 20_000 for own in ids) and linker.created < 25_000


@pytest.mark.parametrize("tracks_first", [True, False])
def test_linking_takes_what_comparing_all_takes(tracks_first):
    """Equal numbers, distances that are equal once rounded, numbers that are not finite."""
    rng = np.random.default_rng(6)
    pools = [[1, 2, 2.5, 3, 3, 3, 7.5], [1e-20, 2e-20, 3e-17, 1.0, 1.0000000000000002, -1.0, 0.0, 1e308, -1e308], [np.nan, np.inf, -np.inf, 1.0, 2.0, 4.0]]
    for pool, jump, _ in itertools.product(pools, (0.0, 1.0, 3.0), range(40)):
        wanted, free = ([float(v) for v in rng.choice(pool, 12)] for _ in range(2))
        left, want = dict(enumerate(free)), []
        for x in wanted:
            near = [(abs(v - x), k) for k, v in left.items() if abs(v - x) <= jump]
            want.append(min(near)[1] if near else None)
            left.pop(want[-1], None)
        pile = linking.Free(free)
        assert [pile.take(x, jump) for x in wanted] == want


def test_a_window_over_many_batches(spark):
    """Windows and series that begin and end within batches, with keys that are null or no number."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(s, w, k, float(3 * k)) for s in (None, float("nan"), 1.0, 2.0) for w in range(4) for k in range(10 if w % 2 else 3)]
        found = linking.linked(spark.createDataFrame(rows, "s double, w bigint, k int, f double"), ["s"], "w", "k", "f", 1.0, 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows) and all(r["track_id"] == r["k"] for r in found)


def test_linking_an_empty_table(spark):
    assert linking.linked(spark.createDataFrame([], "s string, w bigint, k int, f double"), ["s"], "w", "k", "f", 1.0, 2).collect() == []


def test_hypotheses_near_a_better_one_go(spark):
    rows = [("x", -0.9, 1, 5.0), ("x", -0.8, 2, 5.3), ("x", -0.7, 3, 5.6), ("y", -0.1, 4, 5.1)]
    found = linking.distinct_hypotheses(spark.createDataFrame(rows, "band string, place double, id int, hz double"), ["band"], ["place", "id"], "hz")
    assert {r["id"] for r in found.collect()} == {1, 3, 4}


def test_many_hypotheses_and_odd_ones(spark):
    """Against a plain walk; a null or infinite value is kept and absorbs nothing. A fold over 100,000 rows of a group took minutes."""
    rng = np.random.default_rng(8)
    made = [("x" if i % 3 else None, -float(s), i, float(h)) for i, (s, h) in enumerate(zip(rng.integers(0, 50, 100_000), rng.exponential(50, 100_000), strict=True))]
    made += [("x", -99.0, -1, None), ("x", -99.0, -2, float("inf")), ("x", -1.0, -3, float("inf")), ("x", -98.0, -4, float("nan"))]
    began = time.monotonic()
    found = linking.distinct_hypotheses(spark.createDataFrame(pd.DataFrame(made, columns=["band", "place", "id", "hz"], dtype=object), "band string, place double, id bigint, hz double"), ["band"], ["place", "id"], "hz")
    got = {r["id"] for r in found.collect()}
    assert time.monotonic() - began < 60
    want, cells = {-1, -2, -3, -4}, {}
    for b, _, i, hz in sorted(made[:-4], key=lambda r: r[1:3]):
        near = [y for c in (-1, 0, 1) for y in cells.get((b, int(hz / 0.35) + c), ())]
        if not any(abs(y - hz) <= 0.35 for y in near):
            cells.setdefault((b, int(hz / 0.35)), []).append(hz)
            want.add(i)
    assert got == want and len(want) > 500


def test_bands_of_protocol_tracks(spark):
    """The most frequent band, of equal counts the smallest name; a series without a name stays."""
    bands = {0: "bbbaa", 1: "ccaab", 2: ["a", None, None, "b"]}
    rows = [(None if t == 1 else "s", t, w, float(w), w + 1.0, 2.0, 0.5, b) for t, own in bands.items() for w, b in enumerate(own)]
    df = spark.createDataFrame(rows, "s string, track_id bigint, window_index bigint, start_seconds double, end_seconds double, difference_hz double, confidence double, band string")
    got = {r["track_id"]: (r["s"], r["band"]) for r in linking.protocol_tracks(df, ["s"]).collect()}
    assert got == {0: ("s", "b"), 1: (None, "a"), 2: ("s", None)}


def test_label_propagation_against_one_walk_of_the_whole_graph(spark):
    rng = np.random.default_rng(3)
    e = {tuple(sorted(map(int, rng.choice(40, 2, replace=False)))) for _ in range(45)}
    df = spark.createDataFrame([(a, b, 1 + (a + b) % 2) for a, b in e], "a bigint, b bigint, weight bigint")
    near: dict = {}
    for a, b in e:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = 1 + (a + b) % 2
    label, _ = graph.propagated(sorted(near), near)
    groups: dict = {}
    for v, n in label.items():
        groups.setdefault(n, []).append(v)
    assert {r["id"]: r["label"] for r in graph.communities(df).collect()} == {v: min(own) for own in groups.values() for v in own}


def test_many_small_components_and_a_hub(spark):
    """3,000 components, over many batches, and a node with 4,000 neighbours; a call of pandas for each component took minutes."""
    e = [(10 * k + i, 10 * k + i + 1, 1 + (k + i) % 2) for k in range(3000) for i in range(4)] + [(10**6, 10**6 + i, 1) for i in range(1, 4001)]
    df = spark.createDataFrame(pd.DataFrame(e, columns=["a", "b", "weight"]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = graph.communities(df)
        assert "InPandas" not in found._jdf.queryExecution().toString()
        got = {r["id"]: r["label"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near: dict = {}
    for a, b, w in e:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    groups: dict = {}
    for v, n in graph.propagated(sorted(near), near)[0].items():
        groups.setdefault(n, []).append(v)
    assert got == {v: min(own) for own in groups.values() for v in own} and len(got) == 19_001


def test_transitions_count_relations_once(spark):
    """Repeated relations and repeated or several contexts of an item; only groups of context and activity are counted, no pairs kept."""
    e = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 3), (None, 3), (2, None)], "source bigint, target bigint")
    c = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x")], "source bigint, context string")
    t = spark.createDataFrame([(2, "p"), (3, "p"), (3, "p"), (3, None)], "target bigint, activity string")
    found = graph.context_transitions(e, c, t)
    assert {tuple(r) for r in found.collect()} == {("x", "p", 3), ("x", None, 2), ("y", "p", 2), ("y", None, 1)}
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_of_edges_grow_with_the_table(spark, monkeypatch):
    from conftest import SMALL

    from signalloom.plans import graphs

    few = [sorted(map(tuple, graphs.QUERIES[q](spark, SMALL).collect())) for q in ("q41_edge_aggregate", "q44_context_transitions", "r05_label_propagation")]
    monkeypatch.setattr(graphs, "TASK_ROWS", 500)
    assert graphs._edges(spark, SMALL).rdd.getNumPartitions() > 10
    assert few == [sorted(map(tuple, graphs.QUERIES[q](spark, SMALL).collect())) for q in ("q41_edge_aggregate", "q44_context_transitions", "r05_label_propagation")]


def test_modularity_of_two_triangles(spark):
    e = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]
    u = graph.topology(spark.createDataFrame(e, "source bigint, target bigint"))
    labels = spark.createDataFrame([(i, "x" if i < 4 else "y") for i in range(1, 7)], "id bigint, label string")
    (r,) = graph.modularity(u, labels).collect()
    assert r["total_weight"] == 7 and abs(r["modularity"] - (6 / 7 - 0.5)) < 1e-12


def test_ward_families():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (6, 3)), rng.normal(5, 0.1, (6, 3))])
    label, score = clustering.partition(x)
    assert label.tolist() == [0] * 6 + [1] * 6 and score > 0.9
    assert clustering.partition(x[:3])[0].tolist() == [0, 0, 0]
    assert clustering.partition(np.zeros((5, 2)))[1] == 0.0  # equal rows
    merges = clustering.ward(x)
    brute = min((np.linalg.norm(x[i] - x[j]), i, j) for i in range(12) for j in range(i))
    assert abs(merges[0][2] - brute[0]) < 1e-9 and len(merges) == 11


def test_families_refuse_more_rows_than_fit(spark, monkeypatch):
    rows = spark.createDataFrame([(1, i, [float(i)]) for i in range(5)], "g int, k int, x array<double>")
    assert {r["family"] for r in clustering.families(rows, ["g"], "k", "x").collect()} <= {1, 2}
