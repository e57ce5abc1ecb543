"""Video gates and schedules, claims, and streams against their batch twins."""

from __future__ import annotations

import datetime
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from signalloom.operators import claims, linking, video
from signalloom.streaming import timelines


@pytest.fixture(scope="module")
def quadrants(spark):
    """Four quadrants that toggle every 6, 8, 10 and 12 frames, 8 x 8 pixels, 48 frames."""
    rows = []
    for f in range(48):
        for y in range(8):
            for x in range(8):
                on = f // (6 + 2 * (x // 4 + 2 * (y // 4))) % 2 == 0
                rows.append(("v", f, x, y, *([200, 200, 200] if on else [0, 0, 0])))
    return spark.createDataFrame(rows, "v string, frame bigint, x int, y int, r int, g int, b int").cache()


def test_regions_gates_and_windows(spark, quadrants):
    found = video.regions(quadrants, ["v"], 8, 8)
    assert sorted(r["position"] for r in found.collect()) == ["bottom_left", "bottom_right", "top_left", "top_right"]
    assert video.independent(found, ["v"]).first()["independent"]
    gate = video.gates(found.where("position = 'top_left'"), ["v"])
    off = video.off_intervals(gate, ["v", "region"], 12.0).orderBy("start_seconds").collect()
    assert [(r["start_seconds"], r["end_seconds"]) for r in off] == [(0.5, 1.0), (1.5, 2.0), (2.5, 3.0), (3.5, 4.0)]
    w = video.gate_windows(gate, ["v", "region"], 12.0, 3.0, 1.0).orderBy("start_seconds").collect()
    assert [(r["start_seconds"], r["n_edges"], r["rate_hz"], r["duty"]) for r in w] == [(0.0, 3, 1.0, 0.5), (1.0, 3, 1.0, 0.5)]
    t = video.region_traces(quadrants, ["v"], found)
    e = video.edge_stability(t, ["v", "region"]).collect()
    assert len(e) == 4 and all(r["stable"] for r in e)


def test_declared_gates_are_exact(spark):
    segments = [("d", 0, 0, 2_000_000, 4_000, 9_000, 250_000, True, "continue"), ("d", 1, 2_000_000, 3_000_000, 3_333, 3_333, 400_000, True, "continue"),
                ("d", 2, 3_000_000, 3_500_000, 0, 0, 0, False, "continue"), ("d", 3, 3_500_000, 4_500_000, 7_001, 2_003, 600_000, True, "reset")]
    df = spark.createDataFrame(segments, "d string, position int, start_us bigint, end_us bigint, f0_mhz bigint, f1_mhz bigint, duty_ppm bigint, on boolean, policy string")
    want, phase = {}, Fraction(0)
    for _, _, a, b, f0, f1, duty, on, policy in segments:
        phase = phase if on and policy == "continue" else Fraction(0)
        at = lambda t: Fraction(f0, 1000) * t + Fraction(f1 - f0, 1000) * t * t / (2 * Fraction(b - a, 10**6))  # noqa: B023, E731
        for k in range(600):
            if a * 120 <= k * 10**6 < b * 120:
                p = phase + at(Fraction(k * 10**6 // 120 - a, 10**6))
                want[k] = on and p % 1 < Fraction(duty, 10**6)
        phase = (phase + at(Fraction(b - a, 10**6))) if on else Fraction(0)
    got = {r["frame"]: r["on"] for r in video.declared(df, ["d"], 120).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)


def test_comparisons_of_gates_colours_and_clocks(spark):
    g = spark.createDataFrame([("v", k, k % 4 < 2) for k in range(20)], "v string, frame bigint, on boolean")
    (r,) = video.compared(g, g.withColumn("on", F.when(F.col("frame") == 3, True).otherwise(F.col("on"))).where("frame < 19"), ["v"], 1.0).collect()
    assert (r["n_frames"], r["n_mismatch"], r["n_untold"], r["n_unseen"]) == (20, 1, 1, 0)
    c = spark.createDataFrame([("v", k, 10, 20, 30 + 5 * (k == 2)) for k in range(4)], "v string, frame bigint, r int, g int, b int")
    (r,) = video.colour_errors(c, c.withColumn("b", F.lit(30)), ["v"]).collect()
    assert (r["largest"], r["mean"], r["n_beyond"]) == (5, 1.25, 1)
    values = [(k * 7919 + 13) % 101 / 10 for k in range(200)]
    pairs = lambda lag: spark.createDataFrame([("v", "c", k, values[k], values[k - lag], 0.0, 0.0) for k in range(10, 200)], "v string, component string, t int, left double, right double, start_gap double, duration_gap double")
    assert [video.clocks(pairs(lag), ["v"], 1 / 60, 6).first()["classification"] for lag in (0, 4)] == ["aligned", "rejected"]
    s = spark.createDataFrame([("v", i, 1.0 if i // 50 % 2 == 0 else 0.0) for i in range(1000)], "v string, i bigint, left double")
    loud = video.frame_loudness(s, ["v"], 100, 2.0)
    (r,) = video.gate_alignment(loud, loud.withColumn("on", F.col("frame") % 2 == 0), ["v"]).collect()
    assert r["n"] == 20 and r["correlation"] > 0.999 and r["mean_on"] == 1 and r["mean_off"] == 0


def test_levels_colours_and_emphasis(spark):
    v = spark.createDataFrame([("v", float(x)) for x in (0, 1, 2, 90, 95, 100)], "v string, x double")
    assert sorted((r["x"], r["level"]) for r in video.two_levels(v, ["v"], "x").collect()) == [(0, 0), (1, 0), (2, 0), (90, 1), (95, 1), (100, 1)]
    c = spark.createDataFrame([(0, 0, 0), (0, 200, 0), (200, 0, 200), (9, 9, 200)], "r int, g int, b int")
    assert [r[0] for r in c.select(video.colour_state(F.col("r"), F.col("g"), F.col("b"))).collect()] == ["black", "green", "magenta", "other"]
    e = spark.createDataFrame([("v", 0, 1, 10.0), ("v", 0, 2, 10.0), ("v", 1, 1, 30.0), ("v", 1, 2, 10.0)], "v string, edge int, region int, energy double")
    assert {(r["edge"], r["region"]) for r in video.emphasis(e, ["v"]).collect()} == {(0, 2), (1, 1)}


CLAIM = "claim_id string, required boolean, evidence_type string, metric string, unit string, modality string, channels array<string>, regions array<string>, t0 double, t1 double, kind string, target double, target_text string, low double, high double, v0 double, v1 double, comparison string, most_absolute double, most_relative double, floor double, margin double, least_coverage double, least_confidence double"
SEEN = "observation_id string, evidence_type string, metric string, unit string, modality string, channels array<string>, regions array<string>, t0 double, t1 double, kind string, value double, value_text string, coverage double, confidence double, evidence_ids array<string>"


def test_claims(spark):
    def claim(i, metric="m", **k):
        base = dict(claim_id=i, required=True, evidence_type="e", metric=metric, unit="u", modality="audio", channels=["l"], regions=[], t0=None, t1=None, kind="scalar", target=10.0, target_text=None, low=None, high=None,
                    v0=None, v1=None, comparison="absolute", most_absolute=1.0, most_relative=None, floor=None, margin=None, least_coverage=0.5, least_confidence=0.5)
        return tuple((base | k).values())

    def seen(i, metric="m", **k):
        base = dict(observation_id=i, evidence_type="e", metric=metric, unit="u", modality="audio", channels=["l"], regions=[], t0=0.0, t1=1.0, kind="scalar", value=10.5, value_text=None, coverage=0.9, confidence=0.9, evidence_ids=[i])
        return tuple((base | k).values())

    cs = [
        claim("agree"), claim("off", target=20.0), claim("bad", comparison="curve_fit"), claim("weak", metric="w"), claim("none", metric="n"), claim("told", metric="t"), claim("both", metric="b", channels=["l", "r"]),
        claim("rel", target=20.0, comparison="absolute_or_relative", most_relative=0.5), claim("in", kind="interval", comparison="interval_containment", low=11.0, high=13.6, margin=0.5), claim("when", t0=0.0, t1=2.0),
        claim("upside", kind="interval", comparison="interval_containment", low=3.0, high=2.0), claim("line", metric="c", kind="linear_curve", comparison="curve_fit", t0=0.0, t1=2.0, v0=0.0, v1=4.0),
    ]
    obs = [seen("o1", value=14.0), seen("o2"), seen("o3", metric="w", coverage=0.1), seen("o4", metric="b"), seen("o5", metric="b", channels=["r"], confidence=0.7)]
    points = spark.createDataFrame([("line", 0.0, 0.5), ("line", 1.0, 2.0), ("line", 2.0, 3.5)], "claim_id string, t double, value double")
    j = claims.judged(spark.createDataFrame(cs, CLAIM), spark.createDataFrame(obs, SEEN), spark.createDataFrame([("e", "t")], "evidence_type string, metric string"), points)
    got = {r["claim_id"]: r for r in j.collect()}
    assert {i: r["state"] for i, r in got.items()} == {
        "agree": "agree", "off": "disagree", "bad": "invalid_declaration", "weak": "unsupported", "none": "unsupported", "told": "not_evaluated", "both": "agree", "rel": "agree", "in": "agree", "when": "unsupported",
        "upside": "invalid_declaration", "line": "agree"}
    assert got["both"]["o_confidence"] == 0.7 and got["both"]["o_evidence_ids"] == ["o4", "o5"]
    label = lambda *ids: claims.report(j.where(F.col("claim_id").isin(*ids)), ["modality"]).first()["label"]
    assert [label("agree", "rel"), label("agree", "none"), label("agree", "off"), label("none")] == ["verified", "partially_verified", "exploratory", "exploratory"]
    gated = claims.gated(j, spark.createDataFrame([("audio", "digest differs")], "modality string, error string"), ["modality"])
    assert {r["state"] for r in gated.collect()} == {"invalid_declaration"}


def test_blind_requests_and_bundles(spark):
    req = spark.createDataFrame([("a", '{"x": {"Expected": 1}, "y": 2}'), ("b", '{"y": "target"}')], "k string, body string")
    assert [tuple(r) for r in claims.blind_errors(req, "k", "body").collect()] == [("a", "Expected")]
    rows = [("x", 1, "d", True, "h", "h", ["l1"], ["m1"], ["m2", "m3"]), ("x", 2, "d", True, "h", "h", ["l2", "l1"], ["m2"], ["m3"]), ("y", 1, "d", True, "h", "h", [], [], []), ("z", 1, "d", True, "h", "g", [], [], []), ("z", 2, "d", True, "h", "h", [], [], [])]
    df = spark.createDataFrame(rows, "b string, position int, demo string, blind boolean, sha string, actual_sha string, limitations array<string>, observed array<string>, missing array<string>")
    got = {r["b"]: r for r in claims.bundled(df, ["b"], ["demo"], "sha").collect()}
    assert (got["x"]["error"], got["x"]["limitations"], got["x"]["not_evaluated"]) == (None, ["l1", "l2"], ["m3"]) and got["y"]["error"] and got["z"]["error"] == "digest does not match"
    assert [r["pinned"] for r in claims.pinned(spark.createDataFrame([("a",), ("b",)], "t string"), "t", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb").collect()] == [True, False]


def test_streams_give_what_batches_give(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=7 * i + 40 * (i // 9)), i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, value double")
    for k in range(3):
        df.where(F.col("event_id").between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = timelines.event_stream(spark, f"{tmp_path}/in")
    batch = df.withColumn("at", F.col("ts").cast("timestamp"))
    # a window is given out once the latest time is past its end
    timelines.run_to_end(timelines.hopping(stream, ["user_id"], "1 hour", "30 minutes", "1 second"), f"{tmp_path}/c1", path=f"{tmp_path}/w")
    got = {(r["user_id"], r["window_start"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/w").collect()}
    want = {(r["user_id"], r["w"]["start"]): r["n"] for r in batch.groupBy("user_id", F.window("at", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got.items() <= want.items() and len(want) - len(got) <= 9
    timelines.run_to_end(timelines.sessions(stream, ["user_id"], "25 minutes", "1 second"), f"{tmp_path}/c2", path=f"{tmp_path}/s")
    got = {(r["user_id"], r["start"], r["stop"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/s").collect()}
    want = {(r["user_id"], r["start"], r["stop"]): r["n"] for r in timelines.batch_sessions(batch, ["user_id"], 25 * 60).collect()}
    assert got.items() <= want.items() and len(want) - len(got) <= 3 and len(got) > 5
    write = timelines.into_table(f"{tmp_path}/t", ["event_id"])
    timelines.run_to_end(stream, f"{tmp_path}/c3", write=write)
    write(batch, 99)  # a batch written again
    assert spark.read.parquet(f"{tmp_path}/t").count() == 60


def test_linking_in_a_stream(spark, tmp_path):
    rows = [(s, w, [float((w * 3 + s * k) % 11 + k) for k in range(3)]) for s in (1, 2) for w in range(12)]
    df = spark.createDataFrame(rows, "s bigint, window_index bigint, frequencies array<double>")
    for k in range(3):
        df.where(F.col("window_index").between(4 * k, 4 * k + 3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    timelines.run_to_end(timelines.tracks(stream, ["s"], 1.5, 1), f"{tmp_path}/c", path=f"{tmp_path}/out")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    flat = df.select("s", "window_index", F.posexplode("frequencies").alias("k", "f"))
    want = sorted((r["s"], r["window_index"], r["f"], r["track_id"]) for r in linking.linked(flat, ["s"], "window_index", "k", "f", 1.5, 1).collect())
    assert got == want and len(got) == 72


def test_large_windows_in_a_stream(spark, tmp_path):
    """Windows of 25,000 peaks, given out in parts; each against each would be 625 million comparisons a window."""
    rng = random.Random(7)
    rows = [("x", w, sorted(round(rng.expovariate(1 / 50), 2) for _ in range(25_000))) for w in range(5)]
    df = spark.createDataFrame(rows, "s string, window_index bigint, frequencies array<double>")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    began = time.monotonic()
    timelines.run_to_end(timelines.tracks(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["s"], 3.0, 2), f"{tmp_path}/c", path=f"{tmp_path}/out")
    assert time.monotonic() - began < 90
    flat = df.select("s", "window_index", F.posexplode("frequencies").alias("k", "f"))
    want = linking.linked(flat, ["s"], "window_index", "k", "f", 3.0, 2).select("s", "window_index", "f", "track_id")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 125_000 and got.exceptAll(want).isEmpty()
