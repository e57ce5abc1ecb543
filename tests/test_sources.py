"""Sources and sinks on made files."""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.sources import captures, media, sinks


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_recordings_from_disk_and_manifest(spark, tmp_path):
    wave = media.wav_bytes(np.stack([np.full(50, 0.5), np.full(50, -0.25)], axis=1), 100)
    for name in ("lab/focus/deep/a.wav", "lab/sleep/b.wav", "c.MP3", "lab/notes.txt"):
        write(f"{tmp_path}/root/{name}", wave)
    write(f"{tmp_path}/m.csv", "filename,category,notes\nlab/focus/deep/a.wav,study,x\nb.wav,rest,y\ngone.wav,rest,z\n")
    found = media.discovered(spark, f"{tmp_path}/root")
    rows = {r["relative_path"]: r for r in found.collect()}
    assert set(rows) == {"lab/focus/deep/a.wav", "lab/sleep/b.wav", "c.MP3"}
    a = rows["lab/focus/deep/a.wav"]
    assert (a["source"], a["category"], a["intent"], a["stem"], a["suffix"]) == ("lab", "focus", "deep", "a", "wav")
    merged = [(r["relative_path"], r["origin"], r["category"]) for r in media.with_manifest(found, media.manifest(spark, f"{tmp_path}/m.csv")).collect()]
    assert merged == [("c.MP3", "discovered", None), ("gone.wav", "missing", "rest"), ("lab/focus/deep/a.wav", "manifest", "study"), ("lab/sleep/b.wav", "manifest", "rest")]
    write(f"{tmp_path}/root/bad.wav", b"RIFFnothing")
    probes = {os.path.basename(r["path"]): r for r in media.probed(media.discovered(spark, f"{tmp_path}/root")).collect()}
    assert probes["a.wav"]["duration_seconds"] == 0.5 and probes["a.wav"]["channels"] == 2 and probes["bad.wav"]["error"]
    x = media.samples(found.where("stem = 'a'"), block=7).orderBy("i").collect()
    assert [r["i"] for r in x] == list(range(50)) and abs(x[9]["left"] - 0.5) < 1e-3 and abs(x[9]["right"] + 0.25) < 1e-3


def test_frames_and_probe_documents(spark, tmp_path):
    write(f"{tmp_path}/v.rgb", bytes(range(24)))
    frames = media.raw_frames(spark, f"{tmp_path}/v.rgb", 2, 2)
    px = media.pixels(frames, ["path"], 2).where("frame = 1").orderBy("y", "x").collect()
    assert [(p["x"], p["y"], p["r"], p["g"], p["b"]) for p in px] == [(0, 0, 12, 13, 14), (1, 0, 15, 16, 17), (0, 1, 18, 19, 20), (1, 1, 21, 22, 23)]
    with pytest.raises(Exception, match="whole frames"):
        media.raw_frames(spark, f"{tmp_path}/v.rgb", 3, 2).collect()
    good = {"streams": [{"codec_type": "video", "width": 4, "height": 2, "avg_frame_rate": "60000/1001"}, {"codec_type": "audio"}], "format": {"duration": "2.5"}, "frames": [{"best_effort_timestamp_time": "0.5"}, {}]}
    docs = spark.createDataFrame([("a", json.dumps(good)), ("b", json.dumps({"streams": []})), ("c", None)], "k string, body string")
    p = {r["k"]: r for r in media.video_probes(docs, "k", "body").collect()}
    assert (p["a"]["fps_num"], p["a"]["fps_den"], p["a"]["error"], p["a"]["duration_seconds"]) == (60000, 1001, None, 2.5) and p["b"]["error"] and p["c"]["error"]
    assert [(r["frame"], r["t"]) for r in media.frame_times(docs.where("k = 'a'"), "k", "body").collect()] == [(0, 0.5), (1, None)]


def test_captures(spark, tmp_path):
    track = lambda i, **more: {"id": i, "name": f"n{i}", **more}
    body = json.dumps([track("2"), track("3")])
    har = {"log": {"entries": [
        {"request": {"url": "https://h/v3/tracks/1/similar?x=1"}, "response": {"content": {"text": base64.b64encode(body.encode()).decode(), "encoding": "base64"}}},
        {"request": {"url": "https://h/x"}, "response": {"content": {"text": "no json"}}}]}}
    write(f"{tmp_path}/in/a.har", json.dumps(har))
    tags = [{"type": "t", "value": "y"}, {"type": "t", "value": "x"}]
    write(f"{tmp_path}/in/b.json", json.dumps(track("7", tags=tags, similarTracks=[track("8")], mentalState={"displayValue": "Focus"}, variations=[{"url": "https://h/f.mp3?token=1"}])) + "\n" + json.dumps({"k": 1}))
    write(f"{tmp_path}/in/c.json", "{broken")
    files = captures.scan(spark, f"{tmp_path}/in")
    docs = captures.parsed(files)
    kinds = {os.path.basename(r["path"]): (r["format"], r["error"] is None) for r in docs.collect()}
    assert kinds == {"a.har": ("har", True), "b.json": ("concatenated_json", True), "c.json": (None, False)}
    lists = {(os.path.basename(r["path"]), r["source"], tuple(r["targets"])) for r in captures.ranked_lists(docs).collect()}
    assert lists == {("a.har", "1", ("2", "3")), ("b.json", "7", ("8",))}
    t = captures.tracks(captures.objects(docs.where("error is null"), ["path", "number"]), ["path", "number"])
    (seven,) = t.where("id = '7'").collect()
    assert seven["mental_state"] == "Focus" and seven["tags"] == {"t": ["x", "y"]} and seven["similar"] == ["8"]
    joined = captures.variation_join(spark.createDataFrame([("f.mp3",), ("g.mp3",)], "name string"), t)
    assert {(r["name"], r["status"]) for r in joined.collect()} == {("f.mp3", "ok"), ("g.mp3", "unmatched")}
    bad = {(r["at"], r["reason"]) for r in captures.sensitive(docs.where("error is null"), ["path"]).collect()}
    assert bad == {("$.variations[0].url", "value")}
    names = spark.createDataFrame([("x/.hid",), ("x/a.png",), ("x/a.json",), ("x/b.metadata.json",)], "path string")
    assert [r["path"] for r in captures.candidates(names).collect()] == ["x/a.json"]


def test_capture_tree_and_best_capture(spark):
    c = spark.createDataFrame([("p/a.json",), ("q/a.json",), ("p/b.json",), ("p/d.json",)], "path string")
    r = spark.createDataFrame([("s/a.mp3",), ("s/b.mp3",), ("s/e.mp3",), ("s/f.mp3",)], "relative_path string")
    found = {(x["key"], x["status"]) for x in captures.capture_tree(c, r, spark.createDataFrame([("f",)], "stem string")).collect()}
    assert found == {("a", "ambiguous_capture"), ("b", "matched"), ("d", "unmatched_capture"), ("e", "missing_capture"), ("f", "existing_sidecar")}
    c = spark.createDataFrame([("s/a_20250102.json",), ("t/a_20250103.json",), ("t/b_20250101.json",), ("s/b_20250101.json",)], "path string")
    best = {x["relative_path"]: x["capture"] for x in captures.best_captures(c, r.where("relative_path like 's/a%' or relative_path like 's/b%'"), spark.createDataFrame([("z",)], "stem string")).collect()}
    assert best == {"s/a.mp3": "t/a_20250103.json", "s/b.mp3": "s/b_20250101.json"}


def test_transcripts_and_protocols(spark, tmp_path):
    doc = {"status": "COMPLETED", "results": {"items": [{"id": 0, "type": "pronunciation"}, {"id": 1, "type": "punctuation"}], "audio_segments": [
        {"id": 0, "start_time": "0.5", "end_time": "2.0", "transcript": "hi.", "items": [0, 1]}, {"id": 1, "start_time": "3", "end_time": "4", "transcript": "x", "items": [9]}]}}
    write(f"{tmp_path}/t/a.json", json.dumps(doc))
    write(f"{tmp_path}/t/b.json", json.dumps({"status": "FAILED"}))
    rows = captures.transcripts(spark, f"{tmp_path}/t").collect()
    assert sorted((r["status"], r["segment"], r["n_words"], r["error"]) for r in rows if r["segment"] is not None) == [("COMPLETED", 0, 1, None), ("COMPLETED", 1, 0, "segment names an unknown item")]
    assert [r["error"] for r in rows if r["status"] == "FAILED"] == ["job is not completed"]
    out = {"session": {"session_id": "s", "duration_ms": 2000}, "commands": [{"command_id": "c"}], "segments": [
        {"segment_id": "a", "start_ms": 0, "end_ms": 1500, "overlap_with_segment_ids": ["b"], "command_ids": ["c"]},
        {"segment_id": "b", "start_ms": 1000, "end_ms": 2500, "overlap_with_segment_ids": [], "command_ids": ["d"]}]}
    write(f"{tmp_path}/p/x.json", json.dumps(out))
    from signalloom.operators import claims

    sessions, segments, commands = captures.protocols(spark, f"{tmp_path}/p")
    found = {(r["rule"], r["subject"]) for r in claims.protocol_errors(segments, commands, sessions).collect()}
    assert found == {("segment leaves the session", "b"), ("unknown command", "d"), ("undeclared overlap", "b|a")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, [], "</x")], "k int, v array<string>, n string")
    path = f"{tmp_path}/once"
    assert [sinks.write_once(df, path), sinks.write_once(df.repartition(3), path)] == ["written", "unchanged"]
    with pytest.raises(FileExistsError):
        sinks.write_once(df.where("k = 1"), path)
    assert sinks.write_once(df.where("k = 1"), path, overwrite=True) == "overwritten"
    sinks.append_new(df, f"{tmp_path}/add", ["k"])
    sinks.append_new(df.union(df.withColumn("k", F.col("k") + 1)), f"{tmp_path}/add", ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/add").collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_new(df, path)
    assert json.loads(sinks.document(df))[0] == {"k": 1, "n": None, "v": ["a", "b"]} and list(json.loads(sinks.document(df))[0]) == ["k", "n", "v"]
    with pytest.raises(ValueError):
        sinks.document(df, 1)
    sinks.write_csv(df, f"{tmp_path}/csv", ["v", "k"])
    assert {tuple(r) for r in spark.read.option("header", "true").csv(f"{tmp_path}/csv").collect()} == {("a | b", "1"), (None, "2")}
    sinks.write_json(df, f"{tmp_path}/json")
    assert '{"k":1,"n":null,"v":["a","b"]}' in [r["value"] for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert "</x" not in sinks.page(df, "t").split("<script", 1)[1].split("</script>")[0] and "| 1 | a \\| b |" in sinks.markdown(df, "t", ["k", "v"], ["k"], 1)
    bound = sinks.write_traces(df, f"{tmp_path}/trace").first()
    assert media.traces(spark, bound["path"], bound["sha256"]).count() == bound["n"] == 2
    with pytest.raises(ValueError):
        media.traces(spark, bound["path"], "0")
    for status in ("planned", "completed"):
        sinks.record_progress(spark.createDataFrame([("a", status)], "relative_path string, status string"), f"{tmp_path}/log")
    assert [(r["status"], r["paths"]) for r in sinks.progress(spark, f"{tmp_path}/log").collect()] == [("completed", ["a"])]
    lanes = sinks.timeline(spark.createDataFrame([("r", "b", 0, 1), ("r", "a", 1, 2)], "r string, l string, a int, b int"), ["r"], "a", "b", "l")
    assert {(r["l"], r["lane"]) for r in lanes.collect()} == {("a", 1), ("b", 2)}
