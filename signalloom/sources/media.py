"""Recordings: discovery, manifests, header probes, sample scans and raw frames."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File names that count as recordings (fixed values).
SUFFIXES = ("mp3", "wav", "flac", "m4a", "aac", "ogg")


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """One row for each recording below ``root``, found by listing alone: path, relative_path, name, stem, suffix, size, source, category, intent.

    The last three are the first three folders of the relative path, null where it is less deep.
    """
    glob = "*.{" + ",".join([*SUFFIXES, *map(str.upper, SUFFIXES)]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("size"))
    rel = F.regexp_replace(F.regexp_extract(F.col("path"), "(?:^[a-z0-9]+:/*)?(.*)", 1), "^/*" + _quoted(root.split(":", 1)[-1].strip("/")) + "/*", "")
    folders = F.slice(F.split("relative_path", "/"), 1, F.size(F.split("relative_path", "/")) - 1)
    out = files.withColumn("relative_path", rel).withColumn("name", base_name(F.col("relative_path"))).withColumn("_f", folders)
    out = out.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    return out.select("path", "relative_path", "name", "stem", "suffix", "size", *[F.get("_f", k).alias(c) for k, c in enumerate(("source", "category", "intent"))])


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with header: all columns as text, ``filename`` among them."""
    return spark.read.option("header", "true").csv(path)


def with_manifest(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Recordings on disk and in a manifest, each once, sorted by relative path; the manifest's labels win.

    A manifest row means the recording of its exact path, else the only one of its base name. A row that means none is
    kept as missing. Adds ``origin``: manifest, discovered or missing.
    """
    listed = listed.dropDuplicates(["filename"])
    only = found.withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where("_n = 1").select("name", F.col("relative_path").alias("_by_name"))
    exact = found.select(F.col("relative_path").alias("filename"), F.col("relative_path").alias("_exact"))
    m = listed.join(exact, "filename", "left").withColumn("name", base_name(F.col("filename"))).join(only, "name", "left").drop("name")
    m = m.withColumn("_at", F.coalesce("_exact", "_by_name")).drop("_exact", "_by_name")
    labels = [c for c in ("source", "category", "intent") if c in listed.columns]
    m = m.select("filename", "_at", *[F.col(c).alias(f"_m_{c}") for c in labels])
    w = Window.partitionBy("_at").orderBy("filename")
    m = m.withColumn("_k", F.when(F.col("_at").isNotNull(), F.row_number().over(w))).where("_k is null or _k = 1").drop("_k")
    both = found.join(m, found["relative_path"] == m["_at"], "full_outer")
    origin = F.when(F.col("path").isNull(), "missing").when(F.col("filename").isNotNull(), "manifest").otherwise("discovered")
    merged = [F.coalesce(f"_m_{c}", c).alias(c) if c in labels else F.col(c) for c in ("source", "category", "intent")]
    return both.select(F.coalesce("relative_path", "filename").alias("relative_path"), "path", "size", *merged, origin.alias("origin")).orderBy("relative_path")


def _opened(path: str):
    import pyarrow.fs as fs

    system, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def wav_header(head: bytes) -> dict | None:
    """Rate, channels, sample width, frames and the offset of the samples, from the first bytes of a WAV file; null if it is none."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(head):
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
            fmt = (kind, channels, rate, bits)
        if name == b"data" and fmt:
            kind, channels, rate, bits = fmt
            return {"format": kind, "channels": channels, "sample_rate": rate, "bits": bits, "n_frames": size // max(1, channels * bits // 8), "offset": at + 8}
        at += 8 + size + size % 2
    return None


PROBE = "channels int, sample_rate int, bits int, n_frames bigint, duration_seconds double, error string"


def probed(recordings: DataFrame, head_bytes: int = 65_536) -> DataFrame:
    """Recordings (with ``path``) and what their headers say; no more than ``head_bytes`` of a file are read. What is no WAV file has an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path in part["path"]:
                try:
                    with _opened(path) as f:
                        h = wav_header(f.read(head_bytes))
                    rows.append({**h, "duration_seconds": h["n_frames"] / h["sample_rate"], "error": None} if h else {"error": "no readable header"})
                except (OSError, ValueError, ZeroDivisionError) as e:
                    rows.append({"error": str(e)[:200]})
            more = pd.DataFrame(rows, columns=["channels", "sample_rate", "bits", "n_frames", "duration_seconds", "error"], index=part.index)
            for c in ("channels", "sample_rate", "bits", "n_frames"):
                more[c] = more[c].astype("Int64")
            yield pd.concat([part, more], axis=1)

    schema = ", ".join(f"`{n}` {t}" for n, t in recordings.dtypes)
    return recordings.mapInPandas(run, f"{schema}, {PROBE}")


def samples(recordings: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(path, sample_rate, i, left, right) of 16-bit or float WAV recordings, read in blocks of frames; right is null if there is one channel.

    Channels beyond the second are left out. A file is read by one task, a block at a time.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                with _opened(path) as f:
                    h = wav_header(f.read(65_536))
                    if not h or (h["format"], h["bits"]) not in ((1, 16), (3, 32)):
                        raise ValueError(f"{path}: only 16-bit and float WAV files are read")
                    kind, scale = ("<i2", 1 / 32768) if h["bits"] == 16 else ("<f4", 1.0)
                    step = h["channels"] * h["bits"] // 8
                    f.seek(h["offset"])
                    done = 0
                    while done < h["n_frames"]:
                        n = min(block, h["n_frames"] - done)
                        data = f.read(n * step)
                        n = len(data) // step
                        if not n:
                            break
                        x = np.frombuffer(data[: n * step], kind).reshape(n, h["channels"]) * scale
                        right = x[:, 1] if h["channels"] > 1 else np.full(n, np.nan)
                        yield pd.DataFrame({"path": path, "sample_rate": h["sample_rate"], "i": np.arange(done, done + n), "left": x[:, 0], "right": right})
                        done += n

    found = recordings.select("path").mapInPandas(run, "path string, sample_rate int, i bigint, left double, right double")
    return found.withColumn("right", F.nanvl("right", F.lit(None)))


def video_probes(documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, width, height, fps_num, fps_den, fps, duration_seconds, n_audio, error) from probe documents in JSON: exactly one video stream, rational rate."""
    schema = "streams array<struct<codec_type:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string,sample_rate:string,channels:int>>, format struct<duration:string>"
    d = documents.select(key, F.from_json(body, schema).alias("p"))
    kind = lambda k: F.filter("p.streams", lambda s: s["codec_type"] == k)
    d = d.withColumn("v", kind("video")).withColumn("n_audio", F.size(kind("audio"))).withColumn("s", F.get("v", F.lit(0)))
    num, den = rational(F.coalesce("s.avg_frame_rate", "s.r_frame_rate"))
    error = F.when(F.col("p.streams").isNull(), "no streams").when(F.size("v") != 1, "not exactly one video stream").when(~F.coalesce((num > 0) & (den > 0), F.lit(False)), "no frame rate")
    return d.select(key, "s.width", "s.height", num.alias("fps_num"), den.alias("fps_den"), F.try_divide(num, den).alias("fps"), F.coalesce("s.duration", "p.format.duration").try_cast("double").alias("duration_seconds"), "n_audio", error.alias("error"))


def rational(text: Column) -> tuple[Column, Column]:
    """Numerator and denominator of `a/b` or `a`; null if it is neither."""
    parts = F.split(text, "/")
    return F.get(parts, F.lit(0)).try_cast("bigint"), F.when(F.size(parts) == 1, F.lit(1).cast("bigint")).otherwise(F.get(parts, F.lit(1)).try_cast("bigint"))


def frame_times(documents: DataFrame, key: str, body: str) -> DataFrame:
    """(key, frame, t) of the frame times listed in probe documents; frames without a time are kept with null."""
    d = documents.select(key, F.from_json(body, "frames array<struct<best_effort_timestamp_time:string>>").alias("p"))
    return d.select(key, F.posexplode("p.frames").alias("frame", "f")).select(key, "frame", F.col("f.best_effort_timestamp_time").try_cast("double").alias("t"))


def raw_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(path, frame, rgb) of files of uncompressed frames of 3 bytes a pixel, one frame in memory at a time; a broken last frame is an error."""
    size = width * height * 3
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, length in zip(part["path"], part["length"], strict=True):
                if length % size:
                    raise ValueError(f"{name}: {length} bytes are not whole frames of {size}")
                with _opened(name) as f:
                    for k in range(length // size):
                        yield pd.DataFrame({"path": [name], "frame": [k], "rgb": [f.read(size)]})

    return files.mapInPandas(run, "path string, frame bigint, rgb binary")


def pixels(frames: DataFrame, by: list[str], width: int) -> DataFrame:
    """(by, frame, x, y, r, g, b) of frames with ``rgb``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                a = np.frombuffer(row["rgb"], np.uint8).reshape(-1, 3)
                n = np.arange(len(a))
                yield pd.DataFrame({**{c: row[c] for c in by}, "frame": row["frame"], "x": n % width, "y": n // width, "r": a[:, 0], "g": a[:, 1], "b": a[:, 2]}).astype({"r": int, "g": int, "b": int})

    kinds = dict(frames.dtypes)
    return frames.select(*by, "frame", "rgb").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", frame bigint, x int, y int, r int, g int, b int")


def traces(spark: SparkSession, path: str, digest_of: str) -> DataFrame:
    """A written trace table, refused unless its digest (see sinks.write_traces) is the one given."""
    from signalloom.sources.sinks import table_digest

    t = spark.read.parquet(path)
    if table_digest(t) != digest_of:
        raise ValueError(f"{path}: the trace is not the one that was bound")
    return t


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV file of samples (n,) or (n, channels) within -1 and 1; for tests and examples."""
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1 if x.ndim == 1 else x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def json_lines(rows: list[dict]) -> str:
    return "\n".join(json.dumps(r, sort_keys=True) for r in rows)
