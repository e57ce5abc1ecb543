"""Captured provider documents: concatenated JSON, HTTP archives, nested walks, ranked lists, transcripts and device protocols."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HIDDEN = r"(^|/)\.[^/]*$"
NO_CAPTURE = r"(?i)\.(png|jpe?g|gif|webp|svg|metadata\.json|provider\.json|transcript\.json)$"


def json_documents(text: str) -> list:
    """The JSON values that stand one after the other in a text; ValueError where something else stands between them."""
    decoder, at, out = json.JSONDecoder(), 0, []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return out
        value, at = decoder.raw_decode(text, at)
        out.append(value)


def responses(text: str) -> tuple[str, list[tuple[str | None, object]]]:
    """(format, [(request path, document)]): an HTTP archive, one document, or several in a row. Archive bodies that are no JSON are left out."""
    docs = json_documents(text)
    if len(docs) == 1 and isinstance(docs[0], dict) and isinstance(docs[0].get("log"), dict) and "entries" in docs[0]["log"]:
        found = []
        for entry in docs[0]["log"]["entries"] or []:
            content = ((entry or {}).get("response") or {}).get("content") or {}
            body = content.get("text")
            try:
                if content.get("encoding") == "base64":
                    body = base64.b64decode(body or "").decode()
                found.append((urlsplit(((entry.get("request") or {}).get("url")) or "").path or None, json.loads(body)))
            except (ValueError, TypeError):
                continue
        return "har", found
    return ("json" if len(docs) == 1 else "concatenated_json"), [(None, d) for d in docs]


def walked(value: object, path: str = "$") -> Iterator[tuple[str, dict]]:
    """(path, object) of every object within a document, outer ones first."""
    if isinstance(value, dict):
        yield path, value
        for k, v in value.items():
            yield from walked(v, f"{path}.{k}")
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from walked(v, f"{path}[{k}]")


def candidates(files: DataFrame, path: str = "path") -> DataFrame:
    """Files that may be captures: not hidden, no image, no sidecar."""
    return files.where(~F.col(path).rlike(HIDDEN) & ~F.col(path).rlike(NO_CAPTURE))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parsed(files: DataFrame) -> DataFrame:
    """(path, format, number, request_path, document, error): the documents of each file as JSON text with sorted keys; a file that cannot be read has one row with the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["text"], strict=True):
                try:
                    kind, found = responses(text or "")
                    rows += [(path, kind, n, where, json.dumps(d, sort_keys=True), None) for n, (where, d) in enumerate(found)]
                except ValueError as e:
                    rows.append((path, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "format", "number", "request_path", "document", "error"]).astype({"number": "Int32"})

    return files.select("path", "text").mapInPandas(run, "path string, format string, number int, request_path string, document string, error string")


def objects(documents: DataFrame, keys: list[str], body: str = "document") -> DataFrame:
    """(keys, at, object): every object nested in a JSON document, as JSON text, with its path."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                value = json.loads(row[body]) if row[body] else None
                rows += [(*[row[k] for k in keys], at, json.dumps(d, sort_keys=True)) for at, d in walked(value)]
            yield pd.DataFrame(rows, columns=[*keys, "at", "object"])

    kinds = dict(documents.dtypes)
    return documents.select(*keys, body).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", at string, object string")


SENSITIVE_KEY = r"(?i)(token|secret|password|cookie|authorization|credential|api_?key|session_?id)"
SENSITIVE_VALUE = r"(?i)(tokenedurl|[?&](token|signature|auth)=)"


def sensitive(documents: DataFrame, keys: list[str], body: str = "document") -> DataFrame:
    """(keys, at, reason): fields whose name, and texts whose content, must not be passed on, anywhere in a JSON document."""

    def leaves(value: object, path: str) -> Iterator[tuple[str, str | None, str | None]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield f"{path}.{k}", k, v if isinstance(v, str) else None
                yield from leaves(v, f"{path}.{k}")
        elif isinstance(value, list):
            for n, v in enumerate(value):
                if isinstance(v, str):
                    yield f"{path}[{n}]", None, v
                yield from leaves(v, f"{path}[{n}]")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                rows += [(*[row[k] for k in keys], *leaf) for leaf in leaves(json.loads(row[body]) if row[body] else None, "$")]
            yield pd.DataFrame(rows, columns=[*keys, "at", "name", "value"])

    kinds = dict(documents.dtypes)
    flat = documents.select(*keys, body).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", at string, name string, value string")
    reason = F.when(F.col("name").rlike(SENSITIVE_KEY), "field").when(F.col("value").rlike(SENSITIVE_VALUE), "value")
    return flat.select(*keys, "at", reason.alias("reason")).where("reason is not null")


TRACK = """id string, name string, mentalState struct<displayValue:string>, dynamicMentalState struct<displayValue:string>, mobileActivity struct<displayValue:string>, beatsPerMinute double,
 brightnessLevel double, complexityLevel double, releaseStatus string, tags array<struct<type:string,value:string>>, variations array<struct<style:string,neuralEffectLevel:double,lengthInSeconds:double,url:string>>,
 similarTracks array<struct<id:string,name:string>>"""


def tracks(found: DataFrame, keys: list[str]) -> DataFrame:
    """A fixed projection of every object that is a track (has an id and a name): state (else the dynamic one), activity, tags by type as sorted sets, variations."""
    t = found.select(*keys, "at", F.from_json("object", TRACK).alias("t")).where("t.id is not null and t.name is not null")
    kinds = F.array_sort(F.array_distinct(F.transform("t.tags", lambda x: x["type"])))
    tags = F.map_from_entries(F.transform(F.filter(kinds, lambda k: k.isNotNull()), lambda k: F.struct(k.alias("k"), F.array_sort(F.array_distinct(F.transform(F.filter("t.tags", lambda x: x["type"] == k), lambda x: x["value"]))).alias("v"))))
    return t.select(
        *keys, "at", "t.id", "t.name", F.coalesce("t.mentalState.displayValue", "t.dynamicMentalState.displayValue").alias("mental_state"), F.col("t.mobileActivity.displayValue").alias("activity"),
        F.col("t.beatsPerMinute").alias("bpm"), F.col("t.brightnessLevel").alias("brightness"), F.col("t.complexityLevel").alias("complexity"), tags.alias("tags"), "t.variations",
        F.transform("t.similarTracks", lambda s: s["id"]).alias("similar"),
    )


def ranked_lists(documents: DataFrame) -> DataFrame:
    """(path, source, targets) of a capture: lists of requests for a track's similar ones; a capture without these gives those embedded in its tracks."""
    from signalloom.operators.graph import authoritative

    asked = documents.withColumn("source", F.regexp_extract("request_path", "/v3/tracks/([^/]+)/similar", 1)).where("source <> ''")
    asked = asked.select("path", "source", F.transform(F.from_json("document", "array<struct<id:string>>"), lambda s: s["id"]).alias("targets")).where("targets is not null")
    t = tracks(objects(documents.where("error is null"), ["path", "number"]), ["path", "number"])
    return authoritative(asked, t.where(F.size("similar") > 0).select("path", F.col("id").alias("source"), F.col("similar").alias("targets")), ["path"])


def by_file(found: DataFrame, name: str) -> DataFrame:
    """(file, projection, status) of the track whose variation has the given file: ok, conflict if several tracks do, and none is left out by a join with the wanted names (see ``variation_join``)."""
    v = found.select(F.to_json(F.struct("id", "name", "mental_state", "activity", "bpm")).alias("projection"), F.explode("variations").alias("v"))
    v = v.select(F.element_at(F.split(F.regexp_replace("v.url", r"\?.*$", ""), "/"), -1).alias(name), "projection").where(f"{name} is not null")
    return v.groupBy(name).agg(F.min("projection").alias("projection"), F.count_distinct("projection").alias("_n")).withColumn("status", F.when(F.col("_n") > 1, "conflict").otherwise("ok")).drop("_n")


def variation_join(recordings: DataFrame, found: DataFrame, name: str = "name") -> DataFrame:
    """Recordings with the projection of the track that names their file, and status ok, conflict or unmatched."""
    return recordings.join(by_file(found, name), name, "left").withColumn("status", F.coalesce("status", F.lit("unmatched"))).withColumn("projection", F.when(F.col("status") == "ok", F.col("projection")))


def capture_tree(captures: DataFrame, recordings: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Captures (path) and recordings (relative_path) joined on the stem of their names: key, capture, recording, status.

    Several captures of one key are ambiguous, captures without a recording unmatched, recordings without a capture
    missing unless ``sidecars`` (stem) has them already.
    """
    stem = lambda c: F.regexp_replace(F.element_at(F.split(F.col(c), "/"), -1), r"\.[^.]*$", "")
    c = captures.select(stem("path").alias("key"), F.col("path").alias("capture")).withColumn("_n", F.count("*").over(Window.partitionBy("key")))
    r = recordings.select(stem("relative_path").alias("key"), F.col("relative_path").alias("recording"))
    both = c.join(r, "key", "full_outer")
    if sidecars is not None:
        both = both.join(sidecars.select(F.col("stem").alias("key"), F.lit(True).alias("_has")).distinct(), "key", "left")
    else:
        both = both.withColumn("_has", F.lit(None).cast("boolean"))
    status = (
        F.when(F.col("_n") > 1, "ambiguous_capture").when(F.col("recording").isNull(), "unmatched_capture").when(F.col("capture").isNull() & F.col("_has"), "existing_sidecar")
        .when(F.col("capture").isNull(), "missing_capture").otherwise("matched")
    )
    return both.select("key", "capture", "recording", status.alias("status"))


def best_captures(captures: DataFrame, recordings: DataFrame, sidecars: DataFrame) -> DataFrame:
    """For each recording without a sidecar its best capture of the same stem: the latest date (20yymmdd) in its name, then one of the same folder, then the larger path."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(F.col(c), "/"), -1), r"(_?20\d{6})?\.[^.]*$", "")
    folder = lambda c: F.regexp_replace(F.col(c), "/?[^/]*$", "")
    todo = recordings.select(stem("relative_path").alias("stem"), "relative_path").join(sidecars.select("stem"), "stem", "left_anti")
    c = captures.select(stem("path").alias("stem"), "path", F.regexp_extract("path", r"(20\d{6})", 1).alias("date"))
    both = todo.join(c, "stem").withColumn("near", folder("path").endswith(folder("relative_path")))
    return both.groupBy("relative_path").agg(F.max_by("path", F.struct("date", "near", "path")).alias("capture"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, segment, start, stop, n_words, text_sha256, error) of transcription documents; texts are hashed and left out.

    Only completed jobs give segments. A segment that names an item that does not exist has an error.
    """
    item = "struct<id:int,type:string,start_time:string,end_time:string,alternatives:array<struct<content:string>>>"
    schema = f"status string, results struct<items:array<{item}>,audio_segments:array<struct<id:int,start_time:string,end_time:string,transcript:string,items:array<int>>>>"
    d = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.col("_metadata.file_path").alias("path"), "status", "results")
    rows = d.select("path", "status", F.explode_outer(F.when(F.col("status") == "COMPLETED", F.col("results.audio_segments"))).alias("s"), "results.items")
    ids = F.transform("items", lambda i: i["id"])
    start, stop = F.col("s.start_time").try_cast("double"), F.col("s.end_time").try_cast("double")
    n = F.size(F.filter("items", lambda i: F.array_contains("s.items", i["id"]) & (i["type"] == "pronunciation")))
    error = (
        F.when(F.col("status") != "COMPLETED", "job is not completed").when(F.size(F.array_except("s.items", ids)) > 0, "segment names an unknown item")
        .when(~F.coalesce((start >= 0) & (stop >= start), F.lit(False)), "segment has no times")
    )
    return rows.select("path", "status", F.col("s.id").alias("segment"), start.alias("start"), stop.alias("stop"), n.alias("n_words"), F.sha2("s.transcript", 256).alias("text_sha256"), error.alias("error"))


def protocols(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, segments, commands) of device protocol exports, times in milliseconds as exported and in seconds; see claims.protocol_errors."""
    schema = """session struct<session_id:string,duration_ms:bigint>, segments array<struct<segment_id:string,start_ms:bigint,end_ms:bigint,execution_layer:string,intensity:double,color_rgb:array<int>,
      pulse:struct<frequency_hz:double,duty_cycle:double,shape:string>,overlap_with_segment_ids:array<string>,command_ids:array<string>>>, commands array<struct<command_id:string>>"""
    d = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("session_id", F.coalesce("session.session_id", "_metadata.file_name"))
    s = d.select("session_id", F.explode("segments").alias("s")).select("session_id", "s.*")
    s = s.withColumnRenamed("execution_layer", "layer").withColumnRenamed("overlap_with_segment_ids", "overlap_with")
    s = s.withColumn("start_seconds", F.col("start_ms") / 1000).withColumn("end_seconds", F.col("end_ms") / 1000)
    return d.select("session_id", "session.duration_ms"), s, d.select("session_id", F.explode("commands").alias("c")).select("session_id", "c.command_id")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of one schema, one a file, with their path; malformed ones are rows of nulls."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.col("_metadata.file_path").alias("path"), "*")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot tables written by time, in order."""
    from signalloom.operators.history import ordered

    return ordered(spark.read.parquet(path).select("captured_at", "snapshot_id").distinct())
