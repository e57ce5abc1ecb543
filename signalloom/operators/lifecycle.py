"""Runs over a corpus: which recordings are due, how they are bound to their sidecars and earlier runs, indexes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import scalar


def glob_regex(pattern: str) -> str:
    """A regular expression for a shell pattern: * and ? match any characters, slashes too, and [..] one of a set."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            k = end
        else:
            out += "\\" + c if not c.isalnum() and c != "_" and not c.isspace() else c
        k += 1
    return f"(?s)^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    return scalar.any_of(F.lit(False), *[path.rlike(glob_regex(p)) for p in patterns])


def run_status(corpus: DataFrame, finished: DataFrame, patterns: list[str], limit_seconds: float, first: int | None = None) -> DataFrame:
    """The corpus (relative_path, sha256, present, duration_seconds) with ``status`` of each recording; no row is dropped but by ``first``.

    missing, excluded by a pattern, skipped_complete if ``finished`` (relative_path, sha256, provenance) has a validated
    run of the same content, deferred if longer than the limit, else planned. ``first`` keeps the first recordings by
    path before anything else is done: the feature of a trial run.
    """
    rows = corpus.orderBy("relative_path").limit(first) if first is not None else corpus
    done = finished.where("provenance = 'validated'").select("relative_path", "sha256").distinct().withColumn("_done", F.lit(True))
    rows = rows.join(done, ["relative_path", "sha256"], "left")
    status = (
        F.when(~F.coalesce("present", F.lit(False)), "missing").when(excluded(F.col("relative_path"), patterns), "excluded").when(F.col("_done"), "skipped_complete")
        .when(F.col("duration_seconds") > limit_seconds, "deferred").otherwise("planned")
    )
    return rows.withColumn("status", status).drop("_done")


def provenance_id(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Runs with ``run_id``, run_ and 16 digits of the digest of all that the run depends on."""
    return runs.withColumn("run_id", scalar.content_id("run", *[F.col(c) for c in sorted(columns)]))


def provenance_status(evidence: DataFrame, columns: list[str]) -> DataFrame:
    """Evidence with ``provenance`` validated, legacy_missing or invalid: whether its run_id is that of its own columns."""
    want = scalar.content_id("run", *[F.col(c) for c in sorted(columns)])
    return evidence.withColumn("provenance", F.when(F.col("run_id").isNull(), "legacy_missing").when(F.col("run_id") == want, "validated").otherwise("invalid"))


def tree_digest(files: DataFrame) -> DataFrame:
    """One row: a digest of a source tree from (path, sha256) of its files, in order of path. Trees are small; a file gives one row."""
    pairs = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return files.agg(F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["path"], p["sha256"])), "\n"), 256).alias("tree_sha256"))


def recording_manifests(recordings: DataFrame, curated: DataFrame) -> DataFrame:
    """Recordings (relative_path, sha256, inferred labels) with the paths of equal content, and labels: what was curated of the same content, else inferred.

    ``curated``: sha256, category, intent. Adds label_source curated, inferred or none.
    """
    w = Window.partitionBy("sha256")
    paths = F.array_sort(F.collect_set("relative_path").over(w))
    c = curated.dropDuplicates(["sha256"]).select("sha256", F.col("category").alias("_c"), F.col("intent").alias("_i"))
    rows = recordings.withColumn("_p", F.when(F.col("sha256").isNotNull(), paths)).join(c, "sha256", "left")
    peers = F.coalesce(F.array_except("_p", F.array("relative_path")), F.array().cast("array<string>"))
    source = F.when(F.col("_c").isNotNull() | F.col("_i").isNotNull(), "curated").when(F.col("category").isNotNull() | F.col("intent").isNotNull(), "inferred").otherwise("none")
    return rows.select("relative_path", "sha256", F.coalesce("_c", "category").alias("category"), F.coalesce("_i", "intent").alias("intent"), source.alias("label_source"), peers.alias("duplicates"))


def unchanged(before: DataFrame, after: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """Keys whose content is no longer what it was when work began: (key, before, after)."""
    b, a = before.select(key, F.col(digest).alias("before")), after.select(key, F.col(digest).alias("after"))
    return b.join(a, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def bound(recordings: DataFrame, sidecars: DataFrame, name: str) -> DataFrame:
    """Recordings with <name>_status missing, validated or invalid and <name>_error: a sidecar (relative_path, sidecar_sha256, error) counts only for the content it names."""
    s = sidecars.dropDuplicates(["relative_path"]).select("relative_path", "sidecar_sha256", F.col("error").alias("_e"), F.lit(True).alias("_has"))
    rows = recordings.join(s, "relative_path", "left")
    wrong = F.coalesce(F.col("_e"), F.when(~F.col("sidecar_sha256").eqNullSafe(F.col("sha256")), "digest differs"))
    status = F.when(F.col("_has").isNull(), "missing").when(wrong.isNull(), "validated").otherwise("invalid")
    return rows.withColumn(f"{name}_status", status).withColumn(f"{name}_error", F.when(F.col("_has"), wrong)).drop("_e", "_has", "sidecar_sha256")


def fresh(document: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of a derived document (source, source_sha256, ...) with ``stale``: whether a source (source, sha256) is another one by now, or gone."""
    now = sources.select("source", F.col("sha256").alias("_now"))
    return document.join(now, "source", "left").withColumn("stale", ~F.col("source_sha256").eqNullSafe(F.col("_now"))).drop("_now")


def canonical_rows(rows: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each content (sha256, else the path): the first by ``order``, which is what the policies differ in, then by path."""
    w = Window.partitionBy(F.coalesce("sha256", F.concat(F.lit("path:"), F.col("relative_path")))).orderBy(*order, "relative_path")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def index(recordings: DataFrame, manifests: DataFrame, providers: DataFrame, transcripts: DataFrame, evidence: DataFrame) -> DataFrame:
    """The corpus index: each recording with the status of its sidecars and evidence, whether it is indexed, and its record's digest."""
    rows = recordings
    for name, side in (("manifest", manifests), ("provider", providers), ("transcript", transcripts), ("evidence", evidence)):
        rows = bound(rows, side, name)
    names = ("manifest", "provider", "transcript", "evidence")
    bad = scalar.any_of(*[F.col(f"{n}_status") == "invalid" for n in names])
    status = F.when(bad, "invalid").when(F.col("evidence_status") == "validated", "indexed").otherwise("pending")
    rows = rows.withColumn("index_status", status)
    return rows.withColumn("record_id", scalar.content_id("record", F.col("relative_path"), F.col("sha256"), *[F.col(f"{n}_status") for n in names]))


def status_counts(index_rows: DataFrame) -> DataFrame:
    """(field, value, n) for every status of an index, most frequent first within a field."""
    fields = [c for c in index_rows.columns if c.endswith("_status")]
    long = index_rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields])).alias("x")).select("x.*")
    return long.groupBy("field", "value").agg(F.count("*").alias("n")).orderBy("field", F.desc("n"), "value")


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sorted distinct values of each column, empty ones as unknown."""
    return rows.agg(*[F.array_sort(F.collect_set(F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unknown")))).alias(c) for c in columns])


def warnings(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(warning, n): how many rows each rule holds for, rules that hold for none left out; one pass over the rows."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"w{k}") for k, c in enumerate(rules.values())])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("warning"), F.col(f"w{k}").alias("n")) for k, name in enumerate(rules)])).alias("x")).select("x.*").where("n > 0")


def finite(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """A text or number as a finite double within the bounds, else null."""
    v = x.cast("string").try_cast("double")
    ok = ~F.isnan(v) & (F.abs(v) < float("inf"))
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.when(ok, v)


def measurement(name: str, value: Column, unit: str) -> Column:
    """A measurement: name, value (finite or null) and unit."""
    return F.struct(F.lit(name).alias("name"), finite(value).alias("value"), F.lit(unit).alias("unit"))


def evidence(rows: DataFrame, kind: str, subject: list[str], measures: dict[str, tuple[Column, str]], confidence: Column) -> DataFrame:
    """Results of an analysis as evidence: evidence_id, evidence_type, subject (JSON), confidence within 0 and 1, measurements. One function serves every analysis."""
    m = F.array(*[measurement(n, c, u) for n, (c, u) in measures.items()])
    out = rows.select(F.to_json(F.struct(*subject)).alias("subject"), finite(confidence, 0.0, 1.0).alias("confidence"), m.alias("measurements"))
    key = scalar.content_id("evidence", F.lit(kind), F.col("subject"), F.to_json("measurements"))
    return out.select(key.alias("evidence_id"), F.lit(kind).alias("evidence_type"), "subject", "confidence", "measurements")


def measurement_map(measurements: Column) -> Column:
    """name -> value of an array of measurements; of equal names the last counts."""
    names = F.array_distinct(F.transform(measurements, lambda m: m["name"]))
    last = lambda n: F.element_at(F.filter(measurements, lambda m: m["name"] == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def evidence_summary(found: DataFrame, by: list[str]) -> DataFrame:
    """For each subject: number of evidence objects, of distinct ones, and the most confident of each type (of equal ones the smaller id)."""
    once = found.dropDuplicates([*by, "evidence_id"])
    n = found.groupBy(*by).agg(F.count("*").alias("n_objects"))
    best = once.groupBy(*by, "evidence_type").agg(F.min_by(F.struct("evidence_id", "confidence"), F.struct(-F.coalesce("confidence", F.lit(0.0)), "evidence_id")).alias("b"), F.count("*").alias("k"))
    g = best.groupBy(*by).agg(F.sum("k").alias("n_distinct"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("evidence_type", "b")))).alias("strongest"))
    return n.join(g, by)


def contained_labels(names: DataFrame, key: str, name: str, vocabulary: DataFrame, label: str) -> DataFrame:
    """(key, label): vocabulary labels whose words stand in a name in a row, without those inside a longer one that does too.

    Names and labels are normalised (see scalar.label). A name's word sequences meet the vocabulary in an equi-join, so
    no name is compared with every label; sequences are as long as the longest label.
    """
    v = vocabulary.select(scalar.label(F.col(label)).alias("_label")).where("_label is not null").distinct()
    longest = v.agg(F.max(F.size(F.split("_label", "_"))).alias("_most"))
    rows = names.select(key, F.split(scalar.label(F.col(name)), "_").alias("_w")).where("_w is not null").join(F.broadcast(longest)).where("_most is not null")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.col("_most"), F.size("_w") - i + 1)), lambda n: F.array_join(F.slice("_w", i, n), "_"))))
    found = rows.select(key, F.explode(F.array_distinct(grams)).alias("_label")).join(v, "_label")
    one = found.groupBy(key).agg(F.collect_set("_label").alias("_all"))
    inside = lambda a, b: (a != b) & F.concat(F.lit("_"), b, F.lit("_")).contains(F.concat(F.lit("_"), a, F.lit("_")))
    kept = F.filter("_all", lambda a: ~F.exists("_all", lambda b: inside(a, b)))
    return one.select(key, F.explode(kept).alias("label"))
