"""Claims against observations: scope, combination of candidates, validity, support, comparison, report and bundling.

A claim is a row: claim_id, required, evidence_type, metric, unit, modality, channels (array), regions (array), t0, t1
(null: any time), kind (scalar, category, boolean, interval, linear_curve), target (double), target_text, low, high, v0,
v1, comparison, most_absolute, most_relative, floor, margin, least_coverage, least_confidence. An observation has the same
scope, and kind, value (double), value_text, coverage, confidence, evidence_ids (array).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.scalar import any_of

#: Which kinds of target each comparison fits (fixed values).
FITS = {
    "exact": ("category", "boolean", "scalar"), "absolute": ("scalar",), "relative": ("scalar",), "absolute_or_relative": ("scalar",),
    "interval_containment": ("interval",), "curve_fit": ("linear_curve",),
}
KEYS = ["evidence_type", "metric", "unit", "modality"]
SAME_TIME = 1e-9


def validity_error(c: str = "") -> Column:
    """Why a claim cannot be judged, or null."""
    col = lambda n: F.col(f"{c}{n}")
    fits = any_of(*[(col("comparison") == k) & col("kind").isin(*v) for k, v in FITS.items()])
    return (
        F.when(~F.coalesce(fits, F.lit(False)), F.concat_ws(" ", col("comparison"), F.lit("is incompatible with"), col("kind")))
        .when((col("kind") == "interval") & ~F.coalesce(col("low") <= col("high"), F.lit(False)), "interval is upside down")
        .when(col("t0").isNotNull() & ~F.coalesce(col("t1") > col("t0"), F.lit(False)), "time range is not positive")
    )


def scope_matches(claim: str, seen: str) -> Column:
    """Equal sets of regions, no foreign channel, and equal times unless the claim names none."""
    a, b = (lambda n: F.col(f"{claim}.{n}")), (lambda n: F.col(f"{seen}.{n}"))
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    near = lambda n: F.coalesce(F.abs(a(n) - b(n)) <= SAME_TIME, F.lit(False))
    return within(a("regions"), b("regions")) & within(b("regions"), a("regions")) & within(b("channels"), a("channels")) & (a("t0").isNull() | (near("t0") & near("t1")))


def matched(claims: DataFrame, observations: DataFrame) -> DataFrame:
    """Each claim with the observation that answers it, if any: kind, value, value_text, coverage, confidence, evidence_ids with prefix o_.

    Of candidates with just the claim's channels the scalar nearest to a scalar target answers, else the first by id. If
    there are none, candidates that together cover the channels answer if they all saw the same, with the least coverage
    and confidence and the union of their evidence.
    """
    c, o = claims.alias("c"), observations.alias("o")
    on = [F.col(f"c.{k}") == F.col(f"o.{k}") for k in KEYS]
    both = c.join(o, on).where(scope_matches("c", "o"))
    exact = (F.size(F.array_except("c.channels", "o.channels")) == 0).alias("exact")
    apart = F.when((F.col("c.kind") == "scalar") & (F.col("o.kind") == "scalar"), F.abs(F.col("o.value") - F.col("c.target")))
    cand = both.select(
        "c.claim_id", F.col("c.channels").alias("wanted"), exact, F.col("o.channels").alias("channels"), apart.alias("apart"), "o.observation_id",
        *[F.col(f"o.{n}").alias(n) for n in ("kind", "value", "value_text", "coverage", "confidence", "evidence_ids")],
    )
    w = Window.partitionBy("claim_id").orderBy(F.asc_nulls_last("apart"), "observation_id")
    one = cand.where("exact").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    rest = cand.join(one.select("claim_id"), "claim_id", "left_anti")
    seen = F.struct("kind", "value", "value_text")
    many = rest.groupBy("claim_id").agg(
        F.first("wanted").alias("wanted"), F.array_distinct(F.flatten(F.collect_list("channels"))).alias("channels"), F.min(seen).alias("_lo"), F.max(seen).alias("_hi"),
        F.min("coverage").alias("coverage"), F.min("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"),
    ).where((F.col("_lo") == F.col("_hi")) & (F.size("wanted") > 0) & (F.size(F.array_except("wanted", "channels")) == 0))
    names = ["kind", "value", "value_text", "coverage", "confidence", "evidence_ids"]
    found = one.select("claim_id", *names).unionByName(many.select("claim_id", "_lo.kind", "_lo.value", "_lo.value_text", "coverage", "confidence", "evidence_ids"))
    return claims.join(found.select("claim_id", *[F.col(n).alias(f"o_{n}") for n in names]), "claim_id", "left")


def support_failure() -> Column:
    """What a matched claim's observation has too little of, or null. Bounds that are null ask for nothing."""
    return F.when(F.col("o_coverage") < F.col("least_coverage"), "coverage is below the minimum").when(F.col("o_confidence") < F.col("least_confidence"), "confidence is below the minimum")


def agrees() -> Column:
    """Whether a matched claim's observation lies within its tolerance; for curves see ``curve_errors``."""
    off = F.abs(F.col("o_value") - F.col("target"))
    share = off / F.greatest(F.abs("target"), F.coalesce("floor", F.lit(1e-12)))
    margin = F.coalesce("margin", F.lit(0.0))
    absolute, relative = off <= F.col("most_absolute"), share <= F.col("most_relative")
    same = F.when(F.col("kind") == "scalar", F.col("o_value") == F.col("target")).otherwise(F.col("o_value_text") == F.col("target_text"))
    return F.coalesce(
        F.when(F.col("comparison") == "exact", same).when(F.col("comparison") == "absolute", absolute).when(F.col("comparison") == "relative", relative)
        .when(F.col("comparison") == "absolute_or_relative", F.coalesce(absolute, F.lit(False)) | F.coalesce(relative, F.lit(False)))
        .when(F.col("comparison") == "interval_containment", (F.col("o_value") >= F.col("low") - margin) & (F.col("o_value") <= F.col("high") + margin))
        .when(F.col("comparison") == "curve_fit", F.col("curve_agrees")),
        F.lit(False),
    )


def curve_errors(claims: DataFrame, points: DataFrame) -> DataFrame:
    """claim_id, max_error, rmse, n_points, curve_agrees: points (claim_id, t, value) against the line from (t0, v0) to (t1, v1)."""
    rows = points.join(claims.select("claim_id", "t0", "t1", "v0", "v1", "most_absolute"), "claim_id")
    share = F.when(F.col("t1") > F.col("t0"), (F.col("t") - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumn("_e", F.col("value") - (F.col("v0") + share * (F.col("v1") - F.col("v0"))))
    g = rows.groupBy("claim_id").agg(F.max(F.abs("_e")).alias("max_error"), F.sqrt(F.avg(F.col("_e") ** 2)).alias("rmse"), F.count("*").alias("n_points"), F.first("most_absolute").alias("_m"))
    return g.withColumn("curve_agrees", F.coalesce(F.col("max_error") <= F.col("_m"), F.lit(False))).drop("_m")


def judged(claims: DataFrame, observations: DataFrame, declared_missing: DataFrame | None = None, points: DataFrame | None = None) -> DataFrame:
    """Each claim with ``state``: invalid_declaration, not_evaluated, unsupported, agree or disagree, and ``reason``.

    A claim without an observation is not_evaluated if ``declared_missing`` (evidence_type, metric) names it, else unsupported.
    """
    m = matched(claims, observations)
    if points is not None:
        m = m.join(curve_errors(claims, points).select("claim_id", "curve_agrees"), "claim_id", "left")
    else:
        m = m.withColumn("curve_agrees", F.lit(None).cast("boolean"))
    if declared_missing is not None:
        m = m.join(declared_missing.select("evidence_type", "metric").distinct().withColumn("_told", F.lit(True)), ["evidence_type", "metric"], "left")
    else:
        m = m.withColumn("_told", F.lit(None).cast("boolean"))
    nothing, wrong, weak = F.col("o_kind").isNull() & F.col("curve_agrees").isNull(), validity_error(), support_failure()
    state = (
        F.when(wrong.isNotNull(), "invalid_declaration").when(nothing & F.col("_told"), "not_evaluated").when(nothing | weak.isNotNull(), "unsupported")
        .when(agrees(), "agree").otherwise("disagree")
    )
    why = F.coalesce(wrong, F.when(nothing, "no observation"), weak)
    return m.withColumn("state", state).withColumn("reason", why).drop("_told")


def demo_label(by: list[str]) -> list[Column]:
    """Aggregates that label the claims of a group: only required claims count; all agree, some agree without contradiction, or exploratory."""
    own = F.when(F.col("required"), F.col("state"))
    good, bad = F.count_if(own == "agree"), F.count_if(own.isin("disagree", "invalid_declaration"))
    n = F.count(own)
    return [F.when((n > 0) & (good == n), "verified").when((good > 0) & (bad == 0), "partially_verified").otherwise("exploratory").alias("label")]


def report(results: DataFrame, by: list[str]) -> DataFrame:
    """One row for each demo: label and the number of claims in each state."""
    states = ("agree", "disagree", "unsupported", "not_evaluated", "invalid_declaration")
    return results.groupBy(*by).agg(*demo_label(by), F.count("*").alias("n_claims"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states])


def gated(results: DataFrame, documents: DataFrame, by: list[str]) -> DataFrame:
    """Results whose documents failed a check before (``documents``: by, error) all become invalid; repeated claim ids do as well."""
    n = F.count("*").over(Window.partitionBy(*by, "claim_id"))
    rows = results.withColumn("_n", n).join(documents.where("error is not null").groupBy(*by).agg(F.min("error").alias("_error")), by, "left")
    error = F.coalesce("_error", F.when(F.col("_n") > 1, "claim id is not unique"))
    return rows.withColumn("reason", F.coalesce(error, F.col("reason"))).withColumn("state", F.when(error.isNotNull(), "invalid_declaration").otherwise(F.col("state"))).drop("_n", "_error")


#: Fields by which a request would tell the observer what to find.
TELLING = ("expected", "expected_value", "target", "tolerance", "schedule", "claims", "minimum", "maximum")


def blind_errors(requests: DataFrame, key: str, body: str) -> DataFrame:
    """(key, field): fields of a JSON request, at any depth, that a blind request must not have, each once."""
    names = F.regexp_extract_all(F.col(body), F.lit(r'"([^"\\]+)"\s*:'), 1)
    return requests.select(key, F.explode(F.array_distinct(names)).alias("field")).where(F.lower("field").isin(*TELLING))


def bundled(observations: DataFrame, by: list[str], identity: list[str], digest: str) -> DataFrame:
    """One row for each bundle: number of parts, error (fewer than two, differing identity, not blind, digest mismatch), unions of lists in first-seen order.

    ``observations``: by, position, identity fields, blind, digest, actual_digest, limitations (array), observed (array), missing (array).
    """
    merged = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c])))
    g = observations.groupBy(*by).agg(
        F.count("*").alias("n_parts"), any_of(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 1 for c in identity]).alias("_apart"), F.bool_and("blind").alias("_blind"),
        F.bool_and(F.col(digest).eqNullSafe(F.col(f"actual_{digest}"))).alias("_same"), merged("limitations").alias("limitations"), merged("observed").alias("observed"), merged("missing").alias("_missing"),
    )
    error = F.when(F.col("n_parts") < 2, "a bundle needs two observations").when(F.col("_apart"), "identity differs").when(~F.coalesce("_blind", F.lit(False)), "an observation was not blind").when(~F.col("_same"), "digest does not match")
    return g.select(*by, "n_parts", error.alias("error"), "limitations", "observed", F.array_except("_missing", "observed").alias("not_evaluated"))


def pinned(documents: DataFrame, content: str, digest: str) -> DataFrame:
    """Documents with ``pinned``: whether the digest of the content is the given one."""
    return documents.withColumn("pinned", F.coalesce(F.sha2(F.col(content), 256) == F.lit(digest), F.lit(False)))


def protocol_errors(segments: DataFrame, commands: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, rule, subject) of everything wrong with device protocols.

    segments: session_id, segment_id, start_ms, end_ms, layer, overlap_with (array), command_ids (array); commands:
    session_id, command_id; sessions: session_id, duration_ms. Segments meet only those of their own session and layer.
    """
    err = lambda df, rule, subject: df.select("session_id", F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    twice = segments.groupBy("session_id", "segment_id").count().where("count > 1")
    out = err(twice, "duplicate segment", "segment_id").unionByName(err(commands.groupBy("session_id", "command_id").count().where("count > 1"), "duplicate command", "command_id"))
    s = segments.join(sessions, "session_id", "left")
    out = out.unionByName(err(s.where("end_ms <= start_ms or start_ms < 0"), "segment is not positive", "segment_id"))
    out = out.unionByName(err(s.where("duration_ms is null or end_ms > duration_ms"), "segment leaves the session", "segment_id"))
    named = segments.select("session_id", F.explode("command_ids").alias("command_id"))
    out = out.unionByName(err(named.join(commands.select("session_id", "command_id"), ["session_id", "command_id"], "left_anti").distinct(), "unknown command", "command_id"))
    told = segments.select("session_id", "segment_id", F.explode("overlap_with").alias("other")).distinct()
    known = segments.select("session_id", F.col("segment_id").alias("other")).distinct()
    out = out.unionByName(err(told.join(known, ["session_id", "other"], "left_anti").select("session_id", "other").distinct(), "unknown segment", "other"))
    # what overlaps, from a sweep over sorted starts: those that begin before the latest end so far
    side = lambda p: segments.select("session_id", *[F.col(c).alias(f"{p}{c}") for c in ("segment_id", "start_ms", "end_ms")])
    bucket = 1_000
    spread = lambda df, p: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{p}start_ms") / bucket), F.floor(F.greatest(F.col(f"{p}end_ms") - 1, F.col(f"{p}start_ms")) / bucket))))
    meet = spread(side("a_"), "a_").join(spread(side("b_"), "b_"), ["session_id", "_b"])
    meet = meet.where("a_segment_id <> b_segment_id and a_start_ms < b_end_ms and b_start_ms < a_end_ms").select("session_id", F.col("a_segment_id").alias("segment_id"), F.col("b_segment_id").alias("other")).distinct()
    pair = F.concat_ws("|", "segment_id", "other").alias("pair")
    out = out.unionByName(err(meet.join(told, ["session_id", "segment_id", "other"], "left_anti").select("session_id", pair), "undeclared overlap", "pair"))
    return out.unionByName(err(told.join(meet, ["session_id", "segment_id", "other"], "left_anti").select("session_id", pair), "declared overlap is none", "pair"))
