"""Queries that link peaks to tracks and judge sampled series. Samples are hourly sums of each event type, as a series of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators import clustering, linking, matching, signal
from signalloom.plans.joins import SPANS
from signalloom.plans.signals import DAY, HOUR
from signalloom.sources.tables import events, table

QUERIES, SQL = {}, {}
#: Samples in a time unit of the made series: hours in a day.
RATE = 24


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TRACKS = f"""{SPANS}, k AS (SELECT s.user_id, s.event_id, s.event_type, t0 / 1e6 AS a, t1 / 1e6 AS b, value AS f, (s.event_id % 7 + 3) / 10.0 AS m FROM s JOIN events e ON e.event_id = s.event_id),
p AS (SELECT l.user_id, l.event_id AS left_id, r.event_id AS right_id, greatest(0, least(l.b, r.b) - greatest(l.a, r.a)) AS o, least(l.b - l.a, r.b - r.a) AS shorter, abs(l.f - r.f) AS d, least(l.m, r.m) / greatest(l.m, r.m) AS balance, (l.m + r.m) / 2 AS mm
  FROM k l JOIN k r ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'view')"""


def _tracks(spark, sf_dir):
    e = events(spark, sf_dir)
    start, stop = F.col("t") / 1e6, (F.col("t") + F.floor(F.col("value") * 600_000_000)) / 1e6
    return e.select(
        "user_id", "event_id", "event_type", start.alias("start_seconds"), stop.alias("end_seconds"), (stop - start).alias("duration_seconds"), F.col("value").alias("average_frequency_hz"),
        ((F.col("event_id") % 7 + 3) / 10).alias("average_magnitude"), F.lit(1.0).alias("continuity"), F.lit(1.0).alias("frequency_stability"),
    )


def _pairs(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    side = lambda kind: t.where(F.col("event_type") == kind).drop("event_type")
    return linking.carrier_pairs(side("click"), side("view"), ["user_id"])


CONFIDENCE = "round(o / shorter * balance * least(1.0, mm) * greatest(0, 1 - d / 40), 4)"
KEPT = "o >= 30 AND shorter > 0 AND o / nullif(shorter, 0) >= 0.75 AND d <= 40 AND balance >= 0.25"
KIND = "CASE WHEN round_even(r, 0) BETWEEN 2 AND 4 AND abs(r - round_even(r, 0)) <= 0.015::DOUBLE * round_even(r, 0) THEN 'harmonic_relationship' WHEN d < 0.1 THEN 'shared_carrier' WHEN d < 0.5 THEN 'slight_detuning' WHEN d <= 40 THEN 'beat_candidate' ELSE 'wide_interval' END"


@query(f"WITH {TRACKS} SELECT user_id, left_id, right_id, round(o, 3) AS overlap_seconds, round(d, 4) AS difference_hz, {CONFIDENCE}::DOUBLE AS confidence FROM p WHERE {KEPT}")
def q51_carrier_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("user_id", F.col("l_event_id").alias("left_id"), F.col("r_event_id").alias("right_id"), F.round("overlap_seconds", 3).alias("overlap_seconds"), F.round("difference_hz", 4).alias("difference_hz"), "confidence")


@query(f"WITH {TRACKS}, x AS (SELECT p.*, greatest(l.f, r.f) / nullif(least(l.f, r.f), 0) AS r FROM p JOIN k l ON l.event_id = left_id JOIN k r ON r.event_id = right_id WHERE {KEPT}) SELECT {KIND} AS kind, count(*)::BIGINT AS n FROM x GROUP BY 1")
def q55_carrier_pair_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalloom.functions import scalar

    kind = scalar.carrier_pair(F.col("difference_hz"), F.col("l_average_frequency_hz"), F.col("r_average_frequency_hz"))
    return _pairs(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def _peaks(spark, sf_dir):
    """Each type's values of a day, as the peaks of that window."""
    e = events(spark, sf_dir)
    w = F.floor(F.col("t") / DAY).cast("bigint")
    return e.select("event_type", w.alias("window_index"), F.struct((-F.col("value")).alias("v"), "event_id").alias("rank"), F.col("value").alias("frequency_hz"), F.col("value").alias("difference_hz"),
                    (1 / (1 + F.col("value"))).alias("magnitude"), (w * 86400.0).alias("start_seconds"), ((w + 1) * 86400.0).alias("end_seconds"))


@query()
def r01_carrier_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linking.linked(_peaks(spark, sf_dir).drop("difference_hz"), ["event_type"], "window_index", "rank", "frequency_hz", 3.0, 2)
    return linking.carrier_tracks(found, ["event_type"])


@query()
def r02_protocol_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of differences, scored as hypotheses, and of near ones of a band only the best."""
    from signalloom.functions import scalar

    p = _peaks(spark, sf_dir).drop("frequency_hz").withColumnRenamed("magnitude", "confidence")
    found = linking.linked(p, ["event_type"], "window_index", "rank", "difference_hz", 3.0, 2)
    t = linking.protocol_tracks(found.withColumn("band", scalar.band(F.col("difference_hz"))), ["event_type"])
    score = linking.hypothesis_score(F.col("average_confidence"), F.col("frequency_stability"), F.col("duration_seconds"), F.col("average_difference_hz"), F.col("band"))
    t = t.withColumn("hypothesis_score", F.round(score, 4)).withColumn("intent", linking.intent(F.col("average_difference_hz"))).where("hypothesis_score >= 0.005").withColumn("place", -F.col("hypothesis_score"))
    kept = linking.distinct_hypotheses(t.select("event_type", "band", "place", "track_id", "average_difference_hz", "hypothesis_score", "intent", "score"), ["event_type", "band"], ["place", "track_id"], "average_difference_hz")
    return kept.drop("place")


def _series(spark, sf_dir):
    """Hourly sums of each type's values, hours without events as 0: (event_type, i, left, right); right counts them."""
    h = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / HOUR).alias("h")).agg(F.sum("value").alias("v"), F.count("*").cast("double").alias("n"))
    span = h.groupBy("event_type").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    every = span.select("event_type", "lo", F.explode(F.sequence("lo", "hi")).alias("h"))
    return every.join(h, ["event_type", "h"], "left").select("event_type", (F.col("h") - F.col("lo")).alias("i"), F.coalesce("v", F.lit(0.0)).alias("left"), F.coalesce("n", F.lit(0.0)).alias("right"))


@query()
def r03_modulation_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily envelope modulation in ten-day frames, linked to tracks in each channel, and channels' tracks paired one to one."""
    by = ["event_type", "channel"]
    frames = signal.framed(signal.channels(_series(spark, sf_dir)), by, RATE, 10, 1)
    w = signal.envelopes(frames, [*by, "frame", "start_seconds", "end_seconds"], RATE, 0.5, 8.0, 12).withColumn("window_index", F.col("frame"))
    obs = linking.modulation_observations(w)
    totals = w.groupBy(*by).agg(F.count("*").alias("total_windows"))
    tracks = linking.modulation_tracks(linking.linked(obs, by, "window_index", "rank", "modulation_hz", 1.0, 1, tracks_first=False), by, totals)
    side = lambda c: tracks.where(F.col("channel") == c).drop("channel")
    pairs = linking.modulation_pairs(side("left"), side("right"), ["event_type"])
    order = F.struct((-F.col("confidence")).alias("c"), "l_track_id", "r_track_id")
    best = matching.greedy(pairs.withColumn("place", order), ["event_type"], "l_track_id", "r_track_id", "place")
    return best.select("event_type", "l_track_id", "r_track_id", "confidence", "difference_hz", "l_classification", "r_classification")


@query()
def r04_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of each series, by daily features, and what each is made of."""
    rows = _series(spark, sf_dir)
    st = signal.stages(rows, ["event_type"], RATE, seconds=1.0, shortest=3.0)
    made = signal.stage_classes(signal.staged(rows, ["event_type"], st, RATE), ["event_type", "stage"], RATE, 0.5, 11.0)
    return st.join(made, ["event_type", "stage"], "left")


@query()
def r06_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["event_type"]
    found = signal.pulses(signal.channels(_series(spark, sf_dir)), [*by, "channel"], RATE, RATE, 0.05, 6.0)
    return signal.stereo_pulse(found, by)


@query()
def r07_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of the mean vectors of each label's tenths, ordered by their spread: Ward clustering of a few dozen summaries."""
    e = table(spark, sf_dir, "embeddings").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(10)))
    long = e.select("label", "part", F.posexplode("embedding").alias("d", "x"))
    m = long.groupBy("label", "part", "d").agg(F.avg("x").alias("m")).groupBy("label", "part").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("v"))
    rows = m.select(F.lit(1).alias("one"), F.concat_ws("-", "label", "part").alias("key"), "label", F.transform("v", lambda s: s["m"]).alias("x"))
    found = clustering.families(rows, ["one"], "key", "x").join(rows.select("key", "label"), "key")
    return clustering.relabelled(found, "family", [F.min("label"), F.min("key")]).select("key", "label", "family_id", F.round("silhouette", 6).alias("silhouette"), F.round("mean_silhouette", 6).alias("mean_silhouette"))


@query()
def r08_stage_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series, perturbed in 19 ways, classified again: spread of its confidence and whether a threshold of 0.5 is safe."""
    rows = signal.perturbed(_series(spark, sf_dir), ["event_type"])
    made = signal.stage_classes(rows, ["event_type", "variant", "family"], RATE, 0.5, 11.0)
    g = signal.robustness(made, ["event_type"])
    return g.withColumn("against_half", signal.against_threshold(F.col("lowest"), F.col("highest"), F.lit(0.5)))


@query()
def r09_spectrum_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.spectrum_peaks(_series(spark, sf_dir), ["event_type"], RATE, 0.1, 12.0, 10, seconds=30)


@query()
def r10_phase_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = signal.framed(_series(spark, sf_dir), ["event_type"], RATE, 10, 5)
    return signal.phases(frames, ["event_type", "frame"], RATE, 2.0, 2.0, 2.0, 0.5)


@query()
def r11_modulation_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = signal.framed(_series(spark, sf_dir), ["event_type"], RATE, 10, 2)
    w = signal.ridge_windows(frames, ["event_type", "frame", "start_seconds", "end_seconds"], RATE, (1.0, 8.0), 0.2, 4.0, 12)
    return signal.ramp(w, ["event_type"], 10)
