"""Sampled series: frames, spectra, envelopes, phase, pulses, modulation ridges, stages and their robustness.

A series is rows (by, i, left, right) with i from 0 on; right is null throughout a mono series. What needs a transform
of samples runs as a kernel on a window or a bounded segment; classes and fits are column expressions on its numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import kernels as k
from signalloom.operators import linking, stats

FRAME_SCHEMA = "frame bigint, start_seconds double, end_seconds double"


def framed(series: DataFrame, by: list[str], rate: float, seconds: float, hop: float) -> DataFrame:
    """Rows once for each complete frame that holds them: frame, start_seconds, end_seconds. Sizes are whole samples."""
    size, step = int(seconds * rate), max(1, int(hop * rate))
    n = series.groupBy(*by).agg((F.max("i") + 1).alias("_n"))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / F.lit(step))), F.least(F.floor(F.col("i") / F.lit(step)), F.floor((F.col("_n") - size) / F.lit(step)))
    rows = series.join(n, by).where(F.col("_n") >= size).where(first <= last).withColumn("frame", F.explode(F.sequence(first, last))).drop("_n")
    at = F.col("frame") * step / F.lit(rate)
    return rows.withColumn("start_seconds", at.cast("double")).withColumn("end_seconds", (at + size / rate).cast("double"))


def measured(rows: DataFrame, by: list[str], schema: str, kernel: Callable[[np.ndarray, np.ndarray | None], list[dict]]) -> DataFrame:
    """The rows a kernel makes of the left and right samples of each group, in order of i; the group's keys come first.

    A kernel that raises ValueError (too short, a band out of range) gives no row. Null samples count as 0.
    """
    types = dict(rows.dtypes)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        right = None if part["right"].isna().all() else part["right"].fillna(0).to_numpy(float)
        try:
            found = kernel(part["left"].fillna(0).to_numpy(float), right)
        except ValueError:
            found = []
        return pd.DataFrame([dict(zip(by, key, strict=True)) | row for row in found], columns=[*by, *names])

    full = ", ".join(f"`{c}` {types[c]}" for c in by) + ", " + schema
    names = rows.sparkSession.createDataFrame([], full).columns[len(by) :]
    return rows.select(*by, "i", "left", "right").groupBy(*by).applyInPandas(run, full)


def channels(rows: DataFrame) -> DataFrame:
    """Each channel as a series of its own: column channel, samples in left."""
    sides = F.explode(F.array(F.struct(F.lit("left").alias("channel"), F.col("left").alias("v")), F.struct(F.lit("right").alias("channel"), F.col("right").alias("v"))))
    return rows.withColumn("_s", sides).where("_s.v is not null").withColumn("channel", F.col("_s.channel")).withColumn("left", F.col("_s.v")).withColumn("right", F.lit(None).cast("double")).drop("_s")


def selected(rows: DataFrame, channel: str) -> DataFrame:
    """One channel or the mean of both as a mono series; a mono series serves as left and as mean, and has no right."""
    value = {"left": F.col("left"), "right": F.col("right"), "mean": (F.col("left") + F.coalesce("right", "left")) / 2}[channel]
    return rows.withColumn("left", value).where("left is not null").withColumn("right", F.lit(None).cast("double"))


def spectrum_peaks(rows: DataFrame, by: list[str], rate: float, low: float = 1.0, high: float = 5000.0, top: int = 10, seconds: float = 60.0, segments: int = 8) -> DataFrame:
    """by, rank, frequency_hz, magnitude of the highest spectral peaks of the mean of the channels."""

    def kernel(left, right):
        mono = left if right is None else (left + right) / 2
        return [{"rank": n, "frequency_hz": f, "magnitude": m} for n, (f, m) in enumerate(k.spectrum_peaks(mono, rate, low, high, top, seconds, segments))]

    return measured(rows, by, "rank int, frequency_hz double, magnitude double", kernel)


def envelopes(rows: DataFrame, by: list[str], rate: int, low: float, high: float, target: int) -> DataFrame:
    """Modulation depth and modulation peaks of a band in each group (a series, or a frame of one)."""

    def kernel(left, right):
        env, at = k.envelope(left if right is None else (left + right) / 2, rate, low, high, target)
        found = k.modulation_peaks(env, at, high=min(40.0, at / 2))
        return [{"modulation_depth": round(k.depth(env), 4), "peaks": [{"modulation_hz": f, "relative_power": p} for f, p in found]}]

    return measured(rows, by, "modulation_depth double, peaks array<struct<modulation_hz:double,relative_power:double>>", kernel)


def phases(rows: DataFrame, by: list[str], rate: int, f_left: float, f_right: float, width: float = 10.0, trim: float = 0.5) -> DataFrame:
    """Phase of the right carrier against the left one in each group, with a label of five."""

    def kernel(left, right):
        if right is None:
            return []
        return [k.phase_difference(left, right, rate, f_left, f_right, width, trim)]

    found = measured(rows, by, "difference_hz double, raw_locking double, locking double, offset double, n_samples bigint", kernel)
    return found.withColumn("behavior", phase_behavior(F.col("difference_hz"), F.col("raw_locking"), F.col("locking")))


def phase_behavior(difference: Column, raw: Column, locking: Column) -> Column:
    still = F.abs(difference) < 0.1
    return (
        F.when(still & (raw >= 0.9), "phase_locked").when(still & (locking >= 0.8), "stable_offset").when(~still & (locking >= 0.8), "steady_rotation")
        .when(locking >= 0.5, "partially_coherent").otherwise("unrelated")
    )


PULSE = "n bigint, spread double, onsets array<bigint>, n_valid bigint, duty double, low double, high double, interval double, cv double, harmonic double, rate double"


def pulses(rows: DataFrame, by: list[str], rate: float, target: float = 200.0, slowest: float = 0.5, fastest: float = 40.0) -> DataFrame:
    """Numbers of the pulse of each group's left samples (see ``channels``), with its class and confidence."""

    def kernel(left, right):
        env, at = k.frame_rms(left, rate, target)
        return [k.pulse_measures(env, at, slowest, fastest) | {"rate": at}]

    found = measured(rows, by, PULSE, kernel)
    return found.withColumn("classification", pulse_class()).withColumn("confidence", F.round(pulse_confidence(), 6)).withColumn("pulse_rate_hz", F.when(F.col("n_valid") >= 3, F.round(1 / F.col("interval"), 6)))


LEAST_SPREAD, MOST_CV, HARD, LEAST_LOW = 0.12, 0.2, 0.72, 0.12


def pulse_class() -> Column:
    apart = F.col("low") + F.col("high")
    return (
        F.when(F.col("n") < 4, "insufficient_data").when((F.col("spread") < LEAST_SPREAD) | F.col("duty").isNull(), "no_periodic_pulse")
        .when((F.col("n_valid") < 3) & (F.size("onsets") == 0), "no_periodic_pulse").when((F.col("n_valid") < 3) | (F.col("cv") > MOST_CV), "irregular_transients")
        .when((apart >= HARD) & (F.col("low") >= LEAST_LOW), "hard_gated_pulse_train").when(apart < HARD * 0.82, "smooth_amplitude_modulation").otherwise("rhythmic_amplitude_pulsation")
    )


def pulse_confidence() -> Column:
    apart, regular = F.col("low") + F.col("high"), stats.clip(1 - F.col("cv") / MOST_CV, 0.0, 1.0)
    few = F.when(F.size("onsets") > 0, 0.25).otherwise(0.5)
    c = pulse_class()
    value = (
        F.when(F.col("n") < 4, 0.0).when((F.col("spread") < LEAST_SPREAD) | F.col("duty").isNull(), 1 - F.col("spread") / LEAST_SPREAD).when(F.col("n_valid") < 3, few)
        .when(F.col("cv") > MOST_CV, F.least(F.lit(1.0), 0.5 + F.col("cv"))).when(c == "hard_gated_pulse_train", 0.45 * regular + 0.35 * apart + 0.2 * F.least(F.lit(1.0), F.col("spread")))
        .when(c == "smooth_amplitude_modulation", 0.65 * regular + 0.35 * (1 - F.least(F.lit(1.0), apart))).otherwise(0.6 * regular + 0.25 * apart + 0.15 * F.col("harmonic"))
    )
    return stats.clip(value, 0.0, 1.0)


def stereo_pulse(found: DataFrame, by: list[str]) -> DataFrame:
    """One row for each series from the pulses of its channels: their relation and a label for the whole."""
    one = lambda c, side: F.max(F.when(F.col("channel") == side, F.col(c)))
    g = found.groupBy(*by).agg(
        F.count("*").alias("n_channels"), F.array_sort(F.collect_list("classification")).alias("classes"), F.max("rate").alias("rate"), F.max("confidence").alias("confidence"),
        *[one(c, s).alias(f"{s}_{c}") for s in ("left", "right") for c in ("pulse_rate_hz", "onsets")],
    )
    l, r = F.col("left_pulse_rate_hz"), F.col("right_pulse_rate_hz")  # noqa: E741
    mean = (l + r) / 2
    period = F.col("rate") / mean
    nearest = lambda x: F.array_min(F.transform("right_onsets", lambda y: F.abs(y - x))) % period
    wrapped = F.array_sort(F.transform("left_onsets", lambda x: F.least(nearest(x), period - nearest(x)) / period))
    n = F.size("_w")
    middle = F.when(n % 2 == 1, F.get("_w", (n / 2).cast("int"))).otherwise((F.get("_w", (n / 2).cast("int") - 1) + F.get("_w", (n / 2).cast("int"))) / 2)
    none = l.isNull() | r.isNull() | (F.size("left_onsets") == 0) | (F.size("right_onsets") == 0)
    g = g.withColumn("_w", F.when(~none, wrapped)).withColumn("offset_fraction", F.when(~none, middle))
    relation = (
        F.when(F.col("n_channels") < 2, "mono").when(none, "not_available").when(F.abs(l - r) > F.greatest(F.lit(0.15), 0.08 * mean), "different_rates")
        .when(F.col("offset_fraction") <= 0.1, "synchronized").when(F.col("offset_fraction") >= 0.35, "alternating").otherwise("phase_offset")
    )
    g = g.withColumn("relation", relation)
    hard = F.size(F.filter("classes", lambda c: c == "hard_gated_pulse_train"))
    has = lambda c: F.array_contains("classes", c)
    whole = (
        F.when((hard == 2) & F.col("relation").isin("synchronized", "alternating"), F.concat("relation", F.lit("_isochronic_pulse_candidate")))
        .when(hard == 2, "stereo_offset_isochronic_pulse_candidate").when(hard == 1, "channel_specific_isochronic_pulse_candidate")
        .when(has("rhythmic_amplitude_pulsation"), "periodic_amplitude_pulsation").when(has("smooth_amplitude_modulation"), "smooth_amplitude_modulation")
        .when(has("irregular_transients"), "irregular_transients").when(has("insufficient_data"), "insufficient_data").otherwise("no_periodic_pulse")
    )
    keep = F.when(~F.col("relation").isin("mono", "not_available", "different_rates"), F.round("offset_fraction", 6))
    return g.select(*by, "n_channels", "relation", keep.alias("offset_fraction"), whole.alias("classification"), "confidence", "left_pulse_rate_hz", "right_pulse_rate_hz")


LEAST_VARIATION, LEAST_SNR, LEAST_CONCENTRATION = 0.01, 8.0, 0.12


def ridge_windows(frames: DataFrame, by: list[str], rate: int, carrier: tuple[float, float], low: float, high: float, target: int = 200) -> DataFrame:
    """One row for each frame: the strongest modulation of the carrier band, whether supported, and why not."""

    def kernel(left, right):
        env, at = k.envelope(left if right is None else (left + right) / 2, rate, *carrier, target)
        return [k.ridge(env, at, low, high)]

    w = measured(frames, by, "variation double, rate_hz double, snr_db double, concentration double", kernel)
    why = F.array_compact(F.array(
        F.when(F.col("snr_db").isNull(), "no_modulation_band_energy"), F.when(F.col("variation") < LEAST_VARIATION, "insufficient_envelope_variation"),
        F.when(F.col("snr_db") < LEAST_SNR, "insufficient_spectral_snr"), F.when(F.col("concentration") < LEAST_CONCENTRATION, "diffuse_modulation_spectrum"),
    ))
    score = 0.45 * stats.clip((F.col("snr_db") - LEAST_SNR) / 18, 0.0, 1.0) + 0.35 * stats.clip(F.col("concentration") / (2 * LEAST_CONCENTRATION), 0.0, 1.0)
    score = score + 0.2 * stats.clip(F.col("variation") / (4 * LEAST_VARIATION), 0.0, 1.0)
    w = w.withColumn("reasons", why).withColumn("supported", F.size("reasons") == 0).withColumn("confidence", F.coalesce(F.round(score, 6), F.lit(0.0)))
    return w.withColumn("rate_hz", F.when(F.col("supported"), F.round("rate_hz", 6)))


def ramp(windows: DataFrame, by: list[str], seconds: float, least_coverage: float = 0.5, least_slope: float = 0.05, least_run: float = 0.5, least_r2: float = 0.85) -> DataFrame:
    """A line through the supported rates of each series, judged by coverage, contiguity and fit.

    ``windows``: by, frame, start_seconds, end_seconds, rate_hz, supported, confidence. Every series gives one row.
    """
    rows = windows.withColumn("_t", F.when(F.col("supported"), (F.col("start_seconds") + F.col("end_seconds")) / 2)).withColumn("_y", F.when(F.col("supported"), F.col("rate_hz")))
    runs = linking.islands(rows, by, ["frame"], "supported")
    fit = stats.trend(rows.where("supported"), by, "_t", "_y")
    more = rows.groupBy(*by).agg(
        F.count("*").alias("n_windows"), F.count_if("supported").alias("n_supported"), F.stddev_pop("_y").alias("_sd"),
        (F.max("_y") - F.min("_y")).alias("_ptp"), F.avg(F.when(F.col("supported"), F.col("confidence"))).alias("_conf"),
    )
    g = more.join(fit, by, "left").join(runs, by, "left")
    g = g.withColumn("coverage", F.col("n_supported") / F.col("n_windows")).withColumn("contiguous", F.coalesce(F.col("longest_run") / F.col("n_windows"), F.lit(0.0)))
    enough = (F.col("n_supported") >= 3) & (F.col("coverage") >= least_coverage)
    way = F.when(F.col("slope") >= least_slope, "increasing").when(F.col("slope") <= -least_slope, "decreasing").otherwise("stable")
    g = g.withColumn("direction", F.when(enough, way))
    why = F.array_compact(F.array(
        F.when(F.col("contiguous") < least_run, "insufficient_contiguous_coverage"),
        F.when((F.col("direction") == "stable") & (F.col("_sd") > max(0.25, 0.75 / seconds)), "unstable_ridge_with_near_zero_slope"),
        F.when((F.col("direction") != "stable") & (F.col("r2") < least_r2), "poor_linear_fit"),
    ))
    g = g.withColumn("reasons", F.when(enough, why).otherwise(F.array().cast("array<string>")))
    good = enough & (F.size("reasons") == 0)
    name = F.when(~good, "insufficient_support").when(F.col("direction") == "stable", "stable_modulation").otherwise("continuous_modulation_ramp")
    fitted = stats.clip(1 - F.col("rmse") / F.greatest(F.col("_ptp"), F.lit(1 / seconds)), 0.0, 1.0)
    confidence = F.when(good, stats.clip(F.col("coverage") * (0.65 * F.col("_conf") + 0.35 * fitted), 0.0, 1.0)).otherwise(0.0)
    shown = lambda c: F.when(enough, F.round(c, 6)).alias(c)
    return g.select(*by, "n_windows", "n_supported", "coverage", "contiguous", "direction", shown("slope"), shown("intercept"), shown("rmse"), shown("r2"), "reasons", name.alias("classification"), F.round(confidence, 6).alias("confidence"))


def stages(rows: DataFrame, by: list[str], rate: int, seconds: float = 0.5, least: float = 0.8, shortest: float = 2.0) -> DataFrame:
    """Stages of each series: stage, start_seconds, end_seconds, and the score of the change that begins it.

    Window features are made frame by frame; their changes, a few numbers a window, are weighed for each series.
    """
    size = int(round(seconds * rate))
    frames = framed(rows, by, rate, size / rate, size / rate)

    def kernel(left, right):
        return [{"x": k.stage_features(left, right)}]

    features = measured(frames, [*by, "frame"], "x array<double>", kernel)
    scaled = [F.percentile(F.col("x")[j], F.array(F.lit(0.05), F.lit(0.95))).alias(f"p{j}") for j in range(6)]
    scale = features.groupBy(*by).agg(*scaled).select(*by, F.array(*[F.greatest(F.col(f"p{j}")[1] - F.col(f"p{j}")[0], F.lit(1e-6)) for j in range(6)]).alias("_scale"))
    w = Window.partitionBy(*by).orderBy("frame")
    unit = features.join(scale, by).withColumn("z", F.zip_with("x", "_scale", lambda x, s: x / s)).withColumn("_before", F.lag("z").over(w))
    apart = F.sqrt(F.aggregate(F.zip_with("z", "_before", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))
    scores = unit.select(*by, "frame", apart.alias("score"))
    length = rows.groupBy(*by).agg((F.max("i") + 1).alias("_n"))
    types = dict(rows.dtypes)
    distance = max(1, round(shortest / seconds))

    def cut(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame")
        at = k.boundaries(part["score"].to_numpy()[1:], least, distance, len(part)) if len(part) >= 3 else []
        begins, ends = [0, *at], [*at, None]
        total = float(part["_n"].iloc[0]) / rate
        found = [
            {"stage": n + 1, "start_seconds": b * size / rate, "end_seconds": total if e is None else e * size / rate, "score": None if b == 0 else float(part["score"].iloc[b])}
            for n, (b, e) in enumerate(zip(begins, ends, strict=True))
        ]
        return pd.DataFrame([dict(zip(by, key, strict=True)) | f for f in found])

    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", stage int, start_seconds double, end_seconds double, score double"
    return scores.join(length, by).groupBy(*by).applyInPandas(cut, schema)


def staged(rows: DataFrame, by: list[str], found: DataFrame, rate: int) -> DataFrame:
    """The samples with their stage, renumbered from 0 within it."""
    s = found.select(*by, "stage", F.round(F.col("start_seconds") * rate).cast("bigint").alias("_a"), F.round(F.col("end_seconds") * rate).cast("bigint").alias("_b"))
    own = rows.join(s, by).where("i >= _a and i < _b")
    return own.withColumn("i", F.col("i") - F.col("_a")).drop("_a", "_b")


def stage_classes(rows: DataFrame, by: list[str], rate: int, low: float = 40.0, high: float = 5000.0) -> DataFrame:
    """What each group (a stage) is made of: two carriers apart, a hard gate, smooth modulation, or nothing told."""
    each = channels(rows)
    carrier = spectrum_peaks(each, [*by, "channel"], rate, low, min(high, rate / 2), 1, 10.0, 1).groupBy(*by).agg(
        F.max("frequency_hz").alias("_hi"), F.min("frequency_hz").alias("_lo"), F.count("*").alias("_c"), F.min("magnitude").alias("_m"))
    pulse = stereo_pulse(pulses(each, [*by, "channel"], rate, 1000.0), by)
    g = pulse.join(carrier, by, "left").withColumn("carrier_difference_hz", F.when(F.col("_c") == 2, F.col("_hi") - F.col("_lo")))
    two = F.coalesce(F.col("carrier_difference_hz") >= 0.5, F.lit(False))
    name = F.when(two, "binaural_construction").when(F.col("classification").contains("isochronic_pulse_candidate"), "hard_gated_pulse")
    name = name.when(F.col("classification") == "smooth_amplitude_modulation", "smooth_amplitude_modulation").otherwise("unclassified_audio_stage")
    return g.select(*by, name.alias("construction"), F.round(F.when(two, F.col("_m")).otherwise(F.col("confidence")), 6).alias("confidence"), "carrier_difference_hz", F.col("classification").alias("pulse"))


#: Perturbations of a stage: name, family, gain, shift as a share of the length, noise deviation as a share of the root mean square.
VARIANTS = (
    [("original", "identity", 1.0, 0.0, 0.0)]
    + [(f"gain_{g}", "gain", g, 0.0, 0.0) for g in (0.25, 0.5, 0.75, 1.25, 1.5, 2.0)]
    + [(f"shift_{s}", "shift", 1.0, s, 0.0) for s in (0.01, 0.02, 0.03, 0.05, 0.07, 0.1)]
    + [(f"noise_{e}", "noise", 1.0, 0.0, e) for e in (0.001, 0.002, 0.005, 0.01, 0.02, 0.03)]
)


def perturbed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Every series once for each variant: column variant and family. Noise is a hash of place and variant, the same in every run."""
    n = rows.groupBy(*by).agg((F.max("i") + 1).alias("_n"), F.sqrt(F.avg(F.col("left") ** 2)).alias("_rms"))
    v = F.explode(F.array(*[F.struct(F.lit(a).alias("variant"), F.lit(b).alias("family"), F.lit(c).alias("gain"), F.lit(d).alias("shift"), F.lit(e).alias("noise")) for a, b, c, d, e in VARIANTS]))
    x = rows.join(n, by).withColumn("_v", v).select("*", "_v.*").drop("_v")
    unit = lambda side: (F.pmod(F.xxhash64("variant", F.lit(side), "i"), F.lit(2_000_001)) / 1_000_000 - 1) * F.sqrt(F.lit(3.0))
    moved = F.col("i") - F.floor(F.col("shift") * F.col("_n"))
    each = lambda c: (F.col(c) * F.col("gain") + F.col("noise") * F.col("_rms") * unit(c)).alias(c)
    return x.select(*by, "variant", "family", moved.alias("i"), each("left"), each("right")).where("i >= 0")


def robustness(found: DataFrame, by: list[str], original: str = "original") -> DataFrame:
    """Spread of confidence over the variants of each stage, and the share that keeps the original's class."""
    first = found.where(F.col("variant") == original).select(*by, F.col("construction").alias("_name"), F.col("confidence").alias("original_confidence"))
    spans = found.groupBy(*by, "family").agg((F.max("confidence") - F.min("confidence")).alias("_span")).groupBy(*by).agg(F.max("_span").alias("widest_family_span"))
    g = found.join(first, by).groupBy(*by, "_name", "original_confidence").agg(
        F.count("*").alias("n_variants"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"), F.median("confidence").alias("median"),
        F.stddev_samp("confidence").alias("deviation"), F.avg((F.col("construction") == F.col("_name")).cast("double")).alias("stability"),
    ).withColumnRenamed("_name", "construction")
    return g.join(spans, by).withColumn("span", F.col("highest") - F.col("lowest"))


def against_threshold(lowest: Column, highest: Column, threshold: Column) -> Column:
    """Whether a threshold lies within the spread of a confidence, below or above it."""
    return F.when((lowest <= threshold) & (threshold <= highest), "borderline").when(lowest > threshold, "robustly_above").otherwise("robustly_below")
