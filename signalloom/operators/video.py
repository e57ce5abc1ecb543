"""Luminance of frames: regions, gates, traces, declared schedules and clocks of two media."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.operators import stats, windows

#: Weights of red, green and blue in luminance (fixed values).
WEIGHTS = (0.2126, 0.7152, 0.0722)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Luminance between 0 and 1 of 8-bit colours."""
    return (WEIGHTS[0] * r + WEIGHTS[1] * g + WEIGHTS[2] * b) / 255


def gated(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Pixels with ``on``: luminance of max(0.02, a twentieth of the peak) or more."""
    lit = pixels.withColumn("y_lum", luminance(F.col("r"), F.col("g"), F.col("b")))
    top = lit.groupBy(*by).agg(F.greatest(F.lit(0.02), 0.05 * F.max("y_lum")).alias("_t"))
    return lit.join(top, by).withColumn("on", F.col("y_lum") >= F.col("_t")).drop("_t")


def schedules(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, y, signature, n_on): the digest of each pixel's on and off frames; pixels never on go.

    A pixel's frames are packed to one bit each, so the shuffle carries a bit for a pixel and frame.
    """
    bits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", F.col("on").cast("int").alias("v")))), lambda s: s["v"].cast("string")), "")
    g = gated(pixels, by).groupBy(*by, "x", "y").agg(F.sha2(bits, 256).alias("signature"), F.count_if("on").alias("n_on"), bits.alias("gate"))
    return g.where("n_on > 0")


def labelled(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 of 4-connected areas of a mask, 0 outside."""
    out = np.zeros(mask.shape, int)
    n = 0
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        n += 1
        stack = [start]
        while stack:
            y, x = stack.pop()
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = n
                stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def regions(pixels: DataFrame, by: list[str], width: int, height: int, least: float = 0.02) -> DataFrame:
    """Connected areas of pixels with one schedule that cover ``least`` of the frame: region, pixels, box, position, gate.

    The pixels of one video's frame, not its frames, meet in a task.
    """
    types = dict(pixels.dtypes)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, own in part.groupby("signature"):
            mask = np.zeros((height, width), bool)
            mask[own["y"], own["x"]] = True
            area = labelled(mask)
            for n in range(1, area.max() + 1):
                ys, xs = np.nonzero(area == n)
                if len(ys) >= least * width * height:
                    rows.append((*key, len(ys), int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1, float(xs.mean() + 0.5) / width, float(ys.mean() + 0.5) / height, own["gate"].iloc[0]))
        return pd.DataFrame(rows, columns=[*by, "n_pixels", "x0", "y0", "x1", "y1", "cx", "cy", "gate"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", n_pixels int, x0 int, y0 int, x1 int, y1 int, cx double, cy double, gate string"
    found = schedules(pixels, by).groupBy(*by).applyInPandas(run, schema)
    v = F.when(F.col("cy") < 0.45, "top").when(F.col("cy") > 0.55, "bottom").otherwise("middle")
    h = F.when(F.col("cx") < 0.45, "left").when(F.col("cx") > 0.55, "right").otherwise("center")
    w = Window.partitionBy(*by).orderBy("y0", "x0", "n_pixels")
    return found.withColumn("position", F.concat_ws("_", v, h)).withColumn("region", F.row_number().over(w))


def independent(found: DataFrame, by: list[str]) -> DataFrame:
    """Whether each video has several regions, all of different schedules."""
    return found.groupBy(*by).agg(F.count("*").alias("n_regions"), ((F.count("*") > 1) & (F.count_distinct("gate") == F.count("*"))).alias("independent"))


def gates(found: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, region, frame, on) of the regions' gates."""
    v = F.split(F.col("gate"), "")
    return found.select(*by, "region", F.posexplode(F.filter(v, lambda c: c != "")).alias("_k", "_v")).select(*by, "region", F.col("_k").cast("bigint").alias("frame"), (F.col("_v") == "1").alias("on"))


def off_intervals(gate: DataFrame, by: list[str], fps: float, least: float = 0.0) -> DataFrame:
    """(by, start_seconds, end_seconds): maximal stretches of off frames of ``least`` seconds or more."""
    b = windows.run_bounds(windows.runs(gate, by, ["frame"], F.col("on")), by, "frame").where("not state")
    return b.select(*by, (F.col("start") / fps).alias("start_seconds"), ((F.col("stop") + 1) / fps).alias("end_seconds")).where(F.col("end_seconds") - F.col("start_seconds") >= least)


def region_traces(pixels: DataFrame, by: list[str], boxes: DataFrame) -> DataFrame:
    """(by, region, frame, luminance, r, g, b): exact medians of the pixels in each region's box."""
    b = boxes.select(*by, "region", "x0", "y0", "x1", "y1")
    inside = pixels.join(F.broadcast(b), by).where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return inside.groupBy(*by, "region", "frame").agg(
        F.median(luminance(F.col("r"), F.col("g"), F.col("b"))).alias("luminance"), *[F.median(c).alias(c) for c in ("r", "g", "b")])


def edge_stability(traces: DataFrame, by: list[str], shares: tuple[float, ...] = (0.1, 0.25, 0.5)) -> DataFrame:
    """Number of rising edges of each trace at several shares of its peak, and whether all agree."""
    top = traces.groupBy(*by).agg(F.max("luminance").alias("_top"))
    rows = traces.join(top, by).withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumn("on", F.col("luminance") >= F.col("share") * F.col("_top"))
    e = windows.rising_edges(rows.where("_top > 0"), [*by, "share"], ["frame"], "on").groupBy(*by, "share").agg(F.count("*").alias("n"))
    return e.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("share", "n"))).alias("edges"), (F.count_distinct("n") == 1).alias("stable"))


def gate_windows(gate: DataFrame, by: list[str], fps: float, seconds: float = 5.0, hop: float = 1.0) -> DataFrame:
    """Each window's number of rising edges, their rate (edges less one over the time between first and last) and duty; windows are complete."""
    w = Window.partitionBy(*by).orderBy("frame")
    rows = gate.withColumn("edge", F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False)))
    size, step = int(round(seconds * fps)), int(round(hop * fps))
    h = windows.hopping(rows, "frame", size, step, complete=False)
    n = gate.groupBy(*by).agg((F.max("frame") + 1).alias("_n"))
    h = h.join(n, by).where("window_start >= 0 and window_end <= _n")
    g = h.groupBy(*by, "window_start").agg(F.count_if("edge").alias("n_edges"), F.avg(F.col("on").cast("double")).alias("duty"), F.min(F.when(F.col("edge"), F.col("frame"))).alias("_a"), F.max(F.when(F.col("edge"), F.col("frame"))).alias("_b"))
    rate = F.when(F.col("n_edges") > 1, (F.col("n_edges") - 1) * fps / F.nullif(F.col("_b") - F.col("_a"), F.lit(0)))
    return g.select(*by, (F.col("window_start") / fps).alias("start_seconds"), "n_edges", rate.alias("rate_hz"), "duty")


def emphasis(energies: DataFrame, by: list[str]) -> DataFrame:
    """At each edge the region whose energy is highest over the first quartile of its active energy, if 5 % above the second.

    ``energies``: by, edge, region, energy.
    """
    q = energies.where("energy > 0").groupBy(*by, "region").agg(F.percentile("energy", F.lit(0.25)).alias("_q"))
    s = energies.join(q, [*by, "region"]).withColumn("score", F.col("energy") / F.nullif("_q", F.lit(0.0)))
    top = s.groupBy(*by, "edge").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("region")).alias("r"))), asc=False), 1, 2).alias("_t"))
    best, second = F.get("_t", F.lit(0)), F.coalesce(F.get("_t", F.lit(1))["score"], F.lit(0.0))
    return top.select(*by, "edge", F.when(best["score"] > 1.05 * second, -best["r"]).alias("region"), best["score"].alias("score"))


def two_levels(values: DataFrame, by: list[str], value: str, rounds: int = 5) -> DataFrame:
    """Rows with ``level`` 0 or 1: two centres, from the lowest and the highest value on, moved to the medians of their rows five times."""
    c = values.groupBy(*by).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    near = (F.abs(F.col(value) - F.col("_hi")) < F.abs(F.col(value) - F.col("_lo"))).cast("int")
    for _ in range(rounds):
        m = values.join(c, by).withColumn("level", near).groupBy(*by).agg(
            F.median(F.when(F.col("level") == 0, F.col(value))).alias("_l"), F.median(F.when(F.col("level") == 1, F.col(value))).alias("_h"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        c = m.select(*by, F.coalesce("_l", "_lo").alias("_lo"), F.coalesce("_h", "_hi").alias("_hi"))
    return values.join(c, by).withColumn("level", near).drop("_lo", "_hi")


def colour_state(r: Column, g: Column, b: Column, least: float = 0.1) -> Column:
    """black, green, magenta or other, from 8-bit medians."""
    high = F.greatest(r, g, b)
    return F.when(high < least * 255, "black").when((g > r) & (g > b), "green").when((r > g) & (b > g), "magenta").otherwise("other")


def declared(segments: DataFrame, by: list[str], fps: int) -> DataFrame:
    """(by, frame, on) of declared gates, exactly: segments of linear frequency, in integers.

    segments: by, position, start_us, end_us, f0_mhz, f1_mhz (thousandths of a hertz), duty_ppm, on, policy (continue or
    reset). Phase is f0 t + (f1 - f0) t^2 / 2d, from where the segment before ended (continue) or from 0; an off segment
    sets it back. In units of 1 / (2 d 10^9) turns with t and d in microseconds all terms are whole numbers; decimals of
    38 digits hold them up to hours. A frame is at k / fps, to the microsecond below.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    w = Window.partitionBy(*by).orderBy("position")
    s = segments.withColumn("d", F.col("end_us") - F.col("start_us")).where("d > 0")
    # turns of a whole segment are (f0 + f1) d / 2, in 1 / (2 * 10^9)
    s = s.withColumn("_turn", F.when(F.col("on"), (big("f0_mhz") + big("f1_mhz")) * big("d")).otherwise(F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)"))
    s = s.withColumn("_new", F.when(F.lag("on").over(w).isNull() | ~F.lag("on").over(w) | (F.col("policy") == "reset") | ~F.col("on"), 1).otherwise(0))
    s = s.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*by, "_chain").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_phase", F.coalesce(F.sum("_turn").over(before), F.lit(0)).cast("decimal(38,0)") % F.lit(2_000_000_000).cast("decimal(38,0)"))
    k = F.sequence(F.ceil(F.col("start_us") * fps / F.lit(1_000_000)), F.ceil(F.col("end_us") * fps / F.lit(1_000_000)) - 1)
    rows = s.where(F.ceil(F.col("start_us") * fps / F.lit(1_000_000)) < F.ceil(F.col("end_us") * fps / F.lit(1_000_000))).withColumn("frame", F.explode(k))
    t = F.floor(F.col("frame") * 1_000_000 / F.lit(fps)).cast("bigint") - F.col("start_us")
    rows = rows.withColumn("t", F.greatest(t, F.lit(0)).cast("decimal(20,0)"))
    whole = (2 * F.col("f0_mhz").cast("decimal(12,0)") * F.col("d").cast("decimal(14,0)") + (F.col("f1_mhz") - F.col("f0_mhz")).cast("decimal(12,0)") * F.col("t").cast("decimal(14,0)")).cast("decimal(26,0)")
    unit = (F.col("d").cast("decimal(14,0)") * F.lit(2_000_000_000).cast("decimal(12,0)")).cast("decimal(26,0)")
    # (whole mod unit) * t mod unit, then compared by cross-multiplication; t and d within 10^11 (a day) keep 38 digits
    turn = ((whole % unit).cast("decimal(22,0)") * F.col("t").cast("decimal(12,0)")).cast("decimal(38,0)")
    phase = (turn + F.col("_phase").cast("decimal(12,0)") * F.col("d").cast("decimal(14,0)")) % unit
    inside = (phase.cast("decimal(28,0)") * F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(38,0)") < (F.col("duty_ppm").cast("decimal(8,0)") * unit).cast("decimal(38,0)")
    return rows.select(*by, F.col("frame").cast("bigint").alias("frame"), (F.col("on") & inside).alias("on"))


def compared(seen: DataFrame, told: DataFrame, by: list[str], fps: float) -> DataFrame:
    """Frames on which gates differ, frames of one side only, and the share of agreement, for each group."""
    both = seen.select(*by, "frame", F.col("on").alias("a")).join(told.select(*by, "frame", F.col("on").alias("b")), [*by, "frame"], "full_outer")
    return both.groupBy(*by).agg(
        F.count("*").alias("n_frames"), F.count_if(F.col("a") != F.col("b")).alias("n_mismatch"), F.count_if(F.col("a").isNull()).alias("n_unseen"), F.count_if(F.col("b").isNull()).alias("n_untold"),
        F.avg((F.coalesce(F.col("a") == F.col("b"), F.lit(False))).cast("double")).alias("agreement"))


def colour_errors(seen: DataFrame, told: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """Largest and mean difference of 8-bit colours by frame, and the number of frames with more than ``most``."""
    j = seen.alias("s").join(told.alias("t"), [*by, "frame"])
    off = F.greatest(*[F.abs(F.col(f"s.{c}") - F.col(f"t.{c}")) for c in ("r", "g", "b")])
    return j.withColumn("_e", off).groupBy(*by).agg(F.max("_e").alias("largest"), F.avg("_e").alias("mean"), F.count_if(F.col("_e") > most).alias("n_beyond"))


def frame_loudness(samples: DataFrame, by: list[str], rate: int, fps: float) -> DataFrame:
    """(by, frame, rms) of the samples (by, i, left) that belong to each video frame, whose borders are rounded to samples."""
    k = F.floor((F.col("i") + 0.5) * fps / rate)
    return samples.groupBy(*by, k.cast("bigint").alias("frame")).agg(F.sqrt(F.avg(F.col("left") * F.col("left"))).alias("rms"))


def gate_alignment(loudness: DataFrame, gate: DataFrame, by: list[str]) -> DataFrame:
    """Correlation of loudness with the gate, and mean loudness on and off, over frames that both have."""
    j = loudness.join(gate.select(*by, "frame", "on"), [*by, "frame"])
    on = F.col("on").cast("double")
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rms", on).alias("correlation"), F.avg(F.when(F.col("on"), F.col("rms"))).alias("mean_on"), F.avg(F.when(~F.col("on"), F.col("rms"))).alias("mean_off"))


def clocks(pairs: DataFrame, by: list[str], frame: float, reach: int = 30) -> DataFrame:
    """Best lag of each component's right series against its left one, and whether the media run on one clock.

    pairs: by, component, t (frame number), left, right, start_gap, duration_gap (seconds). Of equal correlations the
    smaller lag wins. Aligned: every lag within one frame at 0.95 or more, starts and durations within a frame.
    """
    c = stats.lagged_correlation(pairs, [*by, "component"], "t", "left", "right", reach)
    best = c.groupBy(*by, "component").agg(F.max_by(F.struct("lag", "r"), F.struct("r", -F.abs("lag"), "lag")).alias("b")).select(*by, "component", "b.lag", "b.r")
    gap = pairs.groupBy(*by).agg(F.max(F.abs("start_gap")).alias("_s"), F.max(F.abs("duration_gap")).alias("_d"))
    g = best.groupBy(*by).agg(F.max(F.abs("lag")).alias("largest_lag"), F.min("r").alias("least_correlation")).join(gap, by)
    ok = (F.col("largest_lag") <= 1) & (F.col("least_correlation") >= 0.95) & (F.col("_s") <= frame) & (F.col("_d") <= frame)
    return g.select(*by, "largest_lag", "least_correlation", F.when(ok, "aligned").otherwise("rejected").alias("classification"))
