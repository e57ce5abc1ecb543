"""Linking of peaks in adjacent windows to tracks, and what is measured on tracks.

Only the choice which peak continues which track depends on order; it streams over rows dealt by series and sorted by
window, and holds no more than the open tracks of one series. All measures are aggregates over the linked rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of rate bands in the score of a protocol track (fixed values).
TRACK_WEIGHTS = {"delta": 1.25, "theta": 1.4, "alpha": 1.35, "beta": 0.85, "gamma": 0.35}
#: Weights of rate bands in the score of a hypothesis (fixed values).
HYPOTHESIS_WEIGHTS = {"delta": 1.25, "theta": 1.4, "alpha": 1.35, "beta": 0.75}


class Free:
    """Numbers each of which can be taken once. One that is not finite is near nothing.

    Sorted, with links over what was taken: taking n of n numbers costs n log n, as long as few different ones lie at
    distances that are equal once rounded.
    """

    def __init__(self, numbers: list[float]):
        self.index = sorted((k for k, v in enumerate(numbers) if math.isfinite(v)), key=numbers.__getitem__)  # stable: equal ones as given
        self.sorted = [numbers[k] for k in self.index]
        n = len(self.sorted)
        self.up = list(range(n + 1))  # leads to the first free place from here on, n if there is none
        self.down = list(range(n + 1))  # leads to the last free place before here, plus one; 0 if there is none
        self.first, self.past = [0] * n, [n] * n  # where the equal numbers of a place begin and end
        for k in range(1, n):
            self.first[k] = self.first[k - 1] if self.sorted[k] == self.sorted[k - 1] else k
        for k in range(n - 2, -1, -1):
            self.past[k] = self.past[k + 1] if self.sorted[k] == self.sorted[k + 1] else k + 1

    @staticmethod
    def _end(links: list[int], k: int) -> int:
        while links[k] != k:
            links[k] = links[links[k]]
            k = links[k]
        return k

    def take(self, wanted: float, most: float) -> int | None:
        """The index of the nearest free number within ``most``, of equally near ones the first given; it is free no more."""
        if not math.isfinite(wanted):
            return None
        numbers, end, n = self.sorted, self._end, len(self.sorted)
        middle = bisect_left(numbers, wanted)
        best, given, place = most, -1, -1
        k = end(self.up, middle)
        while k < n and (d := abs(numbers[k] - wanted)) <= best:
            if given < 0 or d < best or self.index[k] < given:
                best, given, place = d, self.index[k], k
            k = end(self.up, self.past[k])
        k = end(self.down, middle) - 1
        while k >= 0 and (d := abs(numbers[k] - wanted)) <= best:
            start = self.first[k]
            k = end(self.up, start)
            if given < 0 or d < best or self.index[k] < given:
                best, given, place = d, self.index[k], k
            k = end(self.down, start) - 1
        if given < 0:
            return None
        self.up[place], self.down[place + 1] = place + 1, place
        return given


class Linker:
    """Open tracks of one series. A track is open while no more than ``gap`` windows in a row went by without it.

    ``tracks_first``: tracks in order of creation each take the nearest free peak; else peaks in the order given each
    take the nearest free track. Of equally near ones the first is taken. What stays free opens a track.
    """

    def __init__(self, jump: float, gap: int, tracks_first: bool = True, open_tracks: list | None = None, created: int = 0):
        self.jump, self.gap, self.tracks_first = jump, gap, tracks_first
        self.open = open_tracks or []  # [track, frequency, window]
        self.created = created

    def window(self, index: int, frequencies: list[float]) -> list[int]:
        """The track of each peak of the next window."""
        self.open = [t for t in self.open if index - t[2] - 1 <= self.gap]
        given: list[int | None] = [None] * len(frequencies)
        if self.tracks_first:
            free = Free(frequencies)
            for t in self.open:
                k = free.take(t[1], self.jump)
                if k is not None:
                    given[k] = t[0]
                    t[1], t[2] = frequencies[k], index
        else:
            free = Free([t[1] for t in self.open])
            for k, f in enumerate(frequencies):
                j = free.take(f, self.jump)
                if j is not None:
                    t = self.open[j]
                    given[k] = t[0]
                    t[1], t[2] = f, index
        for k, f in enumerate(frequencies):
            if given[k] is None:
                given[k] = self.created
                self.open.append([self.created, f, index])
                self.created += 1
        return given


def linked(peaks: DataFrame, by: list[str], window: str, rank: str, frequency: str, jump: float, gap: int, tracks_first: bool = True) -> DataFrame:
    """The peaks with ``track_id``, numbered within each series in order of creation.

    ``rank`` orders the peaks of a window and must be total. Peaks without a frequency, window or rank are left out; an
    empty table gives an empty table. A series is linked by one task, since each window depends on the one before; rows
    stream through it, and it holds one window and the open tracks.
    """
    names = peaks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, linker, now = None, None, None
        held, values = [], []  # rows and frequencies of the window that is not over

        def over() -> list[int]:
            nonlocal series, linker
            if linker is None or now[0] != series:
                series, linker = now[0], Linker(jump, gap, tracks_first)
            return linker.window(now[1], values)

        def numbered(parts: list[pa.RecordBatch], ids: list[int]) -> Iterator[pa.RecordBatch]:
            at = 0
            for part in parts:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids[at : at + part.num_rows], pa.int64())], [*names, "track_id"])
                at += part.num_rows

        for batch in batches:
            keys = zip(*[_plain(batch.column(names.index(c))) for c in by], strict=True) if by else [()] * batch.num_rows
            windows, found = batch.column(names.index(window)).to_pylist(), batch.column(names.index(frequency)).to_pylist()
            ids: list[int] = []
            start = 0
            for k, here in enumerate(zip(keys, windows, strict=True)):
                if here != now:
                    if now is not None:
                        values += found[start:k]
                        ids += over()
                    now, values, start = here, [], k
            if ids:
                yield from numbered([*held, batch.slice(0, start)], ids)
                held = []
            held.append(batch.slice(start))
            values += found[start:]
        if now is not None:
            yield from numbered(held, over())

    rows = peaks.where(F.col(frequency).isNotNull() & F.col(window).isNotNull() & F.col(rank).isNotNull())
    rows = rows.repartition(*by).sortWithinPartitions(*by, window, rank)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", track_id bigint"
    return rows.mapInArrow(run, schema)


def _plain(column: pa.Array) -> list:
    """The values, with one and the same object for all that are no number, which are one key."""
    return [math.nan if isinstance(v, float) and math.isnan(v) else v for v in column.to_pylist()]


def _span(window: str, start: str, stop: str) -> list[Column]:
    return [
        F.count("*").alias("n_windows"), F.min(start).alias("start_seconds"), F.max(stop).alias("end_seconds"),
        (F.max(stop) - F.min(start)).alias("duration_seconds"), (F.count("*") / (F.max(window) - F.min(window) + 1)).alias("continuity"),
    ]


def carrier_tracks(linked_peaks: DataFrame, by: list[str], least: int = 6) -> DataFrame:
    """One row for each track of ``least`` points or more: span, mean frequency and magnitude, stability, continuity."""
    g = linked_peaks.groupBy(*by, "track_id").agg(
        *_span("window_index", "start_seconds", "end_seconds"), F.avg("frequency_hz").alias("average_frequency_hz"), F.min("frequency_hz").alias("lowest_hz"),
        F.max("frequency_hz").alias("highest_hz"), F.avg("magnitude").alias("average_magnitude"), (1 / (1 + F.stddev_pop("frequency_hz"))).alias("frequency_stability"),
    )
    return g.where(F.col("n_windows") >= least)


def protocol_tracks(linked_candidates: DataFrame, by: list[str], least: int = 4) -> DataFrame:
    """One row for each track of candidates: mean difference, stability, confidence, most frequent band (of equal counts the smallest name) and score."""
    g = linked_candidates.groupBy(*by, "track_id").agg(
        *_span("window_index", "start_seconds", "end_seconds"), F.avg("difference_hz").alias("average_difference_hz"),
        F.avg("confidence").alias("average_confidence"), (1 / (1 + F.stddev_pop("difference_hz"))).alias("frequency_stability"),
        F.mode(F.struct("band"), deterministic=True)["band"].alias("band"),
    ).where(F.col("n_windows") >= least)
    score = F.col("average_confidence") * F.col("frequency_stability") * F.least(F.col("n_windows"), F.lit(30)) / 30 * weight(F.col("band"), TRACK_WEIGHTS, 0.5)
    return g.withColumn("score", F.round(score, 4))


def weight(band: Column, weights: dict[str, float], other: float) -> Column:
    out = F.when(F.lit(False), F.lit(other))
    for name, value in weights.items():
        out = out.when(band == name, F.lit(value))
    return out.otherwise(F.lit(other))


def modulation_observations(windows: DataFrame, least_power: float = 0.05, least_depth: float = 0.02, per_window: int = 3) -> DataFrame:
    """Rows (window, modulation_hz, relative_power, rank) from windows with an array ``peaks`` of (modulation_hz, relative_power)."""
    rows = windows.where(F.col("modulation_depth") >= least_depth).select("*", F.posexplode(F.slice("peaks", 1, per_window)).alias("rank", "_p")).drop("peaks")
    rows = rows.select("*", "_p.modulation_hz", "_p.relative_power").drop("_p")
    return rows.where(F.col("relative_power") >= least_power).withColumn("rank", F.struct((-F.col("relative_power")).alias("p"), F.col("rank").alias("k")))


def modulation_tracks(linked_rows: DataFrame, by: list[str], totals: DataFrame, least: int = 3) -> DataFrame:
    """One row for each track: coverage of the series' windows (``totals``: by, total_windows), drift, class and evidence score."""
    centre = (F.col("start_seconds") + F.col("end_seconds")) / 2
    g = linked_rows.withColumn("_c", centre).groupBy(*by, "track_id").agg(
        *_span("window_index", "start_seconds", "end_seconds"), F.median("modulation_hz").alias("median_modulation_hz"), F.avg("modulation_hz").alias("average_modulation_hz"),
        (F.max("modulation_hz") - F.min("modulation_hz")).alias("frequency_span_hz"), F.coalesce(F.regr_slope("modulation_hz", "_c"), F.lit(0.0)).alias("drift_hz_per_second"),
        F.median("relative_power").alias("median_relative_power"), F.median("modulation_depth").alias("median_modulation_depth"),
    ).where(F.col("n_windows") >= least)
    g = g.join(totals, by).withColumn("coverage", F.col("n_windows") / F.greatest(F.col("total_windows"), F.lit(1)))
    ramp = (F.col("frequency_span_hz") >= 0.5) & (F.abs("drift_hz_per_second") >= 0.01)
    kind = F.when(ramp, "modulation_ramp").when(F.col("coverage") >= 0.75, "persistent_modulation").otherwise("episodic_modulation")
    score = F.col("coverage") * F.col("continuity") * F.col("median_relative_power") * F.col("median_modulation_depth")
    return g.withColumn("classification", kind).withColumn("evidence_score", F.round(score, 4))


def hypothesis_score(confidence: Column, stability: Column, duration: Column, difference: Column, band: Column) -> Column:
    """Score of a persistent difference: confidence, stability, duration up to 300 s, whether within 0.5 to 40 Hz, and its band."""
    inside = F.when(difference.between(0.5, 40), 1.0).otherwise(0.25)
    high = F.when((band == "gamma") & (difference <= 40), 0.35).otherwise(weight(band, HYPOTHESIS_WEIGHTS, 0.1))
    return confidence * stability * F.least(duration / 300, F.lit(1.0)) * inside * high


def intent(difference: Column) -> Column:
    """The band of a difference in words."""
    names = ((0.5, "outside"), (4, "deep rest"), (8, "meditation"), (13, "relaxation"), (30, "focus"), (40.0000001, "high attention"))
    out = F.when(difference.isNull(), F.lit(None).cast("string"))
    for limit, name in names:
        out = out.when(difference < limit, name)
    return out.otherwise("outside")


def distinct_hypotheses(rows: DataFrame, by: list[str], order: list[str], value: str, tolerance: float = 0.35) -> DataFrame:
    """Those rows that no better row kept before absorbs: one within ``tolerance`` among those kept of the same group.

    ``order`` must be total, best first. Each group's sorted rows stream through one task, which holds the values kept:
    they lie more than ``tolerance`` apart. Values that are no finite number are all kept and absorb nothing.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, []
        for batch in batches:
            keys = zip(*[_plain(batch.column(names.index(c))) for c in by], strict=True) if by else [()] * batch.num_rows
            stays = []
            for key, x in zip(keys, batch.column(names.index(value)).to_pylist(), strict=True):
                if key != group:
                    group, kept = key, []
                if x is None or not math.isfinite(x):
                    stays.append(True)
                    continue
                k = bisect_left(kept, x)
                stays.append(not any(abs(y - x) <= tolerance for y in kept[max(0, k - 1) : k + 1]))
                if stays[-1]:
                    kept.insert(k, x)
            yield batch.filter(pa.array(stays, pa.bool_()))

    dealt = rows.repartition(*by) if by else rows.coalesce(1)
    return dealt.sortWithinPartitions(*by, *order).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes))


def sides_paired(left: DataFrame, right: DataFrame, by: list[str], frequency: str, widest: float, least_overlap: float, least_seconds: float = 0.0, narrowest: float = 0.0) -> DataFrame:
    """Pairs of a left and a right track that overlap in time and lie near in frequency; columns get l_ and r_.

    Tracks meet in cells of ``widest`` hertz, so no product of all tracks of a series is made. Adds overlap_seconds,
    overlap_ratio (of the shorter one) and difference_hz.
    """
    a = left.select(*by, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in by])
    b = right.select(*by, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    a = a.withColumn("_cell", F.explode(F.array(*[F.floor(F.col(f"l_{frequency}") / widest) + d for d in (-1, 0, 1)])))
    b = b.withColumn("_cell", F.floor(F.col(f"r_{frequency}") / widest))
    overlap = F.greatest(F.lit(0.0), F.least("l_end_seconds", "r_end_seconds") - F.greatest("l_start_seconds", "r_start_seconds"))
    shorter = F.least("l_duration_seconds", "r_duration_seconds")
    both = a.join(b, [*by, "_cell"]).drop("_cell").withColumn("overlap_seconds", overlap).withColumn("difference_hz", F.abs(F.col(f"l_{frequency}") - F.col(f"r_{frequency}")))
    both = both.withColumn("overlap_ratio", F.when(shorter > 0, F.col("overlap_seconds") / F.nullif(shorter, F.lit(0.0))).otherwise(0.0))
    return both.where((F.col("overlap_seconds") >= least_seconds) & (F.col("overlap_ratio") >= least_overlap) & F.col("difference_hz").between(narrowest, widest))


def carrier_pairs(
    left: DataFrame, right: DataFrame, by: list[str], least_overlap: float = 0.75, widest: float = 40.0, narrowest: float = 0.0, least_seconds: float = 30.0, least_balance: float = 0.25
) -> DataFrame:
    """Candidate pairs of carriers of two channels with balance and confidence, which is a product of six terms."""
    p = sides_paired(left, right, by, "average_frequency_hz", widest, least_overlap, least_seconds, narrowest)
    l, r = F.col("l_average_magnitude"), F.col("r_average_magnitude")  # noqa: E741
    p = p.withColumn("balance", F.when(F.greatest(l, r) > 0, F.least(l, r) / F.nullif(F.greatest(l, r), F.lit(0.0))).otherwise(0.0)).where(F.col("balance") >= least_balance)
    mean = lambda c: (F.col(f"l_{c}") + F.col(f"r_{c}")) / 2
    near = F.greatest(F.lit(0.0), 1 - F.col("difference_hz") / widest)
    confidence = F.col("overlap_ratio") * mean("continuity") * mean("frequency_stability") * F.col("balance") * F.least(F.lit(1.0), mean("average_magnitude")) * near
    return p.withColumn("confidence", F.round(confidence, 4))


def modulation_pairs(left: DataFrame, right: DataFrame, by: list[str], widest: float = 0.25, least_overlap: float = 0.5) -> DataFrame:
    """Candidate pairs of modulation tracks of two channels with their confidence."""
    p = sides_paired(left, right, by, "median_modulation_hz", widest, least_overlap)
    low = lambda c: F.least(f"l_{c}", f"r_{c}")
    return p.withColumn("confidence", F.round(F.col("overlap_ratio") * (1 - F.col("difference_hz") / widest) * low("coverage") * low("median_relative_power"), 4))


def modulation_summary(tracks: DataFrame, pairs: DataFrame, by: list[str], totals: DataFrame) -> DataFrame:
    """One label for each series: shared ramp, persistent, episodic, one-sided or none, by what its sides share."""
    shared = pairs.groupBy(*by).agg(
        F.bool_or((F.col("l_classification") == "modulation_ramp") | (F.col("r_classification") == "modulation_ramp")).alias("_ramp"),
        F.max(F.least("l_coverage", "r_coverage")).alias("_shared"),
    )
    some = tracks.groupBy(*by).agg(F.count("*").alias("n_tracks"))
    kind = F.when(F.col("_ramp"), "shared_modulation_ramp").when(F.col("_shared") >= 0.75, "persistent_shared_modulation").when(F.col("_shared").isNotNull(), "episodic_shared_modulation")
    kind = kind.when(F.coalesce("n_tracks", F.lit(0)) > 0, "channel_specific_modulation").otherwise("no_significant_modulation")
    return totals.join(some, by, "left").join(shared, by, "left").select(*by, F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"), F.col("_shared").alias("shared_coverage"), kind.alias("classification"))


def eligible(centre: Column, other: Column, harmonic: Column) -> Column:
    """Whether an envelope may be taken of a pair: both centres at 20 Hz or above and no harmonic relation."""
    return (centre >= 20) & (other >= 20) & harmonic.isNull()


def masked(rows: DataFrame, context: str, wanted: str, column: str) -> DataFrame:
    """Candidates of windows outside the wanted context become empty, so that no track bridges contexts; all windows stay."""
    kind = dict(rows.dtypes)[column]
    return rows.withColumn(column, F.when(F.col(context) == wanted, F.col(column)).otherwise(F.array().cast(kind)))


def islands(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Longest and number of runs of true values in each series."""
    w = Window.partitionBy(*by).orderBy(*order)
    g = df.withColumn("_g", F.row_number().over(w) - F.sum(F.col(value).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(value))
    return g.groupBy(*by, "_g").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.max("_n").alias("longest_run"), F.count("*").alias("n_runs"))
