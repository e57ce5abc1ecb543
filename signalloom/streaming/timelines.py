"""Event streams: hopping windows, sessions, track linking with state, late rows and idempotent sinks.

Each has a batch twin in ``operators``; a stream that ends and whose rows came in time gives what the batch gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalloom.operators.linking import Linker
from signalloom.sources import sinks

#: Rows of linked peaks after which a series gives out what it has, at the end of a window.
OUT_ROWS = 50_000


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Events from Parquet files as a stream, ``files`` new ones a trigger, with ``at`` as event time; a single file needs a pattern as its path."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def hopping(stream: DataFrame, by: list[str], size: str, hop: str, late: str) -> DataFrame:
    """Count, mean and deviation of ``value`` in each hopping window; rows later than ``late`` behind the latest are dropped."""
    g = stream.withWatermark("at", late).groupBy(*by, F.window("at", size, hop).alias("w"))
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("sd_value")).select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean_value", "sd_value")


def sessions(stream: DataFrame, by: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of each key: stretches of events less than ``gap`` apart, with their first time, end and number."""
    g = stream.withWatermark("at", late).groupBy(*by, F.session_window("at", gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def batch_sessions(events: DataFrame, by: list[str], gap_seconds: int) -> DataFrame:
    """The batch twin of ``sessions``, from the gaps between adjacent rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("at")
    fresh = F.when(F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) < gap_seconds * 1_000_000, 0).otherwise(1)
    rows = events.withColumn("_n", fresh).withColumn("_s", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.groupBy(*by, "_s").agg(F.min("at").alias("start"), F.max("at").alias("_last"), F.count("*").alias("n"))
    return g.select(*by, "start", F.timestamp_micros(F.unix_micros("_last") + gap_seconds * 1_000_000).alias("stop"), "n")


def tracks(stream: DataFrame, by: list[str], jump: float, gap: int, tracks_first: bool = True) -> DataFrame:
    """Rows (by, window_index, frequency_hz, track_id) as their windows are complete.

    ``stream`` has one row for each window of a series: by, window_index, frequencies (array, in order of rank); windows
    of a series must come in order. The state of a series is its open tracks: at most the peaks of gap + 1 windows.
    """
    types = dict(stream.dtypes)
    keys = ", ".join(f"`{c}` {types[c]}" for c in by)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        created, ids, freqs, windows = state.get if state.exists else (0, [], [], [])
        linker = Linker(jump, gap, tracks_first, [list(t) for t in zip(ids, freqs, windows, strict=True)], created)
        rows = pd.concat(list(parts), ignore_index=True).sort_values("window_index")
        names = [*by, "window_index", "frequency_hz", "track_id"]
        out: list[tuple] = []
        for index, values in zip(rows["window_index"], rows["frequencies"], strict=True):
            values = [float(v) for v in (values if values is not None else [])]
            out += [(*key, int(index), f, t) for f, t in zip(values, linker.window(int(index), values), strict=True)]
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        state.update((linker.created, [t[0] for t in linker.open], [t[1] for t in linker.open], [t[2] for t in linker.open]))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy(*by).applyInPandasWithState(
        step, f"{keys}, window_index bigint, frequency_hz double, track_id bigint", "created bigint, ids array<bigint>, frequencies array<double>, windows array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def run_to_end(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append") -> None:
    """Run a stream over what is there and stop: into a Parquet folder, or through ``write`` for each batch."""
    out = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    out = out.foreachBatch(write) if write else out.format("parquet").option("path", path)
    out.start().awaitTermination()


def into_table(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds only keys the table does not hold, so that a batch written again after a failure changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        sinks.append_new(batch, path, key)

    return write


def distinct_in_time(stream: DataFrame, key: list[str], late: str) -> DataFrame:
    """The first row of each key within the time rows may be late."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(key)
