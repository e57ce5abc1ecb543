"""Windows over time and over rows: hopping and tumbling windows, runs, edges and moving averages.

All take column names and return DataFrames. Time is a long in a fixed unit; ``by`` lists the keys of a series. None
needs a row order other than the given one, so every result is independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hopping(df: DataFrame, time: str, size: int, hop: int, complete: bool = True) -> DataFrame:
    """Rows once for each window [start, start + size) that holds them; columns window_start and window_end.

    Windows start at multiples of ``hop``. With ``complete``, windows that begin before the first or end after the last
    time of the whole input are left out; these two numbers are one small aggregate, joined as one row.
    """
    first = F.floor((F.col(time) - size) / F.lit(hop)) + 1
    out = df.withColumn("_k", F.explode(F.sequence(first, F.floor(F.col(time) / F.lit(hop)))))
    out = out.withColumn("window_start", (F.col("_k") * hop).cast("bigint")).withColumn("window_end", (F.col("_k") * hop + size).cast("bigint")).drop("_k")
    if complete:
        span = df.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
        out = out.join(F.broadcast(span)).where("window_start >= _lo and window_end <= _hi").drop("_lo", "_hi")
    return out


def tumbling(time: str, size: int) -> Column:
    """The number of the frame that holds a time."""
    return F.floor(F.col(time) / F.lit(size)).cast("bigint")


def runs(df: DataFrame, by: list[str], order: list[str], state: Column) -> DataFrame:
    """The rows with state and run_id: maximal stretches of one state within each series, numbered from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("state", state)
    changed = F.when(F.lag("state").over(w).eqNullSafe(F.col("state")) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return out.withColumn("_c", changed).withColumn("run_id", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_c")


def run_bounds(marked: DataFrame, by: list[str], time: str) -> DataFrame:
    """One row for each run: state, first and last time, number of rows."""
    return marked.groupBy(*by, "run_id", "state").agg(F.min(time).alias("start"), F.max(time).alias("stop"), F.count("*").alias("n_rows"))


def rising_edges(df: DataFrame, by: list[str], order: list[str], active: str) -> DataFrame:
    """Rows at which ``active`` turns true; a series that begins active has its edge at its first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_before", F.coalesce(F.lag(active).over(w), F.lit(False))).where(F.col(active) & ~F.col("_before")).drop("_before")


def transitions(df: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """Counts of adjacent label pairs over all series: label_from, label_to, n."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("label_from", F.lag(label).over(w)).where("label_from is not null").groupBy("label_from", F.col(label).alias("label_to")).agg(F.count("*").alias("n"))


def gaps(df: DataFrame, by: list[str], order: list[str], time: str) -> DataFrame:
    """Rows with ``gap``, the time since the row before; first rows go."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("gap", F.col(time) - F.lag(time).over(w)).where("gap is not null")


def detrended(df: DataFrame, by: list[str], order: list[str], value: str, reach: int) -> DataFrame:
    """Rows with ``trend``, the mean of up to ``reach`` rows on either side and the row, and ``residual``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn("trend", F.avg(value).over(w)).withColumn("residual", F.col(value) - F.col("trend"))


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank; the order must be total."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
