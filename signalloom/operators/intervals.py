"""Interval algebra: merging, complement, overlap with windows, overlap joins in time buckets, nearest matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, by: list[str], start: str, stop: str) -> DataFrame:
    """Unions of intervals that overlap or touch: by, start, stop, n_merged."""
    w = Window.partitionBy(*by).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("_new", fresh).withColumn("_island", island)
    return marked.groupBy(*by, "_island").agg(F.min(start).alias("start"), F.max(stop).alias("stop"), F.count("*").alias("n_merged")).drop("_island")


def complement(merged: DataFrame, by: list[str], low: Column, high: Column) -> DataFrame:
    """The gaps between merged intervals of each series within [low, high]: by, start, stop; empty gaps go."""
    w = Window.partitionBy(*by).orderBy("start")
    inner = merged.select(*by, F.coalesce(F.lag("stop").over(w), low).alias("_from"), F.col("start").alias("_to"))
    last = merged.groupBy(*by).agg(F.max("stop").alias("_from")).withColumn("_to", high)
    gaps = inner.unionByName(last).select(*by, F.greatest("_from", low).cast("bigint").alias("start"), F.least("_to", high).cast("bigint").alias("stop"))
    return gaps.where("start < stop")


def overlap(a_start: Column, a_stop: Column, b_start: Column, b_stop: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_stop, b_stop) - F.greatest(a_start, b_start))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], bucket: int, l_start: str = "l_start", l_stop: str = "l_stop", r_start: str = "r_start", r_stop: str = "r_stop") -> DataFrame:
    """Pairs of half-open intervals of equal keys that overlap, each once; column ``overlap``.

    Both sides go out once for each time bucket they touch and meet in an equi-join on key and bucket; a pair counts in
    the bucket of its later start. Empty intervals overlap nothing. Choose ``bucket`` near the usual length: shorter costs copies, longer candidates.
    """
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.lit(bucket)), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / F.lit(bucket))))
    left, right = left.where(F.col(l_start) < F.col(l_stop)), right.where(F.col(r_start) < F.col(r_stop))
    pairs = left.withColumn("_b", span(l_start, l_stop)).join(right.withColumn("_b", span(r_start, r_stop)), [*by, "_b"])
    later = F.greatest(l_start, r_start)
    pairs = pairs.where((F.col(l_start) < F.col(r_stop)) & (F.col(r_start) < F.col(l_stop)) & (F.floor(later / F.lit(bucket)) == F.col("_b")))
    return pairs.withColumn("overlap", overlap(F.col(l_start), F.col(l_stop), F.col(r_start), F.col(r_stop))).drop("_b")


def covered_windows(merged: DataFrame, by: list[str], size: int, active: float = 0.5, sparse: float = 0.1) -> DataFrame:
    """Windows of ``size`` touched by merged intervals: by, window_start, covered, ratio, and a label of three."""
    touched = merged.withColumn("_k", F.explode(F.sequence(F.floor(F.col("start") / F.lit(size)), F.floor((F.greatest(F.col("stop") - 1, F.col("start"))) / F.lit(size)))))
    lo = F.col("_k") * size
    g = touched.groupBy(*by, lo.cast("bigint").alias("window_start")).agg(F.sum(overlap(F.col("start"), F.col("stop"), lo, lo + size)).cast("bigint").alias("covered"))
    g = g.withColumn("ratio", F.col("covered") / size)
    return g.withColumn("label", F.when(F.col("ratio") >= active, "active").when(F.col("ratio") <= sparse, "sparse").otherwise("mixed"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], l_time: str, l_id: str, r_time: str, r_id: str) -> DataFrame:
    """For every left row the right row of equal keys that is nearest in time: left columns, nearest_id, distance.

    One union sorted by time carries the last and the next right row along, so no pairs are made. Of equal distances
    the smaller right id wins; left rows without a partner go.
    """
    a = left.select(*by, F.col(l_time).alias("_t"), F.col(l_id).alias("_id"), F.lit(None).cast("struct<t:bigint,id:bigint>").alias("_r"))
    b = right.select(*by, F.col(r_time).alias("_t"), F.lit(None).cast("bigint").alias("_id"), F.struct(F.col(r_time).cast("bigint").alias("t"), F.col(r_id).cast("bigint").alias("id")).alias("_r"))
    b = b.groupBy(*by, "_t").agg(F.first("_id").alias("_id"), F.min("_r").alias("_r"))
    w = Window.partitionBy(*by).orderBy("_t")
    upto, after = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    both = a.unionByName(b).withColumn("_p", F.last("_r", True).over(upto)).withColumn("_n", F.first("_r", True).over(after)).where("_id is not null")
    pick = lambda c: F.struct(F.abs(F.col(f"{c}.t") - F.col("_t")).alias("distance"), F.col(f"{c}.id").alias("id"))
    best = F.when(F.col("_p").isNull(), pick("_n")).when(F.col("_n").isNull(), pick("_p")).otherwise(F.least(pick("_p"), pick("_n")))
    found = both.where("_p is not null or _n is not null").withColumn("_best", best)
    return found.select(*by, F.col("_id").alias(l_id), F.col("_t").alias(l_time), F.col("_best.id").alias("nearest_id"), F.col("_best.distance").alias("distance"))


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], l: str, r: str, low: float, high: float) -> DataFrame:  # noqa: E741
    """Pairs of equal keys whose values differ by low to high: an equi-join on cells of width ``high`` and the next two."""
    a = left.withColumn("_c", F.explode(F.array(*[F.floor(F.col(l) / F.lit(high)) + d for d in (-1, 0, 1)])))
    b = right.withColumn("_c", F.floor(F.col(r) / F.lit(high)))
    return a.join(b, [*by, "_c"]).where(F.abs(F.col(l) - F.col(r)).between(low, high)).drop("_c")
