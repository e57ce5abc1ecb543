"""Cohort statistics and feature preparation: leave-one-out scores, robust scaling, one-hot levels, silhouettes, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.operators.stats import clip, normalised_excess


def profiles(df: DataFrame, cohort: str, family: str) -> DataFrame:
    """cohort, family, joint count, sizes of both, share, baseline share and lift."""
    joint = df.groupBy(cohort, family).agg(F.count("*").alias("n_joint"))
    out = joint.withColumn("n_cohort", F.sum("n_joint").over(Window.partitionBy(cohort))).withColumn("n_family", F.sum("n_joint").over(Window.partitionBy(family)))
    total = joint.agg(F.sum("n_joint").alias("n_total"))
    out = out.join(F.broadcast(total)).withColumn("share", F.col("n_joint") / F.col("n_cohort")).withColumn("baseline", F.col("n_family") / F.col("n_total"))
    return out.withColumn("lift", F.col("share") / F.col("baseline"))


def leave_one_out(df: DataFrame, key: str, cohort: str, family: str, least: int = 3) -> DataFrame:
    """Each row's support by its peers, against the rest of all: key, peer_support, baseline, lift, excess; small cohorts go.

    Rows meet the small table of counts, so nothing is windowed over whole cohorts of rows.
    """
    p = profiles(df, cohort, family).where(F.col("n_cohort") >= least)
    support = (F.col("n_joint") - 1) / (F.col("n_cohort") - 1)
    base = (F.col("n_family") - 1) / (F.col("n_total") - 1)
    p = p.select(cohort, family, support.alias("peer_support"), base.alias("baseline"))
    p = p.withColumn("lift", F.when(F.col("baseline") > 0, F.col("peer_support") / F.nullif("baseline", F.lit(0.0)))).withColumn("excess", normalised_excess(F.col("peer_support"), F.col("baseline")))
    return df.select(key, cohort, family).join(p, [cohort, family]).select(key, "peer_support", "baseline", "lift", "excess")


def robust(df: DataFrame, key: str, columns: list[str], limit: float = 5.0) -> DataFrame:
    """ln(1 + max(x, 0)), missing values at the median, centred on it, scaled by the interquartile range (else the deviation, else 1), clipped; <column>__missing says where."""
    logs = df.select(key, *[F.log1p(F.greatest(F.col(c), F.lit(0.0))).alias(c) for c in columns])
    q = logs.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    rows = logs.join(F.broadcast(q))
    out = [F.col(key)]
    for c in columns:
        spread = F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]
        scale = F.when(spread > 1e-9, spread).when(F.col(f"s_{c}") > 1e-9, F.col(f"s_{c}")).otherwise(1.0)
        middle = F.col(f"q_{c}")[1]
        out += [clip((F.coalesce(F.col(c), middle) - middle) / scale, -limit, limit).alias(c), F.col(c).isNull().cast("int").alias(f"{c}__missing")]
    return rows.select(*out)


def one_hot(df: DataFrame, key: str, column: str, levels: list[str]) -> DataFrame:
    return df.select(key, *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}__{v.lower().replace(' ', '_').replace('#', '')}") for v in levels])


def width_of(df: DataFrame, vector: str) -> int:
    """The one width of all vectors; vectors of different widths are an error."""
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} values")
    return low or 0


def levels_of(df: DataFrame, column: str, most: int = 1_000) -> list[str]:
    """The values of a column in order, to make columns of; more than ``most`` are an error."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return sorted(found)


def centroids(df: DataFrame, vector: str, label: str, width: int) -> DataFrame:
    """label, n, centre (array of means) and square (mean squared length); partial sums go to the shuffle, never vectors."""
    means = [F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(width)]
    square = F.avg(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("square")
    g = df.groupBy(label).agg(F.count("*").alias("n"), square, *means)
    return g.select(label, "n", "square", F.array(*[F.col(f"m{i}") for i in range(width)]).alias("centre"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def silhouette(df: DataFrame, key: str, vector: str, label: str, width: int) -> DataFrame:
    """Silhouette of each row in squared Euclidean distance: key, label, intra, nearest, silhouette.

    The mean squared distance of x to a group is |x|^2 - 2 x.m + q, from the group's mean m and mean squared length q, so
    no pairs of rows are made; the rows meet one centroid for each label. Members of single-row groups get 0.
    """
    c = centroids(df, vector, label, width).select(F.col(label).alias("_other"), F.col("n").alias("_n"), "square", "centre")
    # one row of all centroids: its size is the number of labels times the width
    all_c = c.agg(F.array_sort(F.collect_list(F.struct("_other", "_n", "square", "centre"))).alias("_all"))
    rows = df.select(key, label, vector).join(F.broadcast(all_c))
    own = dot(F.col(vector), F.col(vector))
    far = F.transform("_all", lambda s: F.struct(s["_other"].alias("l"), s["_n"].alias("n"), (own - 2 * dot(F.col(vector), s["centre"]) + s["square"]).alias("d")))
    rows = rows.withColumn("_far", far)
    mine = F.filter("_far", lambda s: s["l"] == F.col(label))[0]
    intra = F.when(mine["n"] > 1, mine["d"] * mine["n"] / (mine["n"] - 1))
    nearest = F.array_min(F.transform(F.filter("_far", lambda s: s["l"] != F.col(label)), lambda s: s["d"]))
    s = F.when(intra.isNull() | nearest.isNull() | (F.greatest(intra, nearest) <= 0), 0.0).otherwise((nearest - intra) / F.greatest(intra, nearest))
    return rows.select(key, label, intra.alias("intra"), nearest.alias("nearest"), s.alias("silhouette"))
