"""Grouped statistics: exact quantiles, modulation depth, regularity, regression, dominant labels, association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.operators.windows import top


def depth(low: Column, high: Column) -> Column:
    """(high - low) / (high + low) within 0 and 1, and 0 where the sum is not positive."""
    return F.when(high + low > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (high - low) / (high + low)))).otherwise(F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def regularity(gap: str, tolerance: float = 0.2) -> tuple[Column, Column]:
    """Coefficient of variation of the gaps, and 1 - cv / tolerance within 0 and 1; aggregates."""
    cv = F.stddev_pop(gap) / F.nullif(F.avg(gap), F.lit(0.0))
    return cv, clip(1 - cv / tolerance, 0.0, 1.0)


def dominant(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The most frequent label of each group with its share; of equal counts the smallest label."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*by)
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(total))
    return top(ranked, by, [F.col("n").desc(), F.col(label)], 1).drop("rank")


def trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of each group: n, slope, intercept, r2 (1 where y does not vary) and rmse."""
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_syy(y, x).alias("_syy"), F.regr_sxx(y, x).alias("_sxx"), F.regr_sxy(y, x).alias("_sxy"),
    )
    left = F.greatest(F.lit(0.0), F.col("_syy") - F.when(F.col("_sxx") > 0, F.col("_sxy") ** 2 / F.nullif("_sxx", F.lit(0.0))).otherwise(0.0))
    g = g.withColumn("r2", F.when(F.abs("_syy") < 1e-12, 1.0).otherwise(1 - left / F.nullif("_syy", F.lit(0.0)))).withColumn("rmse", F.sqrt(left / F.col("n")))
    return g.drop("_syy", "_sxx", "_sxy")


def lagged_correlation(df: DataFrame, by: list[str], time: str, left: str, right: str, reach: int) -> DataFrame:
    """Pearson correlation of left(t) with right(t + lag) for every lag within reach: by, lag, n, r.

    Each row goes out once for each lag and meets its partner in an equi-join on the shifted time.
    """
    a = df.select(*by, F.col(time).alias("_t"), F.col(left).alias("_x")).withColumn("lag", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("_at", F.col("_t") + F.col("lag"))
    b = df.select(*by, F.col(time).alias("_at"), F.col(right).alias("_y"))
    g = a.join(b, [*by, "_at"]).groupBy(*by, "lag").agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("r"), F.stddev_pop("_x").alias("_sx"), F.stddev_pop("_y").alias("_sy"))
    flat = (F.col("n") < 4) | (F.col("_sx") <= 1e-12) | (F.col("_sy") <= 1e-12)
    return g.withColumn("r", F.when(flat, 0.0).otherwise(F.col("r"))).drop("_sx", "_sy")


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, rows, columns, chi2, cramers_v, nmi, consistency and majority of the contingency of two labels.

    Zero cells count through sum(joint^2 / expected) - n, so no cross join of the levels is made.
    """
    joint = df.groupBy(a, b).agg(F.count("*").alias("_j"))
    whole = joint.withColumn("_r", F.sum("_j").over(Window.partitionBy(a))).withColumn("_c", F.sum("_j").over(Window.partitionBy(b)))
    ra = joint.groupBy(a).agg(F.sum("_j").alias("_m"), F.max("_j").alias("_top")).agg(F.count("*").alias("n_rows"), F.sum("_m").alias("n"), F.sum(F.col("_m") * F.ln("_m")).alias("_ha"), F.sum("_top").alias("_tops"))
    cb = joint.groupBy(b).agg(F.sum("_j").alias("_m")).agg(F.count("*").alias("n_columns"), F.sum(F.col("_m") * F.ln("_m")).alias("_hb"), F.max("_m").alias("_most"))
    cells = whole.agg(F.sum(F.col("_j") * F.col("_j") / (F.col("_r") * F.col("_c"))).alias("_s"), F.sum(F.col("_j") * F.ln("_j")).alias("_hj"))
    one = ra.join(F.broadcast(cb)).join(F.broadcast(cells))
    n = F.col("n")
    h = lambda c: F.ln(n) - F.col(c) / n
    mi = h("_ha") + h("_hb") - h("_hj")
    chi2 = n * (F.col("_s") - 1)
    k = F.least("n_rows", "n_columns") - 1
    return one.select(
        "n", "n_rows", "n_columns", chi2.alias("chi2"),
        F.when((k > 0) & (n > 0), F.sqrt(F.greatest(F.lit(0.0), chi2) / (n * F.nullif(k, F.lit(0))))).otherwise(0.0).alias("cramers_v"),
        F.when(h("_ha") * h("_hb") > 0, mi / F.sqrt(F.greatest(h("_ha") * h("_hb"), F.lit(1e-300)))).otherwise(0.0).alias("nmi"),
        (F.col("_tops") / n).alias("consistency"), (F.col("_most") / n).alias("majority"),
    )


def normalised_excess(observed: Column, baseline: Column) -> Column:
    """(o - b) / (1 - b) above the baseline, (o - b) / b below it, 0 where that has no meaning."""
    up, down = 1 - baseline, baseline
    above = F.when(up > 0, (observed - baseline) / F.nullif(up, F.lit(0.0))).otherwise(0.0)
    below = F.when(down > 0, (observed - baseline) / F.nullif(down, F.lit(0.0))).otherwise(0.0)
    return F.when(observed >= baseline, above).otherwise(below)
