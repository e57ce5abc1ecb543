"""Verdicts on claims that have their observation in the same row; ``claims`` joins claims with observations first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULTS = ("invalid", "not_evaluated", "unsupported", "agree", "disagree")


def within_relative(observed: Column, target: Column, most: float, floor: float) -> Column:
    """The error as a share of the target, which counts as ``floor`` at least."""
    return F.abs(observed - target) / F.greatest(F.abs(target), F.lit(floor)) <= most


def verdict(is_valid: Column, observed: Column, supported: Column, agrees: Column) -> Column:
    """The result of a claim, in the order of RESULTS."""
    return F.when(~is_valid, "invalid").when(observed.isNull(), "not_evaluated").when(~supported, "unsupported").when(agrees, "agree").otherwise("disagree")


def rollup(claims: DataFrame, by: list[str]) -> DataFrame:
    """by, n_claims, n_agree and a label: all agree, some agree and none contradicts, or else exploratory."""
    yes, no = F.col("result") == "agree", F.col("result").isin("disagree", "invalid")
    label = F.when(F.bool_and(yes), "verified").when(F.bool_or(yes) & ~F.bool_or(no), "partially_verified").otherwise("exploratory")
    return claims.groupBy(*by).agg(F.count("*").alias("n_claims"), F.count_if(yes).alias("n_agree"), label.alias("label"))
