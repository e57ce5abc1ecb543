"""Greedy one-to-one selection by rounds of mutual best choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share; only a local master may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def greedy(pairs: DataFrame, by: list[str], left: str, right: str, order: str) -> DataFrame:
    """The pairs a sequential greedy pass takes that walks them by ``order`` and skips used sides.

    ``order`` must be a total order within a group (a number or struct, smallest first). A pair that is the first of
    both its sides is taken by the sequential pass as well; taking all of these at once and dropping what they use
    leaves the same problem, smaller. Rounds are checkpointed.
    """
    rest, taken = saved(pairs), None
    while True:
        first_l = rest.groupBy(*by, left).agg(F.min(order).alias("_fl"))
        first_r = rest.groupBy(*by, right).agg(F.min(order).alias("_fr"))
        won = rest.join(first_l, [*by, left]).join(first_r, [*by, right]).where((F.col(order) == F.col("_fl")) & (F.col(order) == F.col("_fr"))).select(*rest.columns)
        won = saved(won)
        if won.isEmpty():
            return taken if taken is not None else won
        taken = won if taken is None else taken.unionByName(won)
        rest = saved(rest.join(won.select(*by, left), [*by, left], "left_anti").join(won.select(*by, right), [*by, right], "left_anti"))
