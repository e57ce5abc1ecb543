"""Connected components of an edge table, by hooking to smaller labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of ``edges`` (a, b): the smallest id that it reaches.

    A round takes the smallest label among a node and its neighbours, then the label of that label, so the rounds grow
    with the logarithm of the longest path. Labels are checkpointed each round; only a count reaches the driver. Self
    edges and repeated edges do no harm; null ends are left out; no edges give an empty table.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null and a <> b").distinct()
    both = shared.cut(both)
    labels = shared.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        hooked = labels.join(near.select(F.col("a").alias("id"), "l"), "id").select("id", F.least("label", "l").alias("to"), "label")
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("beyond"))
        after = shared.cut(hooked.join(jump, "to").select("id", F.least("to", "beyond").alias("label"), (F.least("to", "beyond") != F.col("label")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("id", "label")
        labels = after.select("id", "label")


def extended(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The (id, label) table after further edges: components of the labels these join, so settled edges are not walked again."""
    la, lb = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    between = more.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = components(between)
    old = labels.join(over.select(F.col("id").alias("label"), F.col("label").alias("over")), "label", "left").select("id", F.coalesce("over", "label").alias("label"))
    return old.unionByName(over.join(labels.select("id"), "id", "left_anti").select("id", "label"))
