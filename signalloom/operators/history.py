"""Snapshots of a corpus and what changed between two: members, families, sets and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions import scalar


def snapshot(rows: DataFrame, digest: str, path: str, sets: list[str]) -> DataFrame:
    """One row for each distinct input: its paths, the sorted set of each column of ``sets``, and whether it stands in more than one context.

    Null digests are inputs of their own, under their path.
    """
    key = F.coalesce(F.col(digest), F.concat(F.lit("path:"), F.col(path)))
    g = rows.groupBy(key.alias(digest)).agg(F.array_sort(F.collect_set(path)).alias("paths"), *[F.array_sort(F.collect_set(c)).alias(c) for c in sets])
    many = scalar.any_of(*[F.size(c) > 1 for c in sets]) if sets else F.lit(False)
    return g.withColumn("cross_context", many)


def snapshot_id(snap: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of rows and an id from a digest of all rows' digests, whatever their order.

    Each row is hashed; the sums of the halves of these hashes stand for the set, so nothing is collected or sorted.
    """
    h = F.sha2(scalar.canonical(*[F.to_json(c) if dict(snap.dtypes)[c].startswith(("array", "struct", "map")) else F.col(c) for c in columns]), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return snap.agg(F.count("*").alias("n"), F.concat(F.lit("snapshot_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(part(k), F.lit("0")) for k in range(4)]), 256), 1, 16)).alias("snapshot_id"))


def compared(before: DataFrame, after: DataFrame, key: str, sets: list[str], values: list[str]) -> DataFrame:
    """One row for each key of either side: status added, removed, changed or retained; what sets gained and lost; both values."""
    side = lambda df, p: df.select(F.col(key), F.lit(True).alias(f"_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in [*sets, *values]])
    both = side(before, "before").join(side(after, "after"), key, "full_outer")
    none = F.array().cast("array<string>")
    was = lambda p, c: F.coalesce(F.transform(f"{p}_{c}", lambda x: x.cast("string")), none)
    out = both
    for c in sets:
        out = out.withColumn(f"{c}_gained", F.array_sort(F.array_except(was("after", c), was("before", c)))).withColumn(f"{c}_lost", F.array_sort(F.array_except(was("before", c), was("after", c))))
    moved = scalar.any_of(F.lit(False), *[(F.size(f"{c}_gained") + F.size(f"{c}_lost")) > 0 for c in sets], *[~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")) for c in values])
    status = F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").when(moved, "changed").otherwise("retained")
    return out.withColumn("status", status).select(key, "status", *[f"{c}_{w}" for c in sets for w in ("gained", "lost")], *[f"{p}_{c}" for c in values for p in ("before", "after")])


def family_overlap(before: DataFrame, after: DataFrame, member: str, family: str) -> DataFrame:
    """For each family after, the one before that it shares most of (Jaccard; of equal ones the larger id), and how stable that is.

    Only families that share a member meet, in an equi-join on members, so no pairs of all families are made.
    """
    b, a = before.select(member, F.col(family).alias("before_family")).distinct(), after.select(member, F.col(family).alias("family")).distinct()
    nb, na = b.groupBy("before_family").agg(F.count("*").alias("_nb")), a.groupBy("family").agg(F.count("*").alias("n_members"))
    shared = a.join(b, member).groupBy("family", "before_family").agg(F.count("*").alias("n_shared")).join(nb, "before_family").join(na.withColumnRenamed("n_members", "_na"), "family")
    scored = shared.withColumn("jaccard", F.col("n_shared") / (F.col("_na") + F.col("_nb") - F.col("n_shared")))
    best = scored.groupBy("family").agg(F.max(F.struct("jaccard", "before_family", "n_shared")).alias("_b"))
    j = F.coalesce(F.col("_b.jaccard"), F.lit(0.0))
    kind = F.when(F.col("_b").isNull(), "new").when(j >= 0.8, "stable").when(j >= 0.5, "shifted").otherwise("reconfigured")
    return na.join(best, "family", "left").select("family", "n_members", F.col("_b.before_family").alias("before_family"), F.coalesce("_b.n_shared", F.lit(0)).alias("n_shared"), j.alias("jaccard"), kind.alias("status"))


def ordered(snapshots: DataFrame) -> DataFrame:
    """Snapshots with ``position`` in order of time and id, and the id of the one before."""
    w = Window.orderBy("captured_at", "snapshot_id")  # one row for each snapshot
    return snapshots.withColumn("position", F.row_number().over(w)).withColumn("previous_id", F.lag("snapshot_id").over(w))
