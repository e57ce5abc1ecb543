"""Families of recordings: Ward clustering with choice of the number of families, their order, profiles and signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one clustering may hold: its distances take 8 bytes for each pair of rows.
MOST_ROWS = 5_000


def ward(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, distance) by least growth of the variance; cluster n + k is the k-th merge."""
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) if n * n * x.shape[1] < 5e7 else np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    name, size, live = list(range(n)), np.ones(n), np.ones(n, bool)
    out = []
    for k in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        gap = d[i, j]
        out.append((name[i], name[j], float(gap)))
        a, b, c = size[i], size[j], size
        with np.errstate(invalid="ignore"):
            row = np.sqrt(np.maximum(0, ((a + c) * d[i] ** 2 + (b + c) * d[j] ** 2 - c * gap**2) / (a + b + c)))
        live[j] = False
        row[~live] = np.inf
        row[i] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        size[i], name[i] = a + b, n + k
    return out


def cut(merges: list[tuple[int, int, float]], n: int, families: int) -> np.ndarray:
    """Labels 0 on, in order of first row, of the partition into so many families at most; merges of equal distance go together."""
    heights = [m[2] for m in merges]
    limit = sorted(heights)[n - families - 1] if n > families else -1.0
    root = list(range(2 * n - 1))
    for k, (a, b, h) in enumerate(merges):
        if h <= limit:
            root[a] = root[b] = n + k

    def top(v: int) -> int:
        while root[v] != v:
            v = root[v]
        return v

    seen: dict[int, int] = {}
    return np.array([seen.setdefault(top(v), len(seen)) for v in range(n)])


def silhouettes(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Silhouette of every row in Euclidean distance; 0 for rows alone in their family, and for all if there is one family."""
    names = np.unique(label)
    if len(names) < 2:
        return np.zeros(len(x))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    inside = label[:, None] == names[None, :]
    count = inside.sum(axis=0)
    total = d @ inside
    own = np.searchsorted(names, label)
    rows = np.arange(len(x))
    within = total[rows, own] / np.maximum(1, count[own] - 1)
    others = total / count
    others[rows, own] = np.inf
    near = others.min(axis=1)
    top = np.maximum(within, near)
    return np.where((count[own] > 1) & (top > 0), (near - within) / np.where(top > 0, top, 1), 0.0)


def partition(x: np.ndarray, most: int = 8) -> tuple[np.ndarray, float]:
    """Labels and mean silhouette of the best partition: of those without a too small family the one of highest silhouette, then fewest families."""
    n = len(x)
    if n < 4:
        return np.zeros(n, int), 0.0
    merges = ward(x)
    best = (np.zeros(n, int), 0.0, None)
    for families in range(2, min(most, n - 1) + 1):
        label = cut(merges, n, families)
        if label.max() < 1 or np.bincount(label).min() < max(2, int(np.ceil(0.07 * n))):
            continue
        score = round(float(silhouettes(x, label).mean()), 6)
        if best[2] is None or score > best[2]:
            best = (label, score, score)
    return best[0], best[1]


def families(rows: DataFrame, by: list[str], key: str, features: str, most: int = 8) -> DataFrame:
    """(by, key, family, silhouette, mean_silhouette): Ward families of each group's rows of a features array.

    The method needs all pairs of a group, so a group of more than MOST_ROWS rows is an error, not a sample. Families
    are numbered from 1 in order of their smallest key; ``relabelled`` orders them by content.
    """
    types = dict(rows.dtypes)

    def run(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > MOST_ROWS:
            raise ValueError(f"Ward clustering takes {MOST_ROWS} rows at most, not {len(part)}")
        part = part.sort_values(key)
        x = np.array(part[features].tolist(), float)
        label, mean = partition(x, most)
        out = part[[*by, key]].copy()
        out["family"], out["silhouette"], out["mean_silhouette"] = label + 1, silhouettes(x, label), mean
        return out

    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, key]) + ", family int, silhouette double, mean_silhouette double"
    return rows.select(*by, key, features).groupBy(*by).applyInPandas(run, schema)


def relabelled(rows: DataFrame, family: str, order: list) -> DataFrame:
    """Rows with ``family_id`` family_01 on: families in the order of aggregates over their members, then of their old label."""
    g = rows.groupBy(family).agg(*[c.alias(f"_o{k}") for k, c in enumerate(order)])
    number = F.row_number().over(Window.orderBy(*[f"_o{k}" for k in range(len(order))], family))  # one row for each family
    return rows.join(F.broadcast(g.select(family, F.format_string("family_%02d", number).alias("family_id"))), family)


def signatures(rows: DataFrame, family: str, numeric: list[str], categorical: list[str], top: int = 4) -> DataFrame:
    """The features that set each family apart: (family, feature, contrast, rank), the ``top`` largest of each.

    Numbers: family median less corpus median over the interquartile range, or the deviation where that is none.
    Categories: share in the family less share in all, for each level. Nulls do not count.
    """
    long = rows.select(family, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in numeric])).alias("f")).select(family, "f.feature", "f.x").where("x is not null")
    whole = long.groupBy("feature").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_pop("x").alias("sd"))
    spread = F.when(F.col("q")[2] - F.col("q")[0] > 1e-9, F.col("q")[2] - F.col("q")[0]).otherwise(F.col("sd"))
    own = long.groupBy(family, "feature").agg(F.median("x").alias("m")).join(F.broadcast(whole), "feature").withColumn("s", spread).where("s > 1e-9")
    numbers = own.select(family, "feature", ((F.col("m") - F.col("q")[1]) / F.col("s")).alias("contrast"))
    out = numbers
    if categorical:
        cats = rows.select(family, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categorical])).alias("f")).where("f.v is not null").select(family, F.concat("f.c", F.lit("="), "f.v").alias("feature"))
        n = rows.agg(F.count("*").alias("_n"))
        sizes = rows.groupBy(family).agg(F.count("*").alias("_size"))
        all_of = cats.groupBy("feature").agg(F.count("*").alias("_all"))
        share = cats.groupBy(family, "feature").agg(F.count("*").alias("_own")).join(all_of, "feature").join(F.broadcast(sizes), family).join(F.broadcast(n))
        out = numbers.unionByName(share.select(family, "feature", (F.col("_own") / F.col("_size") - F.col("_all") / F.col("_n")).alias("contrast")))
    w = Window.partitionBy(family).orderBy(F.desc(F.abs("contrast")), "feature")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
