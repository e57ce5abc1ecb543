"""Recommendation graphs: edges from ranked lists, degrees, topology, communities, modularity, drift and transitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions import scalar


def list_edges(lists: DataFrame, context: list[str]) -> DataFrame:
    """Rows (context, source, target, rank) of ranked target arrays; rank is from 1; null targets go."""
    return lists.select(*context, "source", F.posexplode("targets").alias("_k", "target")).where("target is not null").select(*context, "source", "target", (F.col("_k") + 1).alias("rank"))


def authoritative(linked: DataFrame, embedded: DataFrame, by: list[str]) -> DataFrame:
    """The lists a request asked for; lists embedded in documents stand in only for captures that have none of these."""
    return linked.unionByName(embedded.join(linked.select(*by).distinct(), by, "left_anti"))


def aggregated(edges: DataFrame, observation: str = "observation_id") -> DataFrame:
    """One row for each source and target: occurrences, and the sorted sets of observations and ranks. Repeated rows of an observation count once."""
    once = edges.select(observation, "source", "target", "rank").distinct()
    return once.groupBy("source", "target").agg(
        F.count("*").alias("n_occurrences"), F.array_sort(F.collect_set(observation)).alias("observations"), F.array_sort(F.collect_set("rank")).alias("ranks"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree over distinct edges; nodes without edges do not appear."""
    e = edges.select("source", "target").distinct()
    both = e.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def topology(edges: DataFrame) -> DataFrame:
    """Undirected weighted edges (a < b, weight): a pair of opposite edges weighs 2; loops go."""
    e = edges.select("source", "target").distinct().where("source <> target")
    return e.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").alias("weight"))


def modularity(undirected: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: total weight and modularity of a labelling (id, label); 0 without edges. Nodes without a label are a label each."""
    named = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    e = undirected.join(named("a"), "a", "left").join(named("b"), "b", "left")
    own = lambda c: F.coalesce(F.concat(F.lit("label:"), F.col(f"l{c}").cast("string")), F.concat(F.lit("id:"), F.col(c).cast("string")))
    e = e.select(own("a").alias("x"), own("b").alias("y"), "weight")
    ends = F.explode(F.array(F.struct(F.col("x").alias("l"), F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0).alias("inner")), F.struct(F.col("y").alias("l"), F.lit(0).cast("bigint").alias("inner"))))
    by_label = e.select("weight", ends.alias("e")).groupBy("e.l").agg(F.sum("weight").alias("degree"), F.sum("e.inner").alias("inner"))
    # the total is half of all degrees; sums over labels give both terms at once
    one = by_label.agg(F.sum("inner").alias("_in"), F.sum("degree").alias("_deg"), F.sum(F.col("degree").cast("double") * F.col("degree")).alias("_sq"))
    m = F.col("_deg") / 2
    return one.select(F.coalesce(m, F.lit(0.0)).alias("total_weight"), F.when(m > 0, F.col("_in") / F.nullif(m, F.lit(0.0)) - F.col("_sq") / (F.nullif(m, F.lit(0.0)) * m * 4)).otherwise(0.0).alias("modularity"))


def connected(undirected: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node of ``undirected`` (a, b) reaches.

    Rounds of taking the smallest label around and the label of that label; each round is checkpointed, and only whether
    anything moved reaches the driver.
    """
    from signalloom.operators.matching import saved

    both = saved(undirected.select("a", "b").unionByName(undirected.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("n"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "n").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("beyond"))
        after = saved(hooked.join(jump, "to").select("id", "before", F.least("to", "beyond").alias("component")))
        labels = after.select("id", "component")
        if after.where("before <> component").isEmpty():
            return labels


def propagated(ids: list, near: dict, sweeps: int = 100) -> tuple[dict, int]:
    """Labels after sweeps in order of (degree falling, id): each node takes the heaviest label around, its own on a tie, else the smallest."""
    degree = {v: sum(near[v].values()) for v in ids}
    label = {v: v for v in ids}
    order = sorted(ids, key=lambda v: (-degree[v], v))
    for sweep in range(1, sweeps + 1):
        moved = False
        for v in order:
            weight: dict = {}
            for u, w in near[v].items():
                weight[label[u]] = weight.get(label[u], 0) + w
            most = max(weight.values(), default=0)
            best = [name for name, w in weight.items() if w == most]
            if best and label[v] not in best:
                label[v], moved = min(best), True
        if not moved:
            return label, sweep
    return label, sweeps


def communities(undirected: DataFrame, sweeps: int = 100) -> DataFrame:
    """(id, label, sweeps): asynchronous label propagation of each connected component, which is exact, as components do not touch.

    One task holds one component at a time: this rule is sequential within it. Components stream through sorted rows, so
    that many small ones cost no more than their edges. Labels become the smallest id of their community.
    """
    from signalloom.operators.matching import saved

    kind = dict(undirected.dtypes)["a"]

    def labelled(rows: list[tuple]) -> list[tuple]:
        near: dict = {}
        for a, b, w in rows:
            near.setdefault(a, {})[b] = w
            near.setdefault(b, {})[a] = w
        label, n = propagated(sorted(near), near, sweeps)
        groups: dict = {}
        for v, name in label.items():
            groups.setdefault(name, []).append(v)
        return [(v, least, n) for own in groups.values() for least in (min(own),) for v in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, held, out, id_type = None, [], [], None

        def given() -> pa.RecordBatch:
            ids, names, n = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(names, id_type), pa.array(n, pa.int32())], ["id", "label", "sweeps"])

        for batch in batches:
            id_type = batch.schema.field("a").type
            for c, *row in zip(*[batch.column(k).to_pylist() for k in ("component", "a", "b", "weight")], strict=True):
                if c != component and held:
                    out += labelled(held)
                    held = []
                component = c
                held.append(row)
            if out:
                yield given()
                out = []
        if held:
            out = labelled(held)
            yield given()

    edges = saved(undirected.select("a", "b", "weight"))  # read in every round and again at the end
    c = connected(edges).select(F.col("id").alias("a"), "component")
    rows = edges.join(c, "a").select("component", "a", "b", "weight").repartition("component").sortWithinPartitions("component", "a", "b")
    return rows.mapInArrow(run, f"id {kind}, label {kind}, sweeps int")


def community_profile(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Each community's members, directed edges within (loops count) and across its border, and its five best connected members."""
    e = edges.select("source", "target").distinct()
    named = lambda c, n: labels.select(F.col("id").alias(c), F.col("label").alias(n))
    both = e.join(named("source", "x"), "source").join(named("target", "y"), "target")
    ends = F.explode(F.array_distinct(F.array("x", "y"))).alias("label")
    counts = both.select(ends, (F.col("x") == F.col("y")).alias("inner")).groupBy("label").agg(F.count_if("inner").alias("n_internal"), F.count_if(~F.col("inner")).alias("n_boundary"))
    d = degrees(e).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    hubs = labels.select("id", "label").join(d, "id", "left").groupBy("label").agg(
        F.count("*").alias("n_members"), F.slice(F.array_sort(F.collect_list(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "id"))), 1, 5).alias("_h"))
    return hubs.select("label", "n_members", F.transform("_h", lambda h: h["id"]).alias("hubs")).join(counts, "label", "left").na.fill(0, ["n_internal", "n_boundary"])


def list_drift(lists: DataFrame) -> DataFrame:
    """Drift of each source's lists (source, observation, targets) between observations.

    Lists of one observation are united; empty ones are set aside. One row for each source: status, number of
    observations, mean and least Jaccard similarity of the pairs of observations. Pairs are of one source's observations.
    """
    sets = lists.select("source", "observation", F.explode_outer("targets").alias("t")).groupBy("source", "observation").agg(F.collect_set("t").alias("s"))
    full = sets.where(F.size("s") > 0)
    n = sets.groupBy("source").agg(F.count("*").alias("n_observations"), F.count_if(F.size("s") > 0).alias("n_nonempty"))
    a, b = full.select("source", F.col("observation").alias("x"), F.col("s").alias("sx")), full.select("source", F.col("observation").alias("y"), F.col("s").alias("sy"))
    p = a.join(b, "source").where("x < y").select("source", scalar.jaccard(F.col("sx"), F.col("sy")).alias("j"))
    g = n.join(p.groupBy("source").agg(F.count("*").alias("n_pairs"), F.avg("j").alias("mean_jaccard"), F.min("j").alias("least_jaccard")), "source", "left")
    status = F.when(F.col("n_observations") < 2, "not_repeated").when(F.col("n_nonempty") < 2, "insufficient_nonempty_repeats").otherwise("assessed")
    return g.select("source", "n_observations", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "mean_jaccard", "least_jaccard", status.alias("status"))


def changes(lists: DataFrame) -> DataFrame:
    """Each source's observations in order, with what was kept, added and removed since the one before: (source, observation, retained, added, removed)."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("observation")
    sets = lists.select("source", "observation", F.explode("targets").alias("t")).groupBy("source", "observation").agg(F.array_sort(F.collect_set("t")).alias("s"))
    rows = sets.withColumn("b", F.lag("s").over(w)).where("b is not null")
    return rows.select("source", "observation", *[F.size(f(x, y)).alias(n) for n, f, x, y in (("retained", F.array_intersect, "s", "b"), ("added", F.array_except, "s", "b"), ("removed", F.array_except, "b", "s"))])


def context_transitions(edges: DataFrame, source_context: DataFrame, target_activity: DataFrame) -> DataFrame:
    """(context, activity, n): distinct relations of sources of a context to targets of an activity.

    ``source_context``: (source, context), ``target_activity``: (target, activity); both may hold several values of one id.
    """
    e = edges.select("source", "target").distinct()
    # distinct on all sides, so that a relation comes once for each context and activity and counting rows is enough
    rows = e.join(source_context.select("source", "context").distinct(), "source").join(target_activity.select("target", "activity").distinct(), "target")
    return rows.groupBy("context", "activity").agg(F.count("*").alias("n"))
