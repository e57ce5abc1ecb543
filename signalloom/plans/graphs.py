"""Queries over graphs of items ordered together, and over what changed between two halves of the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.operators import graph, history
from signalloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EDGES = """l AS (SELECT l_orderkey AS o, l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target, l_linenumber AS rank FROM lineitem),
raw AS (SELECT DISTINCT o, source, target, rank FROM l WHERE target IS NOT NULL), d AS (SELECT DISTINCT source, target FROM raw)"""


#: Rows of lineitem that a task sorts or keeps apart, where the session's number of partitions would give it more.
TASK_ROWS = 1_000_000


def _edges(spark, sf_dir, dealt=True):
    """An edge from every ordered item to the next one of its order.

    ``dealt``: for large tables, dealt by (source, target), as what follows needs. The number of partitions grows with the
    table (its rows are counted from the files' footers), so that a task's memory does not.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = lines.count() // TASK_ROWS + 1
    large = parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = (lines.repartition(parts, "l_orderkey") if large else lines).select(F.col("l_orderkey").alias("observation_id"), F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target"), F.col("l_linenumber").alias("rank"))
    e = e.where("target is not null")
    return e.repartition(parts, "source", "target") if large and dealt else e


@query(f"""WITH {EDGES} SELECT source, target, count(*)::BIGINT AS n_occurrences, count(DISTINCT o)::BIGINT AS n_observations,
  array_to_string(list_sort(list_distinct(list(rank))), ',') AS ranks FROM raw GROUP BY ALL""")
def q41_edge_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = graph.aggregated(_edges(spark, sf_dir))
    return a.select("source", "target", "n_occurrences", F.size("observations").cast("bigint").alias("n_observations"), F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",").alias("ranks"))


@query(f"""WITH {EDGES}, b AS (SELECT source AS id, 0 AS i, 1 AS o FROM d UNION ALL SELECT target, 1, 0 FROM d)
SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM b GROUP BY 1 ORDER BY in_degree DESC, out_degree DESC, id LIMIT 15""")
def q42_degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen best connected items: a top-k report by its nature."""
    return graph.degrees(_edges(spark, sf_dir)).orderBy(F.desc("in_degree"), F.desc("out_degree"), "id").limit(15)


TOPOLOGY = f"""{EDGES}, u AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS w FROM d WHERE source <> target GROUP BY ALL)"""


@query(f"""WITH {TOPOLOGY}, n AS (SELECT pa.p_brand AS x, pb.p_brand AS y, w FROM u JOIN part pa ON pa.p_partkey = a JOIN part pb ON pb.p_partkey = b),
deg AS (SELECT l, sum(w) AS g FROM (SELECT x AS l, w FROM n UNION ALL SELECT y, w FROM n) GROUP BY 1), m AS (SELECT sum(w)::DOUBLE AS m FROM n)
SELECT m AS total_weight, round((SELECT sum(w) FROM n WHERE x = y) / m - (SELECT sum(g::DOUBLE * g) FROM deg) / (4 * m * m), 8) AS modularity FROM m""")
def q43_modularity_given_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    return graph.modularity(graph.topology(_edges(spark, sf_dir)), labels).withColumn("modularity", F.round("modularity", 8))


@query(f"""WITH {EDGES} SELECT s.p_brand AS context, t.p_type AS activity, count(*)::BIGINT AS n FROM d JOIN part s ON s.p_partkey = source JOIN part t ON t.p_partkey = target GROUP BY ALL""")
def q44_context_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return graph.context_transitions(_edges(spark, sf_dir), p.select(F.col("p_partkey").alias("source"), F.col("p_brand").alias("context")), p.select(F.col("p_partkey").alias("target"), F.col("p_type").alias("activity")))


LISTS = """s AS (SELECT l_suppkey AS source, year(l_shipdate) AS observation, list_distinct(list(l_partkey)) AS s FROM lineitem GROUP BY ALL),
n AS (SELECT source, count(*)::BIGINT AS n_observations FROM s GROUP BY 1)"""


def _lists(spark, sf_dir):
    """What each supplier sold in each year, as its list of that year."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.year("l_shipdate").alias("observation"), F.array("l_partkey").alias("targets"))


@query(f"""WITH {LISTS}, p AS (SELECT a.source, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j FROM s a JOIN s b ON a.source = b.source AND a.observation < b.observation),
g AS (SELECT source, count(*)::BIGINT AS n_pairs, avg(j) AS mj, min(j) AS lj FROM p GROUP BY 1)
SELECT source, n_observations, coalesce(n_pairs, 0)::BIGINT AS n_pairs, round(mj, 6) AS mean_jaccard, round(lj, 6) AS least_jaccard,
  CASE WHEN n_observations < 2 THEN 'not_repeated' ELSE 'assessed' END AS status FROM n LEFT JOIN g USING (source)""")
def q45_set_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = graph.list_drift(_lists(spark, sf_dir))
    return d.withColumn("mean_jaccard", F.round("mean_jaccard", 6)).withColumn("least_jaccard", F.round("least_jaccard", 6))


@query(f"""WITH {LISTS}, w AS (SELECT source, observation, s, lag(s) OVER (PARTITION BY source ORDER BY observation) AS b FROM s)
SELECT source, observation::INT AS observation, len(list_intersect(s, b))::INT AS retained, (len(s) - len(list_intersect(s, b)))::INT AS added, (len(b) - len(list_intersect(s, b)))::INT AS removed FROM w WHERE b IS NOT NULL""")
def q52_list_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.changes(_lists(spark, sf_dir))


@query(f"""WITH {EDGES}, b AS (SELECT s.p_brand AS x, t.p_brand AS y FROM d JOIN part s ON s.p_partkey = source JOIN part t ON t.p_partkey = target),
c AS (SELECT l AS label, count(*) FILTER (i)::BIGINT AS n_internal, count(*) FILTER (NOT i)::BIGINT AS n_boundary FROM (SELECT x AS l, x = y AS i FROM b UNION ALL SELECT y, false FROM b WHERE x <> y) GROUP BY 1),
g AS (SELECT id, sum(k) AS degree FROM (SELECT source AS id, 1 AS k FROM d UNION ALL SELECT target, 1 FROM d) GROUP BY 1),
r AS (SELECT p_brand AS label, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(degree, 0) DESC, p_partkey) AS k FROM part LEFT JOIN g ON id = p_partkey)
SELECT label, count(*)::BIGINT AS n_members, array_to_string(list(id ORDER BY k) FILTER (k <= 5), ',') AS hubs, coalesce(any_value(n_internal), 0)::BIGINT AS n_internal, coalesce(any_value(n_boundary), 0)::BIGINT AS n_boundary FROM r LEFT JOIN c USING (label) GROUP BY 1""")
def q53_community_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"))
    return graph.community_profile(_edges(spark, sf_dir), labels).withColumn("hubs", F.array_join(F.transform("hubs", lambda h: h.cast("string")), ","))


@query()
def r05_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of items of one brand and type that were ordered next to each other. Sequential within a component: tests hold it against a plain version."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"))
    e = _edges(spark, sf_dir, dealt=False).select("source", "target")  # the topology of the few that are left counts each once
    own = e.join(p.withColumnRenamed("k", "source"), "source").join(p.withColumnRenamed("k", "target"), ["target", "b", "t"])
    return graph.communities(graph.topology(own))


HALVES = """h AS (SELECT o_custkey, o_orderpriority AS p, o_orderstatus AS s, o_totalprice, o_orderdate < (SELECT quantile_disc(o_orderdate, 0.5) FROM orders) AS early FROM orders),
x AS (SELECT o_custkey, early, list_sort(list_distinct(list(p))) AS ps, count(*)::BIGINT AS n FROM h GROUP BY ALL),
b AS (SELECT * FROM x WHERE early), a AS (SELECT * FROM x WHERE NOT early)"""


def _halves(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    o = o.withColumn("_at", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    middle = o.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _at)").alias("_mid"))
    o = o.join(F.broadcast(middle)).withColumn("early", F.col("_at") < F.col("_mid"))
    return o.where("early"), o.where("not early")


@query(f"""WITH {HALVES}, j AS (SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.o_custkey IS NOT NULL AS was, a.o_custkey IS NOT NULL AS is_, coalesce(b.ps, []) AS bp, coalesce(a.ps, []) AS ap, b.n AS bn, a.n AS an FROM b FULL JOIN a ON a.o_custkey = b.o_custkey),
c AS (SELECT *, list_filter(ap, lambda v: NOT list_contains(bp, v)) AS g, list_filter(bp, lambda v: NOT list_contains(ap, v)) AS l FROM j)
SELECT o_custkey, CASE WHEN NOT was THEN 'added' WHEN NOT is_ THEN 'removed' WHEN len(g) + len(l) > 0 OR bn IS DISTINCT FROM an THEN 'changed' ELSE 'retained' END AS status,
  array_to_string(g, ',') AS gained, array_to_string(l, ',') AS lost, bn AS before_n, an AS after_n FROM c""")
def q46_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda o: o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("priorities"), F.count("*").alias("n"))
    before, after = _halves(spark, sf_dir)
    c = history.compared(side(before), side(after), "o_custkey", ["priorities"], ["n"])
    return c.select("o_custkey", "status", F.array_join("priorities_gained", ",").alias("gained"), F.array_join("priorities_lost", ",").alias("lost"), "before_n", "after_n")


@query(f"""WITH {HALVES}, f AS (SELECT o_custkey, early, s || ' ' || max(p) AS family FROM h GROUP BY o_custkey, early, s QUALIFY row_number() OVER (PARTITION BY o_custkey, early ORDER BY count(*) DESC, s) = 1),
na AS (SELECT family, count(*)::BIGINT AS n_members FROM f WHERE NOT early GROUP BY 1), nb AS (SELECT family AS before_family, count(*) AS k FROM f WHERE early GROUP BY 1),
m AS (SELECT a.family, b.family AS before_family, count(*)::BIGINT AS n_shared FROM f a JOIN f b ON a.o_custkey = b.o_custkey AND NOT a.early AND b.early GROUP BY ALL),
j AS (SELECT m.*, n_members, n_shared / (n_members + k - n_shared) AS jaccard FROM m JOIN na USING (family) JOIN nb USING (before_family)),
t AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY family ORDER BY jaccard DESC, before_family DESC) = 1)
SELECT na.family, na.n_members, before_family, coalesce(n_shared, 0)::BIGINT AS n_shared, round(coalesce(jaccard, 0), 6)::DOUBLE AS jaccard,
  CASE WHEN before_family IS NULL THEN 'new' WHEN jaccard >= 0.8 THEN 'stable' WHEN jaccard >= 0.5 THEN 'shifted' ELSE 'reconfigured' END AS status FROM na LEFT JOIN t USING (family)""")
def q47_family_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(o):
        g = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
        return g.groupBy("o_custkey").agg(F.min_by(F.concat_ws(" ", "o_orderstatus", "p"), F.struct(-F.col("n"), "o_orderstatus")).alias("family"))

    before, after = _halves(spark, sf_dir)
    return history.family_overlap(side(before), side(after), "o_custkey", "family").withColumn("jaccard", F.round("jaccard", 6))


@query("""SELECT sha256(coalesce(text, '')) AS digest, count(DISTINCT doc_id)::BIGINT AS n_paths, array_to_string(list_sort(list_distinct(list(lang) FILTER (lang IS NOT NULL))), ',') AS langs,
  array_to_string(list_sort(list_distinct(list(source) FILTER (source IS NOT NULL))), ',') AS sources, count(DISTINCT lang) > 1 OR count(DISTINCT source) > 1 AS cross_context FROM documents GROUP BY 1""")
def q54_corpus_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("doc_id").cast("string").alias("path"), "lang", "source")
    s = history.snapshot(d, "digest", "path", ["lang", "source"])
    return s.select("digest", F.size("paths").cast("bigint").alias("n_paths"), F.array_join("lang", ",").alias("langs"), F.array_join("source", ",").alias("sources"), "cross_context")
