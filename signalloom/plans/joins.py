"""Queries that join: theta, overlap, nearest, greedy, referential."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions import scalar
from signalloom.operators import intervals, matching, windows
from signalloom.plans.signals import DAY, HOUR
from signalloom.sources.tables import events, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT CASE WHEN l_quantity < 0.5 THEN 'below' WHEN l_quantity < 4 THEN 'delta' WHEN l_quantity < 8 THEN 'theta' WHEN l_quantity < 13 THEN 'alpha'
  WHEN l_quantity < 30 THEN 'beta' WHEN l_quantity <= 100 THEN 'gamma' ELSE 'above' END AS band,
  CASE WHEN round_even(greatest(l_quantity, p_size) / least(l_quantity, p_size), 0) BETWEEN 2 AND 4
    AND abs(greatest(l_quantity, p_size) / least(l_quantity, p_size) - round_even(greatest(l_quantity, p_size) / least(l_quantity, p_size), 0)) <= 0.015::DOUBLE * round_even(greatest(l_quantity, p_size) / least(l_quantity, p_size), 0)
    THEN round_even(greatest(l_quantity, p_size) / least(l_quantity, p_size), 0) END::BIGINT AS harmonic, count(*)::BIGINT AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def q15_band_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(scalar.band(F.col("l_quantity")).alias("band"), scalar.harmonic(F.col("l_quantity"), F.col("p_size").cast("double")).alias("harmonic")).agg(F.count("*").alias("n"))


@query("""SELECT a.s_suppkey AS left_id, b.s_suppkey AS right_id, round(abs(a.s_acctbal - b.s_acctbal), 2) AS difference
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE abs(a.s_acctbal - b.s_acctbal) BETWEEN 0.5 AND 400""")
def q16_pair_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    a = s.select("s_nationkey", F.col("s_suppkey").alias("left_id"), F.col("s_acctbal").alias("l"))
    b = s.select("s_nationkey", F.col("s_suppkey").alias("right_id"), F.col("s_acctbal").alias("r"))
    p = intervals.near_pairs(a, b, ["s_nationkey"], "l", "r", 0.5, 400.0).where("left_id < right_id")
    return p.select("left_id", "right_id", F.round(F.abs(F.col("l") - F.col("r")), 2).alias("difference"))


SPANS = f"s AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t0, epoch_us(ts) + floor(value * 600000000)::BIGINT AS t1 FROM events)"
MERGED = f"""{SPANS}, o AS (SELECT *, max(t1) OVER (PARTITION BY user_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t0, t1) AS island FROM o),
m AS (SELECT user_id, min(t0) AS start, max(t1) AS stop, count(*)::BIGINT AS n_merged FROM i GROUP BY user_id, island)"""


def _spans(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("user_id", "event_id", "event_type", F.col("t").alias("t0"), (F.col("t") + F.floor(F.col("value") * 600_000_000)).cast("bigint").alias("t1"))


def _merged(spark, sf_dir):
    return intervals.merge(_spans(spark, sf_dir), ["user_id"], "t0", "t1")


@query(f"WITH {MERGED} SELECT * FROM m")
def q17_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


@query(f"""WITH {MERGED}, w AS (SELECT min(t0) // {DAY} * {DAY} AS lo, (max(t0) // {DAY} + 1) * {DAY} AS hi FROM s), g AS (
  SELECT user_id, coalesce(lag(stop) OVER (PARTITION BY user_id ORDER BY start), lo) AS a, start AS b FROM m, w
  UNION ALL SELECT user_id, max(stop), any_value(hi) FROM m, w GROUP BY 1)
SELECT user_id, greatest(a, lo)::BIGINT AS start, least(b, hi)::BIGINT AS stop FROM g, w WHERE greatest(a, lo) < least(b, hi)""")
def q18_interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps within the days that the starts of all spans cover."""
    days = _spans(spark, sf_dir).agg((F.floor(F.min("t0") / DAY) * DAY).alias("_lo"), ((F.floor(F.max("t0") / DAY) + 1) * DAY).alias("_hi"))
    rows = _merged(spark, sf_dir).join(F.broadcast(days))
    return intervals.complement(rows, ["user_id", "_lo", "_hi"], F.col("_lo"), F.col("_hi")).drop("_lo", "_hi")


@query(f"""WITH {MERGED}, k AS (SELECT *, unnest(range(start // {6 * HOUR}, greatest(stop - 1, start) // {6 * HOUR} + 1)) AS k FROM m),
c AS (SELECT user_id, (k * {6 * HOUR})::BIGINT AS window_start, sum(greatest(0, least(stop, (k + 1) * {6 * HOUR}) - greatest(start, k * {6 * HOUR})))::BIGINT AS covered FROM k GROUP BY ALL)
SELECT user_id, window_start, covered, round(covered / {6 * HOUR}, 6) AS ratio,
  CASE WHEN covered / {6 * HOUR} >= 0.5 THEN 'active' WHEN covered / {6 * HOUR} <= 0.1 THEN 'sparse' ELSE 'mixed' END AS label FROM c""")
def q19_window_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.covered_windows(_merged(spark, sf_dir), ["user_id"], 6 * HOUR).withColumn("ratio", F.round("ratio", 6))


PAIRS = f"""{SPANS}, p AS (SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id, least(a.t1, b.t1) - greatest(a.t0, b.t0) AS overlap,
  (least(a.t1, b.t1) - greatest(a.t0, b.t0)) / least(a.t1 - a.t0, b.t1 - b.t0) AS ratio
  FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND a.t0 < b.t1 AND b.t0 < a.t1 AND a.t0 < a.t1 AND b.t0 < b.t1)"""


def _pairs(spark, sf_dir):
    s = _spans(spark, sf_dir)
    side = lambda kind, p: s.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("t0").alias(f"{p[0]}_start"), F.col("t1").alias(f"{p[0]}_stop"))
    p = intervals.overlap_join(side("click", "left"), side("view", "right"), ["user_id"], 12 * HOUR)
    shorter = F.least(F.col("l_stop") - F.col("l_start"), F.col("r_stop") - F.col("r_start"))
    return p.select("user_id", "left_id", "right_id", "overlap", (F.col("overlap") / shorter).alias("ratio"))


@query(f"WITH {PAIRS} SELECT user_id, left_id, right_id, overlap::BIGINT AS overlap, round(ratio, 6) AS ratio FROM p")
def q20_interval_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH RECURSIVE {PAIRS},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY overlap DESC, left_id, right_id) AS k FROM p),
walk AS (
  SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS ls, []::BIGINT[] AS rs FROM r GROUP BY user_id
  UNION ALL
  SELECT w.user_id, r.k, CASE WHEN list_contains(ls, left_id) OR list_contains(rs, right_id) THEN ls ELSE list_append(ls, left_id) END,
    CASE WHEN list_contains(ls, left_id) OR list_contains(rs, right_id) THEN rs ELSE list_append(rs, right_id) END
  FROM walk w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1),
done AS (SELECT user_id, arg_max(ls, k) AS ls, arg_max(rs, k) AS rs FROM walk GROUP BY 1),
u AS (SELECT user_id, unnest(ls) AS left_id, unnest(rs) AS right_id FROM done)
SELECT user_id, left_id, right_id, p.overlap::BIGINT AS overlap FROM u JOIN p USING (user_id, left_id, right_id)""")
def q21_greedy_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).select("user_id", "left_id", "right_id", "overlap", F.struct((-F.col("overlap")).alias("o"), "left_id", "right_id").alias("place"))
    return matching.greedy(p, ["user_id"], "left_id", "right_id", "place").select("user_id", "left_id", "right_id", "overlap")


@query("""WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), v AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
n AS (SELECT c.user_id, c.event_id, c.t, v.id AS nearest_id, abs(v.t - c.t) AS distance FROM c JOIN v USING (user_id))
SELECT user_id, event_id, t, nearest_id, distance::BIGINT AS distance FROM n QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY distance, nearest_id) = 1""")
def q22_nearest_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return intervals.nearest(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "t", "event_id", "t", "event_id")


@query("""SELECT 'orders.o_custkey' AS rule, count(*)::BIGINT AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem.l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'lineitem.key', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'customer without orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def q23_referential_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "part")}
    known = lambda name, key, flag: t[name].select(F.col(key), F.lit(True).alias(flag)).distinct()
    lines = t["lineitem"].select("l_orderkey", "l_partkey").join(known("orders", "o_orderkey", "_o"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    lines = lines.join(known("part", "p_partkey", "_p"), F.col("l_partkey") == F.col("p_partkey"), "left")
    counts = lines.agg(F.count_if(F.col("_o").isNull()).alias("o"), F.count_if(F.col("_p").isNull()).alias("p"))  # both from one scan of the lines
    rule = lambda name, n: F.struct(F.lit(name).alias("rule"), F.col(n).alias("n"))
    out = counts.select(F.explode(F.array(rule("lineitem.l_orderkey", "o"), rule("lineitem.l_partkey", "p"))).alias("x")).select("x.*")
    audits = [
        ("orders.o_custkey", t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        ("lineitem.key", t["lineitem"].groupBy("l_orderkey", "l_linenumber").count().where("count > 1")),
        ("customer without orders", t["customer"].join(t["orders"], F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
    ]
    for name, rows in audits:
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n"))
    return out


@query("""SELECT o_custkey AS custkey, arg_max(o_orderkey, (o_totalprice, o_orderdate, o_orderkey)) AS best_order, max(o_totalprice) AS best_price, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def q24_best_capture_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderdate", "o_orderkey")).alias("best_order"), F.max("o_totalprice").alias("best_price"), F.count("*").alias("n")
    )
