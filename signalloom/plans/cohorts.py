"""Queries over cohorts, features and vectors, and tolerance-based agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators import agreement, claims, cohorts, stats, windows
from signalloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH j AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), ra AS (SELECT a, sum(n) AS m, max(n) AS top FROM j GROUP BY 1), cb AS (SELECT b, sum(n) AS m FROM j GROUP BY 1),
t AS (SELECT sum(n) AS n FROM j), full_j AS (SELECT ra.a, cb.b, ra.m AS r, cb.m AS c, coalesce(j.n, 0) AS n FROM ra CROSS JOIN cb LEFT JOIN j ON j.a = ra.a AND j.b = cb.b),
x AS (SELECT sum(pow(f.n - r * c / t.n, 2) / (r * c / t.n)) AS chi2, sum(CASE WHEN f.n > 0 THEN f.n / t.n * ln(f.n * t.n / (r * c)) ELSE 0 END) AS mi FROM full_j f, t),
h AS (SELECT (SELECT -sum(m / n * ln(m / n)) FROM ra, t) AS ha, (SELECT -sum(m / n * ln(m / n)) FROM cb, t) AS hb)
SELECT t.n::BIGINT AS n, (SELECT count(*) FROM ra)::BIGINT AS n_rows, (SELECT count(*) FROM cb)::BIGINT AS n_columns, round(chi2, 4) AS chi2,
  round(sqrt(chi2 / (t.n * (least((SELECT count(*) FROM ra), (SELECT count(*) FROM cb)) - 1))), 6) AS cramers_v, round(mi / sqrt(ha * hb), 6) AS nmi,
  round((SELECT sum(top) FROM ra) / t.n, 6) AS consistency, round((SELECT max(m) FROM cb) / t.n, 6) AS majority FROM x, t, h""")
def q34_categorical_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = stats.association(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").withColumn("chi2", F.round("chi2", 4))
    return one.select("n", "n_rows", "n_columns", "chi2", *[F.round(c, 6).alias(c) for c in ("cramers_v", "nmi", "consistency", "majority")])


PROFILE = """j AS (SELECT p_brand, p_type, count(*)::BIGINT AS n_joint FROM part GROUP BY ALL),
p AS (SELECT *, (sum(n_joint) OVER (PARTITION BY p_brand))::BIGINT AS n_cohort, (sum(n_joint) OVER (PARTITION BY p_type))::BIGINT AS n_family, (sum(n_joint) OVER ())::BIGINT AS n_total FROM j)"""


@query(f"""WITH {PROFILE} SELECT p_brand, p_type, n_joint, n_cohort, n_family, round(n_joint / n_cohort, 6) AS share, round(n_family / n_total, 6) AS baseline,
  round((n_joint / n_cohort) / (n_family / n_total), 6) AS lift FROM p""")
def q35_cohort_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cohorts.profiles(table(spark, sf_dir, "part"), "p_brand", "p_type")
    return p.select("p_brand", "p_type", "n_joint", "n_cohort", "n_family", *[F.round(c, 6).alias(c) for c in ("share", "baseline", "lift")])


@query(f"""WITH {PROFILE}, s AS (SELECT p_brand, p_type, (n_joint - 1) / (n_cohort - 1) AS o, (n_family - 1) / (n_total - 1) AS b FROM p WHERE n_cohort >= 3)
SELECT p_partkey, round(o, 6) AS peer_support, round(b, 6) AS baseline, round(CASE WHEN b > 0 THEN o / b END, 6) AS lift,
  round(CASE WHEN o >= b THEN CASE WHEN b < 1 THEN (o - b) / (1 - b) ELSE 0 END ELSE CASE WHEN b > 0 THEN (o - b) / b ELSE 0 END END, 6) AS excess FROM part JOIN s USING (p_brand, p_type)""")
def q36_leave_one_out_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cohorts.leave_one_out(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_type")
    return s.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("peer_support", "baseline", "lift", "excess")])


@query("""WITH f AS (SELECT c_custkey, ln(1 + greatest(c_acctbal, 0)) AS bal, ln(1 + greatest(s, 0)) AS spent FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey),
q AS (SELECT quantile_cont(bal, 0.25) AS b1, median(bal) AS b2, quantile_cont(bal, 0.75) AS b3, quantile_cont(spent, 0.25) AS s1, median(spent) AS s2, quantile_cont(spent, 0.75) AS s3 FROM f WHERE true)
SELECT c_custkey, round(greatest(-5, least(5, (bal - b2) / (b3 - b1))), 5)::DOUBLE AS c_acctbal, (bal IS NULL)::INT AS c_acctbal__missing,
  round(greatest(-5, least(5, (coalesce(spent, s2) - s2) / (s3 - s1))), 5)::DOUBLE AS spent, (spent IS NULL)::INT AS spent__missing FROM f, q""")
def q37_robust_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    f = cohorts.robust(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(spent, "c_custkey", "left"), "c_custkey", ["c_acctbal", "spent"])
    return f.withColumn("c_acctbal", F.round("c_acctbal", 5)).withColumn("spent", F.round("spent", 5))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"coalesce((c_mktsegment = '{s}')::INT, 0) AS c_mktsegment__{s.lower()}" for s in SEGMENTS) + " FROM customer")
def q38_one_hot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return cohorts.one_hot(c, "c_custkey", "c_mktsegment", cohorts.levels_of(c, "c_mktsegment"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(pow(list_distance(a.v, b.v), 2)) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
i AS (SELECT vec_id, label, s / nullif(n - 1, 0) AS intra FROM d WHERE label = other), o AS (SELECT vec_id, min(s / n) AS nearest FROM d WHERE label <> other GROUP BY 1)
SELECT vec_id, label, round(intra, 5) AS intra, round(nearest, 5) AS nearest, round(CASE WHEN intra IS NULL OR nearest IS NULL OR greatest(intra, nearest) <= 0 THEN 0 ELSE (nearest - intra) / greatest(intra, nearest) END, 5)::DOUBLE AS silhouette FROM i JOIN o USING (vec_id)""")
def q39_silhouette_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    s = cohorts.silhouette(e, "vec_id", "embedding", "label", cohorts.width_of(e, "embedding"))
    return s.select("vec_id", "label", *[F.round(c, 5).alias(c) for c in ("intra", "nearest", "silhouette")])


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, d, avg(x) AS m FROM x GROUP BY ALL),
r AS (SELECT x.vec_id, x.label, round(sqrt(sum(pow(x - m, 2))), 5) AS distance FROM x JOIN c ON x.label = c.label AND x.d = c.d GROUP BY ALL)
SELECT label, vec_id, distance, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id)::INT AS rank FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) <= 3""")
def q40_centroid_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rows nearest to each centroid: representatives are a top-k by their nature."""
    e = table(spark, sf_dir, "embeddings")
    c = cohorts.centroids(e, "embedding", "label", cohorts.width_of(e, "embedding")).select("label", "centre")
    apart = F.zip_with("embedding", "centre", lambda x, m: x.cast("double") - m)
    rows = e.join(F.broadcast(c), "label").withColumn("distance", F.round(F.sqrt(cohorts.dot(apart, apart)), 5))
    return windows.top(rows, ["label"], [F.col("distance"), F.col("vec_id")], 3).select("label", "vec_id", "distance", "rank")


CLAIMS = """o AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS observed, count(*)::BIGINT AS n FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, o_custkey, o_totalprice AS target, observed, n, abs(observed - o_totalprice) / greatest(abs(o_totalprice), 1.0) AS error FROM orders LEFT JOIN o ON l_orderkey = o_orderkey),
v AS (SELECT *, CASE WHEN target IS NULL OR target <= 0 THEN 'invalid' WHEN observed IS NULL THEN 'not_evaluated' WHEN n < 2 THEN 'unsupported' WHEN error <= 0.5 THEN 'agree' ELSE 'disagree' END AS result FROM c)"""


def _claims(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(net).alias("observed"), F.count("*").alias("n"))
    c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("target")).join(o, "o_orderkey", "left")
    valid = F.coalesce(F.col("target") > 0, F.lit(False))
    return c.withColumn("result", agreement.verdict(valid, F.col("observed"), F.col("n") >= 2, agreement.within_relative(F.col("observed"), F.col("target"), 0.5, 1.0)))


@query(f"WITH {CLAIMS} SELECT o_orderkey, result, coalesce(n, 0)::BIGINT AS n FROM v")
def q48_claim_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("o_orderkey", "result", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query(f"""WITH {CLAIMS} SELECT o_custkey, count(*)::BIGINT AS n_claims, count(*) FILTER (result = 'agree')::BIGINT AS n_agree,
  CASE WHEN bool_and(result = 'agree') THEN 'verified' WHEN bool_or(result = 'agree') AND NOT bool_or(result IN ('disagree', 'invalid')) THEN 'partially_verified' ELSE 'exploratory' END AS label FROM v GROUP BY 1""")
def q49_agreement_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.rollup(_claims(spark, sf_dir), ["o_custkey"])


FULL = """o AS (SELECT l_orderkey, sum(l_extendedprice) AS value, least(1.0, count(*) / 4)::DOUBLE AS coverage FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 <> 0 AS required, o_totalprice AS target, CASE o_orderkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'absolute' WHEN 2 THEN 'relative' WHEN 3 THEN 'absolute_or_relative' ELSE 'curve_fit' END AS cmp, value, coverage,
  abs(value - o_totalprice) AS e FROM orders LEFT JOIN o ON l_orderkey = o_orderkey),
j AS (SELECT *, CASE WHEN cmp = 'curve_fit' THEN 'invalid_declaration' WHEN value IS NULL OR coverage < 0.5 THEN 'unsupported' WHEN (CASE cmp WHEN 'exact' THEN value = target WHEN 'absolute' THEN e <= 50000
  WHEN 'relative' THEN e / greatest(abs(target), 1.0) <= 0.5 ELSE e <= 50000 OR e / greatest(abs(target), 1.0) <= 0.5 END) THEN 'agree' ELSE 'disagree' END AS state FROM c)"""


def _judged(spark, sf_dir):
    """A claim on the total of every order, with comparisons of all kinds, against what its lines say."""
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    kinds = F.array(*[F.lit(k) for k in ("exact", "absolute", "relative", "absolute_or_relative", "curve_fit")])
    number = F.lit(None).cast("double")
    scope = lambda key: [F.lit("total").alias("evidence_type"), F.concat(F.lit("order "), F.col(key).cast("string")).alias("metric"), F.lit("money").alias("unit"), F.lit("orders").alias("modality"), none.alias("channels"), none.alias("regions")]
    o = table(spark, sf_dir, "orders")
    c = o.select(
        F.col("o_orderkey").alias("claim_id"), "o_custkey", (F.col("o_orderkey") % 3 != 0).alias("required"), *scope("o_orderkey"), *[number.alias(n) for n in ("t0", "t1", "low", "high", "v0", "v1", "margin", "least_confidence")],
        F.lit("scalar").alias("kind"), F.col("o_totalprice").alias("target"), text.alias("target_text"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("comparison"), F.lit(50000.0).alias("most_absolute"),
        F.lit(0.5).alias("most_relative"), F.lit(1.0).alias("floor"), F.lit(0.5).alias("least_coverage"),
    )
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("value"), F.least(F.lit(1.0), F.count("*") / 4).alias("coverage"))
    s = g.select(F.col("l_orderkey").cast("string").alias("observation_id"), *scope("l_orderkey"), number.alias("t0"), number.alias("t1"), F.lit("scalar").alias("kind"), "value", text.alias("value_text"), "coverage", F.lit(1.0).alias("confidence"), none.alias("evidence_ids"))
    return claims.judged(c, s)


@query(f"WITH {FULL} SELECT o_orderkey AS claim_id, state FROM j")
def q56_claim_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("claim_id", "state")


@query(f"""WITH {FULL} SELECT o_custkey, CASE WHEN count(*) FILTER (required) > 0 AND bool_and(state = 'agree') FILTER (required) THEN 'verified'
  WHEN count(*) FILTER (required AND state = 'agree') > 0 AND count(*) FILTER (required AND state IN ('disagree', 'invalid_declaration')) = 0 THEN 'partially_verified' ELSE 'exploratory' END AS label, count(*)::BIGINT AS n_claims,
  {", ".join(f"count(*) FILTER (state = '{s}')::BIGINT AS n_{s}" for s in ("agree", "disagree", "unsupported", "not_evaluated", "invalid_declaration"))} FROM j GROUP BY 1""")
def q57_demo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.report(_judged(spark, sf_dir), ["o_custkey"])
