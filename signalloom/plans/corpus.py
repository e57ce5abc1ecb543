"""Queries over documents and records: canonical rows, labels, scans and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.functions import scalar
from signalloom.operators import lifecycle
from signalloom.sources.tables import events, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH d AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS digest FROM documents)
SELECT digest, count(*)::BIGINT AS n_copies, min(doc_id) AS canonical_id, count(DISTINCT source)::BIGINT AS n_sources FROM d GROUP BY 1""")
def q25_canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("canonical_id"), F.count_distinct("source").alias("n_sources"))


@query("""WITH d AS (SELECT sha256(coalesce(text, '')) AS digest, toxic, quality FROM documents JOIN labels USING (doc_id))
SELECT digest, count(*)::BIGINT AS n, CASE WHEN count(DISTINCT toxic) > 1 THEN 'toxic' ELSE 'quality' END AS reason FROM d GROUP BY 1 HAVING count(DISTINCT toxic) > 1 OR count(DISTINCT quality) > 1""")
def q26_conflict_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).join(table(spark, sf_dir, "labels"), "doc_id")
    g = d.groupBy("digest").agg(F.count("*").alias("n"), (F.min("toxic") != F.max("toxic")).alias("t"), (F.min("quality") != F.max("quality")).alias("q"))
    return g.where("t or q").select("digest", "n", F.when(F.col("t"), "toxic").otherwise("quality").alias("reason"))


@query(r"""SELECT p_partkey, nullif(trim(regexp_replace(lower(regexp_replace(p_type || ' ' || p_name, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_'), '') AS label,
  substr(trim(regexp_replace(lower(regexp_replace(f, '([^/])\.[^./]*$', '\1')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80) || '-' || substr(sha256(f), 1, 8) AS slug FROM (SELECT *, p_brand || '/' || p_name || '.wav' AS f FROM part)""")
def q27_label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", scalar.label(F.concat_ws(" ", "p_type", "p_name")).alias("label"), scalar.slug(F.concat("p_brand", F.lit("/"), "p_name", F.lit(".wav"))).alias("slug"))


@query(r"""WITH n AS (SELECT p_partkey, '_' || trim(regexp_replace(lower(p_brand || ' ' || p_name || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') || '_' AS name FROM part),
v AS (SELECT DISTINCT trim(regexp_replace(lower(w), '[^a-z0-9]+', '_', 'g'), '_') AS label FROM (SELECT p_name AS w FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part)),
m AS (SELECT p_partkey, label FROM n JOIN v ON contains(name, '_' || label || '_') WHERE label <> '')
SELECT p_partkey, label FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.p_partkey = m.p_partkey AND o.label <> m.label AND contains('_' || o.label || '_', '_' || m.label || '_'))""")
def q28_vocabulary_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("w"))
    v = p.select(F.col("p_name").alias("w")).unionByName(p.select(F.col("p_type").alias("w"))).unionByName(words)
    return lifecycle.contained_labels(p.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("name")), "p_partkey", "name", v, "w")


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path,
  regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS last_number FROM pages""")
def q29_url_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda r, name: F.regexp_extract("url", r, 1).alias(name)
    return table(spark, sf_dir, "pages").select("page_id", part("^[a-z]+://([^/]+)", "host"), part("^[a-z]+://[^/]+(/[^?#]*)", "path"), part("([0-9]+)[^0-9]*$", "last_number"))


@query("""SELECT event_type, TRY_CAST(props->>'k' AS BIGINT) AS k, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL""")
def q30_json_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), "value")
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


SENSITIVE = {"email": "[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][a-z]+", "address": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "token": "(secret|token|password|api_key)[ ]*[=:]"}


@query("WITH d AS (SELECT 'documents' AS origin, doc_id AS id, text AS body FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages) SELECT origin, id, "
       + ", ".join(f"regexp_matches(body, '{r}') AS {k}" for k, r in SENSITIVE.items()) + " FROM d WHERE " + " OR ".join(f"regexp_matches(body, '{r}')" for r in SENSITIVE.values()))
def q31_sensitive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda name, key, body: table(spark, sf_dir, name).select(F.lit(name).alias("origin"), F.col(key).alias("id"), F.col(body).alias("body"))
    d = side("documents", "doc_id", "text").unionByName(side("pages", "page_id", "html"))
    return d.select("origin", "id", *[F.col("body").rlike(r).alias(k) for k, r in SENSITIVE.items()]).where(scalar.any_of(*[F.col(k) for k in SENSITIVE]))


RULES = {
    "orders": {"price positive": "o_totalprice > 0", "status known": "o_orderstatus IN ('F', 'O')", "priority given": "o_orderpriority IS NOT NULL"},
    "lineitem": {"discount below one": "l_discount BETWEEN 0 AND 0.09", "quantity whole": "l_quantity = floor(l_quantity)", "tax low": "l_tax <= 0.07"},
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS origin, '{k}' AS rule, count(*) FILTER (NOT coalesce({r}, false))::BIGINT AS n_violations FROM {t}" for t, rules in RULES.items() for k, r in rules.items()))
def q32_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over each table counts all its violations."""
    out = None
    for name, rules in RULES.items():
        counts = table(spark, sf_dir, name).agg(*[F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(k) for k, r in rules.items()])
        one = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("origin"), F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n_violations")) for k in rules])).alias("x")).select("x.*")
        out = one if out is None else out.unionByName(one)
    return out


def _canon(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns)


@query(f"SELECT o_orderkey, 'order_' || substr(sha256({_canon('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority')}), 1, 16) AS content_id FROM orders")
def q33_content_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.content_id("order", *cols).alias("content_id"))


@query("""WITH l AS (SELECT doc_id, lang AS label, 'lang' AS layer FROM documents UNION ALL SELECT doc_id, CASE WHEN regexp_matches(text, '[éèçê]') THEN 'fr' WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[ñáíóú]') THEN 'es' ELSE 'en' END, 'letters' FROM documents
  UNION ALL SELECT d.doc_id, CASE WHEN quality = 1 THEN d.lang ELSE 'low' END, 'quality' FROM documents d JOIN labels USING (doc_id)),
p AS (SELECT a.doc_id, count(*) AS n, count(*) FILTER (a.label = b.label) AS same FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.layer < b.layer GROUP BY 1)
SELECT CASE WHEN same = n THEN 'consistent' WHEN same = 0 THEN 'divergent' ELSE 'mixed' END AS status, n::BIGINT AS n_comparisons, count(*)::BIGINT AS n_documents FROM p GROUP BY ALL""")
def q50_layer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    letters = F.when(F.col("text").rlike("[éèçê]"), "fr").when(F.col("text").rlike("[äöüß]"), "de").when(F.col("text").rlike("[ñáíóú]"), "es").otherwise("en")
    quality = d.select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("lang")).otherwise("low").alias("label"), F.lit("quality").alias("layer"))
    layers = d.select("doc_id", F.col("lang").alias("label"), F.lit("lang").alias("layer")).unionByName(d.select("doc_id", letters.alias("label"), F.lit("letters").alias("layer"))).unionByName(quality)
    pairs = layers.alias("a").join(layers.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.layer") < F.col("b.layer")))
    p = pairs.groupBy("a.doc_id").agg(F.count("*").alias("n_comparisons"), F.count_if(F.col("a.label") == F.col("b.label")).alias("same"))
    status = F.when(F.col("same") == F.col("n_comparisons"), "consistent").when(F.col("same") == 0, "divergent").otherwise("mixed")
    return p.groupBy(status.alias("status"), "n_comparisons").agg(F.count("*").alias("n_documents"))
