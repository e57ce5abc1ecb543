"""Queries over event timelines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.operators import stats, windows
from signalloom.sources.tables import events

HOUR, DAY = 3_600_000_000, 86_400_000_000
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EV = "SELECT *, epoch_us(ts) AS t FROM events"
HOPS = f"""
e AS ({EV}), span AS (SELECT min(t) AS lo, max(t) AS hi FROM e),
w AS (SELECT e.*, unnest(range((t - {6 * HOUR}) // {3 * HOUR} + 1, t // {3 * HOUR} + 1)) AS k FROM e),
hop AS (SELECT w.*, k * {3 * HOUR} AS window_start, k * {3 * HOUR} + {6 * HOUR} AS window_end FROM w, span
  WHERE k * {3 * HOUR} >= lo AND k * {3 * HOUR} + {6 * HOUR} <= hi)"""


def _hops(spark, sf_dir):
    return windows.hopping(events(spark, sf_dir), "t", 6 * HOUR, 3 * HOUR)


@query(f"""WITH {HOPS} SELECT event_type, window_start, window_end, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value,
  round(stddev_pop(value), 6) AS sd_value FROM hop GROUP BY ALL""")
def q01_hop_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _hops(spark, sf_dir).groupBy("event_type", "window_start", "window_end")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_pop("value"), 6).alias("sd_value"))


@query(f"""WITH {HOPS}, q AS (SELECT window_start, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95 FROM hop GROUP BY 1)
SELECT window_start, round(p5, 6) AS p5, round(p95, 6) AS p95,
  round(CASE WHEN p5 + p95 > 0 THEN greatest(0.0, least(1.0, (p95 - p5) / (p95 + p5))) ELSE 0 END, 4)::DOUBLE AS depth FROM q""")
def q02_window_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _hops(spark, sf_dir).groupBy("window_start").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("p"))
    low, high = F.col("p")[0], F.col("p")[1]
    return q.select("window_start", F.round(low, 6).alias("p5"), F.round(high, 6).alias("p95"), F.round(stats.depth(low, high), 4).alias("depth"))


@query(f"""WITH e AS ({EV}) SELECT t // {HOUR} AS frame, count(*)::BIGINT AS n, round(sqrt(avg(value * value)), 6) AS rms,
  max(abs(value)) AS peak FROM e GROUP BY 1""")
def q03_rms_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).groupBy(windows.tumbling("t", HOUR).alias("frame"))
    return g.agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("value") ** 2)), 6).alias("rms"), F.max(F.abs("value")).alias("peak"))


RUNS = f"""
e AS (SELECT x.*, value > m AS state FROM ({EV}) x JOIN (SELECT user_id, median(value) AS m FROM events GROUP BY 1) USING (user_id)),
c AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS run_id FROM c),
b AS (SELECT user_id, run_id, state, min(t) AS start, max(t) AS stop, count(*)::BIGINT AS n_rows FROM r GROUP BY ALL)"""


def _runs(spark, sf_dir):
    e = events(spark, sf_dir)
    mid = e.groupBy("user_id").agg(F.median("value").alias("m"))
    return windows.runs(e.join(mid, "user_id"), ["user_id"], ["t", "event_id"], F.col("value") > F.col("m"))


@query(f"WITH {RUNS} SELECT * FROM b")
def q04_state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_bounds(_runs(spark, sf_dir), ["user_id"], "t")


@query(f"""WITH {RUNS} SELECT user_id, coalesce(max(n_rows) FILTER (state), 0)::BIGINT AS longest_run, sum(n_rows)::BIGINT AS n,
  round(coalesce(sum(n_rows) FILTER (state), 0) / sum(n_rows), 6)::DOUBLE AS coverage, count(*)::BIGINT AS n_runs FROM b GROUP BY 1""")
def q05_longest_run_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = windows.run_bounds(_runs(spark, sf_dir), ["user_id"], "t")
    on = F.when(F.col("state"), F.col("n_rows"))
    return b.groupBy("user_id").agg(
        F.coalesce(F.max(on), F.lit(0)).cast("bigint").alias("longest_run"), F.sum("n_rows").alias("n"),
        F.round(F.coalesce(F.sum(on), F.lit(0)) / F.sum("n_rows"), 6).alias("coverage"), F.count("*").alias("n_runs"),
    )


@query(f"""WITH e AS ({EV}), l AS (SELECT event_type AS label_to, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS label_from FROM e)
SELECT label_from, label_to, count(*)::BIGINT AS n FROM l WHERE label_from IS NOT NULL GROUP BY ALL""")
def q06_transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.transitions(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type")


@query(f"""WITH e AS ({EV}), g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e),
s AS (SELECT user_id, count(*)::BIGINT AS n_gaps, avg(gap) AS m, stddev_pop(gap) / avg(gap) AS cv FROM g WHERE gap BETWEEN {HOUR} AND {3 * DAY} GROUP BY 1)
SELECT user_id, n_gaps, round(m / {HOUR}, 4) AS mean_hours, round(cv, 6) AS cv, round(greatest(0.0, least(1.0, 1 - cv / 0.8)), 6)::DOUBLE AS regularity FROM s""")
def q07_interval_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = windows.gaps(events(spark, sf_dir), ["user_id"], ["t"], "t").where(F.col("gap").between(HOUR, 3 * DAY))
    cv, regular = stats.regularity("gap", 0.8)
    s = g.groupBy("user_id").agg(F.count("*").alias("n_gaps"), F.avg("gap").alias("m"), cv.alias("cv"), regular.alias("r"))
    return s.select("user_id", "n_gaps", F.round(F.col("m") / HOUR, 4).alias("mean_hours"), F.round("cv", 6).alias("cv"), F.round("r", 6).alias("regularity"))


@query("""WITH c AS (SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL),
r AS (SELECT *, round(n / sum(n) OVER (PARTITION BY user_id), 6)::DOUBLE AS share, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, event_type, n, share FROM r WHERE k = 1""")
def q08_dominant_label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dominant(events(spark, sf_dir), ["user_id"], "event_type").withColumn("share", F.round("share", 6))


@query(f"""WITH e AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / {DAY} AS x, value AS y FROM events),
s AS (SELECT user_id, count(*)::BIGINT AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, sqrt(greatest(0, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x)) / count(*)) AS rmse FROM e GROUP BY 1 HAVING count(*) >= 3)
SELECT user_id, n, round(slope, 5) AS slope, round(r2, 5) AS r2, round(rmse, 5) AS rmse,
  CASE WHEN abs(slope) <= 0.05 THEN 'stable' WHEN r2 < 0.05 THEN 'unsupported' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction FROM s""")
def q09_linear_trend_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("user_id", ((F.col("t") - 1704067200000000) / DAY).alias("x"), F.col("value").alias("y"))
    s = stats.trend(e, ["user_id"], "x", "y").where("n >= 3")
    name = F.when(F.abs("slope") <= 0.05, "stable").when(F.col("r2") < 0.05, "unsupported").when(F.col("slope") > 0, "rising").otherwise("falling")
    return s.select("user_id", "n", F.round("slope", 5).alias("slope"), F.round("r2", 5).alias("r2"), F.round("rmse", 5).alias("rmse"), name.alias("direction"))


@query("""WITH p AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY 1),
s AS (SELECT event_type, (value - lo) / nullif(hi - lo, 0) AS x FROM events JOIN p USING (event_type))
SELECT event_type, round(avg((x >= 0.5)::INT), 6) AS duty, round(avg((x <= 0.15)::INT), 6) AS low, round(avg((x >= 0.85)::INT), 6) AS high FROM s GROUP BY 1""")
def q10_duty_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    p = e.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("p"))
    x = (F.col("value") - F.col("p")[0]) / F.nullif(F.col("p")[1] - F.col("p")[0], F.lit(0.0))  # no share where the levels do not differ
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return e.join(F.broadcast(p), "event_type").withColumn("x", x).groupBy("event_type").agg(share(F.col("x") >= 0.5, "duty"), share(F.col("x") <= 0.15, "low"), share(F.col("x") >= 0.85, "high"))


DAILY = f"d AS (SELECT event_type, epoch_us(ts) // {DAY} AS day, count(*)::DOUBLE AS n, sum(value) AS v FROM events GROUP BY ALL)"


@query(f"""WITH {DAILY}, l AS (SELECT *, unnest(range(-5, 6)) AS lag FROM d),
c AS (SELECT l.event_type, lag, count(*)::BIGINT AS n, CASE WHEN count(*) < 4 THEN 0 ELSE coalesce(round(corr(l.n, d.v), 6), 0) END AS r
  FROM l JOIN d ON l.event_type = d.event_type AND l.day + lag = d.day GROUP BY ALL)
SELECT event_type, lag::BIGINT AS lag, n, r::DOUBLE AS r FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY r DESC, abs(lag), lag) = 1""")
def q11_lagged_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy("event_type", windows.tumbling("t", DAY).alias("day")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    c = stats.lagged_correlation(d, ["event_type"], "day", "n", "v", 5).withColumn("r", F.round("r", 6))
    return windows.top(c, ["event_type"], [F.col("r").desc(), F.abs("lag"), F.col("lag")], 1).select("event_type", F.col("lag").cast("bigint").alias("lag"), "n", "r")


ANGLE = 2 * math.pi / DAY


@query(f"""WITH a AS (SELECT event_type, (epoch_us(ts) % {DAY}) * {ANGLE!r}::DOUBLE AS phi FROM events)
SELECT event_type, count(*)::BIGINT AS n, round(sqrt(pow(avg(cos(phi)), 2) + pow(avg(sin(phi)), 2)), 6) AS locking,
  round(atan2(avg(sin(phi)), avg(cos(phi))), 4) AS mean_angle FROM a GROUP BY 1""")
def q12_phase_locking(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = events(spark, sf_dir).withColumn("phi", F.pmod("t", F.lit(DAY)) * F.lit(ANGLE))
    c, s = F.avg(F.cos("phi")), F.avg(F.sin("phi"))
    return a.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sqrt(c * c + s * s), 6).alias("locking"), F.round(F.atan2(s, c), 4).alias("mean_angle"))


@query(f"""WITH h AS (SELECT epoch_us(ts) // {HOUR} AS hour, count(*)::DOUBLE AS n FROM events GROUP BY 1),
s AS (SELECT min(hour) AS lo, max(hour) - min(hour) + 1 AS size FROM h), m AS (SELECT sum(n) / any_value(size) AS mean FROM h, s),
x AS (SELECT hour - lo AS i, size, (n - mean) * (0.5 - 0.5 * cos({2 * math.pi!r}::DOUBLE * (hour - lo) / size)) AS y FROM h, s, m),
f AS (SELECT *, unnest(range(1, size // 2 + 1)) AS k FROM x),
p AS (SELECT k, sqrt(pow(sum(y * cos({2 * math.pi!r}::DOUBLE * k * i / size)), 2) + pow(sum(y * sin({2 * math.pi!r}::DOUBLE * k * i / size)), 2)) AS magnitude FROM f GROUP BY k),
q AS (SELECT k, magnitude, lag(magnitude) OVER (ORDER BY k) AS l, lead(magnitude) OVER (ORDER BY k) AS r, max(magnitude) OVER () AS top FROM p)
SELECT k::BIGINT AS k, round(magnitude / top, 5) AS magnitude FROM q WHERE magnitude > l AND magnitude > r ORDER BY magnitude DESC, k LIMIT 10""")
def q13_dft_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest peaks of a Hann-weighted Fourier sum of hourly counts, over all bins: a report of ten rows by its nature."""
    h = events(spark, sf_dir).groupBy(windows.tumbling("t", HOUR).alias("hour")).agg(F.count("*").cast("double").alias("n"))
    s = h.agg(F.min("hour").alias("lo"), (F.max("hour") - F.min("hour") + 1).alias("size"), F.sum("n").alias("total"))
    i = F.col("hour") - F.col("lo")
    y = (F.col("n") - F.col("total") / F.col("size")) * (0.5 - 0.5 * F.cos(2 * math.pi * i / F.col("size")))
    x = h.join(F.broadcast(s)).select(i.alias("i"), "size", y.alias("y")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("size") / 2))))
    turn = 2 * math.pi * F.col("k") * F.col("i") / F.col("size")
    p = x.groupBy("k").agg(F.sqrt(F.sum(F.col("y") * F.cos(turn)) ** 2 + F.sum(F.col("y") * F.sin(turn)) ** 2).alias("magnitude"))
    w = Window.orderBy("k")  # one row for each bin
    q = p.withColumn("l", F.lag("magnitude").over(w)).withColumn("r", F.lead("magnitude").over(w)).withColumn("top", F.max("magnitude").over(Window.partitionBy()))
    q = q.where("magnitude > l and magnitude > r").orderBy(F.desc("magnitude"), "k").limit(10)
    return q.select(F.col("k").cast("bigint").alias("k"), F.round(F.col("magnitude") / F.col("top"), 5).alias("magnitude"))


@query(f"""WITH e AS ({EV}) SELECT event_id, round(avg(value) OVER w, 6) AS trend, round(value - avg(value) OVER w, 6) AS residual FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def q14_moving_average_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.detrended(events(spark, sf_dir), ["user_id"], ["t", "event_id"], "value", 2)
    return d.select("event_id", F.round("trend", 6).alias("trend"), F.round("residual", 6).alias("residual"))
