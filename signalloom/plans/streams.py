"""Event tables read as streams to their end, beside the SQL of their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators.matching import shared_folder
from signalloom.plans.signals import HOUR
from signalloom.sources.tables import events
from signalloom.streaming import timelines

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ran(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gave by its end, from a table in the shared folder."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    timelines.run_to_end(stream, f"{at}/checkpoint", path=f"{at}/rows", mode=mode)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


@query(f"""WITH e AS (SELECT event_type, epoch_us(ts) AS t, value FROM events), w AS (SELECT event_type, value, unnest(range((t - {6 * HOUR}) // {3 * HOUR} + 1, t // {3 * HOUR} + 1)) * {3 * HOUR} AS a FROM e)
SELECT event_type, a::BIGINT AS window_start, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS sd_value FROM w WHERE a + {6 * HOUR} <= (SELECT max(t) FROM e) GROUP BY ALL""")
def s01_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows every three hours that were over by the latest event; windows still open stay in the state."""
    w = timelines.hopping(timelines.event_stream(spark, f"{sf_dir}/events.parquet*"), ["event_type"], "6 hours", "3 hours", "0 seconds")
    return _ran(spark, w).select("event_type", F.unix_micros("window_start").alias("window_start"), "n", F.round("mean_value", 6).alias("mean_value"), F.round("sd_value", 6).alias("sd_value"))


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), c AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < {6 * HOUR} THEN 0 ELSE 1 END AS f FROM e),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM c), g AS (SELECT user_id, min(t)::BIGINT AS start, (max(t) + {6 * HOUR})::BIGINT AS stop, count(*)::BIGINT AS n FROM s GROUP BY user_id, k)
SELECT * FROM g WHERE stop <= (SELECT max(t) FROM e)""")
def s02_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events less than six hours apart that were over by the latest event."""
    s = timelines.sessions(timelines.event_stream(spark, f"{sf_dir}/events.parquet*"), ["user_id"], "6 hours", "0 seconds")
    return _ran(spark, s).select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


@query()
def s03_stream_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values of each type linked to tracks with state; tests hold it against the batch."""
    day = F.floor(F.col("t") / (24 * HOUR)).cast("bigint")
    e = events(spark, sf_dir).groupBy("event_type", day.alias("window_index")).agg(F.sort_array(F.collect_list("value")).alias("frequencies"))
    at = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    e.write.parquet(at)
    return _ran(spark, timelines.tracks(spark.readStream.schema(e.schema).parquet(at), ["event_type"], 3.0, 2))
