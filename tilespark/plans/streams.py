"""Streaming queries over events as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table
from ..streaming import windows as W
from .registry import query


def events(spark: SparkSession, sf_dir: str, files: int | None = 64) -> DataFrame:
    ship(spark)
    schema = table(spark, sf_dir, "events").schema
    # a pattern, as a stream's path may be a folder or a single file
    rows = W.stream(spark, f"{sf_dir}/event[s].parquet", schema, files).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", "ts", "user_id", "event_type", "value")


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS begins, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = W.windowed(events(spark, sf_dir).withWatermark("ts", "1 hour"), "ts", F.window("ts", "1 hour"), ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return W.run_available(sums.select(_stamp("w.start").alias("begins"), "event_type", "n", "total"), "complete")


@query("""
    SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS begins, count(*) AS n FROM events, (VALUES (0), (1)) s(k) GROUP BY 1
""")
def s_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = W.windowed(events(spark, sf_dir).withWatermark("ts", "1 hour"), "ts", F.window("ts", "1 hour", "30 minutes"), [], F.count("*").alias("n"))
    return W.run_available(sums.select(_stamp("w.start").alias("begins"), "n"), "complete")


@query("""
    WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS ends, count(*) AS n FROM s GROUP BY user_id, k
""")
def s_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = W.windowed(events(spark, sf_dir).withWatermark("ts", "1 hour"), "ts", F.session_window("ts", "6 hours"), ["user_id"], F.count("*").alias("n"))
    return W.run_available(sums.select("user_id", _stamp("w.start").alias("begins"), _stamp("w.end").alias("ends"), "n"), "complete")


@query("SELECT event_type, count(*) AS n FROM events WHERE value >= 50 GROUP BY 1")
def s_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under a watermark that nothing in one batch is later than."""
    kept = events(spark, sf_dir).withWatermark("ts", "10 minutes").where("value >= 50")
    return W.run_available(kept.groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def s_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = events(spark, sf_dir, files=None).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
    return W.run_available(once, "append")


@query("SELECT c_mktsegment AS segment, event_type, count(*) AS n FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2")
def s_stream_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    joined = events(spark, sf_dir).join(customers, "user_id")
    return W.run_available(joined.groupBy("segment", "event_type").agg(F.count("*").alias("n")), "complete")


@query("""
    WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) / 1e6 AS t FROM events),
    f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(2.0 AS DOUBLE) AS tokens, CAST(NULL AS DOUBLE) AS seen, CAST(0 AS BIGINT) AS granted, CAST(0 AS BIGINT) AS denied FROM events
          UNION ALL
          SELECT user_id, k, CASE WHEN have >= 1 THEN have - 1 ELSE have END, t, granted + CASE WHEN have >= 1 THEN 1 ELSE 0 END, denied + CASE WHEN have >= 1 THEN 0 ELSE 1 END
          FROM (SELECT f.user_id, o.k, o.t, granted, denied, CASE WHEN seen IS NULL THEN tokens ELSE least(CAST(2.0 AS DOUBLE), tokens + CAST(2.0 AS DOUBLE) / 86400 * (o.t - seen)) END AS have FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1))
    SELECT user_id, granted, denied FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1
""")
def s_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests granted and denied for each user by a bucket that refills twice a day."""
    timed = events(spark, sf_dir, files=None).select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return W.run_available(W.bucket_stream(timed, 2.0, 2 / 86_400), "update", ["user_id"])


@query("""
    WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
                                CASE WHEN event_type <> 'error' THEN 'OK' WHEN event_id % 3 = 0 THEN 'RATE_LIMITED' ELSE 'PARSE' END AS x FROM events),
    f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 4 AS c, CAST(2.0 AS DOUBLE) AS r, 0 AS s FROM events
          UNION ALL SELECT f.user_id, o.k, CASE WHEN x = 'OK' AND s + 1 >= 5 THEN least(8, c + 1) WHEN x = 'RATE_LIMITED' THEN greatest(1, c // 2) ELSE c END,
                           CASE WHEN x = 'RATE_LIMITED' THEN greatest(0.1, r / 2) ELSE r END, CASE WHEN x <> 'OK' OR s + 1 >= 5 THEN 0 ELSE s + 1 END
                    FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
    SELECT user_id, CAST(c AS BIGINT) AS concurrency, r AS refill, CAST(s AS BIGINT) AS streak FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1
""")
def s_aimd(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") != "error", "OK").when(F.col("event_id") % 3 == 0, "RATE_LIMITED").otherwise("PARSE")
    timed = events(spark, sf_dir, files=None).select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("t"), kind.alias("x"))
    return W.run_available(W.control_stream(timed, 5), "update", ["user_id"])
