"""Queries of the quality suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..operators import coverage as C
from ..operators import quality as Q
from ..session import table
from . import coverage as P
from .registry import query

_OBSERVED = f"(SELECT CAST(sum(least(n, {P.CAP})) AS BIGINT) FROM every WHERE status IN ('LEAF_DONE', 'LEAF_DONE_SECONDARY', 'GAP'))"
_S8 = """
    SELECT count(*) AS total, count(*) FILTER (WHERE l_shipdate < o_orderdate OR l_shipdate > o_orderdate + INTERVAL 900 DAY) AS outside, count(*) FILTER (WHERE l_shipdate > (SELECT max(o_orderdate) FROM orders) + INTERVAL 1 DAY) AS future
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
_S9 = "SELECT count(*) AS total, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS without FROM orders WHERE o_orderstatus = 'F'"
_S10 = "SELECT count(*) FILTER (WHERE page_id % 5 <> 0) AS stored, count(*) FILTER (WHERE page_id % 5 <> 0 AND (url IS NULL OR html IS NULL OR strlen(html) < 1024)) AS broken FROM pages"


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    nodes = C.coverage(events, P.event_day(), F.col("event_type"), P.CAP).where("status in ('LEAF_DONE', 'LEAF_DONE_SECONDARY', 'GAP')")
    seen = nodes.agg(F.sum(F.least(F.col("n"), F.lit(P.CAP))).alias("observed"))
    return seen.join(events.agg(F.count("event_id").alias("stored")))


@query(f"WITH RECURSIVE {P._TREE}, {P._CHILDREN} SELECT {_OBSERVED} AS observed, (SELECT count(*) FROM events) AS stored, {_OBSERVED} >= (SELECT count(*) FROM events) AS ok")
def q_s3_observed_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir).withColumn("ok", F.col("observed") >= F.col("stored"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("ship"))
    last = orders.agg(F.date_add(F.max("day"), 1).alias("as_of"))
    outside = (F.col("ship") < F.col("day")) | (F.col("ship") > F.date_add("day", 900))
    return lines.join(orders, "k").join(F.broadcast(last)).agg(F.count("*").alias("total"), F.count_if(outside).alias("outside"), F.count_if(F.col("ship") > F.col("as_of")).alias("future"))


@query(_S8)
def q_s8_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dates(spark, sf_dir)


def childless(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return Q.without_children(done, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@query(_S9)
def q_s9_no_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return childless(spark, sf_dir)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.col("page_id") % 5 != 0
    broken = F.col("url").isNull() | F.col("html").isNull() | (F.octet_length("html") < Q.MIN_BLOB)
    return table(spark, sf_dir, "pages").agg(F.count_if(stored).alias("stored"), F.count_if(stored & broken).alias("broken"))


@query(_S10)
def q_s10_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs(spark, sf_dir)


@query(f"""
    WITH RECURSIVE {P._TREE}, {P._CHILDREN}, {P._LEAVES}, {P._VIOLATIONS},
    num AS (SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS malformed, count(*) FILTER (WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 AND good <> '00') AS wrong
            FROM (SELECT o_orderkey, lpad(CAST(98 - CAST(lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || year(o_orderdate) || '405' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '00' AS HUGEINT) % 97 AS VARCHAR), 2, '0') AS good FROM orders)),
    nul AS (SELECT count(*) FILTER (WHERE l.doc_id IS NULL) / count(*) AS rate, count(*) FILTER (WHERE l.doc_id IS NULL) AS n FROM documents d LEFT JOIN labels l USING (doc_id)),
    s8 AS ({_S8}), s9 AS ({_S9}), s10 AS ({_S10})
    SELECT 'S-1' AS id, 'error' AS severity, count(*) = 0 AS ok, count(*) AS evidence FROM bad WHERE run = 'stretched'
    UNION ALL SELECT 'S-2', 'error', count(*) = 0, count(*) FROM every WHERE status = 'GAP'
    UNION ALL SELECT 'S-3', 'error', {_OBSERVED} >= (SELECT count(*) FROM events), {_OBSERVED}
    UNION ALL SELECT 'S-4', 'error', malformed = 0, malformed FROM num
    UNION ALL SELECT 'S-5', 'warn', total = 0 OR wrong / total <= 0.01, wrong FROM num
    UNION ALL SELECT 'S-6', 'error', count(*) = 0, count(*) FROM documents WHERE regexp_matches(lang || ' ' || source || ' ' || text, '[\\x{{C2}}\\x{{C3}}][\\x{{80}}-\\x{{BF}}]')
    UNION ALL SELECT 'S-7', 'warn', rate <= 0.05, n FROM nul
    UNION ALL SELECT 'S-8', 'warn', future = 0 AND (total = 0 OR outside / total <= 0.05), outside FROM s8
    UNION ALL SELECT 'S-9', 'warn', total = 0 OR without / total <= 0.02, without FROM s9
    UNION ALL SELECT 'S-10', 'error', broken = 0, broken FROM s10
    UNION ALL SELECT 'S-11', 'warn', count(*) = 0, count(*) FROM events WHERE event_id % 4 = 3
""")
def q_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    orders, docs = table(spark, sf_dir, "orders"), table(spark, sf_dir, "documents")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    nodes = C.coverage(events, P.event_day(), c("event_type"), P.CAP)
    seq, year, origin = F.lpad(c("o_orderkey").cast("string"), 7, "0"), F.date_format("o_orderdate", "yyyy"), F.lpad((c("o_custkey") % 10000).cast("string"), 4, "0")
    digit = F.when(c("o_orderkey") % 5 == 0, "00").otherwise(I.check_digit(seq, year, F.lit("4"), F.lit("05"), origin))
    number = F.when(c("o_orderkey") % 7 == 0, F.concat(F.lit("x"), seq)).otherwise(F.concat(seq, F.lit("-"), digit, F.lit("."), year, F.lit(".4.05."), origin))
    parsed = orders.select(number.alias("number")).select(I.parse_case_number(c("number")).alias("p"))
    numbers = parsed.agg(F.count("*").alias("total"), F.count_if(c("p").isNull()).alias("malformed"), F.count_if(~c("p.valid")).alias("wrong"))
    damaged = docs.where(T.has_mojibake(F.concat("lang", F.lit(" "), "source", F.lit(" "), "text"))).agg(F.count("*").alias("n"))
    labelled = docs.select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    nulls = labelled.agg(F.count("*").alias("total"), F.count_if(c("has").isNull()).alias("n"))
    dead = events.where("event_id % 4 = 3").agg(F.count("*").alias("n"))
    violations = C.tiling_violations(P.leaves(spark, sf_dir).where("run = 'stretched'"), P.ROOT).agg(F.count("*").alias("n"))
    gaps = nodes.where("status = 'GAP'").agg(F.count("*").alias("n"))
    return Q.report([
        Q.Check("S-1", "error", violations, c("n") == 0, c("n")),
        Q.Check("S-2", "error", gaps, c("n") == 0, c("n")),
        Q.Check("S-3", "error", observed(spark, sf_dir), c("observed") >= c("stored"), c("observed")),
        Q.Check("S-4", "error", numbers, c("malformed") == 0, c("malformed")),
        Q.Check("S-5", "warn", numbers, Q.share("wrong", "total") <= Q.BAD_DIGITS, c("wrong")),
        Q.Check("S-6", "error", damaged, c("n") == 0, c("n")),
        Q.Check("S-7", "warn", nulls, Q.share("n", "total") <= Q.NULL_RATE, c("n")),
        Q.Check("S-8", "warn", dates(spark, sf_dir), (c("future") == 0) & (Q.share("outside", "total") <= Q.BAD_DATES), c("outside")),
        Q.Check("S-9", "warn", childless(spark, sf_dir), Q.share("without", "total") <= Q.NO_PARTY, c("without")),
        Q.Check("S-10", "error", blobs(spark, sf_dir), c("broken") == 0, c("broken")),
        Q.Check("S-11", "warn", dead, c("n") == 0, c("n")),
    ])


@query("""
    WITH s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS stored FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT CAST(ts AS DATE) AS day, count(*) AS now FROM events WHERE event_id % 2 = 1 GROUP BY 1)
    SELECT day, stored, coalesce(now, 0) AS now, abs(coalesce(now, 0) - stored) / stored > 0.1 AS drifted FROM s LEFT JOIN n USING (day)
""")
def q_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of each day's count: the even events and the odd ones."""
    events = table(spark, sf_dir, "events").select(P.event_day().alias("day"), (F.col("event_id") % 2).alias("m"))
    stored = events.where("m = 0").groupBy("day").agg(F.count("*").alias("stored"))
    return Q.drift(stored, events.where("m = 1").groupBy("day").agg(F.count("*").alias("now")), "day")
