"""Queries of work queues, retries, throttling and upserts over events as a log of jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import retry_after_ms
from ..operators import coverage as C
from ..operators import upsert as U
from ..operators import workqueue as Q
from ..session import ship, table
from .registry import query

_STATUS = "CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' WHEN 2 THEN 'done' ELSE 'dead' END"
_PRIORITY = "CASE event_type WHEN 'error' THEN 10 WHEN 'view' THEN 50 WHEN 'click' THEN 90 ELSE 99 END"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({"status": F.expr(_STATUS), "priority": F.expr(_PRIORITY), "site": F.col("user_id") % 4})


@query(f"""
    SELECT site, CAST(place AS BIGINT) AS place, event_id, CAST(priority AS BIGINT) AS priority FROM (
        SELECT user_id % 4 AS site, event_id, {_PRIORITY} AS priority, row_number() OVER (PARTITION BY user_id % 4 ORDER BY {_PRIORITY}, ts, event_id) AS place
        FROM events WHERE {_STATUS} = 'pending') WHERE place <= 10
""")
def q_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next ten jobs of each site: the claim's limit is the feature."""
    out = Q.claim_order(jobs(spark, sf_dir).where("status = 'pending'"), "site", ["priority", "ts", "event_id"], 10)
    return out.select("site", F.col("place").cast("bigint").alias("place"), "event_id", F.col("priority").cast("bigint").alias("priority"))


@query(f"""
    SELECT event_type AS kind, count(*) AS n, max(event_id) AS last FROM events
    WHERE {_STATUS} = 'leased' AND ts + INTERVAL 90 SECOND < (SELECT max(ts) FROM events) GROUP BY 1
""")
def q_expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = jobs(spark, sf_dir)
    now = log.agg(F.max("ts").alias("as_of"))
    late = Q.expired(log.join(F.broadcast(now)), F.col("ts") + F.expr(f"interval {Q.LEASE_MS // 1000} seconds"), F.col("as_of"))
    return late.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("""
    SELECT event_id, attempts, CASE WHEN attempts >= 6 THEN 'dead' ELSE 'pending' END AS outcome
    FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempts FROM events WHERE event_type = 'error')
""")
def q_retry_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("bigint")
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("attempts", nth)
    return failed.select("event_id", "attempts", Q.retry_or_bury(F.col("attempts")).alias("outcome"))


@query(f"SELECT event_id, event_type AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS died FROM events WHERE {_STATUS} = 'dead' ORDER BY ts DESC, event_id LIMIT 100")
def q_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest hundred dead jobs: the limit is the feature."""
    dead = jobs(spark, sf_dir).where("status = 'dead'").orderBy(F.col("ts").desc(), "event_id").limit(100)
    return dead.select("event_id", F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("died"))


@query("""
    SELECT event_id, wanted, CAST(least(wanted, greatest(0, 2000 - coalesce(sum(wanted) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS granted
    FROM (SELECT *, CAST(floor(value) AS BIGINT) AS wanted FROM events)
""")
def q_budget_grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").withColumn("wanted", F.floor("value").cast("bigint"))
    return Q.budget_grants(requests, "user_id", ["ts", "event_id"], "wanted", 2_000).select("event_id", "wanted", "granted")


@query("""
    WITH runs AS (SELECT user_id AS run, min(event_id) AS started, count(*) FILTER (WHERE event_type = 'purchase') AS finished, user_id % 5 AS root FROM events GROUP BY user_id)
    SELECT root, max(started) AS started, arg_max(run, started) AS run FROM runs WHERE finished < 10 GROUP BY root
""")
def q_resume_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest unfinished run of each root."""
    events = table(spark, sf_dir, "events")
    runs = events.groupBy(F.col("user_id").alias("run")).agg(F.min("event_id").alias("started"), F.count_if(F.col("event_type") == "purchase").alias("finished"))
    return runs.where("finished < 10").groupBy((F.col("run") % 5).alias("root")).agg(F.max("started").alias("started"), F.max_by("run", "started").alias("run"))


_RESPONSE = """
    CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 302 WHEN 2 THEN 404 WHEN 3 THEN 408 WHEN 4 THEN 429 WHEN 5 THEN 503 ELSE 200 END AS status,
    CASE WHEN event_id % 3 = 0 THEN 'text/html' ELSE 'application/pdf' END AS ctype, event_id % 5 = 0 AS rejected,
    CASE WHEN event_type = 'error' THEN CASE event_id % 6 WHEN 0 THEN 'SiteChanged' WHEN 1 THEN 'TimeoutError' WHEN 2 THEN 'AbortError' ELSE 'Error' END END AS error,
    CASE WHEN event_id % 2 = 1 THEN 'ECONNRESET' ELSE 'EOTHER' END AS code
"""


@query(f"""
    SELECT event_id, CASE WHEN error IS NOT NULL THEN CASE WHEN error = 'SiteChanged' THEN 'FATAL_SITE_CHANGED' WHEN error IN ('TimeoutError', 'AbortError') THEN 'TIMEOUT' WHEN code = 'ECONNRESET' THEN 'NETWORK' ELSE 'PARSE' END
        WHEN status = 429 THEN 'RATE_LIMITED' WHEN status >= 500 THEN 'SERVER_ERROR' WHEN status = 408 THEN 'TIMEOUT' WHEN status BETWEEN 300 AND 399 THEN 'SESSION_LOST' WHEN status >= 400 THEN 'CLIENT_ERROR'
        WHEN ctype = 'text/html' AND rejected THEN 'RATE_LIMITED' WHEN ctype <> 'application/pdf' THEN 'NOT_PDF' ELSE 'PARSE' END AS failure
    FROM (SELECT event_id, {_RESPONSE} FROM events)
""")
def q_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("_responses")
    seen = spark.sql(f"SELECT event_id, {_RESPONSE} FROM _responses")
    c = F.col
    return seen.select("event_id", Q.classify(c("error"), c("code"), c("status"), c("ctype"), c("rejected"), F.lit("pdf")).alias("failure"))


_MATRIX = ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in Q.RETRY_MATRIX.items())
_CLASSES = list(Q.RETRY_MATRIX)
_FAILURE = "[" + ", ".join(f"'{k}'" for k in _CLASSES) + "][event_id % 11 + 1]"


@query(f"""
    WITH m(failure, most, base, cap) AS (VALUES {_MATRIX}),
    c AS (SELECT event_id, {_FAILURE} AS failure, event_id % 7 AS attempt, (event_id % 5) * 80000 AS elapsed, CASE WHEN event_id % 3 = 0 THEN (event_id % 9) * 1000 END AS ra, (event_id % 4) * 1500 AS prev FROM events),
    j AS (SELECT *, CASE WHEN most = 0 THEN 'never' WHEN attempt >= most THEN 'attempts' WHEN elapsed >= 300000 THEN 'budget' WHEN ra IS NOT NULL THEN 'retry-after' ELSE 'jitter' END AS reason FROM c JOIN m USING (failure))
    SELECT event_id, failure, reason, reason IN ('retry-after', 'jitter') AS retry,
           CAST(CASE reason WHEN 'retry-after' THEN least(cap, ra + 500) WHEN 'jitter' THEN CASE WHEN prev <= 0 OR least(cap, prev * 3) <= base THEN least(base, cap) ELSE least(cap, prev * 3) END ELSE 0 END AS BIGINT) AS delay_ms FROM j
""")
def q_retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the greatest draw of every jitter."""
    failure = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("event_id") % 11 + 1).cast("int"))
    seen = table(spark, sf_dir, "events").select("event_id", failure.alias("failure"))
    n = F.col("event_id")
    after = F.when(n % 3 == 0, (n % 9) * 1000)
    decision = Q.retry_decision(F.col("failure"), n % 7, (n % 5) * 80_000, after, (n % 4) * 1500, F.lit(1.0))
    return seen.select("event_id", "failure", decision.alias("d")).select("event_id", "failure", "d.reason", "d.retry", "d.delay_ms")


_HEADERS = "['3', ' 120 ', '', 'soon', 'Mon, 15 Jan 2024 10:00:30 GMT', 'Mon, 01 Jan 2024 00:00:00 GMT'][event_id % 6 + 1]"


@query(f"""
    SELECT event_id, header, CASE WHEN regexp_full_match(trim(header), '\\d+') THEN CAST(trim(header) AS BIGINT) * 1000
        WHEN header LIKE '%GMT' THEN CAST(greatest(0, epoch_ms(strptime(header[6:25], '%d %b %Y %H:%M:%S')) - epoch_ms(TIMESTAMP '2024-01-15 10:00:00')) AS BIGINT) END AS wait_ms
    FROM (SELECT event_id, {_HEADERS} AS header FROM events)
""")
def q_retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = ["3", " 120 ", "", "soon", "Mon, 15 Jan 2024 10:00:30 GMT", "Mon, 01 Jan 2024 00:00:00 GMT"]
    header = F.element_at(F.array(*map(F.lit, headers)), (F.col("event_id") % 6 + 1).cast("int"))
    now = F.lit("2024-01-15 10:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", header.alias("header")).withColumn("wait_ms", retry_after_ms(F.col("header"), now))


@query(f"""
    WITH RECURSIVE m(failure, most, base, cap) AS (VALUES {_MATRIX}),
    s AS (SELECT failure, base, cap, 1 AS attempt, least(base, cap) AS delay FROM m WHERE most > 0
          UNION ALL SELECT failure, base, cap, attempt + 1, CASE WHEN least(cap, delay * 3) <= base THEN least(base, cap) ELSE least(cap, delay * 3) END FROM s WHERE attempt < 6)
    SELECT failure, CAST(attempt AS BIGINT) AS attempt, CAST(delay AS BIGINT) AS delay_ms FROM s
""")
def q_backoff_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waits of six failures in a row of each class that is retried, with the greatest draws."""
    matrix = spark.createDataFrame([(k, b, c) for k, (a, b, c) in Q.RETRY_MATRIX.items() if a], "failure string, base bigint, cap bigint")
    waits = matrix.select("failure", F.posexplode(Q.backoff_sequence(6, F.col("base"), F.col("cap"), F.lit(1.0))).alias("k", "delay_ms"))
    return waits.select("failure", (F.col("k") + 1).cast("bigint").alias("attempt"), "delay_ms")


@query("""
    WITH o AS (SELECT user_id, ts, event_id, event_type IN ('error', 'click', 'view') AS failed FROM events),
    i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM o),
    r AS (SELECT user_id, island, count(*) AS run FROM i WHERE failed GROUP BY 1, 2)
    SELECT user_id, CAST(coalesce(sum(run // 5), 0) AS BIGINT) AS openings, CAST(coalesce(max(run), 0) AS BIGINT) AS longest FROM (SELECT DISTINCT user_id FROM o) LEFT JOIN r USING (user_id) GROUP BY user_id
""")
def q_breaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.breaker_openings(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "click", "view"))


@query("SELECT CAST(k AS BIGINT) AS opens, CAST(least(600000, 60000 * pow(2, least(k, 10))) AS BIGINT) AS wait_ms FROM range(13) t(k)")
def q_breaker_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(13).select(F.col("id").alias("opens"), Q.breaker_wait_ms(F.col("id")).alias("wait_ms"))


@query("""
    WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
                                CASE WHEN event_type <> 'error' THEN 'OK' WHEN event_id % 3 = 0 THEN 'RATE_LIMITED' ELSE 'PARSE' END AS x FROM events),
    f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 4 AS c, CAST(2.0 AS DOUBLE) AS r, 0 AS s FROM events
          UNION ALL SELECT f.user_id, o.k, CASE WHEN x = 'OK' AND s + 1 >= 5 THEN least(8, c + 1) WHEN x = 'RATE_LIMITED' THEN greatest(1, c // 2) ELSE c END,
                           CASE WHEN x = 'RATE_LIMITED' THEN greatest(0.1, r / 2) ELSE r END, CASE WHEN x <> 'OK' OR s + 1 >= 5 THEN 0 ELSE s + 1 END
                    FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
    SELECT user_id, k AS n, CAST(c AS BIGINT) AS concurrency, round(r, 6) AS refill, CAST(s AS BIGINT) AS streak FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1
""")
def q_aimd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control law over each worker's outcomes in order. Rows reach the fold sorted, and it holds one state."""
    ship(spark)
    kind = F.when(F.col("event_type") != "error", "OK").when(F.col("event_id") % 3 == 0, "RATE_LIMITED").otherwise("PARSE")
    ordered = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("x")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")

    def fold(batches):
        user, n, state = None, 0, None

        def out():
            return pd.DataFrame([(user, n, state[0], state[1], state[2])], columns=["user_id", "n", "concurrency", "refill", "streak"])

        for pdf in batches:
            for key, part in pdf.groupby("user_id", sort=False):
                if key != user:
                    if user is not None:
                        yield out()
                    user, n, state = key, 0, None
                state = Q.control_fold(part["x"], every=5, state=state)
                n += len(part)
        if user is not None:
            yield out()

    return ordered.mapInPandas(fold, "user_id bigint, n bigint, concurrency bigint, refill double, streak bigint").withColumn("refill", F.round("refill", 6))


_ALLOWED = {"signup": ["view", "click", "signup"], "view": ["click", "view", "purchase"], "click": ["purchase", "click", "view", "error"], "purchase": ["view"], "error": ["view", "error"]}


@query(f"""
    WITH s AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, event_type AS new FROM events),
    a(old, new) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, bs in _ALLOWED.items() for b in bs)})
    SELECT old, new, count(*) AS n FROM s ANTI JOIN a USING (old, new) WHERE old IS NOT NULL GROUP BY old, new
""")
def q_illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.illegal_transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", _ALLOWED)


@query("""
    WITH o AS (SELECT o_orderkey AS k, sha256(o_orderstatus || CAST(o_custkey AS VARCHAR)) AS h FROM orders WHERE o_orderkey % 3 <> 0),
    n AS (SELECT o_orderkey AS k, sha256(CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END || CAST(o_custkey AS VARCHAR)) AS h FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' WHEN o.h <> n.h THEN 'updated' ELSE 'unchanged' END AS outcome, count(*) AS n, CAST(sum(coalesce(o.k, n.k)) AS BIGINT) AS key_sum
    FROM o FULL JOIN n ON o.k = n.k GROUP BY 1
""")
def q_upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot with a batch on top: two thirds of the orders, and three quarters of them with some changed."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.col("o_custkey").cast("string").alias("c"))
    old = orders.where("k % 3 <> 0").select("k", F.sha2(F.concat("o_orderstatus", "c"), 256).alias("content_hash"))
    new = orders.where("k % 4 <> 0").select("k", F.sha2(F.concat(F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("o_orderstatus")), "c"), 256).alias("content_hash"))
    return U.outcomes(old, new, ["k"]).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("k").alias("key_sum"))


@query("""
    SELECT c_mktsegment AS segment, count(*) AS added FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') GROUP BY 1
""")
def q_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    added = U.insert_if_absent(orders.where("o_orderdate < '1996-01-01'"), orders.where("o_orderdate >= '1998-01-01'"), ["c_custkey"])
    return table(spark, sf_dir, "customer").join(added, "c_custkey", "left_semi").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("added"))
