"""Queries of counts, rates, reports, metrics and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import duration
from ..functions.text import csv_cell
from ..operators import metrics as M
from ..session import table
from .registry import query


@query("""
    SELECT s AS state, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) k(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s
""")
def q_count_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known states are there with zero if no row has them."""
    known = spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "state string")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))
    return known.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


_STATUS = "CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' WHEN 2 THEN 'done' ELSE 'dead' END"


@query(f"""
    SELECT coalesce(kind, '*') AS kind, coalesce(status, '*') AS status, n FROM (
        SELECT event_type AS kind, {_STATUS} AS status, count(*) AS n FROM events GROUP BY ROLLUP (event_type, {_STATUS}))
""")
def q_queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by kind and status, by kind, and of all."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.expr(_STATUS).alias("status"))
    sums = jobs.rollup("kind", "status").agg(F.count("*").alias("n"))
    return sums.select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("status", F.lit("*")).alias("status"), "n")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1")
def q_cases_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    # days are few, so they are counted first and distinctness costs no second shuffle of rows
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("n").alias("n"), F.count("day").alias("days"))


@query("""
    WITH j AS (SELECT d.text, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT field, round(rate, 6) AS rate FROM (
        SELECT unnest(['text', 'lang', 'source', 'quality', 'toxic']) AS field,
               unnest([avg(CASE WHEN text IS NULL OR text = '' THEN 1.0 ELSE 0 END), avg(CASE WHEN lang IS NULL OR lang = '' THEN 1.0 ELSE 0 END),
                       avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0 END), avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0 END), avg(CASE WHEN toxic IS NULL THEN 1.0 ELSE 0 END)]) AS rate FROM j)
""")
def q_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text") == "", F.lit(True)).alias("no_text"), "lang", "source")
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    empty = {"text": F.col("no_text"), "lang": F.coalesce(F.col("lang") == "", F.lit(True)), "source": F.col("source").isNull(), "quality": F.col("quality").isNull(), "toxic": F.col("toxic").isNull()}
    counted = both.agg(*[F.count_if(c).alias(n) for n, c in empty.items()], F.count("*").alias("total"))
    rate = lambda n: F.when(F.col("total") > 0, F.round(F.col(n) / F.col("total"), 6))
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), rate(n).alias("rate")) for n in empty])).alias("x")).select("x.*").where("rate is not null")


@query("SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_repeated FROM documents")
def q_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are counted by digest: what is shuffled doesn't grow with their length
    groups = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("k"))
    return groups.agg(F.sum("k").alias("n"), F.count("h").alias("n_distinct")).select(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "n_distinct", (F.coalesce("n", F.lit(0).cast("bigint")) - F.col("n_distinct")).alias("n_repeated"))


@query("""
    SELECT event_type, q, value FROM (
        SELECT event_type, unnest([0.5, 0.95, 0.99]) AS q, unnest([s[least(n, 1 + CAST(floor(0.5 * n) AS BIGINT))], s[least(n, 1 + CAST(floor(0.95 * n) AS BIGINT))], s[least(n, 1 + CAST(floor(0.99 * n) AS BIGINT))]]) AS value
        FROM (SELECT event_type, list_sort(list(value)) AS s, count(value) AS n FROM events GROUP BY event_type))
""")
def q_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.exact_quantiles(table(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.95, 0.99])
    return out.select(F.col("key").alias("event_type"), "q", "value")


@query("""
    SELECT event_type AS name, '{user="' || (user_id % 3) || '"}' AS labels, round(sum(value), 4) AS total, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1, 2
""")
def q_metric_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    labels = M.rendered_labels(F.create_map(F.lit("user"), (F.col("user_id") % 3).cast("string")))
    out = M.fold_series(events, F.col("event_type"), labels, F.col("value"), [F.col("ts"), F.col("event_id")])
    return out.withColumn("total", F.round("total", 4))


@query("""
    WITH c AS (SELECT event_type, user_id % 3 AS u, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT '# TYPE ' || event_type || '_total counter' AS line FROM c GROUP BY event_type
    UNION ALL SELECT event_type || '_total{kind="' || event_type || '",user="' || u || '"} ' || n FROM c
""")
def q_prometheus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("u")).agg(F.count("*").alias("n"))
    labels = F.create_map(F.lit("user"), F.col("u").cast("string"), F.lit("kind"), F.col("event_type"))
    series = counts.select(F.concat("event_type", F.lit("_total")).alias("name"), F.lit("counter").alias("kind"), labels.alias("labels"), F.col("n").cast("string").alias("value"))
    return M.exposition(series).select("line")


_ETA = """
    CASE WHEN left_over = 0 THEN 'done' WHEN ran < 10 OR elapsed_ms <= 0 THEN '—' ELSE '~' ||
    CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN s // 60 > 0 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END END
"""


@query(f"""
    WITH u AS (SELECT user_id, count(*) FILTER (WHERE event_id % 4 > 1) AS ran, count(*) FILTER (WHERE event_id % 4 < 2) AS left_over,
                      CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS elapsed_ms FROM events GROUP BY user_id),
    s AS (SELECT *, CASE WHEN ran > 0 THEN CAST(floor(left_over * elapsed_ms / ran / 1000 + 0.5) AS BIGINT) END AS s FROM u)
    SELECT user_id, ran, left_over, elapsed_ms, {_ETA} AS eta FROM s
""")
def q_throughput_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each worker: jobs run, jobs left, and how long these will take at its rate."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", (F.col("event_id") % 4).alias("m"))
    sums = events.groupBy("user_id").agg(
        F.count_if(F.col("m") > 1).alias("ran"), F.count_if(F.col("m") < 2).alias("left_over"),
        F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000).cast("bigint").alias("elapsed_ms"),
    )
    wait = F.when(F.col("ran") > 0, F.col("left_over") * F.col("elapsed_ms") / F.col("ran"))
    eta = F.when(F.col("left_over") == 0, "done").when((F.col("ran") < 10) | (F.col("elapsed_ms") <= 0), "—").otherwise(F.concat(F.lit("~"), duration(wait)))
    return sums.withColumn("eta", eta)


@query("""
    WITH m AS (SELECT event_id, CAST(floor(value * 100000) AS BIGINT) AS ms FROM events), s AS (SELECT *, CAST(floor(ms / 1000 + 0.5) AS BIGINT) AS s FROM m)
    SELECT event_id, ms, CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm'
        WHEN s // 60 > 0 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS text FROM s
""")
def q_duration_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") * 100000).cast("bigint").alias("ms"))
    return events.withColumn("text", duration(F.col("ms")))


@query("SELECT doc_id, lang, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 20")
def q_md5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample report: its limit is the feature."""
    return M.deterministic_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", 20)


@query("""
    SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN regexp_matches(text, '[",\\r\\n]|^[ \\t\\n\\v\\f\\r]|[ \\t\\n\\v\\f\\r]$') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell FROM documents
""")
def q_csv_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", csv_cell(F.col("text")).alias("cell"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_orderkey LIMIT 50 OFFSET 100")
def q_offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").orderBy("o_orderstatus", "o_orderkey").offset(100).limit(50)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500")
def q_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey > 500 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(500)


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint") % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("""
    SELECT user_id AS run, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1
""")
def q_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return latest.select("run", "m.event_id", F.date_format("m.ts", "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("""
    SELECT c_mktsegment, count(*) AS customers, count(o.k) AS with_orders, CAST(sum(coalesce(o.k, 0)) AS BIGINT) AS orders
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) o ON o_custkey = c_custkey GROUP BY 1
""")
def q_total_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over states: all, detailed, and their children."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    both = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(orders, "c_custkey", "left")
    return both.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count("k").alias("with_orders"), F.sum(F.coalesce("k", F.lit(0).cast("bigint"))).alias("orders"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR))) AS r FROM events) WHERE r <= 100")
def q_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of bounded size for each series, drawn by hash: the bound is the feature."""
    place = Window.partitionBy("event_type").orderBy(F.md5(F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(place)).where("r <= 100").select("event_type", "event_id", "value")
