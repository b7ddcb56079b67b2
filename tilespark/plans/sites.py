"""Queries of axes, rules, job dispatch, token refresh, the catalogue and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested as N
from ..operators import sites as S
from ..session import table
from ..sources.exports import catalogue
from .registry import query


@query("""
    WITH n AS (SELECT event_id AS id, CAST(ts AS DATE) AS ini, CAST(ts AS DATE) + CAST(event_id % 4 AS INTEGER) AS fim, CASE WHEN event_id % 3 = 0 THEN event_type END AS facet FROM events),
    h AS (SELECT *, CAST((fim - ini + 1) // 2 AS INTEGER) AS half FROM n)
    SELECT id, 'date' AS axis, ini, ini + half - 1 AS fim, facet FROM h WHERE fim > ini
    UNION ALL SELECT id, 'date', ini + half, fim, facet FROM h WHERE fim > ini
    UNION ALL SELECT id, 'label', ini, fim, v FROM h, (VALUES ('click'), ('view')) AS t(v) WHERE fim = ini AND facet IS NULL
    UNION ALL SELECT id, NULL, ini, fim, facet FROM h WHERE fim = ini AND facet IS NOT NULL
""")
def q_axis_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of one to four days, halved; single days by label; what is left is a gap."""
    i, day = F.col("event_id"), F.to_date("ts")
    nodes = table(spark, sf_dir, "events").select(i.alias("id"), day.alias("ini"), F.date_add(day, (i % 4).cast("int")).alias("fim"), F.when(i % 3 == 0, F.col("event_type")).alias("facet"))
    return S.split_nodes(nodes, [S.DateAxis(), S.LabelAxis(["click", "view"])])


@query("""
    SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'CAPTCHA' WHEN event_type = 'error' THEN 'SESSION_LOST' WHEN event_id % 5 = 0 THEN 'TIMEOUT' ELSE 'PARSE' END AS class FROM events
""")
def q_site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's own rules come first, in their order; the general class is the rest."""
    i, error = F.col("event_id"), F.col("event_type") == "error"
    general = F.when(i % 5 == 0, "TIMEOUT").otherwise("PARSE")
    return table(spark, sf_dir, "events").select("event_id", S.classified(general, [(error & (i % 2 == 0), "CAPTCHA"), (error, "SESSION_LOST")]).alias("class"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'dead' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_totalprice > 100000 THEN 'retry' WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'retry' END AS outcome,
           CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'CLIENT_ERROR' WHEN o_orderstatus = 'F' THEN NULL WHEN o_totalprice > 100000 THEN 'RATE_LIMITED' WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'PARSE' END AS reason FROM orders
""")
def q_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs by status: F always done; O limited, done, or without an answer; P without a handler."""
    limited = F.col("o_totalprice") > 100000

    def finish(jobs: DataFrame) -> DataFrame:
        return jobs.select("o_orderkey", F.lit("done").alias("outcome"), F.lit(None).cast("string").alias("reason"))

    def detail(jobs: DataFrame) -> DataFrame:
        answered = jobs.where(limited | (F.col("o_orderkey") % 2 == 0))
        return answered.select("o_orderkey", F.when(limited, "retry").otherwise("done").alias("outcome"), F.when(limited, "RATE_LIMITED").alias("reason"))

    return S.dispatch(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", "o_orderstatus", {"F": finish, "O": detail}).select("o_orderkey", "outcome", "reason")


@query("SELECT c_custkey, max(o_orderkey) AS token, count(o_orderkey) > 0 AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q_token_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("token"))
    return S.refreshed(table(spark, sf_dir, "customer").select("c_custkey"), found, "c_custkey", "token", [F.col("token")])


@query("SELECT CAST(ordinal_position AS BIGINT) AS place, column_name AS name FROM (SELECT row_number() OVER () AS ordinal_position, column_name FROM (DESCRIBE SELECT * FROM orders))")
def q_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(table(spark, sf_dir, "orders"))


def _record(rows: DataFrame, text) -> DataFrame:
    """A nested record for each document, its fields out of order."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    movement = F.struct(F.col("lang").alias("z"), F.lit("now").alias("listedAt"), text.alias("b"))
    extra = F.create_map(F.lit("k"), F.col("source"), F.lit("ca"), F.lit("x"), F.lit("j"), none)
    return rows.select("doc_id", F.struct(i.alias("z"), F.array(movement, F.lit(None).cast("struct<z:string,listedAt:string,b:string>")).alias("a"), extra.alias("m"), F.lit("x").alias("contentHash"), none.alias("n")).alias("record"))


@query("""
    WITH r AS (SELECT doc_id, '{"a":[{"b":"t' || doc_id || '","z":"' || lang || '"},null],"m":{"j":null,"k":"' || source || '"},"n":null,"z":' || doc_id || '}' AS body FROM documents)
    SELECT doc_id, body, sha256(body) AS digest FROM r
""")
def q_nested_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _record(table(spark, sf_dir, "documents"), F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    body = rows.select("doc_id", N.canonical_text(F.col("record"), rows.schema["record"].dataType).alias("body"))
    return body.select("doc_id", "body", F.sha2("body", 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN chr(195) || chr(135) || doc_id END AS damaged FROM documents")
def q_nested_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh record has a damaged text two levels down."""
    shown = F.concat(F.when(F.col("doc_id") % 7 == 0, "Ã\u0087").otherwise(""), F.col("doc_id").cast("string"))
    rows = _record(table(spark, sf_dir, "documents"), shown)
    return rows.select("doc_id", N.damaged(F.col("record"), rows.schema["record"].dataType).alias("damaged"))
