"""Queries of the coverage tree and its proofs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage as C
from ..session import table
from .registry import query

CAP = 70

_TREE = f"""
    d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
    span AS (SELECT min(day) AS a, max(day) AS b FROM d),
    days AS (SELECT CAST(unnest(generate_series(a - INTERVAL 1 DAY, CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span),
    cum AS (SELECT days.day, CAST(sum(coalesce(d.n, 0)) OVER (ORDER BY days.day) AS BIGINT) AS c FROM days LEFT JOIN d USING (day)),
    tree(depth, ini, fim, n) AS (
        SELECT 0, a, b, (SELECT CAST(sum(n) AS BIGINT) FROM d) FROM span
        UNION ALL
        SELECT k.depth + 1, k.ini, k.fim, hi.c - lo.c FROM (
            SELECT depth, CASE WHEN side = 0 THEN ini ELSE ini + CAST((fim - ini + 1) // 2 AS INTEGER) END AS ini,
                   CASE WHEN side = 0 THEN ini + CAST((fim - ini + 1) // 2 AS INTEGER) - 1 ELSE fim END AS fim
            FROM tree, (VALUES (0), (1)) s(side) WHERE n >= {CAP} AND fim > ini) k
        JOIN cum hi ON hi.day = k.fim JOIN cum lo ON lo.day = k.ini - 1),
    nodes AS (SELECT depth, ini, fim, n, CASE WHEN n < {CAP} THEN 'LEAF_DONE' WHEN fim > ini THEN 'SPLIT' ELSE 'SPLIT_SECONDARY' END AS status FROM tree)
"""
_CHILDREN = f"""
    k AS (SELECT CAST(ts AS DATE) AS day, upper(event_type) AS have, count(*) AS c FROM events GROUP BY 1, 2),
    v AS (SELECT DISTINCT upper(event_type) AS want FROM events),
    children AS (SELECT nodes.depth + 1 AS depth, nodes.ini, nodes.fim, CAST(coalesce(sum(k.c), 0) AS BIGINT) AS n, v.want
                 FROM nodes CROSS JOIN v LEFT JOIN k ON k.day = nodes.ini AND starts_with(k.have, v.want)
                 WHERE nodes.status = 'SPLIT_SECONDARY' GROUP BY ALL),
    every AS (SELECT depth, ini, fim, n, status, CAST(NULL AS VARCHAR) AS class FROM nodes
              UNION ALL SELECT depth, ini, fim, n, CASE WHEN n >= {CAP} THEN 'GAP' ELSE 'LEAF_DONE_SECONDARY' END, want FROM children)
"""


def event_day():
    return F.to_date("ts")


@query(f"WITH RECURSIVE {_TREE} SELECT depth, ini, fim, n, status FROM nodes")
def q_bisect_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tree(table(spark, sf_dir, "events").select("ts"), event_day(), CAP)


@query(f"WITH RECURSIVE {_TREE}, {_CHILDREN} SELECT status, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(least(n, {CAP})) AS BIGINT) AS observed FROM every GROUP BY status")
def q_coverage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "event_type")
    nodes = C.coverage(events, event_day(), F.col("event_type"), CAP)
    return nodes.groupBy("status").agg(F.count("*").alias("nodes"), F.sum("n").alias("n_rows"), F.sum(F.least(F.col("n"), F.lit(CAP))).alias("observed"))


@query(f"WITH RECURSIVE {_TREE}, {_CHILDREN} SELECT ini, class, n, greatest(n - {CAP}, 0) AS unreachable FROM every WHERE status = 'GAP'")
def q_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "event_type")
    gaps = C.coverage(events, event_day(), F.col("event_type"), CAP).where("status = 'GAP'")
    return gaps.select("ini", "class", "n", F.greatest(F.col("n") - CAP, F.lit(0)).alias("unreachable"))


@query("""
    SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey, place, n >= 30 AS truncated
    FROM (SELECT o_orderdate, o_orderkey, row_number() OVER w AS place, count(*) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS n
          FROM orders WINDOW w AS (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey)) WHERE place <= 30
""")
def q_capped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey")
    return C.capped_search(orders, ["month"], "o_orderkey", 30).select("month", "o_orderkey", F.col("place").cast("bigint").alias("place"), "truncated")


_LEAVES = """
    months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS ini FROM orders),
    whole AS (SELECT ini, CAST(ini + INTERVAL 1 MONTH AS DATE) - 1 AS fim FROM months),
    leaves AS (
        SELECT 'sound' AS run, ini, fim FROM whole
        UNION ALL SELECT 'dropped', ini, fim FROM whole WHERE month(ini) % 7 <> 0
        UNION ALL SELECT 'stretched', ini, CASE WHEN month(ini) % 5 = 0 THEN fim + 2 ELSE fim END FROM whole),
    named AS (SELECT run, strftime(ini, '%Y-%m-%d') || '..' || strftime(fim, '%Y-%m-%d') AS id, ini, fim FROM leaves)
"""
ROOT = C.Root(date(1995, 1, 1), date(2001, 12, 31))
_VIOLATIONS = """
    seen AS (SELECT run, ini, fim, lag(fim) OVER w AS p, row_number() OVER w AS f, row_number() OVER (PARTITION BY run ORDER BY ini DESC, id DESC) AS l
             FROM named WINDOW w AS (PARTITION BY run ORDER BY ini, id)),
    bad AS (
        SELECT run, 'missing-start' AS kind, DATE '1995-01-01' AS ini, ini - 1 AS fim FROM seen WHERE f = 1 AND ini <> DATE '1995-01-01'
        UNION ALL SELECT run, 'missing-end', fim + 1, DATE '2001-12-31' FROM seen WHERE l = 1 AND fim <> DATE '2001-12-31'
        UNION ALL SELECT run, 'overlap', ini, least(p, fim) FROM seen WHERE p >= ini
        UNION ALL SELECT run, 'gap', p + 1, ini - 1 FROM seen WHERE p < ini AND ini <> p + 1)
"""


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with orders as resolved leaves: as they are, without some, and with some stretched."""
    months = table(spark, sf_dir, "orders").select(F.to_date(F.trunc("o_orderdate", "month")).alias("ini")).distinct()
    kinds = F.array(
        F.struct(F.lit("sound").alias("run"), F.last_day("ini").alias("fim")),
        F.when(F.month("ini") % 7 != 0, F.struct(F.lit("dropped").alias("run"), F.last_day("ini").alias("fim"))),
        F.struct(F.lit("stretched").alias("run"), F.when(F.month("ini") % 5 == 0, F.date_add(F.last_day("ini"), 2)).otherwise(F.last_day("ini")).alias("fim")),
    )
    out = months.select("ini", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).select("x.run", "ini", "x.fim")
    return out.select("run", C.node_id().alias("id"), "ini", "fim")


@query(f"WITH {_LEAVES}, {_VIOLATIONS} SELECT run, kind, ini, fim FROM bad")
def q_tiling_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tiling_violations(leaves(spark, sf_dir), ROOT)


@query(f"""
    WITH {_LEAVES}, {_VIOLATIONS}
    SELECT run, count(DISTINCT v) = 0 AS ok, count(DISTINCT id) AS n_leaves, count(DISTINCT v) AS n_violations, CAST(any_value(covered) AS BIGINT) AS covered_days, CAST(2557 AS BIGINT) AS root_days
    FROM named JOIN (SELECT run, sum(fim - ini + 1) AS covered FROM named GROUP BY run) USING (run)
    LEFT JOIN (SELECT run, kind || ini AS v FROM bad) USING (run) GROUP BY run
""")
def q_tiling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tiling_summary(leaves(spark, sf_dir), ROOT)


@query(f"WITH {_LEAVES} SELECT x.run, x.id AS a, y.id AS b FROM named x JOIN named y ON x.run = y.run AND x.id < y.id AND x.ini <= y.fim AND y.ini <= x.fim")
def q_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlapping_pairs(leaves(spark, sf_dir))


@query("""
    WITH known AS (SELECT event_type FROM (SELECT DISTINCT event_type FROM events) ORDER BY 1 LIMIT 3)
    SELECT CAST(ts AS DATE) AS day, count(*) AS visible, count(*) FILTER (WHERE event_type IN (SELECT event_type FROM known)) AS attributed,
           count(*) - count(*) FILTER (WHERE event_type IN (SELECT event_type FROM known)) AS unexplained,
           count(*) = count(*) FILTER (WHERE event_type IN (SELECT event_type FROM known)) AS ok
    FROM events GROUP BY 1
""")
def q_facet_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(event_day().alias("day"), "event_type")
    some = events.select("event_type").distinct().orderBy("event_type").limit(3)
    visible = events.groupBy("day").agg(F.count("*").alias("visible"))
    known = events.join(F.broadcast(some), "event_type", "left_semi").groupBy("day").agg(F.count("*").alias("attributed"))
    return C.facet_closure(visible, known, ["day"])


_VOCAB = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_brand FROM part"


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.explode(F.array_union(F.split("p_name", " "), F.array("p_type", "p_brand"))).alias("w")).distinct()


@query(f"WITH v AS ({_VOCAB}) SELECT a.w AS shorter, b.w AS longer FROM v a JOIN v b ON upper(a.w) <> upper(b.w) AND starts_with(upper(b.w), upper(a.w))")
def q_prefix_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prefix_collisions(vocabulary(spark, sf_dir), "w")


@query("""
    WITH u AS (SELECT DISTINCT p_type AS v, 0 AS src FROM part UNION ALL SELECT DISTINCT lower(p_type), 1 FROM part UNION ALL SELECT DISTINCT event_type, 1 FROM events)
    SELECT key, v AS value FROM (SELECT upper(v) AS key, v, row_number() OVER (PARTITION BY upper(v) ORDER BY src, v) AS k FROM u WHERE v <> '') WHERE k = 1
""")
def q_vocab_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first spelling of each folded value: the known vocabulary before what pages add."""
    known = table(spark, sf_dir, "part").select(F.col("p_type").alias("v")).distinct()
    found = known.select(F.lower("v").alias("v")).union(table(spark, sf_dir, "events").select("event_type").distinct())
    both = known.withColumn("src", F.lit(0)).union(found.withColumn("src", F.lit(1))).where("v <> ''")
    return both.groupBy(C.fold(F.col("v")).alias("key")).agg(F.min(F.struct("src", "v")).alias("m")).select("key", F.col("m.v").alias("value"))


@query("""
    SELECT 'before-root' AS label, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' - 3650 AND DATE '1995-12-31'
    UNION ALL SELECT 'after-root', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-01-01' AND DATE '2000-12-31' + 3650
""")
def q_edge_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.edge_probes(table(spark, sf_dir, "orders"), F.to_date("o_orderdate"), C.Root(date(1996, 1, 1), date(2000, 12, 31)))


@query("SELECT event_type AS value, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen FROM events GROUP BY 1")
def q_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("value")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"))
