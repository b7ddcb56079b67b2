"""Queries of result lists, search forms, canaries, jobs' lives and throttle gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..functions.predicates import merged, optional
from ..operators import listing as S
from ..operators import records as R
from ..sources import reports
from ..session import ship, table
from .registry import query


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result page for each customer: a grid of their orders, some without a case number or a dated movement."""
    k, lit = F.col("o_orderkey").cast("string"), F.lit
    cell = lambda n, *inner: F.concat(lit(f'<td class="rich" id="{S.GRID}:'), k, lit(f':j_{n}">'), *inner, lit("</td>"))
    number = F.when(F.col("o_orderkey") % 5 == 0, lit("sem número")).otherwise(F.concat(F.lpad(k, 7, "0"), lit("-10.2024.4.05.8300")))
    moved = F.when(F.col("o_orderkey") % 3 == 0, lit("sem data")).otherwise(lit("juntada &amp; vista (01/02/2024 10:00:00)"))
    html = F.concat(
        lit("<tr>"), cell(1, lit("""<a onclick="abrir('/d.seam?id="""), k, lit("""&amp;ca=b2"""), k, lit("""\\x2Dz')">ver</a>""")),
        cell(2, F.col("o_orderpriority"), lit(' <b class="x btn-block">Proc '), number, lit(" - Multa - ICMS</b><br/>CLIENTE "), F.col("o_custkey").cast("string"), lit("  X\n OUTROS")),
        cell(3, lit("<span>"), moved, lit("</span>")), lit("</tr>"),
    )
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", html.alias("html"))
    return rows.groupBy("o_custkey").agg(F.concat(F.lit("<table>"), F.array_join(F.sort_array(F.collect_list("html")), "\n"), F.lit("</table>")).alias("html"))


@query("""
    SELECT o_custkey, o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || '-10.2024.4.05.8300' AS number, 'b2' || o_orderkey AS token, o_orderpriority AS class, 'Proc' AS sigla, 'Multa - ICMS' AS subject,
           'CLIENTE ' || o_custkey || ' X OUTROS' AS parties, CASE WHEN o_orderkey % 3 <> 0 THEN 'juntada & vista' END AS movement, CASE WHEN o_orderkey % 3 <> 0 THEN '01/02/2024 10:00:00' END AS moved_at, false AS mojibake
    FROM orders WHERE o_orderkey % 5 <> 0
""")
def q_list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.list_rows(result_pages(spark, sf_dir), "o_custkey", "html")


_FIELDS = "[" + ", ".join(f"'{f}'" for f in S.REQUIRED_FIELDS) + "]"


@query(f"""
    SELECT page_id, CASE WHEN page_id % 7 = 1 THEN 'C-10' WHEN page_id % 7 = 2 THEN 'C-3' WHEN page_id % 7 = 3 THEN 'C-1' WHEN page_id % 7 = 4 THEN 'C-2' WHEN page_id % 7 = 5 THEN 'C-3' END AS problem,
           CASE WHEN page_id % 7 <> 2 THEN '/pje/list.seam?p=' || page_id END AS action, CASE WHEN page_id % 7 <> 3 THEN 'fPP:j_id' || page_id END AS action_id, page_id % 7 = 4 AS captcha,
           CAST(len({_FIELDS}) - CASE WHEN page_id % 7 = 5 THEN 1 ELSE 0 END AS BIGINT) AS n_fields FROM pages
""")
def q_search_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages written for each page id, most with one fault, and what they say of themselves."""
    i, lit = F.col("page_id"), F.lit
    k = i % 7
    fields = F.concat(*[lit(f'<input type="text" name="{f}"/>') if n else F.when(k == 5, lit("")).otherwise(lit(f'<select class="s" name="{f}">')) for n, f in enumerate(S.REQUIRED_FIELDS[:-1])])
    html = F.concat(
        F.when(k == 1, lit("<title>Requisição - Rejeitada</title>")).otherwise(""), lit('<form id="'), F.when(k == 2, lit("other")).otherwise(S.FORM), lit('" method="post" action="/pje/list.seam?p='), i.cast("string"), lit('">'), fields,
        lit('<input name="fPP:dnp:nomeParte"/>'), lit('</form><input type="hidden" name="javax.faces.ViewState" value="j_id1"/><script>'),
        F.when(k == 3, lit("")).otherwise(F.concat(lit("executarPesquisa = function() { A4J.submit({'parameters':{'fPP:j_id"), i.cast("string"), lit("':1}}) }"))),
        lit(" function executarReCaptcha(){ if ("), F.when(k == 4, lit("true")).otherwise("false"), lit(") {} }</script>"),
    )
    # without its own form the page has no fields but the hidden one; that count is not shown
    found = table(spark, sf_dir, "pages").select("page_id", S.form_meta(html).alias("m"), k.alias("k"))
    n = F.when(F.col("k") == 2, F.lit(len(S.REQUIRED_FIELDS))).otherwise(F.size("m.fields"))
    return found.select("page_id", "m.problem", "m.action", "m.action_id", "m.captcha", n.cast("bigint").alias("n_fields"))


@query("""
    WITH o AS (SELECT event_id AS seq, event_type AS kind, CAST(floor(value) AS BIGINT) AS v FROM events),
    l AS (SELECT seq, v % 2 AS bad, sum(CASE WHEN v % 2 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS island FROM o WHERE kind = 'click'),
    bad AS (SELECT * FROM (VALUES ('C-1', 'error', (SELECT count(*) FROM o WHERE kind = 'error' AND v % 5 = 1), 0), ('C-2', 'error', (SELECT count(*) FROM o WHERE kind = 'error' AND v % 5 = 2), 0), ('C-3', 'error', (SELECT count(*) FROM o WHERE kind = 'error' AND v % 5 = 3), 0),
        ('C-4', 'error', (SELECT count(*) FROM o WHERE kind = 'view' AND v % 40 <> 30), 0), ('C-5', 'error', 0, 0), ('C-6', 'error', (SELECT coalesce(sum(v % 2), 0) FROM o WHERE kind = 'signup'), 9),
        ('C-7', 'error', (SELECT coalesce(max(n), 0) FROM (SELECT sum(bad) AS n FROM l GROUP BY island)), 2), ('C-8', 'warn', (SELECT count(*) FROM o WHERE kind = 'purchase' AND v % 3 > 0), 0), ('C-9', 'warn', 0, 0), ('C-10', 'error', 0, 0)) t(id, severity, evidence, allowed))
    SELECT id, severity, evidence <= allowed AS ok, CAST(evidence AS BIGINT) AS evidence FROM bad
""")
def q_canaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What events stand for: forms, caps, texts, pages and probes."""
    e, v = table(spark, sf_dir, "events"), F.floor("value").cast("bigint")
    kinds = {"error": ("form", F.when((v % 5).between(1, 3), F.concat(F.lit("C-"), (v % 5).cast("string")))), "view": ("cap", (v % 40).cast("string")), "signup": ("mojibake", (v % 2).cast("string")), "click": ("labels", (v % 2).cast("string")), "purchase": ("edge", (v % 3).cast("string"))}
    kind = value = F.lit(None).cast("string")
    for name, (k, x) in kinds.items():
        kind, value = F.when(F.col("event_type") == name, k).otherwise(kind), F.when(F.col("event_type") == name, x).otherwise(value)
    return S.canaries(e.select(F.col("event_id").alias("seq"), kind.alias("kind"), value.alias("value")), cap=30, golden=24)


_JOBS = "o_orderkey AS id, o_orderpriority AS site, CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'dead' ELSE 'pending' END AS status, o_orderdate AS run_after, CAST(o_orderkey % 6 AS INT) AS attempts"


@query(f"""
    WITH j AS (SELECT {_JOBS} FROM orders), d AS (SELECT id, row_number() OVER (PARTITION BY site ORDER BY run_after, id) AS place FROM j WHERE status = 'pending' AND run_after <= TIMESTAMP '1997-01-01')
    SELECT j.id, site, CASE WHEN place <= 20 THEN 'leased' ELSE status END AS status, CASE WHEN place <= 20 THEN 'w1' END AS leased_by, CASE WHEN place <= 20 THEN '1997-01-01 00:02:00' END AS lease_until, attempts + CASE WHEN place <= 20 THEN 1 ELSE 0 END AS attempts
    FROM j LEFT JOIN d USING (id)
""")
def q_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").selectExpr(*[c.strip() for c in _split(_JOBS)], "cast(null as string) AS leased_by", "cast(null as timestamp) AS lease_until")
    out = L.claim(jobs, "id", "site", ["run_after", "id"], 20, "w1", F.lit("1997-01-01").cast("timestamp"))
    return out.select("id", "site", "status", "leased_by", F.date_format("lease_until", "yyyy-MM-dd HH:mm:ss").alias("lease_until"), F.col("attempts").cast("int").alias("attempts"))


def _split(columns: str) -> list[str]:
    return columns.split(", ")


@query(f"""
    WITH j AS (SELECT {_JOBS} FROM orders), r AS (SELECT id FROM j WHERE status = 'dead' AND site = '1-URGENT' ORDER BY id LIMIT 50)
    SELECT id, site, 'pending' AS status, 0 AS attempts FROM j JOIN r USING (id)
""")
def q_revive(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").selectExpr(*_split(_JOBS))
    return L.revive(jobs, "id", F.col("site") == "1-URGENT", 50).select("id", "site", "status", "attempts")


_EVENT = "CASE event_type WHEN 'click' THEN 'lease' WHEN 'view' THEN 'complete' WHEN 'purchase' THEN 'fail' WHEN 'error' THEN 'dead' ELSE 'revive' END"


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id, {_EVENT} AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, 'pending' AS status, CAST(0 AS BIGINT) AS attempts FROM e
          UNION ALL
          SELECT s.user_id, e.n, CASE WHEN event = 'lease' AND status = 'pending' THEN 'leased' WHEN event = 'complete' AND status = 'leased' THEN 'done' WHEN event = 'dead' AND status = 'leased' THEN 'dead'
                      WHEN event = 'fail' AND status = 'leased' THEN 'pending' WHEN event = 'revive' AND status = 'dead' THEN 'pending' ELSE status END,
                 CASE WHEN event = 'lease' AND status = 'pending' THEN attempts + 1 WHEN event = 'revive' AND status = 'dead' THEN 0 ELSE attempts END
          FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, arg_max(status, n) AS status, arg_max(attempts, n) AS attempts FROM s GROUP BY user_id
""")
def q_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.settle(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(_EVENT).alias("event")), "user_id", ["ts", "event_id"])


_GATE = "CASE event_id % 9 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'HALF_OPEN' ELSE 'CLOSED' END AS state, CAST(event_id % 4 AS BIGINT) AS in_flight, CAST(event_id % 5 AS DOUBLE) / 4 AS tokens, CAST(event_id % 8 AS BIGINT) AS opens, CAST(event_id % 3 AS INT) AS late"


@query(f"""
    WITH e AS (SELECT event_id, ts, {_GATE} FROM events), g AS (SELECT *, least(2.0, tokens + 0.1 * late) AS have FROM e),
    w AS (SELECT *, CASE WHEN state = 'OPEN' THEN 'breaker' WHEN event_id % 11 = 0 THEN 'retry-after' WHEN in_flight >= 3 THEN 'slots' WHEN have < 1 THEN 'tokens' END AS why FROM g)
    SELECT event_id, why IS NULL AS granted, why, round(CASE WHEN why IS NULL THEN have - 1 ELSE tokens END, 6) AS tokens FROM w
""")
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "cast(ts as timestamp) AS ts", *_split(_GATE))
    since = F.timestamp_micros(F.unix_micros("ts") - F.col("late") * 1_000_000)
    wait = F.when(F.col("event_id") % 11 == 0, F.timestamp_micros(F.unix_micros("ts") + 5_000_000))
    g = L.gate(F.col("state"), F.col("ts"), F.col("tokens"), F.lit(2.0), F.lit(0.1), since, wait, F.col("in_flight"), F.lit(3))
    return e.select("event_id", g.alias("g")).select("event_id", "g.granted", "g.why", F.round("g.tokens", 6).alias("tokens"))


@query(f"""
    WITH e AS (SELECT event_id, {_GATE}, CASE WHEN event_type = 'error' THEN 'OPEN' ELSE 'OK' END AS outcome FROM events)
    SELECT event_id, CASE WHEN outcome = 'OPEN' THEN 'OPEN' WHEN state = 'HALF_OPEN' THEN 'CLOSED' WHEN state = 'OPEN' AND late < 2 THEN 'HALF_OPEN' ELSE state END AS state,
           CASE WHEN outcome = 'OPEN' THEN opens + 1 WHEN state = 'HALF_OPEN' THEN 0 ELSE opens END AS opens, outcome = 'OPEN' AND opens >= 4 AS abort,
           CASE WHEN outcome = 'OPEN' THEN CAST(least(600, 60 * power(2, opens)) AS BIGINT) WHEN state = 'HALF_OPEN' THEN NULL ELSE CAST(late - 1 AS BIGINT) END AS wait_s FROM e
""")
def q_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "cast(ts as timestamp) AS ts", *_split(_GATE))
    until = F.timestamp_micros(F.unix_micros("ts") + (F.col("late") - 1) * 1_000_000)
    b = L.breaker(F.col("state"), F.col("opens"), until, F.col("ts"), F.when(F.col("event_type") == "error", "OPEN").otherwise("OK"))
    wait = ((F.unix_micros("b.until") - F.unix_micros("ts")) / 1_000_000).cast("bigint")
    return e.select("event_id", "ts", b.alias("b")).select("event_id", "b.state", "b.opens", "b.abort", wait.alias("wait_s"))


@query("""
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id_doc, CASE o_orderkey % 3 WHEN 0 THEN 'Acórdão' WHEN 1 THEN 'Petição inicial' ELSE 'documento' END AS kind, CASE WHEN o_orderkey % 3 < 2 THEN '11/05/2026 00:36:17' END AS at,
           CASE WHEN o_orderkey % 3 = 0 THEN 'Acórdão ' || o_custkey END AS title FROM orders
""")
def q_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents: with a title, without one, and without a date; scripts in between say nothing."""
    k, lit = F.col("o_orderkey"), F.lit
    text = F.when(k % 3 == 0, F.concat(lit("Visualizar 11/05/2026 00:36:17 - Acórdão (Acórdão "), F.col("o_custkey").cast("string"), lit(") x"))).when(k % 3 == 1, lit("Visualizar 11/05/2026 00:36:17 – Petição inicial")).otherwise("Visualizar")
    link = F.concat(lit("""<a onclick="open('/r?idProcessoDoc="""), k.cast("string"), lit("""&amp;idBin=7')">ver</a>"""))
    html = F.concat(lit("<table><tr><td>"), link, lit("<script>var t = '01/01/2020 00:00:00 - f (x)';</script></td><td>"), text, lit("</td></tr></table>"))
    ship(spark)
    pages = table(spark, sf_dir, "orders").select("o_orderkey", html.alias("html"))
    found = R.parse_details(pages, "o_orderkey", "html").select("o_orderkey", F.explode("document_rows").alias("d"))
    return found.select("o_orderkey", "d.id_doc", "d.kind", "d.at", "d.title")


@query("""
    SELECT o_orderkey, o_custkey AS a, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey END AS b, CASE WHEN o_orderkey % 2 = 0 THEN 7 END AS c FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def q_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps merged, the later one's values first; a filter that is given applies, one that isn't lets all pass."""
    lit, k = F.lit, F.col("o_orderkey")
    mine = F.create_map(lit("a"), F.col("o_custkey"), lit("b"), k)
    more = F.when(k % 2 == 0, F.create_map(lit("b"), lit(0).cast("bigint"), lit("c"), lit(7).cast("bigint"))).otherwise(F.create_map().cast("map<string,bigint>"))
    rows = table(spark, sf_dir, "orders").where(optional(F.col("o_orderpriority"), "1-URGENT") & optional(F.col("o_orderstatus"), None))
    m = rows.select("o_orderkey", merged(mine, more).alias("m"))
    return m.select("o_orderkey", *[F.try_element_at("m", lit(x)).alias(x) for x in "abc"])


@query("""
    WITH m AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1),
    l AS (SELECT 0 AS place, '# Coverage' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| month | rows | days with rows |' UNION ALL SELECT 3, '|---|---|---|'
          UNION ALL SELECT 3 + row_number() OVER (ORDER BY month), '| ' || month || ' | ' || n || ' | ' || days || ' |' FROM m)
    SELECT CAST(place AS BIGINT) AS place, line FROM l
""")
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    months = e.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).groupBy("month").agg(F.sum("n").alias("rows"), F.count("*").alias("days with rows"))
    return reports.markdown("Coverage", months, ["month"])
