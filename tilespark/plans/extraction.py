"""Queries of extraction: pages, labelled fields, subjects, participants, ordinals, nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..session import ship, table
from .registry import query


@query("""
    SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, lower(regexp_extract(html, 'charset="([A-Za-z0-9-]+)"', 1)) AS charset, trim(regexp_extract(html, '<title>([^<]{0,80})', 1)) AS title,
           CAST(len(regexp_extract_all(html, '<a href="([^"]*)"')) AS BIGINT) AS n_links, contains(html, '<form') AS has_form FROM pages
""")
def q_page_form_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), F.lower(F.regexp_extract(html, 'charset="([A-Za-z0-9-]+)"', 1)).alias("charset"), F.trim(F.regexp_extract(html, "<title>([^<]{0,80})", 1)).alias("title"),
        F.size(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).cast("bigint").alias("n_links"), html.contains("<form").alias("has_form"),
    )


@query("""
    WITH d AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, n, CASE WHEN o_custkey % 11 = 0 THEN 'never searched' WHEN o_custkey % 13 = 0 AND n >= 12 THEN 'cap changed' WHEN n >= 12 THEN 'truncated' WHEN o_custkey % 7 = 0 THEN 'empty' ELSE 'rows' END AS state FROM d
""")
def q_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages written for each customer's orders, and what they say of themselves."""
    found = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    k, n = F.col("o_custkey"), F.col("n")
    banner = F.when(n >= 12, F.concat(F.lit("<b>somente os "), F.when(k % 13 == 0, "20").otherwise("12"), F.lit(" primeiros</b>"))).otherwise("")
    shown = F.when((k % 7 == 0) & (n < 12), "").otherwise(F.least(n, F.lit(12)).cast("string"))
    footer = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit('<span class="text-muted"> '), shown, F.lit(" resultados encontrados</span>")))
    return found.select("o_custkey", "n", R.page_state(F.concat(F.lit("<div>"), banner, footer, F.lit("</div>")), 12).alias("state"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detail page for each order: nested and bold-labelled fields, a panel, repeated movements and a document."""
    # the pages are made here: rows are dealt out first, as a table of one small file would leave the parser to one task
    o = table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism)
    k, lit = F.col("o_orderkey").cast("string"), F.lit
    field = lambda name, value: F.concat(lit(f'<div class="propertyView"><div class="name"><label>{name}</label></div><div class="value">'), value, lit("</div></div>"))
    number = F.when(F.col("o_orderkey") % 4 == 0, lit("")).otherwise(field("Número Processo", F.concat(lit("<span> "), k, lit("&nbsp;</span>"))))
    moved = F.concat(lit("<tr><td>01/02/2024 10:00:00 - juntada "), k, lit("</td></tr>"))
    html = F.concat(
        lit('<html><body><div class="propertyView">'), number, field("Classe Judicial", F.col("o_orderpriority")), lit("</div>"),
        lit('<div class="propertyView"><div class="name"><label></label></div><div class="value"><b>Órgão Julgador</b><br/>Vara '), F.col("o_custkey").cast("string"), lit("<br/><b>Jurisdição</b><br/>Sul &amp; Norte</div></div>"),
        lit('<div class="rich-panel-header">Polo ativo</div><div class="rich-panel-body"><span class="text-bold">CLIENTE '), F.col("o_custkey").cast("string"), lit(" (AUTOR)</span></div><table>"), moved, moved,
        lit("""<tr><td><a onclick="open('/r?idBin="""), k, lit("&amp;idProcessoDoc=9"), k, lit("""')">ver</a></td></tr></table></body></html>"""),
    )
    return o.select("o_orderkey", html.alias("html"))


@query("""
    SELECT o_orderkey, label, value FROM (
        SELECT o_orderkey, unnest(['Número Processo', 'Classe Judicial', 'Órgão Julgador', 'Jurisdição', 'participants', 'movements', 'documents']) AS label,
               unnest([CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS VARCHAR) END, o_orderpriority, 'Vara ' || o_custkey, 'Sul & Norte', 'Polo ativo: CLIENTE ' || o_custkey || ' (AUTOR)', '01/02/2024 10:00:00 juntada ' || o_orderkey, '9' || o_orderkey || '/' || o_orderkey]) AS value FROM orders) WHERE value IS NOT NULL
""")
def q_html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    parsed = R.parse_details(detail_pages(spark, sf_dir), "o_orderkey", "html")
    pair = lambda name, c: F.transform(c, lambda x: F.struct(F.lit(name).alias("label"), x.alias("value")))
    rows = F.concat(
        "fields", pair("participants", F.transform("participants", lambda p: F.concat(p["heading"], F.lit(": "), p["line"]))),
        pair("movements", F.transform("movements", lambda m: F.concat(m["at"], F.lit(" "), m["text"]))), pair("documents", F.transform("documents", lambda d: F.concat(d["id_doc"], F.lit("/"), d["id_bin"]))),
    )
    return parsed.select("o_orderkey", F.explode(rows).alias("x")).select("o_orderkey", "x.label", "x.value")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Número Processo,Assunto' ELSE 'Assunto' END AS missing, true AS enough FROM orders
""")
def q_missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    parsed = R.parse_details(detail_pages(spark, sf_dir), "o_orderkey", "html").select("o_orderkey", F.col("fields.label").alias("found"))
    return parsed.select("o_orderkey", F.array_join(R.missing_labels(F.col("found")), ",").alias("missing"), R.enough_labels(F.col("found")).alias("enough"))


@query("SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) END AS code FROM part")
def q_name_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" "))).otherwise(F.concat("p_name", F.lit("  ("), F.col("p_size").cast("string"), F.lit(")")))
    return table(spark, sf_dir, "part").select("p_partkey", R.name_code(text).alias("x")).select("p_partkey", "x.name", "x.code")


@query("""
    SELECT p_partkey, CAST(level AS BIGINT) AS level, code, name FROM (
        SELECT p_partkey, unnest([0, 1, 2]) AS level, unnest([p_partkey, CAST(p_size AS BIGINT), CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 7 END]) AS code, unnest([p_name, p_brand, p_type]) AS name FROM part)
""")
def q_subject_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a text, one with an unclosed parenthesis, and a last name without a code in half the texts."""
    p = table(spark, sf_dir, "part")
    text = F.concat("p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(") - "), "p_brand", F.lit(" ("), F.col("p_size").cast("string"), F.lit(" "), "p_type", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" (7)"))
    found = p.select("p_partkey", F.explode(R.subjects(text)).alias("s"))
    return found.select("p_partkey", F.col("s.level").cast("bigint").alias("level"), "s.code", "s.name")


@query("""
    SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'RN' END AS uf, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey + 100 AS VARCHAR) END AS registration, CASE WHEN c_custkey % 3 = 0 THEN 'CPF' END AS doc_kind,
           CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 11, '0') END AS doc, CASE WHEN c_custkey % 2 = 0 THEN 'ADVOGADO' ELSE 'APELANTE' END AS kind, c_custkey % 2 = 0 AS lawyer FROM customer WHERE c_custkey % 5 <> 0
""")
def q_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    bar = F.when(k % 2 == 0, F.concat(F.lit(" - OAB RN"), (k + 100).cast("string"))).otherwise("")
    doc = F.when(k % 3 == 0, F.concat(F.lit(" - CPF: "), F.lpad(k.cast("string"), 11, "0"))).otherwise("")
    line = F.when(k % 5 == 0, F.col("c_name")).otherwise(F.concat("c_name", bar, doc, F.lit(" ("), F.when(k % 2 == 0, "ADVOGADO").otherwise("APELANTE"), F.lit(")")))
    return table(spark, sf_dir, "customer").select("c_custkey", R.participant(line).alias("p")).where("p is not null").select("c_custkey", "p.*")


@query("""
    SELECT o_orderkey, 'cover' AS kind, NULL AS id_doc, NULL AS id_bin FROM orders
    UNION ALL SELECT l_orderkey, 'receipt', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N'
""")
def q_documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("string").alias("id_doc"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey").cast("string")).alias("id_bin"))
    cases = R.nested(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", ["id_doc", "id_bin"], "docs")
    return cases.select("o_orderkey", F.explode(R.documents_of(F.col("docs"))).alias("d")).select("o_orderkey", "d.*")


@query("""
    WITH f AS (SELECT l_orderkey, l_returnflag, l_suppkey, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_orderkey, l_returnflag, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY pos, l_suppkey) - 1 AS ordinal FROM f
""")
def q_party_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers within each side in the order of the page, after the first of each name is kept."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_suppkey").agg(F.min("l_linenumber").alias("pos"))
    return R.ordinals(first, ["l_orderkey", "l_returnflag"], ["pos", "l_suppkey"], "ordinal").drop("pos")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) - 1 AS seq FROM conversations")
def q_movement_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return R.ordinals(rows, ["conv_id"], [F.col("turn").desc(), "role", "text"], "seq").select("conv_id", "turn", "role", "seq")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def q_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    # by digest, so that the shuffle doesn't carry texts; a minimum pre-aggregates, so no group of copies is a hot task
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


@query("""
    SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines, count(l_orderkey) AS n
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def q_nest_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    cases = R.nested(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey"], "c")
    text = F.array_join(F.transform("c", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",")
    return cases.select("o_orderkey", text.alias("lines"), F.size("c").cast("bigint").alias("n"))
