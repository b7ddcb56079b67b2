"""Queries of cleaning, validation, identity, hashing and raw bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import dates as D
from ..functions import identity as I
from ..functions import text as T
from ..session import ship, table
from .registry import query

_BASE = "lpad(CAST(o_orderkey AS VARCHAR), 7, '0') || year(o_orderdate) || '405' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '00'"


@query(f"""
    WITH d AS (SELECT o_orderkey, lpad(CAST(98 - CAST({_BASE} AS HUGEINT) % 97 AS VARCHAR), 2, '0') AS good, lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS seq, year(o_orderdate) AS y, lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS orig FROM orders),
    n AS (SELECT o_orderkey, good, CASE o_orderkey % 5 WHEN 0 THEN '00' ELSE good END AS dd, seq, y, orig FROM d)
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'x' || seq ELSE seq || '-' || dd || '.' || y || '.4.05.' || orig END AS number, o_orderkey % 7 <> 0 AS well_formed,
           CASE WHEN o_orderkey % 7 <> 0 THEN dd = good END AS valid, CASE WHEN o_orderkey % 7 <> 0 THEN 'Justiça Federal' END AS segment FROM n
""")
def q_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    seq, year, origin = F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.date_format("o_orderdate", "yyyy"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    digit = F.when(F.col("o_orderkey") % 5 == 0, "00").otherwise(I.check_digit(seq, year, F.lit("4"), F.lit("05"), origin))
    number = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("x"), seq)).otherwise(F.concat(seq, F.lit("-"), digit, F.lit("."), year, F.lit(".4.05."), origin))
    named = orders.select("o_orderkey", number.alias("number")).withColumn("p", I.parse_case_number(F.col("number")))
    return named.select("o_orderkey", "number", F.col("p").isNotNull().alias("well_formed"), "p.valid", I.segment_name(F.col("p.segment")).alias("segment"))


def _digit_sql(weights: list[int]) -> str:
    return " + ".join(f"CAST(d[{k + 1}] AS INTEGER) * {w}" for k, w in enumerate(weights))


@query(f"""
    WITH n AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000000000 AS VARCHAR), 9, '0') || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS d FROM customer)
    SELECT c_custkey, d AS digits, d[1:3] || '.' || d[4:6] || '.' || d[7:9] || '-' || d[10:11] AS formatted,
           NOT regexp_full_match(d, '0+|1+|2+|3+|4+|5+|6+|7+|8+|9+') AND ({_digit_sql(list(range(10, 1, -1)))}) * 10 % 11 % 10 = CAST(d[10] AS INTEGER) AND ({_digit_sql(list(range(11, 1, -1)))}) * 10 % 11 % 10 = CAST(d[11] AS INTEGER) AS valid FROM n
""")
def q_cpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    digits = F.concat(F.lpad((key * 7919 % 1_000_000_000).cast("string"), 9, "0"), F.lpad((key % 100).cast("string"), 2, "0"))
    parsed = table(spark, sf_dir, "customer").select("c_custkey", I.parse_person_id(F.lit("CPF"), digits).alias("p"))
    return parsed.select("c_custkey", "p.digits", "p.formatted", "p.valid")


def _company_sql(weights: list[int], at: int) -> str:
    return f"CASE WHEN ({_digit_sql(weights)}) % 11 < 2 THEN 0 ELSE 11 - ({_digit_sql(weights)}) % 11 END = CAST(d[{at}] AS INTEGER)"


@query(f"""
    WITH n AS (SELECT s_suppkey, lpad(CAST(s_suppkey * 104729 % 100000000 AS VARCHAR), 8, '0') || '0001' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS d FROM supplier)
    SELECT s_suppkey, d AS digits, {_company_sql(I.COMPANY_FIRST, 13)} AND {_company_sql(I.COMPANY_SECOND, 14)} AS valid FROM n
""")
def q_cnpj(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    digits = F.concat(F.lpad((key * 104729 % 100_000_000).cast("string"), 8, "0"), F.lit("0001"), F.lpad((key % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", digits.alias("digits"), I.valid_company(digits).alias("valid"))


@query("""
    SELECT event_id, strftime(ts, '%Y-%m-%d') || '..' || strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') || CASE WHEN event_id % 2 = 0 THEN '|class=' || event_type || ',user=' || user_id ELSE '' END AS id FROM events
""")
def q_partition_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("class"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>"))
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").select("event_id", I.partition_id(day, F.date_add(day, 3), facets).alias("id"))


_SAFE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[^A-Za-z0-9._-]', '_', 'g'), '_{{2,}}', '_', 'g'), '^[._]+', ''), '[._]+$', '')"


def _safe_sql(x: str) -> str:
    return f"CASE WHEN {_SAFE.format(x)} = '' THEN 'unknown' ELSE left({_SAFE.format(x)}, 120) END"


@query(f"""
    SELECT page_id, 'br-x/' || CASE WHEN page_id % 4 = 0 THEN 'unknown' ELSE CAST(2000 + page_id % 20 AS VARCHAR) END || '/' || {_safe_sql("url")} || '/' || {_safe_sql("url")} || '__' || {_safe_sql("k")} || CASE WHEN page_id % 3 = 0 THEN '' ELSE '__' || page_id END || '.pdf' AS storage_key,
           k || ':' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE ':' || page_id END AS logical_key
    FROM (SELECT *, CASE page_id % 3 WHEN 0 THEN 'relatório' WHEN 1 THEN '..' ELSE 'recibo' END AS k FROM pages)
""")
def q_blob_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    kind = F.when(n % 3 == 0, "relatório").when(n % 3 == 1, "..").otherwise("recibo")
    day = F.when(n % 4 != 0, F.make_date(2000 + n % 20, F.lit(1), F.lit(1)))
    doc = F.when(n % 3 != 0, n.cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", T.storage_key(F.lit("br-x"), day, F.col("url"), kind, doc).alias("storage_key"), T.logical_key(kind, n.cast("string"), doc).alias("logical_key"))


@query("SELECT c_custkey, '***-' || right(d, 2) AS report, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '***' || right(d, 2) END AS export FROM (SELECT c_custkey, lpad(CAST(c_custkey * 31 AS VARCHAR), 11, '0') AS d FROM customer)")
def q_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad((F.col("c_custkey") * 31).cast("string"), 11, "0")
    shown = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(digits)
    return table(spark, sf_dir, "customer").select("c_custkey", I.report_mask(digits).alias("report"), I.export_mask(shown).alias("export"))


@query(r"""
    SELECT doc_id, md5(c) AS digest, CAST(length(c) AS BIGINT) AS n FROM (
        SELECT doc_id, nfc_normalize(trim(regexp_replace('  ' || replace(replace(text, ' ', chr(160) || ' '), 'é', 'e' || chr(769)) || chr(10), '[\s\x{A0}]+', ' ', 'g'))) AS c FROM documents)
""")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with no-break spaces, decomposed letters and loose ends, cleaned."""
    ship(spark)
    damaged = F.concat(F.lit("  "), F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("é"), F.lit("é")), F.lit("\n"))
    cleaned = table(spark, sf_dir, "documents").select("doc_id", T.clean(damaged).alias("c"))
    return cleaned.select("doc_id", F.md5("c").alias("digest"), F.char_length("c").cast("bigint").alias("n"))


@query("""
    SELECT doc_id, doc_id % 3 = 0 AND (contains(text, 'é') OR contains(text, 'ä') OR contains(text, 'ó')) AS damaged FROM documents
""")
def q_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the texts have three letters as they look when UTF-8 is read as Latin-1."""
    text = F.col("text")
    for letter in "éäó":
        text = F.replace(text, F.lit(letter), F.lit(letter.encode().decode("latin-1")))
    shown = F.when(F.col("doc_id") % 3 == 0, text).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.has_mojibake(shown).alias("damaged"))


@query("SELECT DISTINCT lang, upper(strip_accents(replace(w, 'ß', 'SS'))) AS folded FROM (SELECT lang, unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM documents)")
def q_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("\\p{L}+"), F.lit(0))).alias("w")).distinct()
    return words.select("lang", T.fold_any(F.col("w")).alias("folded")).distinct()


@query("""SELECT doc_id, sha256('{"docId":' || doc_id || ',"lang":"' || lang || '","nChars":' || n_chars || ',"source":"' || source || '","title":null}') AS hash FROM documents""")
def q_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"source": F.col("source"), "docId": F.col("doc_id"), "title": F.lit(None).cast("string"), "nChars": F.col("n_chars"), "lang": F.col("lang"), "listedAt": F.lit("now")}
    return table(spark, sf_dir, "documents").select("doc_id", B.content_hash(fields).alias("hash"))


@query("""
    WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN '1/2/' || year(o_orderdate) WHEN 2 THEN '31/02/' || year(o_orderdate) WHEN 3 THEN '' ELSE strftime(o_orderdate, '%d/%m/%Y') || ' ' END AS text FROM orders),
    d AS (SELECT o_orderkey, text, CASE WHEN regexp_full_match(text, '\\d{2}/\\d{2}/\\d{4}') THEN CAST(try_strptime(text, '%d/%m/%Y') AS DATE) END AS day FROM t)
    SELECT o_orderkey, text, day, strftime(day, '%m/%Y') AS month, strftime(day, '%Y-%m-%d') || 'T00:00:00-03:00' AS begins FROM d
""")
def q_br_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    year = F.date_format("o_orderdate", "yyyy")
    text = F.when(n % 5 == 0, D.br_from_day(day)).when(n % 5 == 1, F.concat(F.lit("1/2/"), year)).when(n % 5 == 2, F.concat(F.lit("31/02/"), year)).when(n % 5 == 3, "").otherwise(F.concat(D.br_from_day(day), F.lit(" ")))
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).withColumn("day", D.day_from_br(F.col("text")))
    return parsed.select("o_orderkey", "text", "day", D.br_month(F.col("day")).alias("month"), D.start_of_day(F.col("day")).alias("begins"))


@query(r"""
    SELECT page_id, 'utf-8' AS charset, CASE WHEN page_id % 3 = 0 OR NOT regexp_matches(html, '[\x{80}-\x{FF}]') THEN 'strict-utf8' ELSE 'document' END AS via FROM pages
""")
def q_charset_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the pages are sent as UTF-8, the others as Latin-1 under a document that says UTF-8."""
    plain = F.regexp_replace("html", r"[^\u0000-ÿ]", "?")
    body = F.when(F.col("page_id") % 3 == 0, F.encode("html", "UTF-8")).otherwise(F.encode(plain, "ISO-8859-1"))
    return table(spark, sf_dir, "pages").select("page_id", B.charset(body, F.lit("text/html")).alias("c")).select("page_id", "c.charset", "c.via")


@query("""
    WITH b AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN '%PDF-1.4' || html || '%%EOF' WHEN 2 THEN '%PDF-1.4 %%EOF' WHEN 3 THEN '%PDF-1.7' || html ELSE '%PDF-1.5' || html || '%%EOF' || repeat(' ', 100) END AS body FROM pages)
    SELECT page_id, CAST(strlen(body) AS BIGINT) AS bytes, CASE WHEN NOT starts_with(body, '%PDF-') THEN 'NOT_PDF' WHEN page_id % 2 = 1 AND page_id % 5 = 1 THEN 'PDF_LENGTH_MISMATCH' WHEN strlen(body) < 1024 THEN 'PDF_TOO_SMALL' WHEN NOT contains(body, '%%EOF') THEN 'PDF_TRUNCATED' ELSE 'OK' END AS verdict FROM b
""")
def q_blob_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, html = F.col("page_id"), F.col("html")
    text = (
        F.when(n % 5 == 0, html).when(n % 5 == 1, F.concat(F.lit("%PDF-1.4"), html, F.lit("%%EOF"))).when(n % 5 == 2, "%PDF-1.4 %%EOF")
        .when(n % 5 == 3, F.concat(F.lit("%PDF-1.7"), html)).otherwise(F.concat(F.lit("%PDF-1.5"), html, F.lit("%%EOF" + " " * 100)))
    )
    body = F.encode(text, "UTF-8")
    declared = F.octet_length(body) + F.when((n % 2 == 1) & (n % 5 == 1), 1).otherwise(0)
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(body).cast("bigint").alias("bytes"), B.file_verdict(body, declared).alias("verdict"))
