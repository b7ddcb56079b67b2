"""Golden vectors of the scalar functions."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tilespark.functions import bytes as B
from tilespark.functions import dates as D
from tilespark.functions import identity as I
from tilespark.functions import text as T
from tilespark.operators import records as R
from tilespark.operators import workqueue as Q


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,valid", [("0000001-66.2024.4.05.0000", True), ("0010001-28.2024.4.05.0000", True), ("0000001-67.2024.4.05.0000", False), ("00000001-66.2024.4.05.0000", None), ("0000001-66.2024.44.05.0000", None), ("not a number", None), (None, None)]
)
def test_case_numbers(spark, text, valid):
    parsed = one(spark, I.parse_case_number, text)
    assert (parsed["valid"] if parsed else None) == valid


def test_find_case_number(spark):
    assert one(spark, I.find_case_number, "see 0000001-66.2024.4.05.0000 and others") == "0000001-66.2024.4.05.0000"
    assert one(spark, I.find_case_number, "none") is None


@pytest.mark.parametrize("kind,text,valid", [("CPF", "111.444.777-35", True), ("CPF", "111.111.111-11", False), ("CPF", "000.000.000-00", False), ("CNPJ", "11.222.333/0001-81", True), ("CNPJ", "11.111.111/1111-11", False)])
def test_person_ids(spark, kind, text, valid):
    parsed = one(spark, lambda c: I.parse_person_id(F.lit(kind), c), text)
    assert parsed["valid"] is valid
    assert parsed["formatted"] == text


def test_person_id_shapes(spark):
    assert one(spark, lambda c: I.parse_person_id(F.lit("CPF"), c), "123") is None
    assert one(spark, lambda c: I.parse_person_id(F.lit("PASSPORT"), c), "AB1")["valid"] is None
    assert one(spark, I.infer_person_id, "11.222.333/0001-81")["kind"] == "CNPJ"
    assert one(spark, I.infer_person_id, "1") is None


def test_masks(spark):
    assert one(spark, I.report_mask, "11144477735") == "***-35"
    assert one(spark, I.export_mask, "11144477735") == "***35"
    assert one(spark, I.export_mask, "") == ""


def test_clean(spark):
    assert one(spark, T.clean, "  APELAÇÃO   CÍVEL \n ") == "APELAÇÃO CÍVEL"
    assert one(spark, T.clean_or_null, "   ") is None
    assert one(spark, T.clean, "cão") == "cão"
    assert one(spark, T.clean, None) is None


@pytest.mark.parametrize("text,damaged", [("APELAÃ\u0087", True), ("APELAÃ‡", True), ("São Paulo, ação, coração", False)])
def test_mojibake(spark, text, damaged):
    assert one(spark, T.has_mojibake, text) is damaged


def test_mojibake_samples(spark):
    text = "x" * 30 + "Ã\u0087" + "y" * 30
    assert one(spark, T.mojibake_samples, text) == ["x" * 12 + "Ã\u0087" + "y" * 10]


def test_fold_and_unescape(spark):
    assert one(spark, T.fold, "APELAÇÃO CÍVEL") == one(spark, T.fold, "apelação  cível") == one(spark, T.fold_any, "apelação  cível") == "APELACAO CIVEL"
    assert one(spark, T.unescape, r"ca=b22e\x2Dac") == one(spark, T.unescape_common, r"ca=b22e\x2Dac") == "ca=b22e-ac"
    assert one(spark, T.unescape, r"é\/\'") == "é/'"


def test_form_encoding(spark):
    assert one(spark, T.urlencode_latin1, "ação b") == "a%E7%E3o+b"
    assert one(spark, T.unrepresentable_latin1, "aé€") == ["€"]


def test_canonical_json(spark):
    fields = {"b": F.lit(None).cast("string"), "a": F.col("x"), "ca": F.lit("token")}
    assert one(spark, lambda c: B.canonical_json(fields), 1, "int") == '{"a":1,"b":null}'
    assert one(spark, lambda c: B.content_hash(fields), 1, "int") == "46e0ff59f6164548317489fbea1133a48f7a83c325c3535e44559c9619afb76b"


@pytest.mark.parametrize("text,day", [("29/02/2024", datetime.date(2024, 2, 29)), ("31/02/2024", None), ("29/02/2023", None), ("00/01/2024", None), ("15/13/2024", None), ("15/5/2024", None), ("", None)])
def test_days(spark, text, day):
    assert one(spark, D.day_from_br, text) == day


def test_iso_days_and_times(spark):
    assert one(spark, D.is_iso_day, "2024-02-29") is True
    assert one(spark, D.is_iso_day, "2024-5-15") is False
    assert one(spark, D.is_iso_day, "2023-02-29") is False
    assert one(spark, D.time_from_br, "11/05/2026 00:36") == "2026-05-11T00:36:00-03:00"
    assert one(spark, D.time_from_br, "11/05/2026 25:36:00") is None


@pytest.mark.parametrize("days", [2, 3, 4, 365, 366, 13_514])
def test_halves_tile(spark, days):
    first = datetime.date(1990, 1, 1)
    last = first + datetime.timedelta(days - 1)
    left, right = spark.createDataFrame([(first, last)], "a date, b date").select(D.halves(F.col("a"), F.col("b")).alias("h")).first()["h"]
    assert left["first"] == first and right["last"] == last and right["first"] == left["last"] + datetime.timedelta(1)
    assert (left["last"] - left["first"]).days + 1 == days // 2


def test_one_day_has_no_halves(spark):
    day = datetime.date(2024, 1, 1)
    assert spark.createDataFrame([(day, day)], "a date, b date").select(D.halves(F.col("a"), F.col("b")).alias("h")).first()["h"] is None


def test_backoff(spark):
    waits = spark.range(1).select(Q.backoff_sequence(5, F.lit(1000).cast("bigint"), F.lit(60000).cast("bigint"), F.lit(1.0)).alias("w")).first()["w"]
    assert waits == [1000, 3000, 9000, 27000, 60000]


@pytest.mark.parametrize("header,wait", [("3", 3000), (" 120 ", 120000), ("Mon, 15 Jan 2024 10:00:30 GMT", 30000), ("Mon, 01 Jan 2024 00:00:00 GMT", 0), ("soon", None), ("", None), (None, None)])
def test_retry_after(spark, header, wait):
    assert one(spark, lambda c: D.retry_after_ms(c, F.lit("2024-01-15 10:00:00").cast("timestamp")), header) == wait


@pytest.mark.parametrize("text,cell", [("a,b", '"a,b"'), ('he said "no"', '"he said ""no"""'), (" leading", '" leading"'), ("plain", "plain"), (None, "")])
def test_csv_cell(spark, text, cell):
    assert one(spark, T.csv_cell, text) == cell


def test_camel_case():
    assert T.camel_case("id_origem") == "idOrigem"
    assert T.camel_case("sha256") == "sha256"


@pytest.mark.parametrize("ms,text", [(3_840_000, "1h 04m"), (252_000, "4m 12s"), (9_400, "9s"), (-5, "0s")])
def test_duration(spark, ms, text):
    assert one(spark, D.duration, ms, "bigint") == text


@pytest.mark.parametrize(
    "body,declared,verdict",
    [(b"<html>", None, "NOT_PDF"), (b"%PDF-1.4" + b"x" * 2000 + b"%%EOF", 5, "PDF_LENGTH_MISMATCH"), (b"%PDF-1.4 %%EOF", None, "PDF_TOO_SMALL"), (b"%PDF-1.4" + b"%%EOF" + b"x" * 5000, None, "PDF_TRUNCATED"), (b"%PDF-1.4" + b"x" * 2000 + b"%%EOF\n", None, "OK")],
)
def test_file_verdicts(spark, body, declared, verdict):
    row = spark.createDataFrame([(bytearray(body), declared)], "b binary, d int").select(B.file_verdict(F.col("b"), F.col("d")).alias("v")).first()
    assert row["v"] == verdict


def test_charsets(spark):
    pick = lambda body, kind: tuple(spark.createDataFrame([(bytearray(body), kind)], "b binary, k string").select(B.charset(F.col("b"), F.col("k")).alias("c")).first()["c"])
    assert pick("é".encode(), None) == ("utf-8", "strict-utf8")
    assert pick(b"\xe9", "text/html; charset=ISO-8859-1") == ("iso-8859-1", "header")
    assert pick(b'<meta charset="latin1">\xe9', "text/html") == ("iso-8859-1", "document")
    assert pick(b"\xe9", None) == ("iso-8859-1", "fallback-latin1")


def test_subjects_with_an_unclosed_parenthesis(spark):
    found = one(spark, R.subjects, "DIREITO (14) - Crédito (5986 OUTRO RAMO (9985) - sem código")
    assert [(s["level"], s["code"], s["name"]) for s in found] == [(0, 14, "DIREITO"), (1, 5986, "Crédito"), (2, 9985, "OUTRO RAMO"), (3, None, "sem código")]


def test_participants(spark):
    p = one(spark, R.participant, "FULANO DE TAL - OAB RN1966 - CPF: 111.444.777-35 (ADVOGADO)")
    assert (p["name"], p["uf"], p["registration"], p["doc_kind"], p["lawyer"]) == ("FULANO DE TAL", "RN", "1966", "CPF", True)
    assert one(spark, R.participant, "EMPRESA X LTDA (APELANTE)")["lawyer"] is False
    assert one(spark, R.participant, "no kind") is None


def test_detail_page():
    html = """<div class="propertyView"><div class="propertyView"><div class="name"><label>Classe Judicial</label></div><div class="value"> A &amp; B </div></div></div>
    <div class="propertyView"><div class="name"><label></label></div><div class="value"><b>Endereço</b><br/>Cais<br/><b>Vara</b><br/>2</div></div>
    <table><tr><td>01/02/2024 10:00:00 - juntada</td></tr><tr><td>01/02/2024 10:00:00 - juntada</td></tr></table><a onclick="go('idProcessoDoc=5&amp;idBin=7')">x</a>"""
    found = R.detail(html)
    assert {f["label"]: f["value"] for f in found["fields"]} == {"Classe Judicial": "A & B", "Endereço": "Cais", "Vara": "2"}
    assert found["movements"] == [{"at": "01/02/2024 10:00:00", "text": "juntada"}]
    assert found["documents"] == [{"id_doc": "5", "id_bin": "7"}]
    assert R.detail(None)["fields"] == []
