"""Result lists, forms, canaries, reports, exports and the scratch folder, at their edges."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tilespark import session
from tilespark.functions.predicates import in_language, merged, optional
from tilespark.operators import listing, records
from tilespark.sources import reports


def test_list_rows_at_the_edges(spark):
    cell = lambda i, n, x: f'<td class="a" id="fPP:processosTable:{i}:j_{n}">{x}</td>'
    page = cell(7, 1, "<a onclick=\"go('/d?ca=b22e\\x2Dac')\">x</a>") + cell(7, 2, '<i>a</i>Classe Y <b class="btn-block">SIG 0000001-10.2024.4.05.8300 - Um - Dois</b> \n ') + cell(7, 3, "<p>fim (01/02/2024 10:00:00)</p>")
    rows = [(1, page), (2, cell(8, 1, "no number")), (3, ""), (4, None), (5, "<td id='x'>0000001-10.2024.4.05.8300</td>")]
    got = listing.list_rows(spark.createDataFrame(rows, "page int, html string"), "page", "html").collect()
    assert [(r["page"], r["id"], r["number"], r["token"], r["sigla"], r["subject"], r["movement"], r["moved_at"]) for r in got] == [(1, 7, "0000001-10.2024.4.05.8300", "b22e", "SIG", "Um - Dois", "fim", "01/02/2024 10:00:00")]


def test_form_without_anything(spark):
    got = spark.createDataFrame([(None,), ("",), ("<title>Requisicao Rejeitada</title>",)], "html string").select(listing.form_meta(F.col("html")).alias("m")).select("m.problem").collect()
    assert [r[0] for r in got] == ["C-3", "C-3", "C-10"]


def test_checks_are_registered_once():
    with pytest.raises(ValueError):
        listing.register_check("C-1", "error", "again")
    assert len(listing.CHECKS) == 10


def test_document_rows():
    assert records.described("x 11/05/2026 00:36:17 - Tipo (Título) y") == ("Tipo", "11/05/2026 00:36:17", "Título")
    assert records.described("11/05/2026 00:36:17 sem traço") == ("documento", None, None)
    assert records.described("11/05/2026 00:36:17 - " + "z" * 81) == ("documento", None, None)
    assert records.link_ids("open('/r?idProcessoDoc=1') '/q?idBin=2&idProcessoDoc=3'") == ("3", "2") and records.link_ids("/r?idBin=1") is None
    deep = "<div>" * 3000 + "01/02/2024 10:00:00 - a" + "</div>" * 3000
    assert records.detail(deep)["movements"] == [{"at": "01/02/2024 10:00:00", "text": "a"}]


def test_predicates(spark):
    df = spark.createDataFrame([("água", 1), ("Azul", None), ("zebra", 3), ("Árvore", 4)], "t string, n int")
    assert [r["t"] for r in df.orderBy(in_language(F.col("t"))).collect()] == ["água", "Árvore", "Azul", "zebra"]
    assert df.where(optional(F.col("n"), None)).count() == 4 and df.where(optional(F.col("n"), 3)).count() == 1
    none = F.lit(None).cast("map<string,int>")
    assert spark.range(1).select(merged(none, F.create_map(F.lit("a"), F.lit(1))).alias("m")).first()["m"] == {"a": 1}


def test_reports_and_entities(spark, tmp_path):
    lines = reports.markdown("T", spark.createDataFrame([("b", None), ("a", 1)], "k string, n int"), ["k"]).orderBy("place").collect()
    assert [r["line"] for r in lines] == ["# T", "", "| k | n |", "|---|---|", "| a | 1 |", "| b |  |"]
    cases = spark.createDataFrame([(2, "x"), (1, "y")], "id_origem int, numero string")
    assert reports.export({"case_record": cases, "other": cases}, str(tmp_path / "e")) == ["case"]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "e" / "case.jsonl")).collect()] == ['{"idOrigem":1,"numero":"y"}', '{"idOrigem":2,"numero":"x"}']


def test_run_folder_is_emptied(spark):
    with session.run_folder(spark) as path:
        inner = session.written(spark.range(3), "inner")
        kept = session.written(inner, "kept", outer=True)
        assert os.path.isdir(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://")) and kept.count() == 3


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return "spark://host:7077" if key == "spark.master" else default

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        session.scratch_dir(Session())
