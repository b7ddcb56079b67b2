"""Sources and sinks: the capped search, snapshots, exports."""

from __future__ import annotations

import datetime
import json

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tilespark.sources import capped, exports, snapshots


def test_capped_search(spark):
    spark.dataSource.register(capped.CappedSource)
    ranges = json.dumps([["2024-01-01", "2024-01-01"], ["2024-01-02", "2024-01-05"]])
    got = spark.read.format("capped").options(table=f"{DATA}/events.parquet", day="ts", cap=30, ranges=ranges).load()
    day = F.date_format("ts", "yyyy-MM-dd")
    total = spark.read.parquet(f"{DATA}/events.parquet").where(day == "2024-01-01").count()
    rows = got.groupBy("ini").agg(F.count("*").alias("n"), F.max("truncated").alias("t")).collect()
    assert {r["ini"]: (r["n"], r["t"]) for r in rows} == {"2024-01-01": (min(30, total), total >= 30), "2024-01-02": (30, True)}


def leaf(spark, *spans):
    return spark.createDataFrame([("r", str(k), datetime.date(2024, 1, a), datetime.date(2024, 1, b)) for k, (a, b) in enumerate(spans)], "run string, id string, ini date, fim date")


def test_snapshots(spark, tmp_path):
    base = str(tmp_path)
    assert snapshots.current(spark, base) is None
    snapshots.commit(spark, base, {"t": spark.range(3)}, leaf(spark, (1, 3), (4, 5)))
    snapshots.commit(spark, base, {"t": snapshots.read(spark, base, "t").union(spark.range(1))})
    assert snapshots.read(spark, base, "t").count() == 4
    with pytest.raises(snapshots.OverlapError):
        snapshots.commit(spark, base, {"t": spark.range(9)}, leaf(spark, (1, 4), (4, 5)))
    assert snapshots.read(spark, base, "t").count() == 4


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, "b,c", None, bytearray(b"x")), (1, " a", "11144477735", None)], "id_origem int, nome string, doc_digitos string, raw binary")
    lines = [json.loads(r["value"]) for r in exports.json_lines(exports.masked(df), ["id_origem"]).collect()]
    assert lines == [{"idOrigem": 1, "nome": " a", "docDigitos": "***35", "raw": None}, {"idOrigem": 2, "nome": "b,c", "docDigitos": None, "raw": "eA=="}]
    exports.write_csv(df, str(tmp_path / "out"), ["id_origem"])
    rows = b"".join(p.read_bytes() for p in sorted((tmp_path / "out/rows").glob("part-*")))
    assert rows.decode() == '1," a",11144477735,\r\n2,"b,c",,eA==\r\n'
    header = b"".join(p.read_bytes() for p in (tmp_path / "out/header").glob("part-*"))
    assert header.decode() == "﻿id_origem,nome,doc_digitos,raw\r\n"
