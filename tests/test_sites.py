"""Sites, handlers, settings, the object store and the sinks of samples."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tilespark import config
from tilespark.functions import nested
from tilespark.operators import sites
from tilespark.sources import blobs, capped, exports


def test_sites():
    sites.register_site("here", lambda cap=30: sites.Site("here", cap, (sites.DateAxis(), sites.LabelAxis(["a"]))))
    assert "here" in sites.site_names() and sites.create_site("here", cap=5).cap == 5
    with pytest.raises(KeyError):
        sites.create_site("nowhere")
    with pytest.raises(ValueError):
        sites.LabelAxis(["x"] * (sites.MAX_LABELS + 1))


def test_axes_take_nulls_and_empty_vocabularies(spark):
    nodes = spark.sql("SELECT 1 AS id, date'2024-01-01' AS ini, date'2024-01-01' AS fim, CAST(NULL AS string) AS facet UNION ALL SELECT 2, NULL, NULL, 'a'")
    got = sites.split_nodes(nodes, [sites.DateAxis(), sites.LabelAxis([])]).orderBy("id").collect()
    assert [(r["id"], r["axis"], r["facet"]) for r in got] == [(1, None, None), (2, None, "a")]


def test_dispatch_without_handlers(spark):
    jobs = spark.createDataFrame([(1, "x"), (2, None)], "key int, kind string")
    assert {tuple(r) for r in sites.dispatch(jobs, "key", "kind", {}).select("key", "outcome").collect()} == {(1, "dead"), (2, "dead")}
    strange = {"x": lambda j: j.select("key", F.lit("maybe").alias("outcome"), F.lit("z").alias("reason"))}
    assert {tuple(r) for r in sites.dispatch(jobs, "key", "kind", strange).select("key", "outcome", "reason").collect()} == {(1, "retry", "PARSE"), (2, "dead", "CLIENT_ERROR")}


def test_settings(spark):
    assert config.settings(spark, {}) == config.Settings()
    assert config.settings(spark, {"TILESPARK_CAP": "7", "TILESPARK_ANONYMIZE": "true"}, cap=None) == config.Settings(cap=7, anonymize=True)
    spark.conf.set("spark.tilespark.cap", "8")
    try:
        assert config.settings(spark, {"TILESPARK_CAP": "7"}).cap == 8 and config.settings(spark, {"TILESPARK_CAP": "7"}, cap=9).cap == 9
    finally:
        spark.conf.unset("spark.tilespark.cap")
    for bad in ({"cap": "x"}, {"cap": 0}, {"anonymize": "perhaps"}, {"nothing": 1}):
        with pytest.raises(ValueError):
            config.settings(spark, {}, **bad)


def test_object_store(spark, tmp_path):
    root = (tmp_path / "store").as_uri()
    sha = hashlib.sha256(b"one").hexdigest()
    objects = spark.createDataFrame([("a/1.pdf", bytearray(b"one"), "application/pdf", sha), ("b 2", None, None, None)], "key string, content binary, content_type string, sha256 string")
    for _ in range(2):
        manifest = {r["key"]: r for r in blobs.put(objects, root).collect()}
    assert (manifest["a/1.pdf"]["bytes"], manifest["a/1.pdf"]["sha256"], manifest["b 2"]["bytes"]) == (3, sha, 0)
    (tmp_path / "store" / "bare").write_bytes(b"xy")
    keys = spark.createDataFrame([("a/1.pdf",), ("bare",), ("gone",)], "key string")
    assert {tuple(r) for r in blobs.head(keys, root).collect()} == {("a/1.pdf", 3, sha), ("bare", 2, None), ("gone", None, None)}
    assert bytes(blobs.get(keys.where("key like 'a%'"), root).first()["content"]) == b"one"
    assert sorted(bytes(r["content"]) for r in blobs.read(spark, root).collect()) == [b"one", b"xy"]
    assert bytes(blobs.get(objects.where("key = 'b 2'"), root).first()["content"]) == b""
    for key in ("../x", "a/../../x", "", "."):
        with pytest.raises(ValueError):
            blobs.path_of("/root", key)
    with pytest.raises(Exception, match="another sha256"):
        blobs.put(objects.withColumn("sha256", F.lit("0")), root)


def test_samples_are_appended(spark, tmp_path):
    path = str(tmp_path / "samples")
    for k in range(2):
        exports.append_samples(spark.range(3).withColumn("run", F.lit(k)), path)
    assert spark.read.parquet(path).count() == 6


def test_capped_search_at_the_edges_of_days(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS int) * 12) AS ts FROM range(6)").coalesce(1).write.parquet(path)
    reader = capped.CappedReader({"table": path, "day": "ts", "cap": "3", "ranges": '[["2024-01-02", "2024-01-03"], ["2025-01-01", "2025-01-01"]]'})
    got = [list(reader.read(p)) for p in reader.partitions()]
    assert [r[2:] for r in got[0]] == [("2", "2024-01-02", True), ("3", "2024-01-02", True), ("4", "2024-01-03", True)] and got[1] == []


def test_nested_values(spark):
    df = spark.createDataFrame([(({"b": [(2, "x")], "a": None},),), ((None,),), (None,)], "r struct<m:map<string,array<struct<z:int,a:string>>>>")
    kind = df.schema["r"].dataType
    got = [tuple(r) for r in df.select(nested.canonical_text(F.col("r"), kind), nested.texts(F.col("r"), kind), nested.damaged(F.col("r"), kind)).collect()]
    assert got == [('{"m":{"a":null,"b":[{"a":"x","z":2}]}}', ["x"], None), ('{"m":null}', [], None), (None, [], None)]
