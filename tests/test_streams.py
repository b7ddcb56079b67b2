"""Streaming queries over more files than a micro-batch takes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.plans import streams


def test_results_do_not_depend_on_the_number_of_files(spark, tmp_path):
    n, kinds = 210, F.array(*[F.lit(k) for k in ("view", "error", "click")])
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int), 0, 0, 0)").alias("ts"), (F.col("id") % 4).alias("user_id"), F.get(kinds, (F.col("id") % 3).cast("int")).alias("event_type"), F.lit(1.0).alias("value"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one/events.parquet"))
    rows.repartitionByRange(70, F.pmod(F.col("event_id") * 37, F.lit(n))).write.parquet(str(tmp_path / "many/events.parquet"))
    assert len(list((tmp_path / "many/events.parquet").glob("part-*.parquet"))) > 64
    for run in (streams.s_token_bucket, streams.s_aimd, streams.s_dedup):
        one, many = (sorted(map(tuple, run(spark, str(tmp_path / d)).collect())) for d in ("one", "many"))
        assert many == one and len(one) == (12 if run is streams.s_dedup else 4)


def test_update_keeps_the_last_row_of_each_key(spark, tmp_path):
    rows = spark.range(6).select((F.col("id") % 2).alias("k"))
    rows.repartition(3).write.parquet(str(tmp_path / "rows"))
    counts = streams.W.stream(spark, str(tmp_path / "rows"), rows.schema, files=1).groupBy("k").count()
    assert sorted(map(tuple, streams.W.run_available(counts, "update", ["k"]).collect())) == [(0, 3), (1, 3)]
