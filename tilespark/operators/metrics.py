"""Aggregations that have no built-in twin: exact quantiles by rank, metric folds, text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_value
from ..session import written


def exact_quantiles(rows: DataFrame, key: str, value: str, quantiles: list[float], cuts: int = 100) -> DataFrame:
    """(key, q, value): for each key the value at index floor(q * n) of its sorted values, the last one at most.

    Equal values are counted first, so a value that most rows share is one row from then on. No key is sorted as a
    whole: approximate percentiles cut its values into ranges, counts of ranges say in which one the wanted index
    lies, and only that range is ranked. The percentiles are written first: they depend on the order in which partial
    results arrive, and counts and ranks must see the same ranges. Keys may be any number: nothing is broadcast unless the
    planner finds it small."""
    counts = rows.select(F.col(key).alias("key"), F.col(value).alias("value")).where("value is not null").groupBy("key", "value").agg(F.count("*").alias("k"))
    marks = counts.groupBy("key").agg(F.percentile_approx("value", [k / cuts for k in range(1, cuts)], 1_000).alias("marks"), F.sum("k").alias("n"))
    marks = written(marks, "quantile-marks")
    placed = counts.join(marks, "key").withColumn("part", F.expr("size(filter(marks, m -> m < value))")).drop("marks")
    parts = placed.groupBy("key", "part").agg(F.sum("k").alias("k"), F.first("n").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0)))
    wanted = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))).alias("at")) for q in quantiles])).alias("w")
    target = parts.select("key", "part", "before", "k", wanted).select("key", "part", "before", "k", "w.*").where("at >= before and at < before + k").drop("k")
    ranked = placed.join(target.select("key", "part").distinct(), ["key", "part"], "left_semi")
    upto = Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.select("key", "part", "value", "k", F.sum("k").over(upto).alias("upto"))
    hit = ranked.join(target, ["key", "part"]).where("at - before >= upto - k and at - before < upto")
    return hit.select("key", "q", "value")


def fold_series(samples: DataFrame, name: Column, labels: Column, value: Column, order: list[Column]) -> DataFrame:
    """(name, labels, total, last): a counter's sum and a gauge's last value, for each name and set of labels."""
    return samples.groupBy(name.alias("name"), labels.alias("labels")).agg(F.sum(value).alias("total"), F.max_by(value, F.struct(*order)).alias("last"))


def rendered_labels(labels: Column) -> Column:
    """{a="x",b="y"} by name; empty without labels. labels: a map."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), label_value(e["value"]), F.lit('"')))
    return F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))


def exposition(series: DataFrame) -> DataFrame:
    """(name, place, line) of series (name, kind, labels map, value text): a type line for each name, then its samples."""
    kinds = series.groupBy("name").agg(F.first("kind").alias("kind"))
    heads = kinds.select("name", F.lit("").alias("place"), F.concat(F.lit("# TYPE "), "name", F.lit(" "), "kind").alias("line"))
    shown = rendered_labels(F.col("labels"))
    return heads.union(series.select("name", shown.alias("place"), F.concat("name", shown, F.lit(" "), "value").alias("line")))


def deterministic_sample(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """n rows by the md5 of their id: the same ones wherever and however often it is drawn."""
    return rows.orderBy(F.md5(F.col(id_col).cast("string"))).limit(n)
