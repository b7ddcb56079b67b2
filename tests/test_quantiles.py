"""Exact quantiles where the approximate ones that they start from differ each time they are computed."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tilespark.operators import metrics


def test_quantiles_do_not_depend_on_the_approximation(spark, monkeypatch):
    @F.udf("array<double>")
    def any_cuts(values):
        return sorted(random.SystemRandom().sample(values, 9))

    rows = [(k, float((i * 7919) % 1009)) for k in "ab" for i in range(3_000)]
    df = spark.createDataFrame(rows, "key string, value double")
    monkeypatch.setattr(metrics.F, "percentile_approx", lambda c, *_: any_cuts.asNondeterministic()(F.collect_list(c)))
    got = metrics.exact_quantiles(df, "key", "value", [0.5, 0.95, 0.99]).collect()
    ordered = sorted(v for k, v in rows if k == "a")
    want = [(k, q, ordered[int(q * 3_000)]) for k in "ab" for q in (0.5, 0.95, 0.99)]
    assert sorted(map(tuple, got)) == want
