"""Batches of large rows that go to Python workers."""

from __future__ import annotations

import pyarrow as pa

from tilespark import session


def test_batches_of_large_rows_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    session.ship(spark)
    rows = spark.range(0, 20, 1, 1).selectExpr("repeat('x', 1000000) as text")
    got = rows.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r["n"] for r in got) == 20
    assert max(r["bytes"] for r in got) <= session.BYTES_PER_BATCH + 1_100_000
