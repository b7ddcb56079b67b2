"""Event-time windows, duplicates and per-key control loops over file streams.

Each function reads a folder or file as a stream, takes what is available and leaves the result as a table in the shared
folder; the same plans run continuously with another trigger.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.workqueue import control_fold
from ..session import scratch_dir


def stream(spark: SparkSession, path: str, schema, files: int | None = 64) -> DataFrame:
    """files: how many a micro-batch takes; None: all that are there, where the order of events across files counts."""
    reader = spark.readStream.schema(schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def run_available(result: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs the stream over what is there. Complete results replace each other, so the last batch counts; appended
    and updated ones add up, an update with the number of its batch. keys: of updates, only the row of each key's last
    batch stays, without the number."""
    spark, base = result.sparkSession, f"{scratch_dir(result.sparkSession)}/stream-{uuid.uuid4().hex}"
    schema, last = result.schema, []

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/n={number}")
        last.append(number)

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(*[f"{base}/rows/n={n}" for n in ([max(last)] if mode == "complete" else sorted(set(last)))])
    if mode == "update" and keys:
        last_rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*schema.fieldNames()), "_batch").alias("last"))
        return last_rows.select("last.*")
    return rows if mode == "update" else rows.select(*schema.fieldNames())


def windowed(events: DataFrame, time: str, window, keys: list[str], *aggs) -> DataFrame:
    return events.groupBy(window.alias("w"), *keys).agg(*aggs)


def token_bucket(key, batches, state, capacity: float = 4.0, rate: float = 2.0):
    """Requests in order of time: each takes a token if there is one. Tokens come back at `rate` a second since the last
    refill, which every request sees, granted or not."""
    tokens, at, granted, denied = state.get if state.exists else (capacity, None, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
    for t in rows["t"]:
        if at is not None and t > at:
            tokens = min(capacity, tokens + rate * (t - at))
        at = t if at is None else max(at, t)
        if tokens >= 1:
            tokens, granted = tokens - 1, granted + 1
        else:
            denied += 1
    state.update((float(tokens), float(at), int(granted), int(denied)))
    yield pd.DataFrame([(key[0], int(granted), int(denied))], columns=["user_id", "granted", "denied"])


def bucket_stream(events: DataFrame, capacity: float, rate: float) -> DataFrame:
    return events.groupBy("user_id").applyInPandasWithState(
        lambda key, batches, state: token_bucket(key, batches, state, capacity, rate),
        "user_id bigint, granted bigint, denied bigint", "tokens double, at double, granted bigint, denied bigint", "update", GroupStateTimeout.NoTimeout,
    )


def control_stream(outcomes: DataFrame, every: int) -> DataFrame:
    """(user_id, concurrency, refill, streak) after each batch; the law is that of the batch fold."""

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        after = control_fold(rows["x"], every=every, state=state.get if state.exists else None)
        state.update((int(after[0]), float(after[1]), int(after[2])))
        yield pd.DataFrame([(key[0], *after)], columns=["user_id", "concurrency", "refill", "streak"])

    return outcomes.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, concurrency bigint, refill double, streak bigint", "concurrency bigint, refill double, streak bigint", "update", GroupStateTimeout.NoTimeout
    )
