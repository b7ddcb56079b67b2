"""Life of jobs and of a site's throttle: claims that stamp a lease, events that end or revive a job, gates and breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workqueue import breaker_wait_ms

LEASE_MS = 120_000
#: Openings of the breaker in a row after which a run stops.
MOST_OPENINGS = 5


def claim(jobs: DataFrame, key: str, site: str, order: list, most: int, worker: str, as_of: Column, lease_ms: int = LEASE_MS) -> DataFrame:
    """All jobs, with the next `most` due ones of each site leased: (status, leased_by, lease_until, attempts) change for these
    only. Only pending jobs that are due are ranked; of those, each task hands on no more than it has."""
    due = jobs.where((F.col("status") == "pending") & (F.col("run_after") <= as_of))
    place = Window.partitionBy(site).orderBy(*order)
    taken = due.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= most).select(F.col(key).alias("_taken"))
    joined = jobs.join(taken, F.col(key) == F.col("_taken"), "left")
    mine = F.col("_taken").isNotNull()
    until = F.timestamp_micros(F.unix_micros(as_of) + lease_ms * 1000)
    return joined.withColumns({
        "status": F.when(mine, "leased").otherwise(F.col("status")), "leased_by": F.when(mine, worker).otherwise(F.col("leased_by")),
        "lease_until": F.when(mine, until).otherwise(F.col("lease_until")), "attempts": F.col("attempts") + F.when(mine, 1).otherwise(0),
    }).drop("_taken")


def settle(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, status, attempts) after the events of each job in order: `lease` counts an attempt, `complete` ends it, `fail`
    puts it back, `dead` buries it, `reap` frees a leased one without giving the attempt back, and `revive` sets a dead one
    to pending with no attempts. Events that don't fit the status change nothing."""
    seq = F.sort_array(F.collect_list(F.struct(*order, "event")))

    def step(s: Column, e: Column) -> Column:
        event, status = e["event"], s["status"]
        leased = status == "leased"
        after = (
            F.when((event == "lease") & (status == "pending"), "leased").when((event == "complete") & leased, "done").when((event == "dead") & leased, "dead")
            .when(event.isin("fail", "reap") & leased, "pending").when((event == "revive") & (status == "dead"), "pending").otherwise(status)
        )
        attempts = F.when((event == "lease") & (status == "pending"), s["attempts"] + 1).when((event == "revive") & (status == "dead"), F.lit(0).cast("bigint")).otherwise(s["attempts"])
        return F.struct(after.alias("status"), attempts.alias("attempts"))

    start = F.struct(F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("attempts"))
    return events.groupBy(key).agg(F.aggregate(seq, start, step).alias("s")).select(key, "s.*")


def revive(jobs: DataFrame, key: str, kind: Column | None = None, most: int = 10_000) -> DataFrame:
    """The dead jobs, of one kind if given, that are brought back: the `most` with the least keys; a filter that is absent
    matches all."""
    dead = jobs.where(F.col("status") == "dead")
    dead = dead if kind is None else dead.where(kind)
    return dead.orderBy(key).limit(most).withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})


def gate(state: Column, as_of: Column, tokens: Column, capacity: Column, refill: Column, since: Column, retry_after: Column, in_flight: Column, concurrency: Column) -> Column:
    """(granted, why, tokens): whether a request may go. An open breaker, a server's wait, full slots and an empty bucket
    refuse, in that order; a grant takes one token."""
    seconds = (F.unix_micros(as_of) - F.unix_micros(since)) / 1e6
    have = F.least(capacity, tokens + refill * seconds)
    why = F.when(state == "OPEN", "breaker").when(F.coalesce(retry_after, as_of) > as_of, "retry-after").when(in_flight >= concurrency, "slots").when(have < 1, "tokens")
    return F.struct(why.isNull().alias("granted"), why.alias("why"), F.when(why.isNull(), have - 1).otherwise(tokens).alias("tokens"))


def breaker(state: Column, opens: Column, until: Column, as_of: Column, outcome: Column) -> Column:
    """(state, opens, until, abort) after an outcome: `OPEN` opens it for longer each time and aborts the run at the
    fifth opening in a row; an open one whose time is up lets one probe through (HALF_OPEN); a probe that is OK closes it
    and forgets its openings."""
    opening = outcome == "OPEN"
    wait = F.timestamp_micros(F.unix_micros(as_of) + breaker_wait_ms(opens) * 1000)
    due = (state == "OPEN") & (until <= as_of)
    closes = (state == "HALF_OPEN") & (outcome == "OK")
    after = F.when(opening, "OPEN").when(closes, "CLOSED").when(due, "HALF_OPEN").otherwise(state)
    count = F.when(opening, opens + 1).when(closes, 0).otherwise(opens)
    return F.struct(after.alias("state"), count.cast("bigint").alias("opens"), F.when(opening, wait).when(closes, F.lit(None).cast("timestamp")).otherwise(until).alias("until"), (opening & (opens + 1 >= MOST_OPENINGS)).alias("abort"))
