"""Work queues as folds over a log of jobs: claims, leases, retries, the dead, budgets, breakers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# For each failure class, attempts, first wait and longest wait in milliseconds.
RETRY_MATRIX = {
    "RATE_LIMITED": (6, 1_000, 60_000), "SERVER_ERROR": (4, 2_000, 30_000), "TIMEOUT": (3, 2_000, 30_000), "NETWORK": (3, 2_000, 30_000), "SESSION_LOST": (2, 500, 5_000),
    "NOT_PDF": (2, 1_000, 10_000), "PDF_TRUNCATED": (2, 1_000, 10_000), "PARSE": (1, 1_000, 5_000), "CLIENT_ERROR": (0, 0, 0), "FATAL_SITE_CHANGED": (0, 0, 0), "BUDGET_EXHAUSTED": (0, 0, 0),
}
# Codes of failed connections.
NETWORK_CODES = [
    "ECONNRESET", "ECONNREFUSED", "ENOTFOUND", "EAI_AGAIN", "EPIPE", "ETIMEDOUT", "EHOSTUNREACH", "ENETUNREACH", "UND_ERR_SOCKET", "UND_ERR_CONNECT_TIMEOUT", "CERT_HAS_EXPIRED", "DEPTH_ZERO_SELF_SIGNED_CERT",
]
BREAKER_CLASSES = ["RATE_LIMITED", "SERVER_ERROR", "NETWORK", "TIMEOUT"]
ITEM_BUDGET_MS = 300_000
LEASE_MS = 90_000
MAX_ATTEMPTS = 6
JITTER_MS = 500
#: Lower goes first.
PRIORITY = {"search": 10, "detail": 50, "blob": 90, "verify": 99}


def classify(error: Column, code: Column, status: Column, content_type: Column, rejected: Column, expect: Column) -> Column:
    """The failure class of an exception (its name and code) or else of a response."""
    by_error = (
        F.when(error == "SiteChanged", "FATAL_SITE_CHANGED").when(error.isin("TimeoutError", "AbortError"), "TIMEOUT")
        .when(code.isin(NETWORK_CODES), "NETWORK").otherwise("PARSE")
    )
    text = content_type.contains("html") | content_type.contains("text")
    by_response = (
        F.when(status.isNull(), "PARSE").when(status == 429, "RATE_LIMITED").when(status >= 500, "SERVER_ERROR").when(status == 408, "TIMEOUT")
        .when(status.between(300, 399), "SESSION_LOST").when(status >= 400, "CLIENT_ERROR").when(text & rejected, "RATE_LIMITED")
        .when((expect == "pdf") & ~content_type.contains("pdf"), "NOT_PDF").otherwise("PARSE")
    )
    return F.when(error.isNotNull(), by_error).otherwise(by_response)


def rule(failure: Column, k: int) -> Column:
    """Attempts (0), first wait (1) or longest wait (2) of a failure class."""
    pairs = chain.from_iterable((F.lit(name), F.lit(v[k])) for name, v in RETRY_MATRIX.items())
    return F.create_map(*pairs)[failure]


def jitter(previous: Column, base: Column, cap: Column, draw: Column) -> Column:
    """The next wait after `previous`: the first is the base, a later one lies between the base and three times the
    previous one, at the place `draw` (0 to 1) says; none is over the cap."""
    upper = F.least(cap, previous * 3)
    later = F.least(cap, F.floor(base + (upper - base) * draw + 0.5).cast("bigint"))
    return F.when((previous <= 0) | (upper <= base), F.least(base, cap)).otherwise(later).cast("bigint")


def honour(retry_after: Column, cap: Column, draw: Column) -> Column:
    return F.least(cap, retry_after + F.floor(F.lit(JITTER_MS) * draw + 0.5).cast("bigint")).cast("bigint")


def retry_decision(failure: Column, attempt: Column, elapsed: Column, retry_after: Column, previous: Column, draw: Column) -> Column:
    """(retry, delay_ms, reason): never, too often, too long, as the server asks, or by jitter, in that order."""
    most, base, cap = (rule(failure, k) for k in range(3))
    no = lambda why: F.struct(F.lit(False).alias("retry"), F.lit(0).cast("bigint").alias("delay_ms"), F.lit(why).alias("reason"))
    yes = lambda delay, why: F.struct(F.lit(True).alias("retry"), delay.alias("delay_ms"), F.lit(why).alias("reason"))
    return (
        F.when(most == 0, no("never")).when(attempt >= most, no("attempts")).when(elapsed >= ITEM_BUDGET_MS, no("budget"))
        .when(retry_after.isNotNull(), yes(honour(retry_after, cap, draw), "retry-after")).otherwise(yes(jitter(previous, base, cap, draw), "jitter"))
    )


def backoff_sequence(attempts: int, base: Column, cap: Column, draw: Column) -> Column:
    """The waits of `attempts` failures in a row, as an array."""
    start = F.array().cast("array<bigint>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(attempts)), start, lambda done, _: F.concat(done, F.array(jitter(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("bigint")), base, cap, draw))))


def breaker_wait_ms(opens: Column) -> Column:
    """The wait doubles with each opening, up to ten minutes."""
    return F.least(F.lit(600_000), 60_000 * F.pow(F.lit(2), F.least(opens, F.lit(10)))).cast("bigint")


def breaker_openings(log: DataFrame, key: str, order: list[str], failed: Column, after: int = 5) -> DataFrame:
    """(key, openings, longest): a breaker opens at each `after`th failure in a row, and its count begins anew."""
    seq = Window.partitionBy(key).orderBy(*order)
    marked = log.select(key, *order, failed.alias("failed")).withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where("failed").groupBy(key, "island").agg(F.count("*").alias("run"))
    sums = runs.groupBy(key).agg(F.sum(F.floor(F.col("run") / after)).cast("bigint").alias("openings"), F.max("run").alias("longest"))
    return log.select(key).distinct().join(sums, key, "left").select(key, F.coalesce("openings", F.lit(0).cast("bigint")).alias("openings"), F.coalesce("longest", F.lit(0).cast("bigint")).alias("longest"))


def claim_order(jobs: DataFrame, site: str, order: list, most: int) -> DataFrame:
    """The next `most` jobs of each site in the order in which workers claim them."""
    return jobs.withColumn("place", F.row_number().over(Window.partitionBy(site).orderBy(*order))).where(F.col("place") <= most)


def expired(jobs: DataFrame, lease_until: Column, as_of: Column) -> DataFrame:
    """Leased jobs whose lease has run out; attempts stay as they are."""
    return jobs.where((F.col("status") == "leased") & (lease_until < as_of))


def retry_or_bury(attempts: Column, most: int = MAX_ATTEMPTS) -> Column:
    return F.when(attempts >= most, "dead").otherwise("pending")


def budget_grants(requests: DataFrame, key: str, order: list[str], wanted: str, budget: int) -> DataFrame:
    """What each request gets of a budget, in order of arrival: what it wants, or what is left."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.lit(budget) - F.coalesce(F.sum(wanted).over(before), F.lit(0)))
    return requests.withColumn("granted", F.least(F.col(wanted), left).cast("bigint"))


def control_fold(outcomes, concurrency: int = 4, low: int = 1, high: int = 8, refill: float = 2.0, every: int = 50, state: tuple | None = None) -> tuple:
    """(concurrency, refill, streak) after outcomes in order: one more slot for `every` successes in a row, half the slots
    and half the refill for a rate limit, and a new streak after any other failure."""
    c, r, streak = state or (concurrency, refill, 0)
    for outcome in outcomes:
        if outcome == "OK":
            streak += 1
            if streak >= every:
                c, streak = min(high, c + 1), 0
        else:
            streak = 0
            if outcome == "RATE_LIMITED":
                c, r = max(low, c // 2), max(0.1, r / 2)
    return c, r, streak
