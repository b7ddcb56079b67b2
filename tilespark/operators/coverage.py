"""Adaptive range partitioning under a row cap, and the proof that its leaves tile the range.

The only pass over the data is one distributed count by day (and, for days that overflow, by class). What comes to the
driver is one count for each calendar day of the range, at most MAX_DAYS; from the running sums the size of any range of
days follows, and the tree is resolved level by level. Days that overflow are split by class on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import contiguous, days_in, overlap
from ..functions.identity import partition_id
from ..functions.text import fold

#: Days of a root range that the driver takes, about a thousand years.
MAX_DAYS = 400_000

NODE_SCHEMA = "depth int, ini date, fim date, n bigint, status string"


@dataclass(frozen=True)
class Root:
    ini: date
    fim: date

    @property
    def days(self) -> int:
        return (self.fim - self.ini).days + 1


def day_counts(rows: DataFrame, day) -> DataFrame:
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("n")).where("day is not null")


def resolve_days(counts: dict[date, int], root: Root, cap: int, has_classes: bool) -> list[tuple]:
    """(depth, first day, last day, rows, status) of every node of the day axis, from the root down.

    A range whose rows stay under the cap is a leaf. One that reaches it is cut in the middle, the shorter half first;
    a single day that reaches it is split by class if there are classes, else declared a gap."""
    if root.days > MAX_DAYS:
        raise ValueError(f"the range has {root.days} days, more than {MAX_DAYS}")
    sums = [0]
    for k in range(root.days):
        sums.append(sums[-1] + counts.get(root.ini + timedelta(k), 0))
    nodes, frontier, depth = [], [(0, root.days - 1)], 0
    while frontier:
        below = []
        for a, b in frontier:
            n = sums[b + 1] - sums[a]
            if n < cap:
                status = "LEAF_DONE"
            elif b > a:
                status, half = "SPLIT", (b - a + 1) // 2
                below += [(a, a + half - 1), (a + half, b)]
            else:
                status = "SPLIT_SECONDARY" if has_classes else "GAP"
            nodes.append((depth, root.ini + timedelta(a), root.ini + timedelta(b), n, status))
        frontier, depth = below, depth + 1
    return nodes


def tree(rows: DataFrame, day, cap: int, root: Root | None = None, has_classes: bool = True) -> DataFrame:
    """The nodes of the day axis. Without a root, it is the range of days there are; no rows give no nodes."""
    days = day_counts(rows, day)
    if root is not None:
        days = days.where(F.col("day").between(F.lit(root.ini), F.lit(root.fim)))
    # without a root, one day too many says that the range is too long, which resolve_days refuses
    counts = {r["day"]: r["n"] for r in days.limit(MAX_DAYS + 1).collect()}
    if len(counts) > MAX_DAYS:
        raise ValueError(f"there are more than {MAX_DAYS} days")
    if root is None and counts:
        root = Root(min(counts), max(counts))
    nodes = resolve_days(counts, root, cap, has_classes) if root else []
    return rows.sparkSession.createDataFrame(nodes, NODE_SCHEMA)


def class_children(rows: DataFrame, day, label, nodes: DataFrame, cap: int) -> DataFrame:
    """The children by class of the days that overflow: each takes the rows whose folded class begins with its own, as a
    prefix filter does."""
    by_class = rows.groupBy(day.alias("day"), fold(label).alias("have")).agg(F.count("*").alias("k"))
    by_class = by_class.join(F.broadcast(nodes.where("status = 'SPLIT_SECONDARY'").select(F.col("ini").alias("day"), "depth")), "day")
    words = rows.select(fold(label).alias("want")).where("want <> ''").distinct()
    # a class meets the vocabulary by its own prefixes, an equi-join, not by comparing every pair
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("have")), lambda n: F.left(F.col("have"), n)))
    sums = by_class.where("have <> ''").withColumn("want", prefixes).join(words, "want").groupBy("day", "depth", "want").agg(F.sum("k").alias("n"))
    days = by_class.select("day", "depth").distinct()
    # every day that overflows gets a child for every class, with or without rows: that is what the split means
    # there are at most MAX_DAYS days, so they go to the classes, of which there may be any number
    listed = days.agg(F.collect_list(F.struct("day", "depth")).alias("all"))
    children = words.join(F.broadcast(listed)).select(F.explode("all").alias("d"), "want").select("d.day", "d.depth", "want")
    out = children.join(sums, ["day", "depth", "want"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return out.select((F.col("depth") + 1).alias("depth"), F.col("day").alias("ini"), F.col("day").alias("fim"), "n", F.when(F.col("n") >= cap, "GAP").otherwise("LEAF_DONE_SECONDARY").alias("status"), F.col("want").alias("class"))


def coverage(rows: DataFrame, day, label, cap: int, root: Root | None = None) -> DataFrame:
    """All nodes: those of the day axis (class null) and the children by class."""
    nodes = tree(rows, day, cap, root)
    return nodes.withColumn("class", F.lit(None).cast("string")).unionByName(class_children(rows, day, label, nodes, cap))


def covers(status, facets=None):
    """Whether a node stands for its range in the tiling: without facets, and resolved or split by class."""
    ok = status.isin("LEAF_DONE", "GAP", "SPLIT_SECONDARY")
    return ok if facets is None else ok & (F.size(facets) == 0)


def tiling_violations(leaves: DataFrame, root: Root) -> DataFrame:
    """(kind, ini, fim) of everything that keeps the leaves (run, id, ini, fim) from tiling the root.

    Each leaf is compared with the one before it by first day: an overlap, else a gap. The first leaf must begin and the
    last by first day end with the root. Runs are judged side by side; without any leaf there is one `empty`."""
    order = Window.partitionBy("run").orderBy("ini", "id")
    back = Window.partitionBy("run").orderBy(F.col("ini").desc(), F.col("id").desc())
    ini, fim = F.lit(root.ini), F.lit(root.fim)
    seen = leaves.select("run", "ini", "fim", F.lag("fim").over(order).alias("p"), F.row_number().over(order).alias("first"), F.row_number().over(back).alias("last"))
    span = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("ini"), b.alias("fim"))
    found = F.array(
        F.when((F.col("first") == 1) & (F.col("ini") != ini), span("missing-start", ini, F.date_sub("ini", 1))),
        F.when((F.col("last") == 1) & (F.col("fim") != fim), span("missing-end", F.date_add("fim", 1), fim)),
        F.when(F.col("p") >= F.col("ini"), span("overlap", F.col("ini"), F.least("p", "fim"))).when(~contiguous(F.col("p"), F.col("ini")), span("gap", F.date_add("p", 1), F.date_sub("ini", 1))),
    )
    out = seen.select("run", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select("run", "v.*")
    none = leaves.groupBy().agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("run"), F.lit("empty").alias("kind"), ini.alias("ini"), fim.alias("fim"))
    return out.unionByName(none)


def tiling_summary(leaves: DataFrame, root: Root) -> DataFrame:
    """ok, number of violations, covered days (overlaps count twice) and days of the root, for each run."""
    bad = tiling_violations(leaves, root).groupBy("run").agg(F.count("*").alias("n_violations"))
    days = leaves.groupBy("run").agg(F.count("*").alias("n_leaves"), F.sum(days_in(F.col("ini"), F.col("fim"))).cast("bigint").alias("covered_days"))
    out = days.join(bad, "run", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0).cast("bigint")))
    return out.select("run", (F.col("n_violations") == 0).alias("ok"), "n_leaves", "n_violations", "covered_days", F.lit(root.days).cast("bigint").alias("root_days"))


def overlapping_pairs(leaves: DataFrame) -> DataFrame:
    """(run, a, b) of leaves of a run that share a day, a < b. Each leaf meets those of the months it touches."""
    month = F.explode(F.sequence(F.trunc("ini", "month"), F.trunc("fim", "month"), F.expr("interval 1 month"))).alias("month")
    keyed = leaves.select("run", "id", "ini", "fim", month)
    a = keyed.select("run", "month", F.col("id").alias("a"), F.col("ini").alias("ai"), F.col("fim").alias("af"))
    b = keyed.select("run", "month", F.col("id").alias("b"), F.col("ini").alias("bi"), F.col("fim").alias("bf"))
    return a.join(b, ["run", "month"]).where((F.col("a") < F.col("b")) & overlap(F.col("ai"), F.col("af"), F.col("bi"), F.col("bf"))).select("run", "a", "b").distinct()


def capped_search(rows: DataFrame, keys: list[str], order: str, cap: int) -> DataFrame:
    """What a capped interface shows: the first `cap` rows of each range, and whether there are as many or more."""
    first = Window.partitionBy(*keys).orderBy(order)
    page = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= cap)
    sizes = rows.groupBy(*keys).agg((F.count("*") >= cap).alias("truncated"))
    return page.join(sizes, keys)


def facet_closure(visible: DataFrame, attributed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the known classes account for against the rows that were visible, for each range."""
    both = visible.join(attributed, keys, "left").withColumn("attributed", F.coalesce("attributed", F.lit(0).cast("bigint")))
    missing = F.greatest(F.lit(0).cast("bigint"), F.col("visible") - F.col("attributed"))
    return both.select(*keys, "visible", "attributed", missing.alias("unexplained"), (missing == 0).alias("ok"))


def prefix_collisions(values: DataFrame, column: str) -> DataFrame:
    """(shorter, longer): values one of which, folded, begins with the other. By an equi-join on all prefixes."""
    folded = values.select(F.col(column).alias("value"), fold(F.col(column)).alias("key")).where("key <> ''").distinct()
    cut = folded.select(F.col("value").alias("longer"), F.explode(F.transform(F.sequence(F.lit(0), F.length("key") - 1), lambda n: F.left(F.col("key"), n))).alias("key")).where("key <> ''")
    return cut.join(folded, "key").select(F.col("value").alias("shorter"), "longer")


def edge_probes(rows: DataFrame, day, root: Root, span: int = 3_650) -> DataFrame:
    """Rows within `span` days before and after the root: a root that is too narrow shows."""
    before = day.between(F.lit(root.ini - timedelta(span)), F.lit(root.ini - timedelta(1)))
    after = day.between(F.lit(root.fim + timedelta(1)), F.lit(root.fim + timedelta(span)))
    counted = rows.agg(F.count_if(before).alias("b"), F.count_if(after).alias("a"))
    return counted.select(F.explode(F.array(F.struct(F.lit("before-root").alias("label"), F.col("b").alias("n")), F.struct(F.lit("after-root").alias("label"), F.col("a").alias("n")))).alias("x")).select("x.*")


def node_id(facets=None):
    return partition_id(F.col("ini"), F.col("fim"), facets)


# The states that each state of a partition may go to.
TRANSITIONS = {
    "PENDING": ["SPLIT", "SPLIT_SECONDARY", "LEAF_DONE", "LEAF_DONE_SECONDARY", "GAP", "FAILED", "PENDING"],
    "SPLIT": ["SPLIT", "STALE"],
    "SPLIT_SECONDARY": ["SPLIT_SECONDARY", "STALE", "GAP"],
    "LEAF_DONE": ["STALE", "LEAF_DONE"],
    "LEAF_DONE_SECONDARY": ["STALE", "LEAF_DONE_SECONDARY"],
    "GAP": ["PENDING", "GAP"],
    "STALE": ["PENDING", "STALE"],
    "FAILED": ["PENDING", "FAILED", "GAP"],
}


def illegal_transitions(log: DataFrame, entity: str, order: list[str], state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Steps (old, new) of an entity's log that the relation doesn't allow, with how often each occurs."""
    steps = log.withColumn("old", F.lag(state).over(Window.partitionBy(entity).orderBy(*order))).where("old is not null").select("old", F.col(state).alias("new"))
    counted = steps.groupBy("old", "new").agg(F.count("*").alias("n"))
    legal = log.sparkSession.createDataFrame([(a, b) for a, bs in allowed.items() for b in bs], "old string, new string")
    return counted.join(F.broadcast(legal), ["old", "new"], "left_anti")
