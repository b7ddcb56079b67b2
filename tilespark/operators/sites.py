"""What a user may add: sites with their axes and rules, and handlers of jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import halves

#: Labels that an axis may hold as literals; larger vocabularies are joined by `coverage.class_children`.
MAX_LABELS = 1_000


class Axis(Protocol):
    """A way to split nodes (id, ini, fim, facet): for which nodes it can, and their parts as an array of (ini, fim, facet)."""

    name: str

    def can_split(self) -> Column: ...

    def split(self) -> Column: ...


class DateAxis:
    """Ranges of two days or more, in halves."""

    name = "date"

    def can_split(self) -> Column:
        return F.col("fim") > F.col("ini")

    def split(self) -> Column:
        return F.transform(halves(F.col("ini"), F.col("fim")), lambda h: F.struct(h["first"].alias("ini"), h["last"].alias("fim"), F.col("facet")))


class LabelAxis:
    """Single days without a facet, by label."""

    def __init__(self, labels: list[str], name: str = "label"):
        if len(labels) > MAX_LABELS:
            raise ValueError(f"{len(labels)} labels; an axis holds {MAX_LABELS} at most")
        self.name, self.labels = name, labels

    def can_split(self) -> Column:
        return (F.col("ini") == F.col("fim")) & F.col("facet").isNull() & F.lit(bool(self.labels))

    def split(self) -> Column:
        labels = F.array(*[F.lit(x) for x in self.labels]).cast("array<string>")
        return F.transform(labels, lambda x: F.struct(F.col("ini"), F.col("fim"), x.alias("facet")))


def split_nodes(nodes: DataFrame, axes: list[Axis]) -> DataFrame:
    """(id, axis, ini, fim, facet): the parts of each node by the first axis that can split it. A node that none can split is a gap:
    itself, without an axis."""
    itself = F.array(F.struct("ini", "fim", "facet"))
    named, parts = F.lit(None).cast("string"), itself
    for axis in reversed(axes):
        can = F.coalesce(axis.can_split(), F.lit(False))
        named, parts = F.when(can, F.lit(axis.name)).otherwise(named), F.when(can, axis.split()).otherwise(parts)
    return nodes.select("id", named.alias("axis"), F.explode(parts).alias("part")).select("id", "axis", "part.*")


@dataclass(frozen=True)
class Site:
    """A site: its row cap (None: it pages), its axes in order of use, and rules (condition, class) that its failures meet first."""

    name: str
    cap: int | None = None
    axes: tuple = (DateAxis(),)
    rules: Callable[[], list[tuple[Column, str]]] = field(default=list)


_SITES: dict[str, Callable[..., Site]] = {}


def register_site(name: str, make: Callable[..., Site]) -> None:
    _SITES[name] = make


def site_names() -> list[str]:
    return sorted(_SITES)


def create_site(name: str, **options) -> Site:
    if name not in _SITES:
        raise KeyError(f"unknown site {name!r}; known: {', '.join(site_names())}")
    return _SITES[name](**options)


def classified(general: Column, rules: list[tuple[Column, str]]) -> Column:
    """The class of the first rule that holds, else the general one."""
    return reduce(lambda rest, r: F.when(r[0], F.lit(r[1])).otherwise(rest), reversed(rules), general)


OUTCOMES = ["done", "retry", "dead", "fatal"]


def dispatch(jobs: DataFrame, key: str, kind: str, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The jobs with outcome and reason. Each handler gets the jobs of its kind and gives (key, outcome, reason).

    Jobs of a kind without a handler are dead; a job that its handler says nothing of, or says no known outcome of, is tried
    again as PARSE."""
    known = F.coalesce(F.col(kind).isin(list(handlers)), F.lit(False))
    said = [h(jobs.where(F.col(kind) == k)).select(key, F.col("outcome").alias("_outcome"), F.col("reason").alias("_reason")) for k, h in handlers.items()]
    if not said:
        return jobs.withColumns({"outcome": F.lit("dead"), "reason": F.lit("CLIENT_ERROR")})
    clear = F.coalesce(F.col("_outcome").isin(OUTCOMES), F.lit(False))
    outcome = F.when(~known, "dead").when(clear, F.col("_outcome")).otherwise("retry")
    reason = F.when(~known, "CLIENT_ERROR").when(clear, F.col("_reason")).otherwise("PARSE")
    return jobs.join(reduce(DataFrame.unionByName, said), key, "left").withColumns({"outcome": outcome, "reason": reason}).drop("_outcome", "_reason")


def refreshed(jobs: DataFrame, found: DataFrame, key: str, token: str, order: list[Column]) -> DataFrame:
    """The jobs with the token of the last row found under their id, and whether there is one."""
    last = found.groupBy(key).agg(F.max_by(token, F.struct(*order)).alias(token))
    return jobs.drop(token).join(last.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))
