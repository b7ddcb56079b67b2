"""Mixing documents to target weights down a tree of domain, language and source.

Budgeting. The token budget goes down the tree: each node's share is dealt to its children by weight. A child can't take
more than its documents have in `max_epochs` epochs; what it lacks goes to its siblings that have room, by weight
again, and only what no sibling can take goes back to its parent's siblings, that is: capacity is known for every
inner node, so a node is never given more than its subtree holds, and a shortage is made up as low in the tree as it
can be.

Selection. A leaf's quota is whole epochs and a rest. In each epoch the leaf's documents stand in an order drawn from the seed
and the epoch's number; the rest is the shortest prefix of that epoch whose tokens reach the quota. No leaf is sorted as a whole:
its documents fall into buckets by their place in that order, sums of buckets say in which bucket the prefix
ends, and only that bucket is sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, written


def fill(budget: float, weights: dict, room: dict) -> dict:
    """budget dealt by weight, no more than its room to each; what some can't take is dealt among the rest again."""
    out, open_ = dict.fromkeys(weights, 0.0), {k for k in weights if weights[k] > 0 and room[k] > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if out[k] + left * weights[k] / total >= room[k]}
        if not full:
            for k in open_:
                out[k] += left * weights[k] / total
            return out
        for k in full:
            left -= room[k] - out[k]
            out[k] = room[k]
        open_ -= full
    return out


def allocate(leaves: dict[tuple, float], budget: float, weights: dict[tuple, float], max_epochs: int) -> dict[tuple, float]:
    """Tokens for each leaf (a path of names). weights: path or prefix of a path -> weight among its siblings; 1 if
    missing. First every inner node's room is summed, then the budget goes down level by level."""
    room: dict[tuple, float] = {}
    for path, tokens in leaves.items():
        for k in range(len(path) + 1):
            room[path[:k]] = room.get(path[:k], 0.0) + tokens * max_epochs
    children: dict[tuple, set] = {}
    for path in room:
        if path:
            children.setdefault(path[:-1], set()).add(path)
    given = {(): min(budget, room.get((), 0.0))}
    for node in sorted(room, key=len):
        if node in children:
            kids = sorted(children[node], key=repr)
            given |= fill(given[node], {k: weights.get(k, 1.0) for k in kids}, {k: room[k] for k in kids})
    return {path: given[path] for path in leaves}


def with_tokens(docs: DataFrame, text_col: str = "text"):
    """Words of the text, as its tokens: the number of pieces between separators, less empty ones at either end."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.size(F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")).cast("long")


def mix(
    docs: DataFrame, domain, language, source, weights: dict[tuple, float], budget: float | None = None, fraction: float = 0.5, max_epochs: int = 2, seed: int = 17, bucket_rows: int = 4_096, max_leaves: int = 1_000_000
) -> DataFrame:
    """The chosen rows of docs, each as a struct _row with all its columns, and _epoch (from 1), _tokens and _leaf; a row that
    is chosen in several epochs comes once for each.

    domain, language, source: columns; null is a name of its own. budget: tokens in all; if None, `fraction` of the
    tokens there are. Null and empty texts have 0 tokens and are chosen with what stands before them. Repeated rows stand
    next to each other and count each; ties in the order go by id and text. An empty table gives no rows. The
    tree has a row for each leaf on the driver; more than max_leaves leaves are an error."""
    path = F.struct(*[F.coalesce(c.cast("string"), F.lit("\u0000null")).alias(n) for c, n in ((domain, "d"), (language, "l"), (source, "s"))])
    # the given columns stay together, so that none of their names can clash with one used here
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), path.alias("_leaf"), with_tokens(docs).alias("_tokens"), F.col("doc_id"), F.col("text"))
    leaves = rows.groupBy("_leaf").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n")).limit(max_leaves + 1).collect()
    if len(leaves) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves")
    have = {tuple(r["_leaf"]): float(r["tokens"]) for r in leaves}
    budget = fraction * sum(have.values()) if budget is None else budget
    quota = allocate(have, budget, weights, max_epochs)
    spark = docs.sparkSession
    plan = []
    for r in leaves:
        leaf, tokens = tuple(r["_leaf"]), r["tokens"]
        buckets = max(1, math.ceil(r["n"] / bucket_rows))
        whole = min(max_epochs, int(quota[leaf] // tokens)) if tokens else 0
        rest = quota[leaf] - whole * tokens
        plan += [(leaf, e, buckets, None) for e in range(1, whole + 1)]
        if rest > 1e-6 and whole < max_epochs:
            plan.append((leaf, whole + 1, buckets, rest))
    plan = spark.createDataFrame(plan, "_leaf struct<d:string,l:string,s:string>, _epoch int, _buckets int, _rest double")
    place = F.xxhash64(F.lit(seed), F.col("_epoch"), F.col("doc_id"), F.xxhash64("text"))
    # shiftrightunsigned leaves 31 bits, so the bucket is the order's leading part
    dealt = rows.join(F.broadcast(plan), "_leaf").withColumn("_place", F.shiftrightunsigned(place, 33)).withColumn("_bucket", F.expr("cast((_place * _buckets) >> 31 as int)"))
    sums = dealt.where("_rest is not null").groupBy("_leaf", "_epoch", "_bucket", "_rest").agg(F.sum("_tokens").alias("n"))
    before = Window.partitionBy("_leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("_leaf", "_bucket", "before", F.when(F.col("before") + F.col("n") < F.col("_rest"), "all").when(F.col("before") < F.col("_rest"), "part").alias("take"))
    ends = written(sums.where("take is not null"), "mix-ends")
    last = ends.where("take = 'part'").groupBy("_leaf").agg(F.min("_bucket").alias("_last"), F.min_by("before", "_bucket").alias("_before"))
    final = ends.groupBy("_leaf").agg(F.max("_bucket").alias("_most")).join(last, "_leaf", "left")
    marked = dealt.join(F.broadcast(final), "_leaf", "left")
    names = ["_row", "_epoch", "_tokens", "_leaf"]
    full = marked.where("_rest is null or _bucket < coalesce(_last, _most + 1)").select(*names)
    within = Window.partitionBy("_leaf").orderBy("_place", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    edge = marked.where("_rest is not null and _bucket = _last").withColumn("_so_far", F.col("_before") + F.coalesce(F.sum("_tokens").over(within), F.lit(0)))
    return full.union(edge.where("_so_far < _rest").select(*names))
