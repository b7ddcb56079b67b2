"""Approximate nearest neighbours by a robust-pruned directed graph for each shard.

Rows are dealt to shards by a hash of their id. Within a shard, rows with the same direction are one node, so copies of one
vector, however many, neither crowd out other edges nor lengthen lists. A node's candidates are proposed by a greedy
search of the graph so far; of these, nearest first, one is kept if no kept one is nearer to it by the factor `alpha`
(relaxed pruning), which leaves a few long edges besides the near ones. Reverse edges are added and pruned likewise. Two passes
are made, the first with alpha 1. Shards are written as a table; any lost task reads it again.

Queries go in small blocks to every shard, while a shard stays where it is: its row comes first in its task, then the
blocks, one after the other. Blocks beyond `per_shard` go to another task with a copy of the shard, so no task grows
with the queries. A beam search returns the shard's best, with cosines in double precision of the original vectors, and
a window takes the best of all shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, rows_of, small, tidy, written


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def beam(vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, the `width` nodes with the largest inner product that a best-first search from the entries
    meets, best first: (nodes, products), filled up with node -1 and product -inf. All queries step together."""
    q, n = len(queries), len(vectors)
    rows = np.arange(q)[:, None]
    met = np.zeros((q, n + 1), dtype=bool)
    met[:, n] = True
    nodes = np.full((q, width), n, dtype=np.int64)
    sims = np.full((q, width), -np.inf, dtype=np.float32)
    open_ = np.zeros((q, width), dtype=bool)
    k = min(width, len(entries))
    start = queries @ vectors[entries].T
    order = np.argsort(-start, axis=1, kind="stable")[:, :k]
    nodes[:, :k], sims[:, :k], open_[:, :k] = entries[order], np.take_along_axis(start, order, 1), True
    met[:, entries] = True
    alive = np.arange(q)
    while len(alive):
        at = np.argmax(open_[alive], axis=1)
        busy = open_[alive, at]
        alive, at = alive[busy], at[busy]
        if not len(alive):
            break
        open_[alive, at] = False
        near = edges[nodes[alive, at]]
        near = np.where(near < 0, n, near)
        fresh = ~met[alive[:, None], near]
        met[alive[:, None], near] = True
        found = np.einsum("qrd,qd->qr", vectors[np.minimum(near, n - 1)], queries[alive])
        found = np.where(fresh, found, -np.inf).astype(np.float32)
        all_sims = np.concatenate((sims[alive], found), axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        sims[alive] = np.take_along_axis(all_sims, order, 1)
        nodes[alive] = np.take_along_axis(np.concatenate((nodes[alive], near), axis=1), order, 1)
        open_[alive] = np.take_along_axis(np.concatenate((open_[alive], fresh), axis=1), order, 1)
    nodes[(nodes == n) | ~np.isfinite(sims)] = -1
    return nodes, sims


def prune(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of `own`, at most `degree` of its candidates (-1: none), nearest first; each kept one drops those
    left that are nearer to it, by alpha, than to the node."""
    n = len(vectors)
    c = np.sort(np.where(candidates == own[:, None], -1, candidates), axis=1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    there = vectors[np.clip(c, 0, n - 1)]
    to_own = 2 - 2 * np.einsum("qcd,qd->qc", there, vectors[own])
    to_own = np.where(c < 0, np.inf, to_own)
    order = np.argsort(to_own, axis=1, kind="stable")
    c, to_own, there = np.take_along_axis(c, order, 1), np.take_along_axis(to_own, order, 1), np.take_along_axis(there, order[:, :, None], 1)
    among = 2 - 2 * np.einsum("qcd,qed->qce", there, there)
    out = np.full((len(own), degree), -1, dtype=np.int64)
    left = c >= 0
    rows = np.arange(len(own))
    for k in range(degree):
        first = np.argmax(left, axis=1)
        has = left[rows, first]
        if not has.any():
            break
        out[has, k] = c[rows[has], first[has]]
        left &= ~(alpha * alpha * among[rows, first] <= to_own) | ~has[:, None]
        left[rows, first] = False
    return out


def graph(vectors: np.ndarray, degree: int, width: int, alpha: float, seed: int = 7, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) of the nodes; vectors have length one."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    entries = np.unique(np.concatenate(([int(np.argmax(vectors @ vectors.mean(axis=0)))], rng.permutation(n)[: math.isqrt(n)])))
    edges = np.full((n, degree), -1, dtype=np.int64)
    if n <= degree + 1:
        full = np.tile(np.arange(n), (n, 1))
        edges[:, : n] = np.where(full == np.arange(n)[:, None], -1, full)[:, :degree] if n <= degree else -1
        if n == degree + 1:
            edges = np.stack([np.delete(np.arange(n), i) for i in range(n)])
        return edges, entries
    for i in range(n):
        pick = rng.integers(0, n - 1, size=degree)
        edges[i] = pick + (pick >= i)
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, block):
            own = order[at : at + block]
            found, _ = beam(vectors, edges, entries, vectors[own], width)
            edges[own] = prune(vectors, own, np.concatenate((found, edges[own]), axis=1), degree, a)
            source, target = np.repeat(own, degree), edges[own].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            heads = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            counts = np.diff(np.append(heads, len(target)))
            nth = np.arange(len(target)) - np.repeat(heads, counts)
            # a node that many point to takes their edges `degree` at a time
            for turn in range(int(nth.max()) // degree + 1 if len(nth) else 0):
                now = nth // degree == turn
                nodes, row = np.unique(target[now], return_inverse=True)
                more = np.full((len(nodes), degree), -1, dtype=np.int64)
                more[row, nth[now] % degree] = source[now]
                for b in range(0, len(nodes), 1024):
                    own2 = nodes[b : b + 1024]
                    both = np.concatenate((edges[own2], more[b : b + 1024]), axis=1)
                    edges[own2] = prune(vectors, own2, both, degree, a)
    return edges, entries


def _build(degree: int, width: int, alpha: float):
    def run(pdf):
        import pandas as pd

        ids = pdf["vec_id"].to_numpy(dtype=np.int64)
        original = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        # rows with the same values up to a positive factor that is a power of two or exact are one node; others differ
        scaled = original / np.abs(original).max(axis=1, keepdims=True)
        _, first, node = np.unique(scaled, axis=0, return_index=True, return_inverse=True)
        node = node.ravel()
        directions = unit(original[first]).astype(np.float32)
        edges, entries = graph(directions, degree, width, alpha)
        order = np.lexsort((ids, node))
        return pd.DataFrame([{
            "shard": int(pdf["shard"].iloc[0]), "dim": original.shape[1], "ids": ids[order].tobytes(), "node": node[order].astype(np.int32).tobytes(),
            "vectors": original[order].astype(np.float64).tobytes(), "edges": edges.astype(np.int32).tobytes(), "entries": entries.astype(np.int32).tobytes(),
        }])

    return run


INDEX_SCHEMA = "shard int, dim int, ids binary, node binary, vectors binary, edges binary, entries binary"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector that is neither null, empty nor zero and holds finite
    components only."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")


def build_index(vectors: DataFrame, shard_rows: int = 4_096, degree: int = 24, width: int = 48, alpha: float = 1.2) -> DataFrame:
    """One row for each shard of usable(...) rows. Every row is in the index; shards hold about shard_rows rows of one
    dimension, and vectors of another dimension are in other shards."""
    rows = vectors.select("vec_id", "v", F.size("v").alias("dim"))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    n = min(shards, 4 * partitions(vectors.sparkSession))
    return written(rows.repartition(n, "shard", "dim").groupBy("shard", "dim").applyInPandas(lambda key, pdf: _build(degree, width, alpha)(pdf), INDEX_SCHEMA), "ann-index")


def _opened(x):
    """What a search needs of a shard's row: ids, exact directions, first row of each node, nodes' sizes, directions, edges and
    entries."""
    dim = x["dim"]
    ids, node = np.frombuffer(x["ids"], dtype=np.int64), np.frombuffer(x["node"], dtype=np.int32)
    exact = unit(np.frombuffer(x["vectors"], dtype=np.float64).reshape(-1, dim))
    heads = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    edges = np.frombuffer(x["edges"], dtype=np.int32).reshape(len(heads), -1).astype(np.int64)
    return ids, exact, heads, np.diff(np.append(heads, len(node))), exact[heads].astype(np.float32), edges, np.frombuffer(x["entries"], dtype=np.int32).astype(np.int64)


def _search(k: int, width: int, together: int = 256):
    """Rows of a task: a shard, then blocks of queries for it, then the next shard."""

    def found(shard, query_ids, queries):
        ids, exact, heads, sizes, directions, edges, entries = shard
        nodes, _ = beam(directions, edges, entries, queries.astype(np.float32), max(width, k))
        out = []
        for q, query, hits in zip(queries, query_ids.tolist(), nodes, strict=True):
            hits = hits[hits >= 0]
            # of rows with the same direction, the k + 1 least ids can be among the k nearest
            rows = np.concatenate([np.arange(heads[h], heads[h] + min(sizes[h], k + 1)) for h in hits])
            owner = np.repeat(heads[hits], np.minimum(sizes[hits], k + 1))
            owner, rows = owner[ids[rows] != query], rows[ids[rows] != query]
            sims = np.array([math.fsum(p) for p in (exact[owner] * q).tolist()])
            best = np.lexsort((ids[rows], -sims))[:k]
            out += [(query, int(ids[rows[b]]), float(sims[b])) for b in best]
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    def run(batches):
        shard, held = None, []

        def flush():
            query_ids, queries = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return found(shard, query_ids, queries)

        for batch in batches:
            for x in rows_of(batch):
                if x["block"] < 0:
                    if held:
                        yield flush()
                    shard = _opened(x)
                    continue
                held.append((np.asarray(x["query_ids"], dtype=np.int64), unit(np.asarray(x["query_vs"], dtype=np.float64).reshape(-1, x["dim"]))))
                if sum(len(ids) for ids, _ in held) >= together:
                    yield flush()
        if held:
            yield flush()

    return tidy(run)


def search(index: DataFrame, queries: DataFrame, k: int = 5, width: int = 160, block_rows: int = 64, per_shard: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, v), its k nearest rows that the index finds, but
    those with its own id; ties go to the smaller vec_id.

    Queries are packed into blocks of about block_rows, and each block meets each shard of its dimension once."""
    spark = index.sparkSession
    blocks = max(1, math.ceil(queries.count() / block_rows))
    copies = math.ceil(blocks / per_shard)
    packed = (
        queries.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
        .groupBy("block", "dim").agg(F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("v")).alias("query_vs"))
    )
    shards = small(index.select("shard", "dim"), "ann-shards")
    sent = packed.join(shards, "dim").select("shard", "dim", F.pmod("block", F.lit(copies)).alias("copy"), "block", "query_ids", "query_vs")
    # a shard without queries of its dimension isn't sent at all
    used = index.join(small(queries.select(F.size("v").alias("dim")).distinct(), "ann-dims"), "dim", "left_semi")
    stays = used.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("block", F.lit(-1))
    both = stays.unionByName(sent, allowMissingColumns=True)
    dealt = both.repartition(partitions(spark), "shard", "dim", "copy").sortWithinPartitions("shard", "dim", "copy", "block")
    hits = dealt.mapInArrow(_search(k, width), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """The k nearest of every row whose id is divisible by `every`, by cosine, among all rows but its own.

    Vectors that are null, zero or hold null or non-finite components take no part, as query or candidate; nor do rows
    with a null id. Vectors of another dimension than the query's are no candidates. Repeated rows are candidates
    each; a repeated query id is answered for each of its rows, best first, k in all. With fewer than k candidates all
    are returned. An empty table gives no rows. Other columns are not read."""
    rows = usable(vectors, id_col, vector_col)
    return search(build_index(rows), rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0), k)
