"""Shared pieces of the corpus operators: materialisation, word hashing on raw UTF-8 buffers, components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, written
from ..session import table as read_table

# Freed buffers go back to the system; Python workers live long beside the JVM's heap.
pa.set_memory_pool(pa.system_memory_pool())
_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


#: The six ASCII characters that separate words: space and \x09 to \x0D.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; the Python workers get this package first."""
    ship(spark)
    return read_table(spark, sf_dir, name)


def small(df: DataFrame, what: str, most: int = 500_000) -> DataFrame:
    """df, written, with a broadcast hint if it has at most so many (short) rows; else a join shuffles both sides."""
    df = written(df, what)
    return F.broadcast(df) if df.count() <= most else df


def planned_bytes(df: DataFrame) -> int:
    """The bytes that the planner expects to read. It only sizes structures; no result depends on it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing on buffers

_SEED = np.random.default_rng(20240229)
#: One random 64-bit value for each byte value, and two odd bases of polynomial hashes modulo 2^64.
BYTE_CODE = _SEED.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD_BASE = int(_SEED.integers(1, 2**61)) * 8 + 5
WINDOW_BASE = int(_SEED.integers(1, 2**61)) * 8 + 5
CHECK_BASE = int(_SEED.integers(1, 2**61)) * 8 + 3
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Only rare long texts need more powers than these; workers keep 10 MB of them for each base at most.
KEPT_POWERS = 1_200_000
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept and doubled as needed; more than KEPT_POWERS aren't kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = min(KEPT_POWERS, 1 << max(10, (n - 1).bit_length())) if n <= KEPT_POWERS else n
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base % 2**64)
        np.multiply.accumulate(have, out=have)
        if n <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after the other with a space after each, and where each text
    starts (one more entry than texts). Nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    out = np.full(len(data) + n, 0x20, dtype=np.uint8)
    at = np.ones(len(out), dtype=bool)
    at[offsets[1:] + np.arange(n)] = False
    out[at] = data
    return out, offsets + np.arange(n + 1)


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes that are no separators. The buffer ends with a separator."""
    inside = np.concatenate(([False], ~SPACE[buffer], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; it depends on nothing but those bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    high = powers(WORD_BASE, len(buffer))
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[buffer] * high, out=sums[1:])
    low = powers(pow(WORD_BASE, -1, 2**64), len(buffer))
    return mix((sums[ends] - sums[starts]) * low[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int, base: int = WINDOW_BASE) -> np.ndarray:
    """A 64-bit hash of every n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    k = len(words) - n + 1
    return mix((sums[n:] - sums[:k]) * powers(pow(base, -1, 2**64), k))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values, by doubling."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[: len(x) - (n - width)], x[n - width :])


def sliding_max(x: np.ndarray, n: int) -> np.ndarray:
    return ~sliding_min(~x, n)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def slices(batches, limit: int = 1 << 20):
    """Record batches cut so that the first string column holds about limit bytes in each; a longer text stands
    alone. Hashing holds some forty times those bytes meanwhile."""
    for batch in batches:
        column = next(c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type))
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
        give_back()


def packs(batches, limit: int):
    """Record batches, joined or cut so that the first string column holds about limit bytes in each."""
    held, size = [], 0

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()

    for batch in slices(batches, limit):
        held.append(batch)
        size += batch.nbytes
        if size >= limit // 2:
            yield from joined()
            held, size = [], 0
    if held:
        yield from joined()


def tidy(run):
    """The same function of record batches, which gives memory back when its arrays are gone: workers wait for their next task
    beside the JVM's heap."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def rows_of(batch):
    """The rows of a batch as dictionaries, one at a time: rows here may be megabytes each."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]
    give_back()


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected edge list; component is the least node reachable.

    Each round takes the least label among neighbours and then the label of that label; a written table ends each
    round's lineage. The number of rounds grows with the logarithm of the longest path, and nothing but a count
    comes to the driver."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = written(both.union(both.select("y", "x")).where("x <> y").distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        seen = both.join(labels, both.y == labels.node).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = step.join(jump, "next").select("node", F.col("label").alias("old"), F.least("next", "far").alias("label"))
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
