"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both agree.

Texts of up to `chunk` bytes are encoded whole. A longer text is cut into chunks of `chunk` bytes (at whole characters),
each with `overlap` bytes of the next one. Chunks are dealt to all tasks, so one huge text is not one task's work. Every
chunk is encoded with offsets and reports, for the overlaps at its two ends, the boundaries between tokens, as (offset in
the text, mark), and how many of its tokens lie before each. Two neighbours are spliced at the first boundary that both
report with the same mark:

* where the tokenizer file allows a proof (see tokens.py), boundaries are those at which a token begins in any context,
  and the mark is 0;
* elsewhere every boundary in the overlap is one, and the mark is a hash of the ids and offsets of the tokens on either
  side of it: it is the same only where both encodings have come into step.

Where neighbours have no boundary in common, the two are encoded again with an overlap widened eightfold, and again, until
it reaches the text's end; a text that has no common boundary even then is encoded whole. As every offset is counted
from its own chunk's begin, the sums hold whichever boundary each edge takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packs, partitions, tidy, written
from .tokens import load

#: Proven boundaries that a chunk reports for each of its edges, at most; one is enough for a splice.
REPORTED = 4
#: Each widening of the overlap.
WIDER = 8
#: Bytes of text that are encoded at once; a longer text is encoded alone.
SLICE = 4 << 20


def _whole_character(data: bytes, at: int) -> int:
    """The first place from `at` on where a character begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def cut(data: bytes, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of each chunk; it shares [the next one's begin, end) with the next one. The last one ends with the text."""
    out, begin = [], 0
    while True:
        right = _whole_character(data, begin + chunk)
        end = _whole_character(data, right + overlap)
        if end >= len(data):
            out.append((begin, len(data)))
            return out
        out.append((begin, end))
        begin = right


def _within(marks, begin: int, lo: int, hi: int, most: int | None):
    """The marks of a chunk that begins at `begin` whose offsets in the text are in [lo, hi), the first `most` of them."""
    at, mark, before = marks
    a, b = np.searchsorted(at, (lo - begin, hi - begin))
    if most is not None:
        b = min(b, a + most)
    return list(zip((at[a:b] + begin).tolist(), mark[a:b].tolist(), strict=True)), before[a:b].tolist()


def _most(tokenizer) -> int | None:
    return REPORTED if tokenizer.proven else None


def splice(before: tuple[list, list], after: tuple[list, list]) -> int | None:
    """Tokens of the chunk before and less those of the chunk after that lie before their first common boundary."""
    there = dict(zip(*after, strict=True))
    return next((n - there[m] for m, n in zip(*before, strict=True) if m in there), None)


def spliced(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of one text by overlapping chunks, in one task."""
    data = text.encode()
    cuts = cut(data, chunk, overlap)
    marks = lambda begin, end: (lambda n, m: (int(n[0]), m[0]))(*tokenizer.marks(pa.array([data[begin:end].decode()], pa.string())))
    found = [marks(*c) for c in cuts]
    total = found[-1][0]
    for k, (begin, end) in enumerate(cuts[:-1]):
        right, width, a, b, b_end = cuts[k + 1][0], overlap, found[k][1], found[k + 1][1], cuts[k + 1][1]
        while True:
            n = splice(_within(a, begin, right, end, _most(tokenizer)), _within(b, right, right, end, _most(tokenizer)))
            if n is not None or end == len(data):
                break
            width *= WIDER
            end = _whole_character(data, min(right + width, len(data)))
            b_end = max(b_end, end)
            a, b = marks(begin, end)[1], marks(right, b_end)[1]
        if n is None:
            return tokenizer.count(text)
        total += n
    return total


def token_count(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk: int = 16_384, overlap: int = 1_024) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The counts are those of the tokenizer on the whole text, without added special tokens; special strings inside a
    text are handled as the file has it. Null texts count as empty: 0 bytes and 0 tokens. Repeated rows are counted
    each. A null id stays null. An empty table gives no rows. Other columns are not read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    short = rows.where(F.col("n_bytes") <= chunk)
    counted = short.select(F.struct("doc_id", "n_bytes").alias("row"), "text").mapInArrow(_counter(tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
    long = rows.where(F.col("n_bytes") > chunk)
    return counted.union(_long_counts(long, tokenizer_path, chunk, overlap)).withColumn("over_limit", F.col("n_tokens") > limit)


def _counter(path: str):
    def run(batches):
        tokenizer = load(path)
        for batch in packs(batches, SLICE):
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row.field(0), row.field(1), pa.array(tokenizer.counts(batch.column(1)), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return tidy(run)


PIECES = "doc long, begin long, left long, left_end long, right long, right_end long, final boolean, only int, edge int, piece string"
REPORTS = "doc long, edge int, after boolean, marks array<struct<at: bigint, mark: bigint>>, before array<bigint>, total long"


def _long_counts(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens of rows whose texts are longer than a chunk."""
    spark = long.sparkSession
    # repeated rows are told apart by a number, which is written, so that later jobs read the same ones
    kept = written(long.withColumn("doc", F.monotonically_increasing_id()), "long-texts")
    n_bytes = kept.agg(F.max("n_bytes")).first()[0]
    if n_bytes is None:
        return kept.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_tokens"))
    reports = written(_reports(kept.select("doc", "text", F.lit(None).cast("array<int>").alias("edges")), path, chunk, overlap, overlap), "token-boundaries")
    totals = reports.where("total is not null").select("doc", F.col("total").alias("n"))
    width = overlap
    while True:
        sides = reports.where("total is null").groupBy("doc", "edge").agg(*[F.max(F.when(F.col("after") == side, F.struct("marks", "before"))).alias(name) for name, side in (("a", False), ("b", True))])
        first = F.get(F.array_intersect("a.marks", "b.marks"), F.lit(0))
        sides = sides.withColumn("first", first).withColumn("n", F.expr("a.before[cast(array_position(a.marks, first) as int) - 1] - b.before[cast(array_position(b.marks, first) as int) - 1]"))
        edges = written(sides.select("doc", "edge", "n"), "token-splices")
        totals = totals.union(edges.where("n is not null").select("doc", "n"))
        failed = edges.where("n is null").groupBy("doc").agg(F.collect_list("edge").alias("edges"))
        if edges.where("n is null").isEmpty() or width >= n_bytes:
            break
        width *= WIDER
        reports = written(_reports(kept.join(failed, "doc").select("doc", "text", "edges"), path, chunk, overlap, width), "token-boundaries")
    sums = totals.join(failed, "doc", "left_anti").groupBy("doc").agg(F.sum("n").alias("n_tokens"))
    whole = kept.join(failed, "doc", "left_semi").select(F.struct("doc", "n_bytes").alias("row"), "text").mapInArrow(_counter(path), "doc_id long, n_bytes long, n_tokens long")
    every = sums.union(whole.select("doc_id", "n_tokens"))
    return kept.select("doc", "doc_id", "n_bytes").join(every, "doc").select("doc_id", "n_bytes", "n_tokens")


def _reports(texts: DataFrame, path: str, chunk: int, overlap: int, width: int) -> DataFrame:
    """The boundaries of all chunks of (doc, text), or, where `edges` lists some, those of the chunks on either side of
    them with overlaps of `width`."""
    pieces = texts.mapInArrow(_cut_rows(chunk, overlap, width), PIECES)
    return pieces.repartition(partitions(texts.sparkSession)).mapInArrow(_report(path), REPORTS)


def _cut_rows(chunk: int, overlap: int, width: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string())
    names = [c.split()[0] for c in PIECES.split(", ")]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        out, size = [], 0
        for batch in batches:
            for doc, text, edges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for row in pieces(doc, data, edges):
                    out.append(row)
                    size += len(row[-1])
                    if size > SLICE:
                        yield batch_of(out)
                        out, size = [], 0
        if out:
            yield batch_of(out)

    def pieces(doc, data, edges):
        cuts = cut(data, chunk, overlap)
        if edges is None:
            for k, (begin, end) in enumerate(cuts):
                final, left_end = k == len(cuts) - 1, cuts[k - 1][1] if k else begin
                right = end if final else cuts[k + 1][0]
                yield doc, begin, begin, left_end, right, end, final, -1, k, data[begin:end].decode()
            return
        for k in edges:
            begin, right = cuts[k][0], cuts[k + 1][0]
            end = _whole_character(data, min(right + width, len(data)))
            yield doc, begin, begin, begin, right, end, False, 0, k, data[begin:end].decode()
            yield doc, right, right, end, end, end, False, 1, k + 1, data[right : max(end, cuts[k + 1][1])].decode()

    return run


def _report(path: str):
    """Of each piece its edges: with `only` 0 or 1 its right or its left one, else both, and the last piece's tokens."""
    mark = pa.list_(pa.struct([("at", pa.int64()), ("mark", pa.int64())]))
    kinds = (pa.int64(), pa.int32(), pa.bool_(), mark, pa.list_(pa.int64()), pa.int64())
    names = ["doc", "edge", "after", "marks", "before", "total"]

    def run(batches):
        tokenizer = load(path)
        for batch in packs(batches, SLICE):
            counts, found = tokenizer.marks(batch.column("piece"))
            out = []
            for k, (doc, begin, left, left_end, right, right_end, final, only, edge) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)):
                if only != 0 and (edge > 0):
                    marks, before = _within(found[k], begin, left, left_end, _most(tokenizer))
                    out.append((doc, edge - 1, True, [{"at": a, "mark": m} for a, m in marks], before, None))
                if only != 1 and not final:
                    marks, before = _within(found[k], begin, right, right_end, _most(tokenizer))
                    out.append((doc, edge, False, [{"at": a, "mark": m} for a, m in marks], before, None))
                if final:
                    out.append((doc, edge, False, None, None, int(counts[k])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return tidy(run)
