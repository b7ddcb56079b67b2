"""Exact removal of word passages that occur more than once, behind a count-min prefilter.

A window is `width` consecutive words of one text. Every word that is covered by a window whose word sequence also
starts anywhere else, in the same text or another, is removed.

1. Sketch. Each window is represented by the least hash among its inner grams (`gram` words each). Equal windows
   have equal representatives at equal offsets, so a window that occurs twice has a representative that is
   selected at two positions or more. Each task counts its selected positions in a sparse count-min sketch; the
   partition sketches are merged block by block on the executors into bitmaps of cells that were hit twice or more.
   Counts are only overestimated, so no repeated window is lost.
2. Exact grouping. A second scan keeps the windows whose cells are hit twice in every row of the sketch. Their
   96-bit hashes, each once for a pack of texts, are dealt by hash to shards that find the hashes with two
   occurrences; what a shard returns is one bit for each hash it was sent. A window that is in every text reaches
   its shard once for a pack, not once for a text.
3. Texts without a hot window are finished in step 2; the others are joined to their bits by pack.

The sketch has about four cells for each selected position, by the bytes that the planner reports, at any size of the
input. Up to `max_cells` cells a row it is merged into bitmaps that are broadcast to the second scan. A larger one is
never brought to one place: texts are written in packs with the distinct grams that they select, the grams go to the
owners of their cells, and the owners return a bit for each (`resident_hot`).
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    CHECK_BASE, gram_hashes, mix, partitions, planned_bytes, rows_of, slices, sliding_max, sliding_min, span_hashes, text_buffers, word_spans, written,
)

ROWS = 2
#: Cells of a row are dealt to the mergers in blocks of 2^BLOCK_BITS.
BLOCK_BITS = 20
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def sketch_bits(size_in_bytes: int) -> int:
    """log2 of the cells in a row: about four for each selected position."""
    positions = max(1, size_in_bytes) * 2 / 5.5 * 0.08
    return max(BLOCK_BITS, math.ceil(math.log2(4 * positions)))


def cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(grams * _ODD[row]) >> np.uint64(64 - bits)).astype(np.int64)


def hashed(column: pa.Array):
    """Word hashes of all texts of a column with word starts, word ends, the buffer, and the number of words of each text."""
    buffer, offsets = text_buffers(column)
    starts, ends = word_spans(buffer)
    words = span_hashes(buffer, starts, ends)
    firsts = np.searchsorted(starts, offsets)
    return words, starts, ends, buffer, firsts


def window_starts(firsts: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Which of the n_words - width + 1 windows of the concatenated words lie within one text."""
    k = max(0, n_words - width + 1)
    # a window that starts within width - 1 words before a boundary crosses it
    delta = np.zeros(k + 1, dtype=np.int32)
    np.add.at(delta, np.clip(firsts[1:-1] - width + 1, 0, k), 1)
    np.add.at(delta, np.clip(firsts[1:-1], 0, k), -1)
    return np.cumsum(delta[:-1]) == 0


def representatives(words: np.ndarray, ok: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The least gram hash of every window, and the hashes of the positions that are selected by a window within
    one text."""
    grams = gram_hashes(words, gram)
    inner = width - gram + 1
    least = sliding_min(grams, inner)
    shown = np.where(ok, least, np.uint64(0))
    padded = np.concatenate((np.zeros(inner - 1, dtype=np.uint64), shown, np.zeros(inner - 1, dtype=np.uint64)))
    # a position is selected if some valid window that holds it has it as its least: the greatest of those least values
    return least, grams[sliding_max(padded, inner) == grams]


def _sketcher(bits: int, width: int, gram: int):
    def run(batches):
        parts: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        held = 0

        def flush():
            for row in range(ROWS):
                if not parts[row]:
                    continue
                values, counts = np.unique(np.concatenate(parts[row]), return_counts=True)
                blocks = values >> BLOCK_BITS
                edges = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True])))
                local = (values & ((1 << BLOCK_BITS) - 1)).astype(np.uint32)
                packed = local | ((counts > 1).astype(np.uint32) << np.uint32(31))
                yield pa.RecordBatch.from_pydict(
                    {"row": pa.array([row] * (len(edges) - 1), pa.int32()), "block": pa.array(blocks[edges[:-1]], pa.int32()),
                     "cells": pa.array([packed[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())}
                )
                parts[row].clear()

        for batch in slices(batches):
            words, _, _, _, firsts = hashed(batch.column(0))
            if len(words) < width:
                continue
            ok = window_starts(firsts, len(words), width)
            _, chosen = representatives(words, ok, width, gram)
            for row in range(ROWS):
                parts[row].append(cells(chosen, row, bits))
            held += len(chosen)
            if held >= 2 << 20:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _merge(batches):
    """Partition sketches of one block, each a list of cells with a flag for two hits, to a bitmap of cells hit twice."""
    current, seen, twice = None, None, None

    def out():
        return pa.RecordBatch.from_pydict({"row": pa.array([current[0]], pa.int32()), "block": pa.array([current[1]], pa.int32()), "hot": pa.array([np.packbits(twice).tobytes()], pa.binary())})

    for batch in batches:
        for row, block, blob in zip(batch.column("row").to_pylist(), batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            if current != (row, block):
                if current is not None:
                    yield out()
                current, seen, twice = (row, block), np.zeros(1 << BLOCK_BITS, dtype=bool), np.zeros(1 << BLOCK_BITS, dtype=bool)
            packed = np.frombuffer(blob, dtype=np.uint32)
            at, many = packed & np.uint32(0x7FFFFFFF), packed >> np.uint32(31) == 1
            twice[at[many | seen[at]]] = True
            seen[at] = True
    if current is not None:
        yield out()


def repeated_cells(texts: DataFrame, bits: int, width: int, gram: int) -> np.ndarray:
    """The merged sketch as packed bits, ROWS x 2^bits / 8 bytes."""
    spark = texts.sparkSession
    sparse = texts.mapInArrow(_sketcher(bits, width, gram), "row int, block int, cells binary")
    merged = sparse.repartition(partitions(spark), "row", "block").sortWithinPartitions("row", "block").mapInArrow(_merge, "row int, block int, hot binary")
    out = np.zeros((ROWS, (1 << bits) // 8), dtype=np.uint8)
    size = (1 << BLOCK_BITS) // 8
    for x in merged.toLocalIterator():
        out[x["row"], x["block"] * size : (x["block"] + 1) * size] = np.frombuffer(x["hot"], dtype=np.uint8)
    return out


def is_hot(sketch: np.ndarray, grams: np.ndarray, bits: int) -> np.ndarray:
    hot = np.ones(len(grams), dtype=bool)
    for row in range(ROWS):
        at = cells(grams, row, bits)
        hot &= (sketch[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return hot


def sized(answers: DataFrame, column: str, max_broadcast: int) -> DataFrame:
    """Answers of a bit for each hash, broadcast while they are little: packs then needn't be shuffled to them."""
    size = answers.agg(F.sum(F.aggregate(column, F.lit(0).cast("long"), lambda a, v: a + F.length(v["bits"]) + 64))).first()[0] or 0
    return F.broadcast(answers) if size <= max_broadcast else answers


TEXTS_SCHEMA = "pack string, ids array<long>, texts array<string>, grams binary, many binary"


def _select(width: int, gram: int):
    """Packs of whole texts, with the distinct grams that their windows select, ascending, and which occur there twice."""

    def run(batches):
        for batch in slices(batches):
            words, _, _, _, firsts = hashed(batch.column(1))
            grams, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            if len(words) >= width:
                grams, counts = np.unique(representatives(words, window_starts(firsts, len(words), width), width, gram)[1], return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {"pack": [uuid.uuid4().hex], "ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), "texts": pa.array([batch.column(1).to_pylist()], pa.list_(pa.string())),
                 "grams": pa.array([grams.tobytes()], pa.binary()), "many": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())}
            )

    return run


def _deal_cells(bits: int, owned: int):
    """Each pack's cells, ascending, in one blob for each owner (a row and a range of 2^owned cells)."""

    def run(batches):
        for batch in batches:
            for x in rows_of(batch):
                grams = np.frombuffer(x["grams"], dtype=np.uint64)
                many = np.unpackbits(np.frombuffer(x["many"], dtype=np.uint8), count=len(grams)).astype(np.uint32)
                for row in range(ROWS if len(grams) else 0):
                    at = cells(grams, row, bits)
                    order = np.argsort(at, kind="stable")
                    at = at[order]
                    packed = (at & ((1 << owned) - 1)).astype(np.uint32) | (many[order] << np.uint32(31))
                    owner = at >> owned
                    edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
                    yield pa.RecordBatch.from_pydict(
                        {"pack": [x["pack"]] * (len(edges) - 1), "row": pa.array([row] * (len(edges) - 1), pa.int32()), "owner": pa.array(owner[edges[:-1]], pa.int64()),
                         "cells": pa.array([packed[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())}
                    )

    return run


def _judge_cells(owned: int):
    """A bit for each cell that a pack sent: whether it is hit twice by all packs. An owner's rows come one after the
    other; one owner is held at a time."""
    held: list[tuple] = []

    def verdict():
        seen, twice = np.zeros(1 << owned, dtype=bool), np.zeros(1 << owned, dtype=bool)
        for x in held:
            packed = np.frombuffer(x[3], dtype=np.uint32)
            at, many = packed & np.uint32(0x7FFFFFFF), packed >> np.uint32(31) == 1
            twice[at[many | seen[at]]] = True
            seen[at] = True
        hot = [twice[np.frombuffer(x[3], dtype=np.uint32) & np.uint32(0x7FFFFFFF)] for x in held]
        return pa.RecordBatch.from_pydict(
            {"pack": [x[0] for x in held], "row": pa.array([x[1] for x in held], pa.int32()), "owner": pa.array([x[2] for x in held], pa.int64()),
             "bits": pa.array([np.packbits(h).tobytes() for h in hot], pa.binary()), "n": pa.array([len(h) for h in hot], pa.int32())}
        )

    def run(batches):
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("pack", "row", "owner", "cells")), strict=True):
                if held and held[0][1:3] != x[1:3]:
                    yield verdict()
                    held.clear()
                held.append(x)
        if held:
            yield verdict()
            held.clear()

    return run


def resident_hot(packed: DataFrame, bits: int, owned: int, max_broadcast: int) -> DataFrame:
    """The packs of texts with `hits`: for each row of the sketch and owner, the bits of the pack's cells."""
    spark = packed.sparkSession
    dealt = packed.select("pack", "grams", "many").mapInArrow(_deal_cells(bits, owned), "pack string, row int, owner long, cells binary")
    judged = dealt.repartition(partitions(spark), "row", "owner").sortWithinPartitions("row", "owner").mapInArrow(_judge_cells(owned), "pack string, row int, owner long, bits binary, n int")
    hits = written(judged.groupBy("pack").agg(F.collect_list(F.struct("row", "owner", "bits", "n")).alias("hits")), "hits")
    return packed.drop("many").join(sized(hits, "hits", max_broadcast), "pack", "left")


def hot_grams(grams: np.ndarray, hits: list[dict], bits: int) -> np.ndarray:
    """Which of a pack's distinct grams have cells hit twice in every row of the sketch."""
    hot = np.ones(len(grams), dtype=bool)
    for row in range(ROWS):
        marks = [np.unpackbits(np.frombuffer(v["bits"], dtype=np.uint8), count=v["n"]) for v in sorted((v for v in hits if v["row"] == row), key=lambda v: v["owner"])]
        order = np.argsort(cells(grams, row, bits), kind="stable")
        hot[order] &= np.concatenate(marks).astype(bool)
    return hot


PACK_SCHEMA = "pack string, ids array<long>, n_words array<int>, texts array<string>, spots binary, first binary, second binary, done_ids array<long>, done_words array<int>, done_sha array<string>"


def _packed(ids: list, texts: pa.Array, width: int, gram: int, hot_of) -> pa.RecordBatch:
    """A pack of texts with the hashes of the windows whose representatives are hot; texts without any are finished."""
    words, starts, ends, buffer, firsts = hashed(texts)
    counts = np.diff(firsts)
    hot_text = np.zeros(len(ids), dtype=bool)
    spots = np.zeros(0, dtype=np.int64)
    if len(words) >= width:
        ok = window_starts(firsts, len(words), width)
        least, _ = representatives(words, ok, width, gram)
        spots = np.flatnonzero(ok)
        spots = spots[hot_of(least[spots])]
        hot_text[np.searchsorted(firsts, spots, side="right") - 1] = True
    first = gram_hashes(words, width)[spots] if len(spots) else np.zeros(0, dtype=np.uint64)
    second = (gram_hashes(words, width, CHECK_BASE)[spots] >> np.uint64(32)).astype(np.uint32) if len(spots) else np.zeros(0, dtype=np.uint32)
    # spots count words from the first word of the pack's hot texts
    kept_before = np.concatenate(([0], np.cumsum(np.where(hot_text, counts, 0))))
    text_of = np.searchsorted(firsts, spots, side="right") - 1
    moved = (spots - firsts[text_of] + kept_before[text_of]).astype(np.uint32)
    hot_at, cold_at = np.flatnonzero(hot_text), np.flatnonzero(~hot_text)
    raw = buffer.tobytes()
    sha = [hashlib.sha256(b" ".join(raw[starts[firsts[i]] : ends[firsts[i + 1] - 1]].split()) if counts[i] else b"").hexdigest() for i in cold_at]
    hot_texts = texts.take(pa.array(hot_at)).to_pylist()
    return pa.RecordBatch.from_pydict(
        {
            "pack": [uuid.uuid4().hex], "ids": pa.array([[ids[i] for i in hot_at]], pa.list_(pa.int64())), "n_words": pa.array([counts[hot_at].tolist()], pa.list_(pa.int32())),
            "texts": pa.array([hot_texts], pa.list_(pa.string())), "spots": pa.array([moved.tobytes()], pa.binary()), "first": pa.array([first.tobytes()], pa.binary()), "second": pa.array([second.tobytes()], pa.binary()),
            "done_ids": pa.array([[ids[i] for i in cold_at]], pa.list_(pa.int64())), "done_words": pa.array([counts[cold_at].tolist()], pa.list_(pa.int32())), "done_sha": pa.array([sha], pa.list_(pa.string())),
        }
    )


def _pack(sketch, bits: int, width: int, gram: int):
    def run(batches):
        merged = sketch.value
        for batch in slices(batches):
            yield _packed(batch.column(0).to_pylist(), batch.column(1), width, gram, lambda grams: is_hot(merged, grams, bits))

    return run


def _pack_resident(bits: int, width: int, gram: int):
    def run(batches):
        for batch in batches:
            for x in rows_of(batch):
                grams = np.frombuffer(x["grams"], dtype=np.uint64)
                hot = hot_grams(grams, x["hits"] or [], bits) if len(grams) else np.zeros(0, dtype=bool)
                yield _packed(x["ids"], pa.array(x["texts"], pa.string()), width, gram, lambda least, g=grams, h=hot: h[np.searchsorted(g, least)])

    return run


def _distinct(first: np.ndarray, second: np.ndarray):
    """Order of the windows by hash, the start of each group of equal 96-bit hashes in that order."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(order) else np.zeros(0, dtype=np.int64)


def _deal(shards: int):
    """Each pack's distinct window hashes, dealt to shards by hash, with a flag for those that the pack has twice."""

    def run(batches):
        for batch in batches:
            for x in rows_of(batch):
                pack, first, second = x["pack"], x["first"], x["second"]
                first, second = np.frombuffer(first, dtype=np.uint64), np.frombuffer(second, dtype=np.uint32)
                order, heads = _distinct(first, second)
                if not len(heads):
                    continue
                many = np.diff(np.append(heads, len(order))) > 1
                a, b = first[order][heads], second[order][heads]
                shard = (a >> np.uint64(32)).astype(np.int64) * shards >> 32
                edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
                yield pa.RecordBatch.from_pydict(
                    {
                        "pack": [pack] * (len(edges) - 1), "shard": pa.array(shard[edges[:-1]], pa.int32()), "first": pa.array([a[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                        "second": pa.array([b[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), "many": pa.array([np.packbits(many[i:j]).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    }
                )

    return run


def _judge(batches):
    """For each shard, which of the hashes that each pack sent have two occurrences or more. A shard's rows come
    one after the other; one shard is held at a time."""
    held: list[tuple] = []

    def verdict():
        firsts = [np.frombuffer(x[2], dtype=np.uint64) for x in held]
        seconds = [np.frombuffer(x[3], dtype=np.uint32) for x in held]
        many = np.concatenate([np.unpackbits(np.frombuffer(x[4], dtype=np.uint8), count=len(f)) for x, f in zip(held, firsts, strict=True)]).astype(bool)
        order, heads = _distinct(np.concatenate(firsts), np.concatenate(seconds))
        sizes = np.diff(np.append(heads, len(order)))
        repeated = (sizes > 1) | np.logical_or.reduceat(many[order], heads)
        out = np.zeros(len(order), dtype=bool)
        out[order] = np.repeat(repeated, sizes)
        edges = np.cumsum([0] + [len(f) for f in firsts])
        return pa.RecordBatch.from_pydict(
            {"pack": [x[0] for x in held], "shard": pa.array([x[1] for x in held], pa.int32()), "bits": pa.array([np.packbits(out[i:j]).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
             "n": pa.array(np.diff(edges), pa.int32())}
        )

    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("pack", "shard", "first", "second", "many")), strict=True):
            if held and held[0][1] != x[1]:
                yield verdict()
                held.clear()
            held.append(x)
    if held:
        yield verdict()


RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _apply(width: int, with_text: bool):
    def run(batches):
        for batch in batches:
            for x in rows_of(batch):
                verdicts = sorted(x["verdicts"] or [], key=lambda v: v["shard"])
                first, second = np.frombuffer(x["first"], dtype=np.uint64), np.frombuffer(x["second"], dtype=np.uint32)
                spots = np.frombuffer(x["spots"], dtype=np.uint32).astype(np.int64)
                total = sum(x["n_words"])
                cover = np.zeros(total + 1, dtype=np.int32)
                if verdicts:
                    order, heads = _distinct(first, second)
                    marks = np.concatenate([np.unpackbits(np.frombuffer(v["bits"], dtype=np.uint8), count=v["n"]) for v in verdicts]).astype(bool)
                    again = np.zeros(len(order), dtype=bool)
                    again[order] = np.repeat(marks, np.diff(np.append(heads, len(order))))
                    hit = spots[again]
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + width, -1)
                gone = np.cumsum(cover[:-1]) > 0
                out, at = [], 0
                for i, n, text in zip(x["ids"], x["n_words"], x["texts"], strict=True):
                    words, drop = text.encode().split(), gone[at : at + n]
                    at += n
                    kept = b" ".join(w for w, g in zip(words, drop.tolist(), strict=True) if not g)
                    out.append((i, n, int(drop.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                out += [(i, n, 0, s, None) for i, n, s in zip(x["done_ids"], x["done_words"], x["done_sha"], strict=True)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, gram: int = 8, max_cells: int = 1 << 28, owned_bits: int = 22, shard_windows: int = 1 << 20, max_broadcast: int = 64 << 20,
    with_text: bool = False,
) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 (lower-case hex of the kept words joined by
    one space, UTF-8) and, if with_text, kept (null where nothing was removed).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null texts and texts without words have 0 words and the hash of the empty
    string. Texts of fewer than `width` words lose nothing. Repeated rows are two texts: each loses what the other
    repeats. A null id stays null. An empty table gives no rows. Other columns are not read.

    max_cells: a larger sketch stays with its owners, 2^owned_bits cells each; results are the same either way."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = sketch_bits(planned_bytes(rows))
    if 1 << bits <= max_cells:
        sketch = spark.sparkContext.broadcast(repeated_cells(rows.select("text"), bits, width, gram))
        packed = rows.mapInArrow(_pack(sketch, bits, width, gram), PACK_SCHEMA)
    else:
        texts = written(rows.mapInArrow(_select(width, gram), TEXTS_SCHEMA), "texts", row_group=16 << 20)
        packed = resident_hot(texts, bits, min(bits, owned_bits), max_broadcast).mapInArrow(_pack_resident(bits, width, gram), PACK_SCHEMA)
    packs = written(packed, "packs", row_group=16 << 20)
    hot = packs.agg(F.sum(F.length("first") / 8)).first()[0] or 0
    shards = max(1, math.ceil(hot / shard_windows), partitions(spark))
    dealt = packs.select("pack", "first", "second").mapInArrow(_deal(shards), "pack string, shard int, first binary, second binary, many binary")
    judged = dealt.repartition(partitions(spark), "shard").sortWithinPartitions("shard").mapInArrow(_judge, "pack string, shard int, bits binary, n int")
    verdicts = written(judged.groupBy("pack").agg(F.collect_list(F.struct("shard", "bits", "n")).alias("verdicts")), "verdicts")
    out = packs.join(sized(verdicts, "verdicts", max_broadcast), "pack", "left").mapInArrow(_apply(width, with_text), RESULT_SCHEMA)
    return out if with_text else out.drop("kept")
