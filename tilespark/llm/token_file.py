"""Token ids in a bit-plane file format, written in document order and read back.

Segment (one row of a Parquet table, so that any store that Spark writes can hold it):

* the ids of consecutive documents, each ended by `end_id`, cut into blocks of `block` ids; only the last is shorter.
  No document crosses a segment; a segment takes documents until it holds `segment` ids.
* a block is a matrix of 32-bit little-endian ids, transposed into 4 byte planes ("byte") or 32 bit planes ("bit");
  each plane is a zstandard frame.
* `data` holds the frames one after the other; `chunk_index` holds, for every block, the number of ids and the
  length of each frame as little-endian unsigned 32-bit integers: any block can be found and read alone.
* `doc_ids` and `doc_lengths` say whose ids they are; `part` (the first id of its range of ids) and `inner` (ids of
  the range before this segment) order the segments. `start`, added on reading, is the number of ids in all
  segments before.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packs, partitions, tidy, written
from .tokens import load

PLANES = {"byte": 4, "bit": 32}
#: Stands for a range of ids that begins with a null.
FIRST = -(2**63)
#: Bytes of text that are encoded at once; a longer text is encoded alone.
SLICE = 4 << 20


def encode_block(ids: np.ndarray, mode: str, level: int = 1) -> list[bytes]:
    """The compressed planes of one block of ids."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if mode == "bit":
        planes = [p.tobytes() for p in np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)]
    else:
        planes = [p.tobytes() for p in np.ascontiguousarray(rows.T)]
    compress = zstandard.ZstdCompressor(level=level).compress
    return [compress(p) for p in planes]


def decode_block(frames: list[bytes], n: int, mode: str) -> np.ndarray:
    decompress = zstandard.ZstdDecompressor().decompress
    planes = [np.frombuffer(decompress(f), dtype=np.uint8) for f in frames]
    if mode == "bit":
        bits = np.stack([np.unpackbits(p, count=n) for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    else:
        rows = np.stack(planes, axis=1)
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def encode_segment(ids: np.ndarray, block: int, mode: str) -> tuple[bytes, bytes]:
    """(data, chunk_index) of a run of ids."""
    data, index = [], []
    for at in range(0, len(ids), block):
        piece = ids[at : at + block]
        frames = encode_block(piece, mode)
        data += frames
        index += [len(piece), *map(len, frames)]
    return b"".join(data), np.asarray(index, dtype="<u4").tobytes()


def read_blocks(data: bytes, chunk_index: bytes, mode: str, only: range | None = None) -> list[np.ndarray]:
    """The blocks of a segment, or those of a range of block numbers, found by the chunk index."""
    index = np.frombuffer(chunk_index, dtype="<u4").reshape(-1, 1 + PLANES[mode]).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(index[:, 1:].sum(axis=1))))
    out = []
    for k in only if only is not None else range(len(index)):
        edges = begin[k] + np.concatenate(([0], np.cumsum(index[k, 1:])))
        out.append(decode_block([data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], int(index[k, 0]), mode))
    return out


SEGMENT_SCHEMA = "part long, inner long, doc_ids array<long>, doc_lengths array<long>, n_ids long, n_blocks int, mode string, chunk_index binary, data binary"


def _encode(path: str, end_id: int, block: int, segment: int, mode: str):
    def run(batches):
        tokenizer = load(path)
        part, inner, keys, lengths, packed, held = None, 0, [], [], [], 0

        def out():
            flat, own = np.concatenate(packed), np.concatenate(lengths)
            data, index = encode_segment(flat, block, mode)
            ids = pa.concat_arrays(keys)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int64()), "inner": pa.array([inner], pa.int64()), "doc_ids": pa.ListArray.from_arrays([0, len(ids)], ids), "doc_lengths": pa.ListArray.from_arrays([0, len(own)], pa.array(own, pa.int64())),
                 "n_ids": pa.array([len(flat)], pa.int64()), "n_blocks": pa.array([-(-len(flat) // block)], pa.int32()), "mode": [mode], "chunk_index": pa.array([index], pa.binary()), "data": pa.array([data], pa.binary())}
            )

        for batch in packs(batches, SLICE):
            key = batch.column("doc_id")
            if part is None and batch.num_rows:
                part = key[0].as_py() if key[0].is_valid else FIRST
            ids, counts = tokenizer.packed(batch.column("text"))
            counts = counts + 1
            ends = np.cumsum(counts)
            every = np.empty(int(ends[-1]), dtype="<u4")
            last = np.zeros(len(every), dtype=bool)
            last[ends - 1] = True
            every[last], every[~last] = end_id, ids
            begin = done = 0  # rows and ids of this batch that are in segments
            while begin < batch.num_rows:
                stop = int(np.searchsorted(ends, done + segment - held, side="left")) + 1  # the row that fills the segment is in it
                stop = min(stop, batch.num_rows)
                to = int(ends[stop - 1])
                keys.append(key.slice(begin, stop - begin))
                lengths.append(counts[begin:stop])
                packed.append(every[done:to])
                held += to - done
                begin, done = stop, to
                if held >= segment:
                    yield out()
                    inner, keys, lengths, packed, held = inner + held, [], [], [], 0
        if keys:
            yield out()

    return tidy(run)


def write_segments(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block: int = 65_536, segment: int = 1 << 20, mode: str = "byte", path: str | None = None
) -> DataFrame:
    """The segments of all documents in ascending order of id, written to path (or the shared folder) and read back.

    Documents are dealt to ranges of ids, sorted there and encoded in one pass.
    Null texts are empty: the end id alone. A null id comes before all others. Rows with equal ids are ordered by
    text; equal rows are written each. An empty table gives no segments."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    segments = ordered.mapInArrow(_encode(tokenizer_path, end_id, block, segment, mode), SEGMENT_SCHEMA)
    if path is not None:
        segments.write.parquet(path)
        kept = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    else:
        kept = written(segments, "token-ids")
    # one short row for each range of ids, of which there are as many as shuffle partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return kept.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("inner")).drop("part_start")


def _digest(batches):
    for batch in batches:
        for x in batch.to_pylist():
            flat = np.concatenate(read_blocks(x["data"], x["chunk_index"], x["mode"])) if x["n_blocks"] else np.zeros(0, dtype="<u4")
            raw, lengths = memoryview(flat.astype("<u4", copy=False).tobytes()), np.asarray(x["doc_lengths"], dtype=np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["doc_ids"], pa.int64()), pa.array(x["start"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the segments alone."""
    return segments.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
