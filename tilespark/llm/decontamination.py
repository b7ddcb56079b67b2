"""Benchmark decontamination by canonical templates.

Texts become sequences of template words: lower case, without punctuation; a word with a digit is a number
placeholder, a number with a letter suffix or a unit after a number is a unit placeholder, and a word that begins with a
capital may be a name placeholder. Texts are read in three ways, and windows of all are hashed: names are the capitals
within a sentence and a line; the capitals within a sentence, however lines break; all capitals. So where a name stands and
how white space lies hides no match. A run of name words, or of number words, is one placeholder. Windows of
`width` template words are hashed; a benchmark item that is shorter is one window. Documents' windows are hash-joined with
the items' windows. Positions count words as they stand, before runs become one.

A match has a shift, the window's position in the document less that in the item. Inserted or dropped words, and slots of
another number of words, move it; so the matches of one shift are judged alone and together with those of shifts less
than the item's length away, the nearest first. A document holds the item if these windows are at least `coverage` of the
item's windows, or cover at least `coverage` of the words that these cover, half of a window's template words at least
aren't placeholders, and the slots are consistent: equal names or units of the item face equal ones of the document, and
the reverse; numbers may face any. A name that faces several keeps itself, else the one that it faces at most places;
windows with another one, or without a most frequent one, don't count, and neither do the words under them. So a question
with other numbers or names is caught, and a text that merely has names in the same places is not.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WINDOW_BASE, gram_hashes, mix, partitions, powers, ragged, slices, small, span_hashes, text_buffers, tidy, word_spans, written

# Words that are units when they follow a number.
UNITS = "mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hours minutes seconds days weeks months years percent usd eur dollars euros cents miles meters metres grams litres liters".split()

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LITERAL, _NUMBER, _UNIT, _NAME = 0, 1, 2, 3
_PLACEHOLDER = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], dtype=np.uint64)


def _unit_hashes() -> np.ndarray:
    buffer, _ = text_buffers(pa.array(UNITS))
    return np.sort(span_hashes(buffer, *word_spans(buffer)))


def templates(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(exact hash, its kind in each reading) of every word that has a letter or digit, and where each text's words begin."""
    buffer, offsets = text_buffers(column)
    word_at = _WORD_BYTE[buffer]
    # punctuation inside or around a word is dropped; the word's other bytes are moved together
    starts, ends = word_spans(buffer)
    lean = np.where(word_at, _LOWER[buffer], 0x20)
    inside = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.repeat(starts, ends - starts) + np.arange(len(inside)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    use = word_at[at]
    sizes = np.bincount(inside[use], minlength=len(starts))
    real = sizes > 0
    packed = lean[at[use]]
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    exact = span_hashes(packed, begin[real], begin[real] + sizes[real])
    digits = np.bincount(inside[use], weights=_DIGIT[buffer[at[use]]], minlength=len(starts))[real] > 0
    letters = np.bincount(inside[use], weights=_LETTER[buffer[at[use]]], minlength=len(starts))[real] > 0
    first = starts[real]
    capital = (buffer[first] >= 65) & (buffer[first] <= 90)
    place = np.flatnonzero(real)
    last = buffer[ends - 1]
    before = np.maximum(place - 1, 0)
    same_line = (place > 0) & (buffer[np.minimum(ends[before], len(buffer) - 1)] == 0x20) & (starts[place] == ends[before] + 1)
    # within a sentence: the word before ends neither a sentence nor a text
    quiet = ~np.isin(last[before], [0x2E, 0x21, 0x3F, 0x3A])
    firsts_all = np.searchsorted(starts, offsets)
    firsts = np.concatenate(([0], np.cumsum(real)))[firsts_all]
    quiet[firsts[:-1][firsts[:-1] < len(quiet)]] = False
    units = _unit_hashes()
    is_unit = units[np.minimum(np.searchsorted(units, exact), len(units) - 1)] == exact
    after_number = np.concatenate(([False], (digits & ~letters)[:-1]))
    after_number[firsts[:-1][firsts[:-1] < len(exact)]] = False
    kinds = []
    for name in (capital & quiet & same_line, capital & quiet, capital):
        kind = np.where(digits, np.where(letters, _UNIT, _NUMBER), np.where(name, _NAME, _LITERAL))
        kinds.append(np.where(is_unit & after_number, _UNIT, kind))
    return exact, kinds, firsts


def merged(exact: np.ndarray, kind: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words, runs of names or of numbers being one: template hash, exact hash, kind, the number of the first
    word of each (and, at the end, of all words), and where each text's template words begin."""
    begins = np.ones(len(kind), dtype=bool)
    begins[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] != _NUMBER) & (kind[1:] != _NAME))
    begins[firsts[:-1][firsts[:-1] < len(kind)]] = True
    heads = np.flatnonzero(begins)
    sizes = np.diff(np.concatenate((heads, [len(kind)])))
    if len(heads):
        runs = mix(np.add.reduceat(exact * powers(WINDOW_BASE, int(sizes.max()))[ragged(sizes)], heads))
        exact = np.where(sizes > 1, runs, exact[heads])
    kind = kind[heads]
    hashes = np.where(kind == _LITERAL, exact, mix(_PLACEHOLDER[kind]))
    return hashes, exact, kind, np.concatenate((heads, [len(begins)])), np.searchsorted(heads, firsts)


def _windows(batches, width: int, wanted: dict[int, np.ndarray | None] | None):
    """(id, position, hash, size, slots, places, reading) of windows. wanted: for each window size, the sorted hashes to keep, or
    None to keep all; if wanted is None itself, these are items: all windows of `width`, or the whole of a shorter one,
    with the place of each template word and of the window's end."""
    for batch in slices(batches):
        exact, kinds, begin = templates(batch.column(1))
        for reading, kind in enumerate(kinds):
            # each reading has the names of the one before, and windows without another one are the same
            other = kind != kinds[reading - 1] if reading else np.ones(len(kind), dtype=bool)
            if other.any():
                yield from _read(batch.column(0), exact, kind, begin, other, reading, width, wanted)


def _read(ids: pa.Array, exact: np.ndarray, kind: np.ndarray, begin: np.ndarray, other: np.ndarray, reading: int, width: int, wanted):
    """The windows of one reading that hold a word of which other is true."""
    hashes, exact, kind, heads, firsts = merged(exact, kind, begin)
    fresh = np.concatenate(([0], np.cumsum(other)))[heads]
    # 0 for words as they are, odd for words with digits, even for names and units
    digits = (kind == _NUMBER) | ((kind == _UNIT) & ~np.isin(exact, _unit_hashes()))
    marked = np.where(kind == _LITERAL, np.uint64(0), (exact & ~np.uint64(1)) | np.uint64(2) | digits.astype(np.uint64)).view(np.int64)
    counts = np.diff(firsts)
    sizes = sorted({width, *np.unique(counts[(counts > 0) & (counts < width)]).tolist()}) if wanted is None else sorted(wanted)
    for size in sizes:
        grams = gram_hashes(hashes, size) ^ np.uint64(size)
        if not len(grams):
            continue
        row = np.repeat(np.arange(len(counts)), counts)[: len(grams)]
        ok = (firsts[1:][row] - np.arange(len(grams)) >= size) & (fresh[size:] > fresh[: len(grams)])
        if wanted is None:
            ok &= (counts[row] == size) | (size == width)
        hit = np.flatnonzero(ok)
        if wanted is not None and wanted[size] is not None:
            at = np.minimum(np.searchsorted(wanted[size], grams[hit]), len(wanted[size]) - 1)
            hit = hit[wanted[size][at] == grams[hit]]
        slots = [marked[k : k + size].tolist() for k in hit]
        places = [(heads[k : k + size + 1] - begin[r]).tolist() for k, r in zip(hit, row[hit])] if wanted is None else [None] * len(hit)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row[hit])), pa.array(heads[hit] - begin[row[hit]], pa.int32()), pa.array(grams[hit].view(np.int64)), pa.array(np.full(len(hit), size), pa.int32()), pa.array(slots, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(np.full(len(hit), reading), pa.int32())],
            names=["id", "pos", "window", "size", "slots", "places", "reading"],
        )


WINDOW_SCHEMA = "id long, pos int, window long, size int, slots array<long>, places array<int>, reading int"
MATCH_SCHEMA = "doc_id long, item_id long, n_windows long, item_windows long, n_slots long, changed_slots long, exact boolean"


def _kept(counts: dict[tuple[int, int], int], side: int) -> set[tuple[int, int]]:
    """Of the pairs with the same word on one side: the one of equal words, else the one at the most places, if one is."""
    of: dict[int, list] = {}
    for pair, n in counts.items():
        of.setdefault(pair[side], []).append((pair[0] == pair[1], n, pair))
    return {max(x)[2] for x in of.values() if len(x) == 1 or max(x)[0] or sorted(y[1] for y in x)[-2] < max(x)[1]}


def _share(found: list[tuple]) -> tuple[int, int, int, int]:
    """(windows, words) of the consistent ones of matches (position, places, slots, facing slots), and (slots, changed
    slots) of all."""
    at = {(p, a, b) for _, places, slots, mine in found for p, a, b in zip(places, slots, mine, strict=False) if a and not a & 1}
    counts: dict[tuple[int, int], int] = {}
    for _, a, b in at:
        counts[a, b] = counts.get((a, b), 0) + 1
    bad = counts.keys() - (_kept(counts, 0) & _kept(counts, 1))
    good, words, lost = set(), set(), set()
    for pos, places, slots, mine in found:
        if bad and any(pair in bad for pair in zip(slots, mine, strict=True)):
            lost.update(range(places[0], places[-1]))
        else:
            good.add(pos)
            words.update(range(places[0], places[-1]))
    facing = {(a, b) for _, _, slots, mine in found for a, b in zip(slots, mine, strict=True) if a}
    return len(good), len(words - lost), len(facing), sum(a != b for a, b in facing)


def _best(shifts: dict[int, dict[int, tuple]], n_windows: int, n_words: int, coverage: float) -> tuple[int, int, int] | None:
    """(windows, slots, changed slots) at the best alignment that holds the item: the most windows, then the fewest
    changed slots, then the least shift. shifts: for each shift, matches by position in the item."""
    best = None
    order = sorted(shifts)
    for at, shift in enumerate(order):
        tries = [list(shifts[shift].values())]
        if len(tries[0]) < n_windows:
            taken, left, right = dict(shifts[shift]), at - 1, at + 1
            while len(taken) < n_windows:
                down = shift - order[left] if left >= 0 else n_words
                up = order[right] - shift if right < len(order) else n_words
                if min(down, up) >= n_words:
                    break
                left, right, near = (left - 1, right, order[left]) if down <= up else (left, right + 1, order[right])
                for pos, match in shifts[near].items():
                    taken.setdefault(pos, match)
            if len(taken) > len(tries[0]):
                tries.append(list(taken.values()))
        for found in tries:
            share = _share(found)
            if share[0] and (share[0] >= coverage * n_windows - 1e-9 or share[1] >= coverage * n_words - 1e-9):
                rank = (share[0], -share[3], -shift)
                if best is None or rank > best[0]:
                    best = rank, (share[0], share[2], share[3])
        if best and best[1][0] == n_windows and not best[1][2]:
            break
    return best and best[1]


def _judge(coverage: float):
    """The items that documents hold. The matches of a document and item come one after the other, those of stricter
    readings first."""

    def run(batches):
        current, sums, found = None, None, {}

        def held():
            best, shifts = None, {}
            # further readings only add: what the stricter ones hold stays held
            for _, group in groupby(found.items(), lambda x: x[0][0]):
                for (_, shift, start), match in group:
                    shifts.setdefault(shift, {}).setdefault(start, match)
                more = _best(shifts, *sums, coverage)
                if more and (best is None or (more[0], -more[2]) > (best[0], -best[2])):
                    best = more
            return [] if best is None else [(*current, best[0], sums[0], best[1], best[2], best[2] == 0)]

        kinds = [pa.int64()] * 6 + [pa.bool_()]
        names = [x.split()[0] for x in MATCH_SCHEMA.split(", ")]
        for batch in batches:
            out = []
            for doc, item, reading, pos, start, slots, places, mine, windows, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current != (doc, item):
                    out += held() if current else []
                    current, sums, found = (doc, item), (windows, words), {}
                found.setdefault((reading, pos - start, start), (start, places, slots, mine))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)
        if current:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held()], t) for k, t in enumerate(kinds)], names=names)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.6, max_broadcast: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, n_windows (matching), item_windows, n_slots, changed_slots, exact: the items that documents
    hold, one row for each document and item, at the best alignment. exact: no slot differs.

    Null and empty texts and items hold and match nothing; so do items without literal words. Items of fewer than
    `width` words match as one window. n_windows counts consistent windows, slots are those of all. Rows with a null id are left out. Repeated documents are one document, repeated
    items one item. Empty tables give no rows. Other columns are not read.

    The items' window hashes are broadcast while there are at most max_broadcast; beyond that, all windows of the
    documents are shuffled to them."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null and text is not null").distinct()
    items = written(items.mapInArrow(lambda b: _windows(b, width, None), WINDOW_SCHEMA), "item-windows")
    # a window that is mostly placeholders says nothing
    items = items.where("size(filter(slots, s -> s <> 0)) * 2 <= size")
    known = items.select("size", "window").distinct()
    few = known.count() <= max_broadcast
    by_size: dict[int, list[int]] = {}
    for r in (known if few else known.select("size", F.lit(0).alias("window")).distinct()).collect():
        by_size.setdefault(r["size"], []).append(r["window"])
    wanted = spark.sparkContext.broadcast({k: np.sort(np.array(v, dtype=np.int64).view(np.uint64)) if few else None for k, v in by_size.items()})
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    found = rows.mapInArrow(tidy(lambda b: _windows(b, width, wanted.value)), WINDOW_SCHEMA)
    a = found.select(F.col("id").alias("doc_id"), "pos", "window", "size", F.col("slots").alias("mine"), F.col("reading").alias("read"))
    b = items.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "window", "size", "slots", "places", "reading")
    words = items.select("id", "pos", F.explode(F.expr("sequence(places[0], places[size] - 1)")).alias("word"))
    sums = words.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("pos").alias("item_windows"), F.countDistinct("word").alias("item_words"))
    joined = a.join(b, ["window", "size"]).join(F.broadcast(sums) if few else sums, "item_id")
    joined = joined.select("doc_id", "item_id", F.greatest("read", "reading").alias("reading"), "pos", "item_pos", "slots", "places", "mine", "item_windows", "item_words")
    dealt = joined.repartition(partitions(spark), "doc_id", "item_id").sortWithinPartitions("doc_id", "item_id", "reading", "pos", "item_pos", "places", "mine")
    return dealt.mapInArrow(_judge(coverage), MATCH_SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns. Rows with a null id stay."""
    held = small(matches(docs, benchmark).select(F.col("doc_id").alias("_held")).distinct(), "contaminated")
    return docs.join(held, docs.doc_id.cast("long") == held._held, "left_anti")
