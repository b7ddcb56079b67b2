"""Removal of repeated and nearly repeated lines by a segment-partition edit join, in DataFrame functions only.

Two lines are near copies if their edit distance is at most `tau`. If a line is cut into tau + 1 segments of even
length, tau edits leave one of them whole, and it stands in the other line not far from its place. So:

1. Equal lines are one line, named by the md5 of its text; from here on only distinct lines of `min_chars` or more take
   part. Shorter lines are only compared for equality. One scan names rows and lines and is written; everything that is
   said about a row later comes from that table, so the result doesn't depend on how files are split.
2. Index: for each line, a hash of (length, segment number, segment).
3. Probe: for each line and each length from its own down to tau less, hashes of the substrings that can face a segment
   of a line of that length. Of the start positions only those within (i - 1) of the segment's place from the left and
   within (tau + 1 - i) of it from the right, for segment i, are taken: fewer edits than that lie on either side.
4. A segment that more than a quarter of `long_list` lines have at one place and length says little, as the pairs of its
   lines grow with their square. Such lines meet among themselves by more: they are cut into 3 tau segments, of which
   tau edits touch tau at most, and meet if all others are equal (`refined`). A line gives some hundred keys by this, fewer
   than it could have pairs in lists that long.
5. Where such lists are longer than eight times `long_list` still, as those of lines made from a template, only the touched
   segments are looked at, again in 3 tau, until segments are single characters. The work grows with the lines, not with
   the pairs of a template.
6. Pairs whose counts of some characters differ by more than 2 tau in all aren't near copies, as an edit changes two counts
   by one at most. They are ruled out first, those of crowded lines as they meet. All others are verified by a banded bit-parallel automaton: row d holds, in 2 tau + 1 bits, which
   prefixes of one line near the diagonal are within d edits of the other's prefix; one step for each character does
   all rows. It runs from the first to the last character in which the lines differ.
7. Links make classes; of each class the first occurrence, by doc_id and line number, stays.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, small, written


def segment(n: Column, parts: int, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of a text of n characters cut into parts; later ones are longer."""
    base, shorter = F.floor(n / parts).cast("int"), F.lit(parts) - n % parts
    return 1 + (i - 1) * base + F.greatest(F.lit(0), i - 1 - shorter), base + F.when(shorter < i, 1).otherwise(0)


def _choices(rows: list[tuple[int, ...]], names: list[str]) -> Column:
    """The rows as an array of structs: one small constant, over which each line's keys are made by one expression."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])


def _one(line: Column, n: Column, rows: list[tuple[int, int, int]], parts: int) -> Column:
    """Hashes of (length of the other line, segment number, the substring that faces it) for single segments, which
    always lie within the line. Spelled out for each: generated code is some ten times as fast as a lambda."""

    def key(less: int, i: int, shift: int) -> Column:
        m = n - less if less else n
        a, size = segment(m, parts, F.lit(i))
        return F.xxhash64(m, F.lit(i), line.substr(a + shift, size))

    return F.array(*[key(*row) for row in rows])


def index_keys(line: Column, n: Column, parts: int) -> Column:
    """A hash for each segment of the line."""
    return _one(line, n, [(0, i, 0) for i in range(1, parts + 1)], parts)


def probe_keys(line: Column, n: Column, tau: int, parts: int) -> Column:
    """Hashes of the substrings that can face segments of a line that is up to tau shorter. A row of _one for each length of
    the other line, segment and shift: fewer edits than segments lie on either side."""
    rows = [(less, i, shift) for less in range(tau + 1) for i in range(1, parts + 1) for shift in range(max(1 - i, less - (parts - i)), min(i - 1, less + parts - i) + 1)]
    return _one(line, n, rows, parts)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _agree(a: Column, b: Column) -> Column:
    """How many characters two arrays have in common from the first on."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differ > 0, differ.cast("int") - 1).otherwise(F.least(F.size(a), F.size(b)))


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether the edit distance of two texts, whose lengths differ by at most tau, is at most tau. What both begin and end
    with changes no distance and is taken off first."""
    pair = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    rest = lambda x, k: F.slice(x, k + 1, F.size(x) - k)
    no_head = _let(pair, lambda p: _let(_agree(p["a"], p["b"]), lambda k: F.struct(F.reverse(rest(p["a"], k)).alias("a"), F.reverse(rest(p["b"], k)).alias("b"))))
    core = _let(no_head, lambda p: _let(_agree(p["a"], p["b"]), lambda k: F.struct(F.reverse(rest(p["a"], k)).alias("a"), F.reverse(rest(p["b"], k)).alias("b"))))
    return _let(core, lambda p: F.when(F.least(F.size(p["a"]), F.size(p["b"])) == 0, F.greatest(F.size(p["a"]), F.size(p["b"])) <= tau).otherwise(_within(p["a"], p["b"], tau)))


#: Characters that are counted, sixteen to a number.
COUNTED = ("etaoinshrdlucmfw", "ypvbgkjqxz .,-01")


def letter_counts(line: Column, groups: tuple[str, ...] = COUNTED) -> Column:
    """The counts of some characters modulo 16, packed in a number for each group."""

    def packed(letters: str) -> Column:
        out = F.lit(0).cast("long")
        for k, c in enumerate(letters):
            count = (F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(15).cast("long"))
            out = out.bitwiseOR(F.shiftleft(count, 4 * k))
        return out

    return F.struct(*[packed(letters).alias(f"c{k}") for k, letters in enumerate(groups)])


def may_be_near(x: Column, y: Column, tau: int, groups: tuple[str, ...] = COUNTED) -> Column:
    """False only if the counts of two lines show that they are more than tau edits apart. Modulo 16 a difference can look
    smaller than it is, the shorter way round, but never larger."""

    def apart(field: str, k: int) -> Column:
        a, b = (F.shiftrightunsigned(v[field], 4 * k).bitwiseAND(F.lit(15).cast("long")) for v in (x, y))
        return F.least(F.abs(a - b), 16 - F.abs(a - b))

    return sum((apart(f"c{i}", k) for i, letters in enumerate(groups) for k in range(len(letters))), F.lit(0)) <= 2 * tau


def _within(a: Column, b: Column, tau: int) -> Column:
    """The automaton on arrays of characters. Its rows lie side by side in one number; bit k of row d after j characters of b
    says that the first j + k - tau characters of a are within d edits of them."""
    width = 2 * tau + 1
    full = (1 << width) - 1
    start = 0
    for d in range(tau + 1):
        start |= sum(1 << k for k in range(tau, min(width, tau + d + 1))) << (d * width)

    def row(state: Column, d: int) -> Column:
        return F.shiftrightunsigned(state, d * width).bitwiseAND(F.lit(full).cast("long"))

    def step(state: Column, j: Column) -> Column:
        same = sum((F.when(F.get(a, j + (k - tau)) == F.get(b, j), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)), F.lit(0)).cast("long")

        def below(done: Column, d: int, same: Column) -> Column:
            """Rows 0..d-1 are done; adds row d, and so on."""
            if d > tau:
                return done
            new = row(state, d).bitwiseAND(same)
            if d:
                before, now = row(state, d - 1), row(done, d - 1)
                new = new.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(now, 1)).bitwiseAND(F.lit(full).cast("long"))
            return _let(done.bitwiseOR(F.shiftleft(new, d * width)), lambda x: below(x, d + 1, same))

        return _let(same, lambda same: below(F.lit(0).cast("long"), 0, same))

    last = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.lit(start).cast("long"), step)
    accepting = F.pow(F.lit(2), F.size(a) - F.size(b) + tau).cast("long")
    return F.shiftrightunsigned(last, tau * width).bitwiseAND(accepting) != 0


# ---------------------------------------------------------------- lists of many lines

#: A line meets others by its segments alone in lists of up to long_list / CROWDED lines; `refined` makes 96 keys of it.
CROWDED = 4
#: Lists of templated lines are refined again from so many times long_list on: one line costs as many keys in each round.
TEMPLATE = 8
#: Such lines, or what is left of them, are cut into so many segments for each edit. With 3, what is left gets shorter in
#: each round.
PARTS = 3


def _cut_out(tau: int) -> str:
    """What stands for equal text between segments that are left. Where it is out of line by more than its length, texts
    differ in more than tau places."""
    return "\x01" * (tau // 2 + 1)


def _touched(tau: int) -> list[tuple[int, ...]]:
    """(segments that may differ, then how far the text after each is shifted) of all ways in which tau edits can lie in
    tau of the segments; the last shift is how much shorter the other text is. Where shifts take all edits, segments
    without one are whole, and one choice of these is enough."""
    shifts = [s for s in product(range(-tau, tau + 1), repeat=tau) if s[-1] >= 0 and sum(abs(b - a) for a, b in zip((0, *s), s)) <= tau]
    ways, seen = [], set()
    for choice in combinations(range(1, PARTS * tau + 1), tau):
        for s in shifts:
            moves = [(e, b - a) for e, a, b in zip(choice, (0, *s), s) if a != b]
            if sum(abs(d) for _, d in moves) == tau:
                if tuple(moves) in seen:
                    continue
                seen.add(tuple(moves))
            ways.append((*choice, *s))
    return ways


def _spots(x: Column, n: Column, t: Column, tau: int) -> tuple[list[Column], list[Column], Column]:
    """For one way of _touched: the substrings that are equal, those that may differ, and whether all fit."""
    m = n - t[f"s{tau - 1}"]
    same, differ, fits, at, shift = [], [], m >= 0, F.lit(1), F.lit(0)
    for k in range(tau):
        a, size = segment(m, PARTS * tau, t[f"e{k}"])
        same.append(x.substr(at + shift, a - at))
        differ.append(x.substr(a + shift, size + t[f"s{k}"] - shift))
        fits = fits & (size + t[f"s{k}"] - shift >= 0)
        at, shift = a + size, t[f"s{k}"]
    return [*same, x.substr(at + shift, m - at + 1)], differ, fits


def _refine(members: DataFrame, tau: int) -> tuple[DataFrame, DataFrame]:
    """(index, probes) of (list, id, counts, x, n): a row for each way that a text can differ in, with the key of what is equal."""
    names = [f"e{k}" for k in range(tau)] + [f"s{k}" for k in range(tau)]
    ways = _touched(tau)

    def keyed(rows):
        def one(t):
            same, _, fits = _spots(F.col("x"), F.col("n"), t, tau)
            return F.when(fits, F.struct(F.xxhash64("list", F.col("n") - t[f"s{tau - 1}"], *[t[f"e{k}"] for k in range(tau)], *same).alias("key"), t.alias("t")))

        found = members.withColumn("k", F.explode(F.filter(F.transform(_choices(rows, names), one), lambda x: x.isNotNull())))
        return found.select("id", "counts", "x", "n", "k.key", "k.t")

    unmoved = [w for w in ways if not any(w[tau:])]
    return keyed(unmoved), keyed([w for w in ways if any(w[tau:])])


def _meet(probe: DataFrame, index: DataFrame, tau: int, once: bool = False) -> DataFrame:
    """Pairs (a, b) of lines with equal keys whose letter counts are near enough. Both have (id, key, counts). once: they
    are the same rows, and a pair is looked at one way round only."""
    a, b = (rows.select(F.col("id").alias(name), F.col("counts").alias(f"counts_{name}"), "key") for rows, name in ((probe, "a"), (index, "b")))
    apart = F.col("a") < F.col("b") if once else F.col("a") != F.col("b")
    met = a.join(b, (a.key == b.key) & apart & may_be_near(F.col("counts_a"), F.col("counts_b"), tau))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def refined(lines: DataFrame, tau: int, long_list: int) -> DataFrame:
    """Pairs (a, b) of lines that may be within tau edits; all that are within tau edits are among them. lines: (id, line, n,
    counts)."""
    left = lines.select(F.lit(0).cast("long").alias("list"), "id", "counts", F.col("line").alias("x"), "n")
    pairs = None
    while True:
        ways = _refine(left, tau)
        # the texts are left out here: there are many keys to a line
        index, probe = (written(rows.select("id", "counts", "n", "key"), "refined-keys") for rows in ways)
        lists = written(index.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("hub"), F.max("n").alias("n")).where("size > 1"), "refined-lists")
        long = small(lists.where(f"size > {long_list}").select("key", "hub", (F.col("n") <= PARTS * tau).alias("last")), "refined-long-lists")
        short = index.join(long, "key", "left_anti")
        own = _meet(short, short, tau, once=True)
        # segments of single characters: lines of an unmoved list differ in tau places at most, so one of them links all
        last = long.where("last")
        hubs = index.join(last, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        moved = _meet(probe, index.join(long.where("not last"), "key", "left_anti"), tau)
        found = written(own.union(hubs).union(moved).distinct(), "refined-pairs")
        pairs = found if pairs is None else pairs.union(found)
        again = long.where("not last").select("key")
        if again.isEmpty():
            return pairs
        # only what may differ is looked at again; what is equal between is cut short
        _, differ, _ = _spots(F.col("x"), F.col("n"), F.col("t"), tau)
        left = ways[0].join(again, "key").union(ways[1].join(again, "key")).select(F.col("key").alias("list"), "id", "counts", F.concat_ws(_cut_out(tau), *differ).alias("x"))
        left = written(left.withColumn("n", F.char_length("x")).distinct(), "refined-rests")


# ---------------------------------------------------------------- the operator


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, ids): for each row of docs the names of its lines, null for blank ones; row tells repeated rows apart.
    Null texts have no lines."""
    name = lambda x: F.when(F.trim(x) != "", F.unhex(F.md5(x)))
    ids = F.coalesce(F.transform(F.split(F.col(text_col), "\n"), name), F.array().cast("array<binary>"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), ids.alias("ids"))


def candidates(lines: DataFrame, tau: int, long_list: int) -> DataFrame:
    """Distinct pairs (a, b) of lines that share a segment in place. lines: (id, line, n), n > tau + 1; copies may repeat.

    Keys are made where the lines are read; what is shuffled to make copies one are keys, not texts."""
    n, line = F.col("n"), F.col("line")
    keyed = lines.select("id", index_keys(line, n, tau + 1).alias("index"), probe_keys(line, n, tau, tau + 1).alias("probe"))
    once = written(keyed.groupBy("id").agg(F.first("index").alias("index"), F.first("probe").alias("probe")), "line-keys")
    index, probe = once.select("id", F.explode("index").alias("key")), once.select("id", F.explode("probe").alias("key"))
    crowded = small(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(1, long_list // CROWDED)).select("key"), "crowded-segments")
    if crowded.isEmpty():
        return probe.select(F.col("id").alias("a"), "key").join(index.select(F.col("id").alias("b"), "key"), "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # lines of crowded segments meet each other by what is equal outside of tau segments, and only so; here they meet the others
    again = small(index.join(crowded, "key", "left_semi").select("id").union(probe.join(crowded, "key", "left_semi").select("id")).distinct(), "crowded-lines")
    marked = once.join(again.withColumn("met", F.lit(True)), "id", "left").withColumn("met", F.coalesce("met", F.lit(False)))
    a = marked.select(F.col("id").alias("a"), F.col("met").alias("met_a"), F.explode("probe").alias("key"))
    b = marked.select(F.col("id").alias("b"), F.col("met").alias("met_b"), F.explode("index").alias("key"))
    met = a.join(b, (a.key == b.key) & (F.col("a") != F.col("b")) & ~(F.col("met_a") & F.col("met_b")))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    few = written(lines.join(again, "id", "left_semi").dropDuplicates(["id"]).select("id", "line", "n", letter_counts(line).alias("counts")), "crowded-texts")
    return pairs.union(refined(few, tau, TEMPLATE * long_list)).distinct()


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, min_chars: int = 24, long_list: int = 64) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): occurrences(docs), written, and (id, class) of the distinct lines that are linked with another
    one."""
    rows = written(occurrences(docs, id_col, text_col), "line-places")
    lines = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).where(F.trim("line") != "")
    long = lines.select(F.unhex(F.md5("line")).alias("id"), F.char_length("line").alias("n"), "line").where(F.col("n") >= max(min_chars, tau + 2))
    pairs = written(candidates(long, tau, long_list), "line-pairs")
    wanted = small(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "line-candidates")
    common = COUNTED[:1]
    texts = written(long.join(wanted, "id", "left_semi").dropDuplicates(["id"]).select("id", "line", letter_counts(F.col("line"), common).alias("counts")), "line-texts")
    side = lambda name, column: texts.select(F.col("id").alias(name), F.col(column).alias(f"{column}_{name}"))
    near = pairs.join(side("a", "counts"), "a").join(side("b", "counts"), "b").where(may_be_near(F.col("counts_a"), F.col("counts_b"), tau, common)).select("a", "b")
    both = near.join(side("a", "line"), "a").join(side("b", "line"), "b").where(F.abs(F.char_length("line_a") - F.char_length("line_b")) <= tau)
    links = written(both.where(within(F.col("line_a"), F.col("line_b"), tau)).select("a", "b"), "line-links")
    classes = components(links)
    return rows, classes.select(F.col("node").alias("id"), F.col("component").alias("class"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, min_chars: int = 24, long_list: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines (lines that aren't blank), n_removed, removed (their numbers from 0,
    ascending).

    Of each class of equal or linked lines the occurrence with the least (doc_id, line number) stays; a null id comes
    first, and repeated rows are told apart by their place. Blank lines are neither counted nor removed. Lines under
    min_chars characters are only removed if equal. Null and empty texts, and texts of blank lines, have 0 lines. An
    empty table gives no rows. Other columns are not read."""
    rows, classes = line_classes(docs, id_col, text_col, tau, min_chars, long_list)
    places = rows.select("doc_id", "row", F.posexplode("ids").alias("pos", "id")).where("id is not null")
    first = F.struct("doc_id", "row", "pos")
    # pre-aggregated by line, so that a line that is everywhere is one row before it meets its class
    by_line = places.groupBy("id").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    by_line = by_line.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    heads = by_line.groupBy("class").agg(F.min("first").alias("head"), F.sum("n").alias("n")).where("n > 1")
    repeated = by_line.select("id", "class").join(heads.select("class", "head"), "class").select("id", "head")
    gone = places.join(repeated, "id").where(F.col("head") != first).groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("removed"))
    out = rows.select("doc_id", "row", F.size(F.filter("ids", lambda x: x.isNotNull())).cast("long").alias("n_lines")).join(gone, "row", "left")
    out = out.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that line_dedup lists taken out of their texts. Ids must be unique and not null."""
    gone = removed.where("n_removed > 0").select(F.col("doc_id").alias("_gone_id"), F.col("removed").alias("_gone"))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, k: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), k)), "\n")
    return docs.join(gone, docs[id_col].cast("long") == gone._gone_id, "left").withColumn(text_col, kept).select(*docs.columns)
