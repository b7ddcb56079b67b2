"""The corpus operators against plain versions, on texts that try their edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilespark.llm import ann, decontamination, html_extract, html_pages, jaccard_join, line_dedup, mixing, substring_dedup, token_count, token_file, tokens, toxicity
from tilespark.llm.common import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, extra=True):
    """doc_id and text, and columns whose names operators may use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({"n": F.lit("x"), "node": F.lit(1), "_leaf": F.lit(2), "h": F.lit(None).cast("string")}) if extra else df


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "ß,", "日本"]
    out = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 60, 150])))) for k in range(40)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out += [(100, "start " + passage), (101, passage + "\nend"), (102, "x\t" + passage.replace(" ", "  ") + " y"), (103, passage + " mid " + passage)]
    out += [(110, "a " * 80), (111, ""), (112, None), (113, " \n "), (114, out[3][1]), (114, out[3][1]), (None, "a b c")]
    words = out[2][1].split() * 3
    out += [(120 + k, " ".join(w if i != 7 * k else "changed" for i, w in enumerate(words))) for k in range(4)]
    return out


# ---------------------------------------------------------------- substring dedup


def plain_substring(rows, width):
    words = [[w for w in WORD.findall(t or "")] for _, t in rows]
    seen = Counter(tuple(w[k : k + width]) for w in words for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [35, 12])
def test_substring_dedup(spark, width):
    got = substring_dedup.substring_dedup(frame(spark, texts()), width=width)
    assert sorted(map(tuple, got.collect()), key=str) == plain_substring(texts(), width)


def test_substring_dedup_with_a_full_sketch(spark):
    """A sketch that is far too small lets windows through, and loses none."""
    got = substring_dedup.substring_dedup(frame(spark, texts()), width=12, max_cells=1 << 20, shard_windows=64)
    assert sorted(map(tuple, got.collect()), key=str) == plain_substring(texts(), 12)


@pytest.mark.parametrize("max_broadcast", [0, 64 << 20])
def test_substring_dedup_with_a_resident_sketch(spark, max_broadcast):
    """A sketch beyond max_cells is asked where it lies, by many owners, and gives the same rows."""
    got = substring_dedup.substring_dedup(frame(spark, texts()), width=12, max_cells=1 << 10, owned_bits=15, max_broadcast=max_broadcast)
    assert sorted(map(tuple, got.collect()), key=str) == plain_substring(texts(), 12)
    none = substring_dedup.substring_dedup(frame(spark, [(1, "a")]).where("doc_id < 0"), max_cells=1 << 10, max_broadcast=max_broadcast)
    assert none.count() == 0


def test_sketch_never_underestimates():
    words = np.random.default_rng(0).integers(0, 2**63, size=500, dtype=np.uint64)
    words = np.concatenate((words, words[100:160], words[:50]))
    firsts = np.array([0, 500, 560, 610])
    ok = substring_dedup.window_starts(firsts, len(words), 35)
    least, chosen = substring_dedup.representatives(words, ok, 35, 8)
    counts = Counter(chosen.tolist())
    windows = Counter(tuple(words[k : k + 35].tolist()) for k in np.flatnonzero(ok))
    for k in np.flatnonzero(ok):
        assert counts[int(least[k])] >= min(2, windows[tuple(words[k : k + 35].tolist())])


# ---------------------------------------------------------------- Jaccard join


def plain_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("n,percent,long_list", [(3, 90, 64), (5, 80, 64), (3, 80, 2), (2, 50, 3)])
def test_components(spark, n, percent, long_list):
    got = jaccard_join.similar_components(frame(spark, texts()), n=n, percent=percent, long_list=long_list, block=3)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(texts(), n, percent)


def test_large_families(spark):
    """Near copies of one text in their hundreds: long lists, several blocks."""
    rng = random.Random(1)
    base = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.02 else f"z{rng.randrange(10**6)}" for w in base)) for k in range(300)]
    got = jaccard_join.similar_components(frame(spark, rows), n=3, percent=90, long_list=16, block=40)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows, 3, 90)


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (9, "other words stand here as well"), (None, "a b c d e f g"), (7, None)]
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 3, 7, 9, None] and "_leaf" in kept.columns


def test_keep_one_judges_rows_of_an_id_by_their_texts(spark):
    rows = [(2, "a b c d e f g"), (4, "a b c d e f g"), (4, "quite other words stand in this one here"), (6, "quite other words stand in this one here")]
    rows += [(8, "one more text of nine words stands right here"), (8, "one  more text of nine words stands right here"), (9, "One more text of nine words stands right here"), (8, None)]
    kept = jaccard_join.keep_one(frame(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[0], rows[2], rows[5], rows[7]], key=str)


def plain_rows(rows, n=5, percent=80):
    """Numbers of the rows that keep_one_row keeps, by all pairs."""
    sets = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set() for w in (WORD.findall((t or "").lower()) for _, t in rows)]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {}
    for k, (i, t) in enumerate(rows):
        if sets[k]:
            first.setdefault(group[k], []).append((i is None, i or 0, t, k))
    return sorted((rows[k] for k in {min(x)[-1] for x in first.values()} | {k for k in range(len(rows)) if not sets[k]}), key=str)


def test_keep_one_row(spark):
    t, u, v = "a b c d e f g", "quite other words stand in this one here", "one more text of nine words stands right here"
    for rows in (
        [(1, t), (1, t), (5, t), (5, u)],
        [(None, t), (None, t), (3, t), (3, t), (None, u), (None, u), (None, u + " x"), (4, None), (4, None), (None, ""), (None, None), (7, " ")],
        [(8, v), (8, v.replace(" ", "  ")), (9, v), (8, None), (2, t), (2, u), (1, u)],
        [(k % 3, t) for k in range(40)] + [(None, v)] * 20,
        [(1, t), (2, u)],
    ):
        kept = jaccard_join.keep_one_row(frame(spark, rows))
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == plain_rows(rows), rows
        assert kept.columns == frame(spark, rows).columns
    assert jaccard_join.keep_one_row(frame(spark, rows).where("doc_id > 5")).count() == 0


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100, 103: 100}


# ---------------------------------------------------------------- tokens


def long_texts():
    rng = random.Random(8)
    w = lambda: "".join(rng.choices("abcdeéß ,.\n'09", k=rng.randrange(1, 9)))
    return [(1, " ".join(w() for _ in range(3000))), (2, "x" * 5000), (2, "x" * 5000), (3, " " * 4000 + "a b" * 900), (4, "日本語" * 1500), (5, "a<|endoftext|>b " * 600), (6, ""), (7, None), (None, "hi  there"), (8, "word " * 3000)]


def test_token_counts(spark):
    tokenizer = tokens.load(BPE).tokenizer
    got = token_count.token_count(frame(spark, long_texts()), BPE, chunk=512, overlap=32)
    expected = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in long_texts()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_splices(name):
    tokenizer = tokens.load(public_tokenizers.path(name))
    for _, text in long_texts():
        assert token_count.spliced(tokenizer, text or "", 700, 24) == tokenizer.count(text or "")


@pytest.mark.parametrize("text", ["", "a", " a b", "  x", "é ü\n\nb c", "a<|endoftext|>b c", "日本 語 a b", "1²Ⅷ x_y 's don't", "tab\there  two", "x\x1cy z\x85", "😀 hi 😀", "ß'S'll", "a ", "\n", "á b́c", "a\nb\n c\n", "end.\nThe, next; x'"])
def test_field_lookups_equal_the_library(text):
    t = tokens.load(BPE)
    ids = t.tokenizer.encode(text, add_special_tokens=False).ids
    assert t.count(text) == len(ids) and t.pack(text) == np.asarray(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_segments_round_trip(mode):
    ids = np.random.default_rng(2).integers(0, 2**32, size=1000, dtype=np.uint64).astype("<u4")
    data, index = token_file.encode_segment(ids, 96, mode)
    blocks = token_file.read_blocks(data, index, mode)
    assert np.array_equal(np.concatenate(blocks), ids) and [len(b) for b in blocks] == [96] * 10 + [40]
    assert np.array_equal(token_file.read_blocks(data, index, mode, range(3, 5))[1], ids[384:480])


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_files(spark, mode, tmp_path):
    rows = [r for r in long_texts()]
    tokenizer = tokens.load(BPE).tokenizer
    segments = token_file.write_segments(frame(spark, rows), BPE, segment=700, block=128, mode=mode, path=str(tmp_path / "ids"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_file.read_digests(segments).collect())
    start, expected = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((start, i, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == expected


# ---------------------------------------------------------------- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(120):
        a = "".join(rng.choices("abé", k=rng.randrange(1, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "x"])
        b = "".join(b)
        if b and abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("ok", line_dedup.within(F.col("a"), F.col("b"), 2))
    for r in df.collect():
        assert r["ok"] == (distance(r["a"], r["b"]) <= 2), r


def plain_lines(rows, tau, least):
    places = [(k, p, line) for k, (_, t) in enumerate(rows) for p, line in enumerate((t or "").split("\n")) if line.strip(" ")] if rows else []
    distinct = sorted({x[2] for x in places})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = [x for x in distinct if len(x) >= least]
    for i, a in enumerate(long):
        for b in long[:i]:
            if abs(len(a) - len(b)) <= tau and distance(a, b) <= tau:
                root[find(a)] = find(b)
    first = {}
    for k, p, line in places:
        place = (rows[k][0] is not None, rows[k][0] or 0, k, p)
        first[find(line)] = min(place, first.get(find(line), place))
    out = []
    for k, (i, _) in enumerate(rows):
        mine = [(p, line) for kk, p, line in places if kk == k]
        out.append((i, len(mine), [p for p, line in mine if first[find(line)] != (i is not None, i or 0, k, p)]))
    return sorted(out, key=str)


@pytest.mark.parametrize("long_list", [64, 2])
def test_line_dedup(spark, long_list):
    rng = random.Random(9)
    lines = ["".join(rng.choices("abcdefgh é", k=rng.choice([3, 26, 27, 40]))) for _ in range(25)]
    near = []
    for line in lines[:12]:
        for _ in range(2):
            b = list(line)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(b))
                b[at : at + rng.randrange(2)] = rng.choice(["", "z", "q"])
            near.append("".join(b))
    every = lines + near + [" ", "", lines[0], lines[1]]
    rows = [(k, "\n".join(rng.choices(every, k=rng.randrange(0, 7)))) for k in range(30)] + [(40, None), (41, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = line_dedup.line_dedup(df.withColumn("line", F.lit("c")), long_list=long_list)
    assert sorted(((r["doc_id"], r["n_lines"], r["removed"]) for r in got.collect()), key=str) == plain_lines(rows, 2, 24)
    cleaned = line_dedup.without_lines(df, got).where("doc_id = 0").first()["text"]
    gone = set(got.where("doc_id = 0").first()["removed"])
    assert cleaned == "\n".join(x for k, x in enumerate(rows[0][1].split("\n")) if k not in gone)


def removed(got):
    return sorted(((r["doc_id"], r["n_lines"], r["removed"]) for r in got.collect()), key=str)


def test_line_dedup_whatever_the_splits(spark, tmp_path):
    """Files are split otherwise between the call and the action, as when executors come or go; rows repeat, ids are null."""
    rng = random.Random(7)
    lines = ["".join(rng.choices("abcdefgh ", k=rng.choice([5, 30, 60]))) for _ in range(30)]
    rows = [(k // 2 if k % 7 else None, "\n".join(rng.choices(lines, k=rng.randrange(0, 9)))) for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    found = []
    try:
        for first, second in ((1, 1), (1, 16), (8, 2)):
            spark.conf.set("spark.sql.files.minPartitionNum", first)
            got = line_dedup.line_dedup(spark.read.parquet(str(tmp_path / "docs")))
            spark.conf.set("spark.sql.files.minPartitionNum", second)
            found.append(removed(got))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
    # of rows with one id the first may be any; what is kept and how many lines there are is the same
    plain = plain_lines(rows, 2, 24)
    for one in found:
        assert sorted(((i, n) for i, n, _ in one), key=str) == sorted(((i, n) for i, n, _ in plain), key=str)
        assert sum(len(x) for *_, x in one) == sum(len(x) for *_, x in plain)


@pytest.mark.parametrize("kind", ["one field", "two fields", "lengths"])
def test_line_dedup_of_templates(spark, kind):
    rng = random.Random(3)
    w = lambda n, of: "".join(rng.choices(of, k=rng.choice(n)))
    make = {
        "one field": lambda: f"the order number {w([8], '0123456789')} was shipped to you today",
        "two fields": lambda: f"the {w([2, 3], '012')} was shipped with {w([2], '01')} to {w([0, 1, 2], 'ab')} today",
        "lengths": lambda: f"the order number {w([5, 6, 7], '01')} was shipped to you today",
    }[kind]
    rows = [(k, make()) for k in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert removed(line_dedup.line_dedup(df, long_list=2)) == plain_lines(rows, 2, 24)


def test_line_dedup_of_a_family(spark):
    """Near copies that are more than tau edits apart share segments, but few of their pairs are candidates; real links are."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrst ", k=n))
    base, family = letters(240), []
    for _ in range(90):
        at = rng.randrange(len(base))
        family.append(base[:at] + letters(5) + base[at:])
    near = []
    for line in family[:20]:
        i, j = sorted(rng.sample(range(len(line)), 2))
        near.append((line, line[:i] + rng.choice(["", "Z", line[i] + "Z"]) + line[i + 1 : j] + rng.choice(["", "Q", line[j] + "Q"]) + line[j + 1 :]))
    df = spark.createDataFrame([(line,) for line in [*family, *(b for _, b in near)]], "line string").coalesce(1)
    lines = df.select(F.unhex(F.md5("line")).alias("id"), "line", F.char_length("line").alias("n"))
    got = {(bytes(r["a"]), bytes(r["b"])) for r in line_dedup.candidates(lines, 2, 64).collect()}
    ids = [tuple(sorted(hashlib.md5(x.encode()).digest() for x in pair)) for pair in near]
    assert all(pair in got for pair in ids)
    assert len(got) < 1_000


def test_line_dedup_of_very_long_and_odd_lines(spark):
    long = "".join(random.Random(2).choices("abcdefgh", k=30_000))
    rows = [(1, long), (2, long[:9] + "Z" + long[9:]), (3, long[1:-1]), (4, long[500:]), (5, "\x01" * 30), (6, "\x01" * 31), (7, "日本語" * 10), (8, "日本語" * 9 + "日x語"), (9, "   "), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in line_dedup.line_dedup(df).where("n_removed > 0").orderBy("doc_id").collect()] == [2, 3, 6, 8]


# ---------------------------------------------------------------- toxicity


def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 5 == 1
        words = [f"wort{rng.randrange(300)}" for _ in range(rng.randrange(4, 60))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "bugger", f"lowei{rng.choice('abcdef')}"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_words_and_stems(spark):
    rows, docs, labels = labelled(spark)
    lexicon = toxicity.train(docs, labels)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    held = [k for k in scored if zlib.crc32(str(k).encode()) % 5 == 0]
    assert held and all(scored[k]["held_out"] == (k in set(held)) for k in scored)
    assert np.mean([scored[k]["predicted"] == int(k % 5 == 1) for k in held]) > 0.97
    more = [(1, "you 1di0t there"), (2, "you іdіоt there"), (3, ""), (4, None), (None, "loweix " * 3), (4, None)]
    out = toxicity.score(frame(spark, more), lexicon).collect()
    assert {r["doc_id"]: r["predicted"] for r in out} == {1: 1, 2: 1, 3: 0, 4: 0, None: 1} and len(out) == 6
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(frame(spark, more[:4]), lexicon).collect()) == [3, 4]


def test_toxicity_exceptions_and_no_labels(spark):
    lexicon = toxicity.Lexicon({"trash ": 3.0}, ["trash can"], -2.0, (3.0, 0.0, 0.0))
    automaton = lexicon.automaton()
    assert lexicon.score("the trash can", automaton) < 0.5 < lexicon.score("you trash", automaton)
    docs = frame(spark, [(1, "a")])
    empty = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, empty).first()["predicted"] == 0


def test_folding():
    assert toxicity.fold("IDI0T!! іdіоt $tupid 1234 x") == "idiot idiot stupid x"


# ---------------------------------------------------------------- nearest neighbours


def exact_nearest(vectors, k, every):
    out = {}
    usable = {i: np.array(v, dtype=float) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    for i, v in usable.items():
        if i % every == 0:
            s = sorted(((-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in usable.items() if j != i and len(w) == len(v)))
            out[i] = [j for _, j in s[:k]]
    return out


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 32))
    vectors = [(i, (centres[i % 20] + 0.6 * rng.standard_normal(32)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))
    rows = ann.usable(df)
    got = ann.search(ann.build_index(rows, shard_rows=800), rows.where("vec_id % 50 = 0"), 5).collect()
    truth = exact_nearest(vectors, 5, 50)
    hits = sum(r["vec_id"] in truth[r["query_id"]] for r in got)
    assert len(got) == 300 and hits / 300 >= 0.9


def test_recall_of_many_shards_and_blocks(spark):
    """The registered beam over several shards; blocks go to copies of a shard; ids repeat; two dimensions."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    vectors = [(i if i != 77 else 100, (centres[i % 12] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(2400)] + [(50 * i, rng.standard_normal(4).tolist()) for i in range(60, 90)]
    rows = ann.usable(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    got = ann.search(ann.build_index(rows, shard_rows=300), rows.where("vec_id % 50 = 0"), 5, block_rows=8, per_shard=2).collect()
    hits = total = 0
    for at in {i for i, _ in vectors if i % 50 == 0}:
        own = [v for i, v in vectors if i == at]
        best = sorted(((-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), j) for v in own for j, w in vectors if j != at and len(w) == len(v)))[:5]
        mine = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == at]
        assert len(mine) == 5
        hits, total = hits + len(set(mine) & {j for _, j in best}), total + len({j for _, j in best})
    assert hits / total >= 0.9


def test_nearest_edges(spark):
    base = [1.0, 2.0, 3.0]
    vectors = [(0, base), (50, [2.0, 4.0, 6.0]), (7, base), (3, base), (9, base), (11, [0.0, 0.0, 0.0]), (12, None), (13, [1.0, None, 2.0]), (14, [float("nan"), 1.0, 1.0]), (100, [-1.0, -2.0, 3.0]), (150, [1.0, 2.0]), (None, base)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [3, 7, 9, 50, 100], 50: [0, 3, 7, 9, 100], 100: [0, 3, 7, 9, 50]}
    assert ann.nearest(df.where("vec_id < 0")).count() == 0


# ---------------------------------------------------------------- decontamination


def test_decontamination(spark):
    item = "A train leaves Boston at 40 km per hour while another one leaves Chicago at 60 km per hour and they meet after 5 hours somewhere between Boston and Chicago"
    other = item.replace("Boston", "Lisbon").replace("Chicago", "Madrid").replace("40", "35").replace("60", "75")
    broken = "A train leaves Lisbon at 35 km per hour while another one leaves Madrid at 75 km per hour and they meet after 5 hours somewhere between Oslo and Paris"
    docs = [(1, f"Some words first. {item} and more"), (2, f"Before it. {other}!"), (3, f"Before it. {broken} x"), (4, "A train leaves early."), (5, ""), (6, None), (7, "One two three."), (1, f"Some words first. {item} and more")]
    bench = [(10, item), (11, "One two three"), (12, None), (13, ""), (14, "12 34 56 78"), (11, "One two three")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    for cap in (4_000_000, 0):
        got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.matches(frame(spark, docs), benchmark, max_broadcast=cap).collect()}
        assert got == {(1, 10): True, (2, 10): False, (7, 11): True}
    kept = decontamination.drop_contaminated(frame(spark, [*docs, (None, item)]), benchmark)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 4, 5, 6, None]


def held(spark, item, *texts):
    benchmark = spark.createDataFrame([(10, item)], "item_id long, text string")
    return sorted(r["doc_id"] for r in decontamination.matches(frame(spark, list(enumerate(texts))), benchmark).collect())


def test_decontamination_over_shifts(spark):
    item = "the old ferry left Lisbon at dawn with nine crates of oranges and then it crossed the wide bay to reach the small harbour where seven men were waiting for the load"
    words = item.split()
    inserted, dropped = " ".join([*words[:15], "slowly", *words[15:]]), " ".join([*words[:15], *words[16:]])
    longer = item.replace("Lisbon", "New York")
    few = " ".join(words[:12]) + " and then something else altogether happened on that day"
    assert held(spark, item, f"before it {inserted}", dropped, f"before it {longer} after", " ".join(words[:22]), few) == [0, 1, 2, 3]


def test_decontamination_reads_names_anywhere(spark):
    item = "Lisbon has nine bridges over its wide old river. Anna crossed three of them on her way home. Porto has only two and they are both new."
    other = item.replace("Lisbon", "Oslo").replace("Anna", "Paula").replace("Porto", "Bergen")
    trip = "the old ferry left Lisbon at dawn and reached Faro after Anna had gone to sleep near Evora with Berta and the small dog"
    wrapped = trip.replace(" Lisbon", "\nLisbon").replace(" Faro", "  Faro").replace(" Anna", "\n\nAnna").replace(" Evora", "\tEvora").replace(" Berta", "\nBerta")
    assert held(spark, item, f"Before it. {other}", "Oslo has nine bridges, and that is all.") == [0]
    assert held(spark, trip, f"so {wrapped}", wrapped.replace("Faro", "Elvas")) == [0, 1]


def test_decontamination_keeps_the_consistent_part(spark):
    item = "when the old keeper Marta went up to the lamp she saw that the oil was low and the glass was black with smoke so she went down again to the store for a can and a cloth and on the stairs the young helper asked Marta about the weather of the day"
    altered = item.replace("Marta about", "Berta about")
    sums = "a farmer has 5 cows and buys 7 more at the market so how many cows does the farmer then have on the farm"
    same = "every day 2 hens lay eggs for the shop and each box holds 2 of them so how many boxes are needed in a week"
    assert held(spark, item, f"before it {altered} after") == [0]
    assert held(spark, sums, sums.replace("5", "6").replace("7", "6")) == [0]
    assert held(spark, same, same.replace("2 hens", "3 hens").replace("2 of", "5 of")) == [0]


# ---------------------------------------------------------------- mixing


def test_allocation_makes_up_shortages_among_siblings_first():
    leaves = {("a", "x", "1"): 10.0, ("a", "x", "2"): 1000.0, ("a", "y", "3"): 1000.0, ("b", "x", "4"): 1000.0}
    got = mixing.allocate(leaves, 400.0, {}, 1)
    assert got == pytest.approx({("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "3"): 100, ("b", "x", "4"): 200})
    short = mixing.allocate({**leaves, ("a", "x", "2"): 20.0}, 400.0, {}, 1)
    assert short == pytest.approx({("a", "x", "1"): 10, ("a", "x", "2"): 20, ("a", "y", "3"): 170, ("b", "x", "4"): 200})
    assert sum(mixing.allocate(leaves, 1e9, {}, 2).values()) == 2 * sum(leaves.values())


def test_mix(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 30)), f"s{k % 3}" if k % 17 else None) for k in range(300)] + [(1, None, "s0"), (2, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_row", F.lit(1))
    pick = lambda n: mixing.mix(df.repartition(n), F.lit("d"), F.lit("l"), F.col("source"), {}, fraction=0.7, max_epochs=2, bucket_rows=16)
    one = sorted(((r["_row"]["doc_id"], r["_epoch"]) for r in pick(2).collect()))
    assert one == sorted(((r["_row"]["doc_id"], r["_epoch"]) for r in pick(5).collect()))
    total = Counter()
    for r in pick(2).collect():
        total[r["_leaf"]["s"]] += r["_tokens"]
    have = Counter()
    for _, t, s in rows:
        have[s if s else "\x00null"] += len((t or "").split())
    quota = mixing.allocate({("d", "l", s): float(n) for s, n in have.items()}, 0.7 * sum(have.values()), {}, 2)
    for (_, _, s), q in quota.items():
        assert q <= total[s] < q + 30
    assert mixing.mix(df.where("doc_id < 0"), F.lit("d"), F.lit("l"), F.col("source"), {}).count() == 0


# ---------------------------------------------------------------- html


@pytest.fixture(scope="module")
def weights():
    return html_extract.trained()


def test_labeller_on_unseen_pages(weights):
    rng, labeller = np.random.default_rng(424242), html_extract.Labeller(weights)
    right = blocks = 0
    for _ in range(120):
        html, wanted = html_pages.page(rng)
        found = html_extract.blocks(html)
        if found:
            p = labeller.label([found])[0]
            right += sum((v >= 0.5) == (t in wanted) for v, (_, t, _) in zip(p, found, strict=True))
            blocks += len(found)
    assert right / blocks > 0.97


def plain_labels(page, w):
    """The network of one page block by block, gate by gate, as written down in the papers."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    xs, out = html_extract.vectors([page])[0].astype(np.float64), np.full(len(page), float(w["bias"][0]))
    hidden = html_extract.HIDDEN
    for side, order, rows in (("f", range(len(page)), slice(0, hidden)), ("b", range(len(page) - 1, -1, -1), slice(hidden, None))):
        h = c = np.zeros(hidden)
        for t in order:
            i, f, o, g = np.split(xs[t] @ w["w" + side] + h @ w["u" + side] + w["b" + side], 4)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            out[t] += h @ w["out"][rows]
    return sigmoid(out)


def test_labeller_equals_a_plain_network(weights):
    rng, labeller = np.random.default_rng(9), html_extract.Labeller(weights)
    pages = [p for p in (html_extract.blocks(html_pages.page(rng)[0]) for _ in range(12)) if p]
    for page, together in zip(pages, labeller.label(pages), strict=True):
        assert np.allclose(together, plain_labels(page, weights), atol=1e-4)
        assert np.allclose(labeller.label_long(page, 7), together, atol=1e-4)


def test_long_pages_are_labelled_in_pieces(weights):
    import tracemalloc

    assert html_extract.groups([0, 3, 9, 2, 40], 2, 20) == [[3, 1], [2], [4]]
    html = "<body>" + "".join(f"<p>Block {k} of a page, and then some.</p>" for k in range(30_000)) + "</body>"
    short = ["<body><p>Some words of a short page stand here.</p></body>"] * 63
    labeller = html_extract.Labeller(weights)
    labeller.label([html_extract.blocks(short[0])])
    tracemalloc.start()
    texts = html_extract.main_text([html, *short], labeller)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(texts) == 64 and peak < 200e6


def test_extraction(spark, weights):
    body = "".join(f"<p>This is paragraph {k} of the story,\n with &amp; more &quot;words&quot; in it.</p>" for k in range(6))
    page = f"<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>The title of it</h1>{body}</article><footer>&copy; site</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (3, None, "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(rows).collect()}
    expected = "The title of it " + " ".join(f'This is paragraph {k} of the story, with & more "words" in it.' for k in range(6))
    assert got == {1: (expected, len(expected)), 2: ("", 0), 3: ("", 0)}
    assert html_extract.extract(rows.where("page_id < 0")).count() == 0


# ---------------------------------------------------------------- empty tables


def test_empty_tables(spark):
    docs = frame(spark, [(1, "a")]).where("doc_id < 0")
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert jaccard_join.similar_components(docs).count() == 0
    assert token_count.token_count(docs, BPE).count() == 0
    assert token_file.read_digests(token_file.write_segments(docs, BPE)).count() == 0
    assert line_dedup.line_dedup(docs).count() == 0
    assert decontamination.matches(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert toxicity.score(docs, toxicity.Lexicon()).count() == 0


# ---------------------------------------------------------------- fields and splices against the library


def test_random_texts_equal_the_library():
    """White space of all kinds, letters of one to four bytes, special strings and contractions, in any order."""
    t, rng = tokens.load(BPE), random.Random(5)
    alphabet = ["a", "b", "é", "à", "É", "×", " ", " ", " ", "\n", "\t", " ", "\u0085", " ", "　", "\x1c", "日", "“", "’", "'s", "'", "1", "²", "<|endoftext|>", ".", ",", "😀", "x", "y", "ŉ"]
    some = ["".join(rng.choices(alphabet, k=rng.randrange(0, 25))) for _ in range(4000)] + ["q" * 300, " " + "z" * 41]
    ids, counts = t.packed(pa.array(some))
    expected = [t.tokenizer.encode(x, add_special_tokens=False).ids for x in some]
    assert [len(x) for x in expected] == counts.tolist() and [i for x in expected for i in x] == ids.tolist()
    for x in some[:400]:
        x = x * 6
        assert token_count.spliced(t, x, 40, 6) == len(t.tokenizer.encode(x, add_special_tokens=False).ids), x


def test_token_counts_widen_and_encode_whole(spark):
    """No boundary in the first overlap of some texts, and none at all in others; repeated rows and null ids too."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcdefg", k=n))
    rows = [(1, " ".join(word(rng.choice([3, 200, 700])) for _ in range(60))), (2, word(9000)), (2, word(9000)), (None, "x y " * 900), (3, "é" * 2500 + " a " + "b" * 2500)]
    rows += [rows[1]]
    got = token_count.token_count(frame(spark, rows), BPE, chunk=256, overlap=16)
    tokenizer = tokens.load(BPE).tokenizer
    expected = [(i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_of_other_files(spark, name):
    path = public_tokenizers.path(name)
    rows = [(1, " ".join(f"word{k % 97} and" for k in range(900))), (2, "short one"), (3, None)]
    got = token_count.token_count(frame(spark, rows), path, chunk=1024, overlap=128)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {i: tokens.load(path).count(t or "") for i, t in rows}
