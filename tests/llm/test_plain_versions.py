"""Scores, contaminated documents and chosen rows against plain versions that look at everything."""

from __future__ import annotations

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import WORD, frame

from tilespark.llm import decontamination, mixing, toxicity

# ---------------------------------------------------------------- toxicity


def plain_score(lexicon, text):
    """Every entry at every place, without an automaton."""
    folded = f" {toxicity.fold(text or '')} "
    best = {}
    for at in range(len(folded)):
        hits = [w for term, w in lexicon.weights.items() if folded.startswith(f" {term}", at)]
        if hits:
            best[at] = max(hits)
    for phrase in lexicon.exceptions:
        for at in range(len(folded)):
            if folded.startswith(f" {phrase} ", at):
                # an entry begins at the space before its word, so the space after the phrase belongs to the next one
                best = {k: w for k, w in best.items() if not at <= k <= at + len(phrase)}
    total = sum(best.values())
    x = (math.log1p(total), total / math.sqrt(1 + folded.count(" ")), math.log1p(len(best)))
    return 1 / (1 + math.exp(-(lexicon.bias + sum(a * b for a, b in zip(lexicon.slopes, x)))))


def test_scores_equal_a_plain_search(spark):
    rng = random.Random(4)
    lexicon = toxicity.Lexicon({"idiot ": 3.0, "idi": 1.0, "trash ": 2.5, "bugg": 1.5, "you ": 0.5}, ["trash can", "you bugger"], -1.0, (0.8, 1.1, -0.2))
    words = ["idiot", "1d10t", "іdіоt", "idiotic", "trash", "can", "TRASH", "bugger", "buggy", "you", "a", "b", "été", "!!"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for k in range(300)] + [(900, None), (901, ""), (None, "idiot"), (902, "a " * 40_000 + "idiot"), (3, "trash"), (3, "trash")]
    got = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in toxicity.score(frame(spark, rows), lexicon).collect())
    assert got == sorted((str(i), round(plain_score(lexicon, t), 9)) for i, t in rows)


# ---------------------------------------------------------------- decontamination


def plain_templates(text):
    """For each reading, the template words: (template, word, kind, number of the first word)."""
    raw = [(m[0], m.start(), m.end()) for m in WORD.finditer(text)]
    out = []
    for reading in range(3):
        words = []
        for k, (w, begin, _) in enumerate(raw):
            lean = re.sub(r"[A-Z]", lambda m: m[0].lower(), re.sub(r"[^0-9A-Za-z\x80-\U0010ffff]", "", w))
            if not lean:
                continue
            digits, letters = bool(re.search("[0-9]", lean)), bool(re.search(r"[a-z\x80-\U0010ffff]", lean))
            quiet = bool(words) and raw[k - 1][0][-1] not in ".!?:"
            near = k > 0 and text[raw[k - 1][2] : begin] == " "
            name = "A" <= w[0] <= "Z" and (reading == 2 or (quiet and (reading == 1 or near)))
            kind = ("unit" if letters else "number") if digits else "name" if name else ""
            if lean in decontamination.UNITS and words and words[-1][2]:
                kind = "unit"
            words.append((lean, kind, digits and not letters))
        runs = []
        for k, (w, kind, _) in enumerate(words):
            if runs and kind and kind in ("number", "name") and runs[-1][2] == kind:
                runs[-1][1].append(w)
            else:
                runs.append([kind or w, [w], kind, k])
        out.append(([(("", t) if not kind else (kind,), tuple(w), kind, k) for t, w, kind, k in runs], len(words)))
    return out


def plain_matches(docs, items, width=8, coverage=0.6):
    numbers = {}

    def slot(word):
        if not word[2]:
            return 0
        odd = word[2] == "number" or (word[2] == "unit" and word[1][0] not in decontamination.UNITS)
        return 2 * numbers.setdefault(word[1], len(numbers) + 1) + odd

    def windows(text, sizes):
        seen = {}
        for reading, (words, total) in enumerate(plain_templates(text)):
            for size in sizes(len(words)):
                for k in range(len(words) - size + 1):
                    own = words[k : k + size]
                    places = [w[3] for w in own] + [words[k + size][3] if k + size < len(words) else total]
                    seen.setdefault((tuple(w[0] for w in own), tuple(slot(w) for w in own), own[0][3], tuple(places)), reading)
        return [(*k, r) for k, r in seen.items()]

    found = set()
    whole = {i: windows(t, lambda n: [width] if n >= width else [n] if n else []) for i, t in items.items()}
    whole = {i: [w for w in ws if 2 * sum(s != 0 for s in w[1]) <= len(w[1])] for i, ws in whole.items()}
    sizes = sorted({len(w[0]) for ws in whole.values() for w in ws})
    for d, text in docs.items():
        mine = windows(text, lambda n: sizes)
        for i, ws in whole.items():
            rows = sorted((max(r, r2), p2, p, pl, s2, s) for t, s, p, pl, r in ws for t2, s2, p2, _, r2 in mine if t == t2)
            if not rows:
                continue
            n_windows, n_words = len({w[2] for w in ws}), len({x for w in ws for x in range(w[3][0], w[3][-1])})
            cols = [[d] * len(rows), [i] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [list(r[5]) for r in rows], [list(r[3]) for r in rows], [list(r[4]) for r in rows], [n_windows] * len(rows), [n_words] * len(rows)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[str(k) for k in range(10)])
            found |= {(x["doc_id"], x["item_id"], x["exact"]) for out in decontamination._judge(coverage)([batch]) for x in out.to_pylist()}
    return found


def test_matches_equal_nested_loops(spark):
    rng = random.Random(12)
    words = "the a train leaves from with of old river bridge near town and then goes under over small big house".split()
    names, units = ["Lisbon", "Porto", "Anna", "New York"], ["km", "kg", "hours"]

    def word():
        x = rng.random()
        return rng.choice(names) if x < 0.12 else f"{rng.randrange(90)}" if x < 0.2 else f"{rng.randrange(9)} {rng.choice(units)}" if x < 0.25 else f"{rng.randrange(9)}km" if x < 0.27 else rng.choice(words) + rng.choice(["", "", "", ",", "."])

    items = {k: " ".join(word() for _ in range(rng.choice([3, 7, 12, 25]))) for k in range(25)} | {90: "", 91: "12 34"}
    docs = {}
    for k in range(60):
        t = items[rng.randrange(25)].split(" ")
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = [word()]
        t = " ".join(t) if rng.random() < 0.8 else " ".join(t[: len(t) // 2])
        docs[k] = " ".join(word() for _ in range(5)) + rng.choice([" ", "\n", ". ", "  "]) + t + " " + " ".join(word() for _ in range(4))
    docs |= {200: "", 201: "x " * 30_000 + items[3], 202: items[5]}
    got = decontamination.matches(frame(spark, [*docs.items(), (300, None), (202, items[5])]), spark.createDataFrame([*items.items(), (92, None)], "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"], r["exact"]) for r in got.collect()}
    assert found == plain_matches(docs, items) and len(found) > 20


# ---------------------------------------------------------------- mixing


@pytest.mark.parametrize("fraction,epochs", [(0.35, 1), (0.8, 2), (1.4, 2)])
def test_chosen_rows_equal_plain_prefixes(spark, fraction, epochs):
    rng = random.Random(8)
    rows = [(rng.choice([k, k // 3, None]), " ".join(["w"] * rng.randrange(0, 25)) if k % 13 else None, rng.choice("aab"), rng.choice(["x", "y", None])) for k in range(400)]
    rows += rows[:20] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"_leaf": F.lit(1), "_tokens": F.lit("z")})
    weights = {("d", "a"): 3.0, ("d", "a", "x"): 2.0}
    got = mixing.mix(df.repartition(5), F.lit("d"), F.col("lang"), F.col("source"), weights, fraction=fraction, max_epochs=epochs, bucket_rows=16)
    chosen = sorted(((r["_row"]["doc_id"], r["_row"]["text"], r["_row"]["lang"], r["_row"]["source"], r["_epoch"]) for r in got.collect()), key=str)
    places = [df.withColumn("p", F.shiftrightunsigned(F.xxhash64(F.lit(17), F.lit(e).cast("int"), F.col("doc_id"), F.xxhash64("text")), 33)).collect() for e in range(1, epochs + 1)]
    leaves = {}
    for r in places[0]:
        leaf = ("d", r["lang"], r["source"] or "\0null")
        leaves[leaf] = leaves.get(leaf, 0.0) + len((r["text"] or "").split())
    quota = mixing.allocate(leaves, fraction * sum(leaves.values()), weights, epochs)
    expected = []
    for leaf, tokens in leaves.items():
        left = quota[leaf]
        for e in range(epochs):
            if left <= 1e-6:
                break
            own = sorted((r for r in places[e] if ("d", r["lang"], r["source"] or "\0null") == leaf), key=lambda r: (r["p"], r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
            so_far = 0
            for r in own:
                if so_far >= left and not left >= tokens:
                    break
                expected.append((r["doc_id"], r["text"], r["lang"], r["source"], e + 1))
                so_far += len((r["text"] or "").split())
            left -= tokens
    assert chosen == sorted(expected, key=str)
