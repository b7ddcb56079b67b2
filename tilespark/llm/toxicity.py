"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding: lower case; look-alike letters of other alphabets to Latin; within words that have letters, digits and signs
that stand for letters to those letters. Accents stay: they tell languages apart.

The lexicon is learned from labelled texts: whole words and word beginnings (stems) of `min_stem` to `max_stem`
letters whose share of toxic texts is far above their share of clean ones. A stem stands for all its words, so a
longer stem or word is kept only if it is clearly better. An entry's weight is its smoothed log odds. Phrases of two
words that hold an entry but are found in clean texts as often as in toxic ones are exceptions: what they hold
doesn't count there. The score is a logistic function of the weights found and of their sum for each root of the
text's length in words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, written

# Letters that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = str.maketrans(dict(zip("аеорсухіјѕԁӏкмтвнгαβεικνορτυχ", "aeopcyxijsdlkmtbhrabeikvoptux", strict=True)))
LEET = str.maketrans("0134578@$!", "oieastbasi")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$!][0-9@$!\w]*|[0-9@$!]+[^\W\d_][0-9@$!\w]*")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The text in lower case with look-alikes and stand-ins replaced, and words joined by single spaces."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    text = _MIXED.sub(lambda m: m[0].rstrip("@$!").translate(LEET), text)
    return " ".join(_WORD.findall(text))


@dataclass
class Lexicon:
    """weights: entry -> weight; an entry that ends with a space is a word, any other a stem. exceptions: phrases within
    which entries don't count. bias and slopes: the logistic score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -4.0
    slopes: tuple[float, ...] = (1.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(" " + entry, (len(entry) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found

    def features(self, text: str, automaton) -> tuple[float, float, float]:
        """Log of the sum of weights, that sum for each root of a word, log of the number of matched words."""
        folded = f" {fold(text)} "
        best: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded) if len(automaton) else ():
            begin = end - length + 1
            if weight is None:
                covered.append((begin, end))
            elif weight > best.get(begin, 0.0):
                best[begin] = weight
        for a, b in covered:
            best = {k: w for k, w in best.items() if not a <= k < b}
        total = sum(best.values())
        return math.log1p(total), total / math.sqrt(1 + folded.count(" ")), math.log1p(len(best))

    def score(self, text: str | None, automaton) -> float:
        z = self.bias + sum(s * x for s, x in zip(self.slopes, self.features(text or "", automaton), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def terms(text: str, min_stem: int, max_stem: int) -> set[str]:
    words = set(fold(text).split())
    out = {w + " " for w in words if len(w) >= 2}
    for w in words:
        out.update(w[:n] for n in range(min_stem, min(max_stem, len(w)) + 1))
    return out


def _term_counts(min_stem: int, max_stem: int):
    """For each task, the number of its toxic and clean texts that hold each term; null counts the texts."""

    def run(batches):
        counts = [Counter(), Counter()]
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                counts[y].update(terms(text or "", min_stem, max_stem))
                counts[y][None] += 1
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield _count_rows(counts)
                counts = [Counter(), Counter()]
        yield _count_rows(counts)
        give_back()

    return run


def _count_rows(counts):
    keys = [k for c in counts for k in c]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([0] * len(counts[0]) + [1] * len(counts[1]), pa.int32()), pa.array([v for c in counts for v in c.values()], pa.int64())], names=["term", "y", "n"]
    )


def choose(rows: list[tuple[str, int, int]], toxic: int, clean: int, max_terms: int, least: int) -> dict[str, float]:
    """Weights from (term, toxic texts, clean texts). Of nested stems and words that nearly the same toxic texts hold the
    longest is taken. Of the others a longer one is taken beside a shorter only if its log odds are higher by one half
    or more. Terms of few texts, as a family of copies may give, weigh less."""
    odds = {t: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for t, a, b in rows}
    count = {t: a for t, a, _ in rows}
    within: dict[str, int] = {}
    for term, a in count.items():
        for n in range(1, len(term.rstrip(" ")) + (term[-1] == " ")):
            within[term[:n]] = max(a, within.get(term[:n], 0))
    chosen: dict[str, float] = {}
    for term in sorted(count, key=lambda t: (len(t), t)):
        bare = term.rstrip(" ")
        above = max((odds[bare[:n]] for n in range(1, len(term)) if bare[:n] in chosen), default=0.0)
        if within.get(term, 0) < 0.9 * count[term] and odds[term] >= max(math.log(8), above + 0.5):
            chosen[term] = odds[term] * min(1.0, count[term] / (4 * least))
    top = sorted(chosen, key=lambda t: (-chosen[t], t))[:max_terms]
    return {t: chosen[t] for t in top}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Weights (bias first) by Newton's method; classes weigh the same in sum up to a factor of two."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, min_stem: int = 3, max_stem: int = 7, max_terms: int = 4_000, max_fit: int = 2_000) -> Lexicon:
    """A lexicon from labelled rows outside the held-out fold (crc32 of doc_id as text, modulo 5, is 0).

    The fit takes at most max_rows labelled rows, those with the least hashes of doc_id: a bounded sample that does not
    depend on the order of rows. max_fit of them, again by hash, set the score's slopes. Only their texts are read
    in; what comes to the driver is the counts of terms found in at least a hundredth of the toxic rows, and max_fit
    texts. Rows with a null id, text or label are left out. Without a toxic or a clean row, nothing is toxic."""
    spark = docs.sparkSession
    fold5 = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(fold5 != 0)
        .dropDuplicates(["doc_id"]).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_rows)
    )
    sample = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(picked), "doc_id"), "toxicity-fit")
    counts = sample.select("text", "y").mapInArrow(_term_counts(min_stem, max_stem), "term string, y int, n long")
    counts = counts.groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    size = sample.groupBy("y").count().collect()
    toxic, clean = (next((r["count"] for r in size if r["y"] == y), 0) for y in (1, 0))
    if not toxic or not clean:
        return Lexicon()
    least = max(3, toxic // 100)
    rows = counts.where((F.col("a") >= least) & F.col("term").isNotNull() & ((F.col("a") + 0.5) / (toxic + 1) >= 8 * (F.col("b") + 0.5) / (clean + 1))).collect()
    lexicon = Lexicon(choose([(r["term"], r["a"], r["b"]) for r in rows], toxic, clean, max_terms, least))
    fit = sample.orderBy("h", "doc_id").limit(max_fit).select("text", "y").toLocalIterator()
    seen = [(r["text"], r["y"]) for r in fit]
    automaton = lexicon.automaton()
    lexicon.exceptions = _exceptions(lexicon, seen)
    automaton = lexicon.automaton()
    y = np.asarray([y for _, y in seen], dtype=float)
    if 0 < y.sum() < len(y):
        w = logistic(np.asarray([lexicon.features(t, automaton) for t, _ in seen]), y)
        lexicon.bias, lexicon.slopes = float(w[0]), tuple(float(v) for v in w[1:])
    return lexicon


def _exceptions(lexicon: Lexicon, seen: list[tuple[str, int]], least: int = 3) -> list[str]:
    """Two-word phrases with an entry in them that at least `least` clean texts hold and no more toxic ones."""
    words = re.compile("|".join(rf"^{re.escape(e.strip())}{'$' if e.endswith(' ') else ''}" for e in lexicon.weights) or r"(?!)")
    counts = [Counter(), Counter()]
    for text, y in seen:
        w = fold(text).split()
        counts[y].update({f"{a} {b}" for a, b in zip(w, w[1:]) if words.search(a) or words.search(b)})
    return sorted(p for p, n in counts[0].items() if n >= least and counts[1][p] <= n)


def _scorer(lexicon: Lexicon, id_col: str):
    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [lexicon.score(t, automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[id_col, "held_out", "score", "predicted"]
            )

    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without matches. Repeated rows get a row each. A null id gives a
    null held_out. An empty table gives no rows. No column but the text has a part in the score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(lexicon, "doc_id"), "doc_id long, held_out boolean, score double, predicted int")


def _keep(lexicon: Lexicon):
    def run(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            clean = [lexicon.score(t, automaton) < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))
        give_back()

    return run


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns as they are."""
    return docs.mapInArrow(_keep(lexicon), docs.schema)
