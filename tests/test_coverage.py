"""The coverage tree and its proofs: scenarios, random trees, and each check made to fail."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tilespark.operators import coverage as C
from tilespark.operators import quality as Q
from tilespark.operators import upsert as U

DAY = datetime.date(2024, 1, 1)


def day(k):
    return DAY + datetime.timedelta(k)


def rows(spark, spec):
    """spec: (day number, class, count)"""
    return spark.createDataFrame([(day(d), c) for d, c, n in spec for _ in range(n)], "day date, class string")


def statuses(spark, spec, root, cap=30):
    nodes = C.coverage(rows(spark, spec), F.col("day"), F.col("class"), cap, root)
    return nodes.collect()


def test_all_found_without_gap(spark):
    spec = [(i, "A", 40 if i % 73 == 0 else 5 if i % 7 == 0 else 1 if i % 3 == 0 else 0) for i in range(366)]
    spec = [(d, "AB"[k % 2], n // 2 + (n % 2) * k) for d, _, n in spec for k in range(2)]
    nodes = statuses(spark, spec, C.Root(day(0), day(365)))
    assert not [n for n in nodes if n["status"] == "GAP"]
    leaves = [n for n in nodes if n["status"] in ("LEAF_DONE", "LEAF_DONE_SECONDARY")]
    assert sum(n["n"] for n in leaves) == sum(n for _, _, n in spec)


def test_few_queries_for_a_long_range():
    nodes = C.resolve_days({day(3): 5, day(900): 5, day(1800): 5}, C.Root(day(0), day(1826)), 30, True)
    assert len(nodes) < 30


def test_empty_range_is_one_query():
    assert len(C.resolve_days({}, C.Root(day(0), day(365)), 30, True)) == 1


def test_one_class_over_the_cap_is_a_gap(spark):
    nodes = statuses(spark, [(14, "A", 45), (19, "A", 3)], C.Root(day(0), day(30)))
    gaps = [n for n in nodes if n["status"] == "GAP"]
    assert [(g["ini"], g["n"]) for g in gaps] == [(day(14), 45)]
    assert any(n["status"] == "LEAF_DONE" and n["ini"] <= day(19) <= n["fim"] and n["n"] == 3 for n in nodes)


def test_three_classes_fit(spark):
    nodes = statuses(spark, [(14, c, 15) for c in "ABC"] + [(19, "A", 3)], C.Root(day(0), day(30)))
    assert not [n for n in nodes if n["status"] == "GAP"]
    assert sum(n["n"] for n in nodes if n["status"] == "LEAF_DONE_SECONDARY") == 45


def test_prefix_classes_take_each_others_rows(spark):
    nodes = statuses(spark, [(0, "AÇÃO", 20), (0, "acao civil", 15)], C.Root(day(0), day(0)))
    assert {n["class"]: n["n"] for n in nodes if n["class"]} == {"ACAO": 35, "ACAO CIVIL": 15}


def leaves(spark, spans, run="r"):
    return spark.createDataFrame([(run, f"{a:05d}", day(a), day(b)) for a, b in spans], "run string, id string, ini date, fim date")


def random_tiling(rng, days):
    cuts = sorted(rng.sample(range(1, days), min(days - 1, rng.randint(3, 25))))
    edges = [0, *cuts, days]
    return [(a, b - 1) for a, b in zip(edges[:-1], edges[1:])]


def test_random_tilings(spark):
    rng = random.Random(5)
    root, all_rows, broken = C.Root(day(0), day(399)), None, set()
    for k in range(40):
        spans = random_tiling(rng, 400)
        if k % 2:
            broken.add(f"r{k}")
            at = rng.randrange(len(spans))
            kind = rng.choice(["drop", "stretch", "shift"])
            a, b = spans[at]
            spans = spans[:at] + ([] if kind == "drop" else [(a, b + 2)] if kind == "stretch" else [(a + 1, b + 1)]) + spans[at + 1 :]
        more = leaves(spark, spans, f"r{k}")
        all_rows = more if all_rows is None else all_rows.union(more)
    summary = {r["run"]: r["ok"] for r in C.tiling_summary(all_rows, root).collect()}
    assert {r for r, ok in summary.items() if not ok} == broken


@pytest.mark.parametrize("spans,kinds", [([(1, 9)], ["missing-start"]), ([(0, 8)], ["missing-end"]), ([(0, 4), (6, 9)], ["gap"]), ([(0, 5), (5, 9)], ["overlap"]), ([], ["empty"]), ([(0, 9)], [])])
def test_violations(spark, spans, kinds):
    assert [r["kind"] for r in C.tiling_violations(leaves(spark, spans), C.Root(day(0), day(9))).collect()] == kinds


def test_overlapping_pairs(spark):
    found = C.overlapping_pairs(leaves(spark, [(0, 40), (40, 50), (51, 60)])).collect()
    assert [(r["a"], r["b"]) for r in found] == [("00000", "00040")]


def test_transitions(spark):
    log = spark.createDataFrame([(1, 1, "PENDING"), (1, 2, "SPLIT"), (1, 3, "LEAF_DONE"), (2, 1, "GAP"), (2, 2, "PENDING")], "e int, t int, s string")
    assert [(r["old"], r["new"], r["n"]) for r in C.illegal_transitions(log, "e", ["t"], "s", C.TRANSITIONS).collect()] == [("SPLIT", "LEAF_DONE", 1)]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, content_hash string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, content_hash string")
    assert {r["k"]: r["outcome"] for r in U.outcomes(old, new, ["k"]).collect()} == {1: "kept", 2: "unchanged", 3: "updated", 4: "inserted"}
    assert sorted(map(tuple, U.next_snapshot(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "x"), (4, "d")]
    again = U.next_snapshot(U.next_snapshot(old, new, ["k"]), new, ["k"])
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "b"), (3, "x"), (4, "d")]


def test_drift(spark):
    stored = spark.createDataFrame([("a", 100), ("b", 100)], "k string, stored bigint")
    now = spark.createDataFrame([("a", 109), ("b", 111)], "k string, now bigint")
    assert {r["k"]: r["drifted"] for r in Q.drift(stored, now, "k").collect()} == {"a": False, "b": True}


def test_a_failed_warning_does_not_fail_the_report(spark):
    count = lambda n: spark.createDataFrame([(n,)], "n bigint")
    checks = lambda bad: [Q.Check("S-1", "error", count(bad), F.col("n") == 0, F.col("n")), Q.Check("S-11", "warn", count(1), F.col("n") == 0, F.col("n"))]
    assert Q.passed(Q.report(checks(0))).first()["ok"] is True
    assert Q.passed(Q.report(checks(2))).first()["ok"] is False
