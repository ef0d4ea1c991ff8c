"""Cycles by a separator, hulls, and witnesses against an enumeration of all worlds."""

import itertools
import random

import pytest

from tests.patterns.test_worlds import KINDS, SCHEMA, brute, history
from trailmark.plans import compile as plans
from trailmark.plans.pattern import Pattern, Relation, Step


def frames(spark, cases):
    events = spark.createDataFrame([(p, 100 * p + e["event_id"], e["kind"], e["lo"], e["hi"], e["end_lo"], e["end_hi"], 0, None, None) for p, (h, _) in cases.items() for e in h], SCHEMA)
    windows = spark.createDataFrame([(p, *(w or (None, None))) for p, (_, w) in cases.items()], "patient long, w_start long, w_end long")
    return events, spark.createDataFrame([(k, k) for k in KINDS], "concept string, ancestor string"), windows


def cyclic(r):
    steps = tuple(Step(n, r.choice(KINDS)) for n in "abcd")
    relations = []
    for k, (x, y) in enumerate([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")] + [("a", "c")] * (r.random() < 0.4)):
        x, y = (y, x) if r.random() < 0.5 else (x, y)
        least = r.choice([None, -2, -1, 0])
        relations.append(Relation(f"r{k}", "during", x, y, grace=r.randint(0, 2)) if r.random() < 0.3 else Relation(f"r{k}", "after", x, y, least, r.choice([None, (least or 0) + r.randint(1, 3)])))
    return Pattern(steps, tuple(relations), scope=r.choice(["any", "within"]))


@pytest.mark.parametrize("seed", range(4))
def test_cycles_of_four_against_worlds(spark, seed):
    r = random.Random(40 + seed)
    pattern = cyclic(r)
    assert not pattern.is_forest() and plans.separator(pattern)
    cases = {p: (history(r, seed % 2 == 0, False), (0, 5)) for p in range(40)}
    got = {x.patient: x.status for x in plans.statuses(pattern, *frames(spark, cases)).collect()}
    assert got == {p: brute(pattern, h, w) for p, (h, w) in cases.items()}, pattern


def test_a_step_that_is_not_next_to_the_separator(spark):
    """a - b - c - d - a with separator a or another: c is reached through its partners."""
    ids = iter(range(100))
    event = lambda p, kind, t: (p, next(ids), kind, t, t, t, t, 0, None, None)
    rows = [event(1, "k1", 0), event(1, "k2", 1), event(1, "k3", 2), event(1, "k4", 1), event(2, "k1", 0), event(2, "k2", 1), event(2, "k3", 5), event(2, "k4", 1)]
    events = spark.createDataFrame(rows, SCHEMA)
    windows = spark.createDataFrame([(1, 0, 9), (2, 0, 9)], "patient long, w_start long, w_end long")
    closure = spark.createDataFrame([(f"k{k}", f"k{k}") for k in range(1, 5)], "concept string, ancestor string")
    one = lambda i, x, y: Relation(i, "after", x, y, 0, 1)
    pattern = Pattern(tuple(Step(n, f"k{k}") for k, n in enumerate("abcd", 1)), (one("r1", "a", "b"), one("r2", "b", "c"), one("r3", "a", "d"), one("r4", "d", "c")))
    assert [r.patient for r in plans.exact_patients(pattern, events, closure, windows).collect()] == [1]


@pytest.mark.parametrize("seed", range(2))
def test_hulls_and_witnesses(spark, seed):
    r = random.Random(90 + seed)
    steps = tuple(Step(n, k) for n, k in zip("abc", KINDS, strict=True))
    pattern = Pattern(steps, (Relation("r1", "after", "a", "b", 1, 3), Relation("r2", "during", "b", "c", grace=1)), scope=["any", "within", "from_start"][seed])
    cases = {p: (history(r, False, False), None if p % 9 == 0 else (0, 4)) for p in range(60)}
    events, closure, windows = frames(spark, cases)
    want = {p: brute(pattern, h, w) for p, (h, w) in cases.items()}
    refuted = {x.patient: x.refuted for x in plans.hulls(pattern, events, closure, windows).collect()}
    assert all(want[p] in ("none", "excluded") for p, no in refuted.items() if no) and any(no for no in refuted.values()) and len(refuted) == len(cases)
    found = {x.patient: x for x in plans.witnesses(pattern, events, closure, windows).collect()}
    assert {p for p in found if cases[p][1]} == {p for p, s in want.items() if s in ("exact", "possible")}
    for p, x in found.items():
        by_id = {100 * p + e["event_id"]: e for e in cases[p][0]}
        assert x.replayed and all(by_id[x[f"{s.id}_event_id"]]["lo"] <= x[f"{s.id}_at"] <= by_id[x[f"{s.id}_event_id"]]["hi"] for s in steps) and 1 <= x.b_at - x.a_at <= 3 and x.c_at >= x.b_at
    assert not any(itertools.filterfalse(lambda x: x.replayed, found.values()))
