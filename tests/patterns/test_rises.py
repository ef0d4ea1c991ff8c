"""Rises and falls of readings with uncertain times against an enumeration of all worlds."""

import itertools
import random
from fractions import Fraction

import pytest

from trailmark.operators import rises
from trailmark.plans import compile as plans
from trailmark.plans.pattern import Pattern, Relation, Step

SCHEMA = "patient long, event_id long, kind string, lo long, hi long, end_lo long, end_hi long, micro long"


def meets(t, value, others, previous, within, factor, floor, falls):
    """others: (time, id, value) of one world."""
    before = sorted((x for x in others if t - within <= x[0] <= t - 1), reverse=True)[:previous]
    if not before:
        return False
    base = max(Fraction(sum(x[2] for x in before), len(before)), Fraction(floor))
    return value * Fraction(*factor) <= base if falls else value >= base * Fraction(*factor)


@pytest.mark.parametrize("seed", range(40))
def test_judged_against_worlds(seed):
    r = random.Random(seed)
    for _ in range(60):
        lo = r.randint(3, 7)
        hi = lo + r.randint(0, 3)
        others = [(a, a + r.randint(0, 4), k if k < 2 else k + 1, r.randint(1, 9)) for k, a in enumerate(r.randint(0, 8) for _ in range(r.randint(0, 4)))]
        previous, within, falls, value = r.randint(1, 3), r.randint(1, 6), r.random() < 0.4, r.randint(1, 12)
        factor, floor = r.choice([(1, 1), (3, 2), (2, 1)]), r.choice([0, 4])
        sure, spans = rises.judged(lo, hi, value, others, previous, within, factor, floor, falls)
        may, must = set(), True
        for t in range(lo, hi + 1):
            for times in itertools.product(*(range(o[0], o[1] + 1) for o in others)):
                ok = meets(t, value, [(x, o[2], o[3]) for x, o in zip(times, others, strict=True)], previous, within, factor, floor, falls)
                must &= ok
                may |= {t} if ok else set()
        assert (sure, {t for a, b in spans for t in range(a, b + 1)}) == (must, may), (lo, hi, value, others, previous, within, factor, floor, falls)
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("seed", range(4))
def test_rising_steps_against_worlds(spark, seed):
    r = random.Random(70 + seed)
    previous, within, floor, falls = r.randint(1, 2), r.randint(2, 4), r.choice([0, 3]), seed % 2 == 1
    pattern = Pattern((Step("a", "k1", rise=(previous, within, 3, 2, floor), falls=falls), Step("b", "k2")), (Relation("r", "after", "a", "b", 0, 2),))
    cases = {}
    for p in range(50):
        cases[p] = [(k, r.choice(["k1", "k1", "k2"]), lo, lo + r.randint(0, 2), r.randint(1, 9)) for k, lo in enumerate(r.randint(0, 5) for _ in range(r.randint(1, 5)))]
    events = spark.createDataFrame([(p, 100 * p + k, kind, lo, hi, lo, hi, v) for p, h in cases.items() for k, kind, lo, hi, v in h], SCHEMA)
    windows = spark.createDataFrame([(p, 0, 9) for p in cases], "patient long, w_start long, w_end long")
    closure = spark.createDataFrame([("k1", "k1"), ("k2", "k2")], "concept string, ancestor string")
    got = {x.patient: x.status for x in plans.statuses(pattern, events, closure, windows).collect()}
    for p, h in cases.items():
        readings, others = [x for x in h if x[1] == "k1"], [x for x in h if x[1] == "k2"]
        every, some = None, False
        for times in itertools.product(*(range(x[2], x[3] + 1) for x in h)):
            at = {x[0]: t for x, t in zip(h, times, strict=True)}
            holds = {(a[0], b[0]) for a in readings for b in others if 0 <= at[b[0]] - at[a[0]] <= 2 and meets(at[a[0]], a[4], [(at[o[0]], o[0], o[4]) for o in readings if o is not a], previous, within, (3, 2), floor, falls)}
            some |= bool(holds)
            every = holds if every is None else every & holds
        assert got[p] == ("exact" if every else "possible" if some else "none"), h


def test_a_dense_history_meets_few_neighbours(spark):
    rows = [(1, k, "k1", 10 * k, 10 * k + 25, 10 * k, 10 * k + 25, k) for k in range(500)]
    found = rises.near(spark.createDataFrame(rows, SCHEMA), 3, 10**6).collect()
    assert max(len(r.others) for r in found) <= 12


def test_steps_that_other_steps_can_bind_are_unresolved(spark):
    rows = [(1, 1, "k1", 0, 4, 0, 4, 1), (1, 2, "k1", 3, 6, 3, 6, 9)]
    events = spark.createDataFrame(rows, SCHEMA)
    windows, closure = spark.createDataFrame([(1, 0, 9)], "patient long, w_start long, w_end long"), spark.createDataFrame([("k1", "k1")], "concept string, ancestor string")
    pattern = lambda least: Pattern((Step("a", "k1", rise=(1, 9, 2, 1, 0)), Step("b", "k1")), (Relation("r", "after", "b", "a", least, 9),))
    assert plans.statuses(pattern(2), events, closure, windows).first().status == "unresolved"
    assert plans.statuses(pattern(7), events, closure, windows).first().status == "none"
