"""Shared time variables against an enumeration of all worlds."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.patterns.test_worlds import KINDS, SCHEMA, patterns
from trailmark.functions import timealg as ta
from trailmark.operators import shared
from trailmark.plans.pattern import Pattern, Relation, Step


def history(r):
    """Up to four events; times share variables, also an end with the next one's start, whose ranges may contradict each other."""
    out = []
    for i in range(r.randint(2, 4)):
        lo = r.randint(0, 4)
        hi = lo + r.randint(0, 2)
        point = r.random() < 0.4
        end = (lo, hi) if point else sorted((r.randint(lo, lo + 2), hi + r.randint(0, 2)))
        start_var = r.choice([None, "x", "y"])
        end_var = None if point else r.choice([None, None, "x", "y", "z"])
        if out and r.random() < 0.4:
            start_var = out[-1]["end_var"]
            if start_var:
                lo, hi = out[-1]["end_lo"], out[-1]["end_hi"]
                end = (lo, hi) if point else (lo, hi + r.randint(0, 2))
        out.append({"event_id": i, "kind": r.choice(KINDS), "lo": lo, "hi": hi, "end_lo": end[0], "end_hi": end[1], "start_var": start_var, "end_var": end_var})
    return out


def worlds(events):
    bounds, named = {}, []
    for k, e in enumerate(events):
        point = e["end_var"] is None and (e["end_lo"], e["end_hi"]) == (e["lo"], e["hi"])
        start = e["start_var"] or f"s{k}"
        end = start if point else e["end_var"] or f"e{k}"
        named.append((start, end))
        for name, lo, hi in ((start, e["lo"], e["hi"]), (end, e["end_lo"], e["end_hi"])):
            a, b = bounds.get(name, (lo, hi))
            bounds[name] = (max(a, lo), min(b, hi))
    names = sorted(bounds)
    for values in itertools.product(*(range(bounds[n][0], bounds[n][1] + 1) for n in names)):
        at = dict(zip(names, values, strict=True))
        if all(at[a] <= at[b] for a, b in named):
            yield [(at[a], at[b]) for a, b in named]


def brute(pattern, events, window):
    if window is None:
        return "excluded"
    domains = [[i for i, e in enumerate(events) if e["kind"] == s.concept] for s in pattern.steps]
    at, every, some, any_world = {s.id: k for k, s in enumerate(pattern.steps)}, {}, False, False
    for w in worlds(events):
        any_world = True
        for b in itertools.product(*domains):
            ok = True
            for r in pattern.relations:
                (s1, e1), (s2, _) = w[b[at[r.source]]], w[b[at[r.target]]]
                ok &= (r.least is None or s2 - s1 >= r.least) and (r.most is None or s2 - s1 <= r.most) if r.kind == "after" else s2 >= s1 and s2 - e1 <= r.grace
            for x in b:
                ok &= {"any": True, "from_start": w[x][0] >= window[0], "within": window[0] <= w[x][0] <= window[1], "after": w[x][0] >= window[1]}[pattern.scope]
            every[b] = every.get(b, True) and ok
            some |= ok
    return "inconsistent" if not any_world else "exact" if any(every.values()) else "possible" if some else "none"


def frames(spark, cases):
    events = spark.createDataFrame([(p, 100 * p + e["event_id"], e["kind"], e["lo"], e["hi"], e["end_lo"], e["end_hi"], 0, e["start_var"], e["end_var"]) for p, (h, _) in cases.items() for e in h], SCHEMA)
    windows = spark.createDataFrame([(p, *(w or (None, None))) for p, (_, w) in cases.items()], "patient long, w_start long, w_end long")
    return events, spark.createDataFrame([(k, k) for k in KINDS], "concept string, ancestor string"), windows


def shares(events):
    uses = [{x for x in (e["start_var"], e["end_var"]) if x} for e in events]
    return any(a & b for a, b in itertools.combinations(uses, 2))


@pytest.mark.parametrize("seed", range(5))
def test_against_worlds(spark, seed):
    r = random.Random(1000 + seed)
    pattern = patterns(r)
    cases = {p: (history(r), None if p % 11 == 0 else (1, 3)) for p in range(60)}
    got = {x.patient: x.status for x in shared.statuses(pattern, *frames(spark, cases)).collect()}
    assert got == {p: brute(pattern, h, w) for p, (h, w) in cases.items() if shares(h)}, pattern
    assert len(got) > 20


def test_order_through_an_event_that_is_not_bound(spark):
    """c ends where b begins and begins where a ends: a is no later than b, whatever their ranges."""
    rows = [(1, 1, "k1", 0, 9, 0, 9, 0, None, "x"), (1, 2, "k3", 0, 9, 0, 9, 0, "x", "y"), (1, 3, "k2", 0, 9, 0, 9, 0, "y", "z")]
    events = spark.createDataFrame(rows, SCHEMA)
    windows, closure = spark.createDataFrame([(1, 0, 20)], "patient long, w_start long, w_end long"), spark.createDataFrame([(k, k) for k in KINDS], "concept string, ancestor string")
    ask = lambda least: shared.statuses(Pattern((Step("a", "k1"), Step("b", "k2")), (Relation("r", "after", "a", "b", least, 9),)), events, closure, windows).first().status
    assert (ask(0), ask(1), ask(10 - 1)) == ("exact", "possible", "possible")


def test_a_chain_stays_near_pairs(spark):
    """A chain of 200 touching intervals: ranges move along it, and its order is kept of overlapping neighbours only."""
    n = 200
    rows = [(1, k, "k1", 10 * k, 10 * k + 15, 10 * k + 10, 10 * k + 25, 0, f"v{k}", f"v{k + 1}") for k in range(n)]
    named = shared.with_names(spark.createDataFrame(rows, SCHEMA))
    known = shared.tightened(shared.variables(named), shared.order(named))
    assert known.count() == n + 1
    after = shared.no_earlier(known, shared.order(named)).withColumn("n", F.size("after"))
    assert after.agg(F.max("n")).first()[0] <= 2


def test_refused(spark):
    cases = {1: (history(random.Random(1)), (1, 3))}
    with pytest.raises(ValueError, match="independent times"):
        shared.statuses(Pattern((Step("a", "k1", occurrence="first"),)), *frames(spark, cases))


def test_one_hour_at_one_instant(spark):
    rows = [(1, 1, "k1", 0, 9, 0, 9, 0, "x", None), (1, 2, "k2", 4, 30, 4, 30, 0, "x", None), (2, 3, "k1", 0, 9, 0, 9, 0, "x", None), (2, 4, "k2", 20, 30, 20, 30, 0, "x", None)]
    events = spark.createDataFrame(rows, SCHEMA)
    windows, closure = spark.createDataFrame([(1, 0, 20), (2, 0, 20)], "patient long, w_start long, w_end long"), spark.createDataFrame([(k, k) for k in KINDS], "concept string, ancestor string")
    same = Pattern((Step("a", "k1"), Step("b", "k2")), (Relation("r", "after", "a", "b", 0, 0),), scope="within")
    assert {r.patient: r.status for r in shared.statuses(same, events, closure, windows).collect()} == {1: "exact", 2: "inconsistent"}
    assert ta.FOREVER > 30
