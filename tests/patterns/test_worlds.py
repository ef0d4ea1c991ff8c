"""Statuses against an enumeration of all worlds: every choice of every time, on small grids."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from trailmark.functions import timealg as ta
from trailmark.plans import compile as plans
from trailmark.plans.pattern import Pattern, Relation, Step

KINDS = ["k1", "k2", "k3"]
SCHEMA = "patient long, event_id long, kind string, lo long, hi long, end_lo long, end_hi long, micro long, start_var string, end_var string"


def history(r, points, shared):
    out = []
    names: dict[str, tuple[int, int]] = {}
    for i in range(r.randint(1, 4)):
        lo = r.randint(0, 4)
        hi = lo + r.randint(0, 2)
        var = None
        if shared and r.random() < 0.6:
            var = r.choice("xy")
            lo, hi = names.setdefault(var, (lo, hi))
        end = (lo, hi) if points else (r.randint(lo, hi + 1), hi + r.randint(0, 2))
        end = (min(end), max(end))
        out.append({"event_id": i, "kind": r.choice(KINDS), "lo": lo, "hi": hi, "end_lo": end[0], "end_hi": end[1], "micro": 0, "start_var": var, "end_var": None})
    return out


def worlds(events):
    names = sorted({e["start_var"] for e in events if e["start_var"]})
    ranges = [range(next(e for e in events if e["start_var"] == n)["lo"], next(e for e in events if e["start_var"] == n)["hi"] + 1) for n in names]
    own = [e for e in events if not e["start_var"]]
    for values in itertools.product(*ranges, *(range(e["lo"], e["hi"] + 1) for e in own)):
        by_name = dict(zip(names, values, strict=False))
        by_id = {e["event_id"]: v for e, v in zip(own, values[len(names) :], strict=True)}
        starts = [by_name[e["start_var"]] if e["start_var"] else by_id[e["event_id"]] for e in events]
        points = [e["end_lo"] == e["lo"] and e["end_hi"] == e["hi"] for e in events]
        ends = [[s] if p else range(max(e["end_lo"], s), e["end_hi"] + 1) for e, s, p in zip(events, starts, points, strict=True)]
        for chosen in itertools.product(*ends):
            yield list(zip(starts, chosen, strict=True))


def brute(pattern, events, window):
    if window is None:
        return "excluded"
    domains = [[i for i, e in enumerate(events) if e["kind"] == s.concept] for s in pattern.steps]
    at = {s.id: k for k, s in enumerate(pattern.steps)}
    every, some = {}, False
    for w in worlds(events):
        for b in itertools.product(*domains):
            ok = True
            for r in pattern.relations:
                (s1, e1), (s2, _) = w[b[at[r.source]]], w[b[at[r.target]]]
                ok &= (r.least is None or s2 - s1 >= r.least) and (r.most is None or s2 - s1 <= r.most) if r.kind == "after" else s2 >= s1 and s2 - e1 <= r.grace
            for x in b:
                ok &= {"any": True, "from_start": w[x][0] >= window[0], "within": window[0] <= w[x][0] <= window[1], "after": w[x][0] >= window[1]}[pattern.scope]
            every[b] = every.get(b, True) and ok
            some |= ok
    return "exact" if any(every.values()) else "possible" if some else "none"


def patterns(r):
    steps = tuple(Step(n, r.choice(KINDS)) for n in "abc"[: r.randint(1, 3)])
    relations = []
    for k, (x, y) in enumerate(itertools.combinations([s.id for s in steps], 2)):
        if r.random() < 0.75:
            if r.random() < 0.5:
                x, y = y, x
            least = r.choice([None, -1, 0, 1])
            relations.append(Relation(f"r{k}", "during", x, y, grace=r.randint(0, 1)) if r.random() < 0.3 else Relation(f"r{k}", "after", x, y, least, r.choice([None, (least or 0) + r.randint(0, 2)])))
    return Pattern(steps, tuple(relations), scope=r.choice(["any", "from_start", "within", "after"]))


@pytest.mark.parametrize("seed", range(8))
def test_closed_forms_against_worlds(spark, seed):
    r = random.Random(seed)
    pattern = patterns(r)
    cases = {p: (history(r, seed % 2 == 0, False), None if p % 7 == 0 else (1, 3)) for p in range(40)}
    events = spark.createDataFrame([(p, 100 * p + e["event_id"], e["kind"], e["lo"], e["hi"], e["end_lo"], e["end_hi"], 0, None, None) for p, (h, _) in cases.items() for e in h], SCHEMA)
    windows = spark.createDataFrame([(p, *(w or (None, None))) for p, (_, w) in cases.items()], "patient long, w_start long, w_end long")
    closure = spark.createDataFrame([(k, k) for k in KINDS], "concept string, ancestor string")
    got = {row.patient: row.status for row in plans.statuses(pattern, events, closure, windows).collect()}
    assert got == {p: brute(pattern, h, w) for p, (h, w) in cases.items()}, pattern


@pytest.mark.parametrize("seed", range(5))
def test_forests_of_steps_with_own_events_against_worlds(spark, seed):
    """No two steps but related ones can bind one event: ranges are carried, no binding is made."""
    r = random.Random(300 + seed)
    kinds = ["k1", "k2", "k3"] if seed % 2 else ["k1", "k1", "k2"]
    steps = tuple(Step(n, k) for n, k in zip("abc", kinds, strict=True))
    relations = []
    for k, (x, y) in enumerate([("a", "b"), ("b", "c")] if seed % 2 == 0 or r.random() < 0.6 else [("a", "b"), ("a", "c")]):
        x, y = (y, x) if r.random() < 0.5 else (x, y)
        least = r.choice([None, -1, 0, 1])
        relations.append(Relation(f"r{k}", "during", x, y, grace=r.randint(0, 1)) if r.random() < 0.4 else Relation(f"r{k}", "after", x, y, least, r.choice([None, (least or 0) + r.randint(0, 2)])))
    pattern = Pattern(steps, tuple(relations), scope=r.choice(["any", "any", "from_start", "within"]))
    cases = {p: (history(r, seed % 3 == 0, False), (1, 3)) for p in range(80)}
    events = spark.createDataFrame([(p, 100 * p + e["event_id"], e["kind"], e["lo"], e["hi"], e["end_lo"], e["end_hi"], 0, None, None) for p, (h, _) in cases.items() for e in h], SCHEMA)
    windows = spark.createDataFrame([(p, *w) for p, (_, w) in cases.items()], "patient long, w_start long, w_end long")
    closure = spark.createDataFrame([(k, k) for k in KINDS], "concept string, ancestor string")
    assert plans.independent(pattern, plans.of_pattern(pattern, closure))
    got = {row.patient for row in plans.possible_patients(pattern, events, closure, windows).collect()}
    assert got == {p for p, (h, w) in cases.items() if brute(pattern, h, w) != "none"}, pattern


def brute_ordered(pattern, events, window):
    """Scenarios: for each choice of the events that ordered steps take, the worlds in which they are first (last); exact if each has one binding that
    holds in all its worlds, possible if some binding holds in some."""
    if window is None:
        return "excluded"
    at = {s.id: k for k, s in enumerate(pattern.steps)}
    domains = [[i for i, e in enumerate(events) if e["kind"] == s.concept] for s in pattern.steps]
    found: dict[tuple, dict[tuple, bool]] = {}
    some = False
    for w in worlds(events):
        picks = []
        for s, d in zip(pattern.steps, domains, strict=True):
            extreme = (min if s.occurrence == "first" else max)((w[x][0] for x in d), default=None)
            picks.append([x for x in d if w[x][0] == extreme] if s.occurrence else d)
        for b in itertools.product(*picks):
            target = tuple(x for x, s in zip(b, pattern.steps, strict=True) if s.occurrence)
            ok = True
            for r in pattern.relations:
                (s1, e1), (s2, _) = w[b[at[r.source]]], w[b[at[r.target]]]
                ok &= (r.least is None or s2 - s1 >= r.least) and (r.most is None or s2 - s1 <= r.most) if r.kind == "after" else s2 >= s1 and s2 - e1 <= r.grace
            for x in b:
                ok &= {"any": True, "from_start": w[x][0] >= window[0], "within": window[0] <= w[x][0] <= window[1], "after": w[x][0] >= window[1]}[pattern.scope]
            own = found.setdefault(target, {})
            own[b] = own.get(b, True) and ok
            some |= ok
    if not all(domains):
        return "none"
    return "exact" if found and all(any(own.values()) for own in found.values()) else "possible" if some else "none"


@pytest.mark.parametrize("seed", range(16))
def test_ordered_steps_against_worlds(spark, seed):
    """From seed 10 on, steps share kinds: another one can bind the events that a first or last step rests on."""
    r = random.Random(500 + seed)
    kinds = r.sample(KINDS, 3) if seed < 10 else [r.choice(KINDS[:2]) for _ in range(3)]
    steps = tuple(Step(n, k, occurrence=r.choice(["first", "last"]) if n == "a" or r.random() < 0.3 else None) for n, k in zip("abc"[: r.randint(1, 3)], kinds, strict=False))
    relations = []
    for k, (x, y) in enumerate(itertools.combinations([s.id for s in steps], 2)):
        x, y = (y, x) if r.random() < 0.5 else (x, y)
        least = r.choice([None, -1, 0, 1])
        relations.append(Relation(f"r{k}", "during", x, y, grace=r.randint(0, 1)) if r.random() < 0.3 else Relation(f"r{k}", "after", x, y, least, r.choice([None, (least or 0) + r.randint(0, 3)])))
    pattern = Pattern(steps, tuple(relations), scope=r.choice(["any", "any", "from_start", "within"]))
    cases = {p: (history(r, seed % 2 == 0, False), None if p % 9 == 0 else (1, 4)) for p in range(60)}
    events = spark.createDataFrame([(p, 100 * p + e["event_id"], e["kind"], e["lo"], e["hi"], e["end_lo"], e["end_hi"], 0, None, None) for p, (h, _) in cases.items() for e in h], SCHEMA)
    windows = spark.createDataFrame([(p, *(w or (None, None))) for p, (_, w) in cases.items()], "patient long, w_start long, w_end long")
    closure = spark.createDataFrame([(k, k) for k in KINDS], "concept string, ancestor string")
    got = {row.patient: row.status for row in plans.statuses(pattern, events, closure, windows).collect()}
    assert got == {p: brute_ordered(pattern, h, w) for p, (h, w) in cases.items()}, pattern


def test_first_of_two_uncertain_events(spark):
    rows = [(1, 1, "k1", 5, 9, 5, 9, 0, None, None), (1, 2, "k1", 6, 6, 6, 6, 0, None, None), (1, 3, "k2", 14, 14, 14, 14, 0, None, None)]
    events = spark.createDataFrame(rows, SCHEMA)
    windows, closure = spark.createDataFrame([(1, 0, 20)], "patient long, w_start long, w_end long"), spark.createDataFrame([(k, k) for k in KINDS], "concept string, ancestor string")
    pattern = lambda a, b: Pattern((Step("a", "k1", occurrence="first"), Step("b", "k2")), (Relation("r", "after", "a", "b", a, b),))
    assert plans.exact_patients(pattern(8, 9), events, closure, windows).count() == 1
    assert plans.possible_patients(pattern(5, 7), events, closure, windows).count() == 0
    both = Pattern((Step("a", "k1", occurrence="first"), Step("b", "k1")), (Relation("r", "after", "a", "b", 0, 4),))
    assert plans.exact_patients(both, events, closure, windows).count() == 1


def test_ongoing_events_are_not_listed_by_day(spark):
    rows = [(1, 1, "k1", 0, 0, 0, ta.FOREVER, 0, None, None), (1, 2, "k1", 50, 50, ta.FOREVER, ta.FOREVER, 0, None, None), (1, 3, "k2", 10**15, 10**15, 10**15, 10**15, 0, None, None), (2, 4, "k2", 5, 5, 5, 5, 0, None, None), (2, 5, "k1", 6, 6, ta.FOREVER, ta.FOREVER, 0, None, None)]
    events = spark.createDataFrame(rows, SCHEMA)
    windows, closure = spark.createDataFrame([(1, 0, 20), (2, 0, 20)], "patient long, w_start long, w_end long"), spark.createDataFrame([(k, k) for k in KINDS], "concept string, ancestor string")
    for steps in ((Step("a", "k1"), Step("b", "k2")), (Step("b", "k2"), Step("a", "k1"))):
        pattern = Pattern(steps, (Relation("r", "during", "a", "b", grace=3),))
        assert [r.patient for r in plans.exact_patients(pattern, events, closure, windows).collect()] == [1]
        assert [r.patient for r in plans.possible_patients(pattern, events, closure, windows).collect()] == [1]
        assert plans.bindings(pattern, events, closure, windows).count() == 2


@pytest.mark.parametrize("step", [Step("a", "k1", nth=2), Step("a", "k1", nth=-1), Step("a", "k1", count=(2, 1))])
def test_nth_and_counted_steps_against_worlds(spark, step):
    r = random.Random(str(step))
    pattern = Pattern((step, Step("b", "k2")), (Relation("r", "after", "a", "b", 0, 2),))
    cases = {p: history(r, True, False) for p in range(60)}
    events = spark.createDataFrame([(p, 100 * p + e["event_id"], e["kind"], e["lo"], e["hi"], e["lo"], e["hi"], 0, None, None) for p, h in cases.items() for e in h], SCHEMA)
    windows = spark.createDataFrame([(p, 0, 9) for p in cases], "patient long, w_start long, w_end long")
    closure = spark.createDataFrame([(k, k) for k in KINDS], "concept string, ancestor string")
    exact, possible = ({x.patient for x in f(pattern, events, closure, windows).collect()} for f in (plans.exact_patients, plans.possible_patients))
    for p, h in cases.items():
        own, other = ([i for i, e in enumerate(h) if e["kind"] == k] for k in ("k1", "k2"))
        every, some = {}, False
        for w in worlds(h):
            if step.nth:
                starts = sorted(w[i][0] for i in own)
                found = [("nth", starts[step.nth - 1 if step.nth > 0 else step.nth])] if len(starts) >= abs(step.nth) else []
            else:
                found = [(i, w[i][0]) for i in own if sum(w[i][0] - 1 <= w[j][0] <= w[i][0] for j in own) >= 2]
            holds = {(a, b) for a, s in found for b in other if 0 <= w[b][0] - s <= 2}
            some |= bool(holds)
            every = holds if every == {} and w is not None and not isinstance(every, set) else every & holds
        assert (p in exact, p in possible) == (bool(every), some), h


def test_allen_relations_are_one_of_thirteen(spark):
    rows = [(s, e, u, v) for s in range(4) for e in range(s, 4) for u in range(4) for v in range(u, 4)]
    found = spark.createDataFrame(rows, "s long, e long, u long, v long").select("*", ta.allen(*map(F.col, "seuv")).alias("x"), ta.allen(*map(F.col, "uvse")).alias("y")).collect()
    for row in found:
        assert (row.x is None) == (row.s == row.e or row.u == row.v)
        if row.x:
            pair = {row.x, row.y}
            assert pair == {"equals"} or any(pair == {a, b} for a, b in ta.INVERSES.items()), pair
            atoms = ta.atoms(row.x) if row.x != "equals" else ta.ATOMS["equals"]
            values = {"s": row.s, "e": row.e, "u": row.u, "v": row.v}
            assert all(values[a] - values[b] <= k for a, b, k in atoms)


@pytest.mark.parametrize("operator", [*ta.ATOMS, *ta.INVERSES, "gap", "minimum_overlap"])
def test_bounded_classes_against_worlds(spark, operator):
    r = random.Random(operator)
    bounds = {"gap": (0, 1), "minimum_overlap": (1, None)}.get(operator, (None, None))
    rows = []
    for i in range(60):
        ranges = [sorted((r.randint(0, 4), r.randint(0, 4))) for _ in range(4)]
        rows.append((i, *(x for p in ranges for x in p)))
    names = ["s_lo", "s_hi", "e_lo", "e_hi", "u_lo", "u_hi", "v_lo", "v_hi"]
    found = ta.atoms(operator, *bounds)
    col = lambda x: {k: F.col(f"{k}_{x}") for k in "seuv"}
    out = spark.createDataFrame(rows, "i long, " + ", ".join(f"{n} long" for n in names)).select("*", ta.classified(found, col("lo"), col("hi"), F.lit(True)).alias("status")).collect()
    for row in out:
        choices = [range(row[f"{k}_lo"], row[f"{k}_hi"] + 1) for k in "seuv"]
        whole = [dict(zip("seuv", c, strict=True)) for c in itertools.product(*choices)]
        proper = [w for w in whole if w["s"] < w["e"] and w["u"] < w["v"]]
        holds = [all(w[a] - w[b] <= k for a, b, k in found) for w in proper]
        if not any(holds):
            assert row.status == "IMPOSSIBLE"
        else:
            assert row.status in ("CERTAIN", "POSSIBLE") and (row.status != "CERTAIN" or all(holds))
