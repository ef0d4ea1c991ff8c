"""From patterns to DataFrame plans.

Each step becomes a filtered view of the events with its own column prefix; relations become joins on patient and time range.
Bounded relations join by time buckets, so a long history doesn't become one task or all its pairs, and where events last by buckets as long
as they; only unbounded ones join on the patient alone. Exact decisions over forests are semi-joins from the leaves to the root, possible ones carry the times that each event has
left (plans.forest): neither enumerates anything. Other patterns' bindings are joined on plausibility and decided jointly (plans.network).
Relaxed ones come from one join of the widest pattern, each binding priced by the cheapest set that admits it.

A step bound to the first or last event of its kind under uncertain times is one scenario for each event that can be it: the pattern is
exact if it is so in every scenario of a patient, possible if it is in some. Scenarios are closed forms as long as no other step can
bind the events in question; where one can, each scenario's order facts (the first starts no later than any other of them) join the binding's
network. Nth, counted and rising steps have no such facts: what is exact or ruled out with independent times is so, and what is left is unresolved.

Inputs: events (patient, event_id, kind, lo, hi, end_lo, end_hi, micro), windows (patient, w_start, w_end), the closure. Events without shared
time variables only; others go to operators.shared.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import timealg as ta
from trailmark.lineage import cut
from trailmark.operators import rises
from trailmark.operators.counts import narrowed
from trailmark.operators.derived import counted_uncertain, nth_envelope, risen, scenarios
from trailmark.operators.ranges import join_by_length, join_ranges, semi_join_range
from trailmark.plans import forest, network
from trailmark.plans.pattern import Pattern, Relation, Step
from trailmark.sources.model import Kinds

FIELDS = ("event_id", "lo", "hi", "end_lo", "end_hi", "kind")


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def of_pattern(pattern: Pattern, closure: DataFrame | Kinds) -> Kinds:
    return closure if isinstance(closure, Kinds) else Kinds(closure, set().union(*pattern.concepts().values()))


def meeting(step: Step) -> Column:
    """The step's condition on values."""
    out = F.lit(True)
    if step.at_least is not None:
        out = out & (F.col("micro") >= step.at_least)
    return out & (F.col("micro") < step.below) if step.below is not None else out


def selected(events: DataFrame, closure: DataFrame | Kinds, step: Step, concepts: set[str] | None = None, possible: bool = False) -> DataFrame:
    """The step's candidate events: of its concept, meeting its value condition; of a step bound to the first or last, one row for each event that can
    be it, as it is in the worlds in which it is; of an nth step, one row with the range of its start; of a counted one, the events that reach the count
    in all worlds, or, if possible, each with the times at which it can reach it; of a rising or falling one, the readings that do so in all worlds, or,
    if possible, each with the times at which it can."""
    wanted = concepts or {step.concept}
    kinds = closure if isinstance(closure, Kinds) else Kinds(closure, wanted)
    rows = kinds.of(events, wanted).filter(meeting(step))
    if step.nth:
        start = nth_envelope(rows, step.nth).select("patient", F.lit(None).cast("long").alias("event_id"), F.lit(step.concept).alias("kind"), F.col("nth_lo").alias("lo"), F.col("nth_hi").alias("hi"))
        return start.select("*", F.col("lo").alias("end_lo"), F.col("hi").alias("end_hi"), F.lit(None).cast("long").alias("micro"))
    if step.count:
        n, span = step.count
        return narrowed(rows, n, span) if possible else rows.join(counted_uncertain(rows, n, span).filter("certain"), ["patient", "event_id"], "left_semi")
    if step.rise:
        previous, within, num, den, floor = step.rise
        if rows.filter("lo < hi").limit(1).count():
            return rises.selected(rows, previous, within, (num, den), floor, step.falls, possible)
        return risen(rows, previous, within, (num, den), floor, step.falls).select(*rows.columns)
    return scenarios(rows, step.occurrence) if step.occurrence else rows


def named(rows: DataFrame, step: str, more: tuple[str, ...] = ()) -> DataFrame:
    return rows.select("patient", *(F.col(c).alias(f"{step}_{c}") for c in (*FIELDS, *more)))


def scope_bounds(scope: str, step: str) -> list[tuple[tuple[Column, Column], int]]:
    """Differences that must be at least zero."""
    start = (F.col(f"{step}_lo"), F.col(f"{step}_hi"))
    w_start, w_end = F.col("w_start"), F.col("w_end")
    from_start, to_end, past_end = ta.difference(w_start, w_start, *start), ta.difference(*start, w_end, w_end), ta.difference(w_end, w_end, *start)
    return {"any": [], "from_start": [(from_start, 0)], "within": [(from_start, 0), (to_end, 0)], "after": [(past_end, 0)]}[scope]


def relation_bounds(r: Relation) -> list[tuple[tuple[Column, Column], int | None, int | None]]:
    """The relation's constraints as (bounds of y - x, lo, hi). Both steps may have one event."""
    a, b = r.source, r.target
    same = F.col(f"{a}_event_id") == F.col(f"{b}_event_id")
    starts = ta.difference(F.col(f"{a}_lo"), F.col(f"{a}_hi"), F.col(f"{b}_lo"), F.col(f"{b}_hi"), same)
    if r.kind == "after":
        return [(starts, r.least, r.most)]
    from_end = ta.difference(F.col(f"{a}_end_lo"), F.col(f"{a}_end_hi"), F.col(f"{b}_lo"), F.col(f"{b}_hi"))
    own = (F.col(f"{a}_lo") - F.col(f"{a}_end_hi"), F.least(F.lit(0), F.col(f"{a}_hi") - F.col(f"{a}_end_lo")))
    from_end = tuple(F.when(same, x).otherwise(y) for x, y in zip(own, from_end, strict=True))
    return [(starts, 0, None), (from_end, None, r.grace)]


def holds(r: Relation, test) -> Column:
    return both([test(b, lo, hi) for b, lo, hi in relation_bounds(r)])


def in_scope(pattern: Pattern, step: str, test) -> Column:
    return both([test(b, lo, None) for b, lo in scope_bounds(pattern.scope, step)])


def reach(r: Relation, step: str, other: str) -> tuple[Column, Column] | None:
    """The range of other's start that the relation leaves plausible, from step's; None if it is unbounded."""
    lo, hi, end = F.col(f"{step}_lo"), F.col(f"{step}_hi"), F.col(f"{step}_end_hi")
    if r.kind == "after" and None not in (r.least, r.most):
        return (lo + r.least, hi + r.most) if step == r.source else (lo - r.most, hi - r.least)
    if r.kind == "during" and step == r.source:
        return lo, F.least(end, F.lit(ta.FOREVER)) + r.grace
    return None


def width_of(r: Relation) -> int:
    return max(ta.UNITS["hour"], (r.most or 0) - (r.least or 0) if r.kind == "after" else ta.UNITS["day"] + r.grace)


def joined(left: DataFrame, right: DataFrame, r: Relation, step: str, other: str) -> DataFrame:
    """left (which has step) joined with right (step `other`) on the patient and the relation's reach."""
    span, times = reach(r, step, other), (F.col(f"{other}_lo"), F.col(f"{other}_hi"))
    if span is None:
        return left.join(right, "patient")
    if r.kind == "after":
        return join_ranges(left, right, ["patient"], span, times, width_of(r))
    # all that begins after an ongoing event is its partner: no list of buckets is needed to find it
    ongoing = F.col(f"{step}_end_hi") >= ta.FOREVER
    near = join_by_length(left.filter(~ongoing), right, ["patient"], span, times, width_of(r))
    return near.unionByName(left.filter(ongoing).join(right, "patient").filter(times[1] >= span[0]))


def supported(left: DataFrame, right: DataFrame, r: Relation, step: str, other: str, keys: tuple[str, ...] = ("patient",)) -> DataFrame:
    """The rows of left (which has step) that some row of right (step `other`) with equal keys meets the relation with, for certain."""
    keys = list(keys)
    names = {f"{s}_{c}": F.col(f"{s}_{c}") for s in (step, other) for c in FIELDS}
    own, its = (lambda c: names[f"{step}_{c}"]), (lambda c: names[f"{other}_{c}"])
    if r.kind == "after" and None not in (r.least, r.most):
        same = 0 if r.least <= 0 <= r.most else None  # an event that both steps have is its own partner, whatever its range
        span = (its("hi") - r.most, its("lo") - r.least) if step == r.source else (its("hi") + r.least, its("lo") + r.most)
        point = own("hi") if step == r.source else own("lo")
        if same is not None:
            span = (F.least(span[0], its("hi" if step == r.source else "lo")), F.greatest(span[1], its("hi" if step == r.source else "lo")))
        return semi_join_range(left, right, keys, point, span, width_of(r), holds(r, ta.certain))
    if r.kind == "during" and step == r.target:  # each left row begins within the other's range
        ongoing = its("end_lo") >= ta.FOREVER
        near = semi_join_range(left, right.filter(~ongoing), keys, own("lo"), (its("lo"), its("end_lo") + r.grace), width_of(r), holds(r, ta.certain))
        begun = right.filter(ongoing).groupBy(*keys).agg(F.min(its("hi")).alias("_begun"))  # it covers whatever begins later
        far = left.join(begun, keys).filter(own("lo") >= F.col("_begun")).drop("_begun")
        return near.unionByName(far).dropDuplicates([*keys, f"{step}_event_id"])
    right = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(right, both([F.col(k) == F.col(f"_r_{k}") for k in keys]) & holds(r, ta.certain), "left_semi")


@dataclass(frozen=True)
class Facts:
    """What the steps of a pattern that rest on all events of their kind leave to decide jointly."""

    ordered: tuple[Step, ...] = ()  #: steps bound to a first or last event
    met: tuple[tuple[str, str], ...] = ()  #: an ordered step and another one that can bind events of its kind
    doubtful: bool = False  #: another step can bind the events of an nth, counted or rising step

    def __bool__(self) -> bool:
        return bool(self.met)


def facts_of(pattern: Pattern, kinds: Kinds) -> Facts:
    concepts, met, doubtful = pattern.concepts(), [], False
    for s in pattern.steps:
        if not (s.occurrence or s.nth or s.count or s.rise):
            continue
        if len(concepts[s.id]) > 1:
            raise ValueError(f"{s.id} rests on all events of its concept and can't be widened")
        others = [o.id for o in pattern.steps if o.id != s.id and kinds.meet(concepts[s.id], concepts[o.id])]
        if s.occurrence:
            met += [(s.id, o) for o in others]
        else:
            doubtful |= bool(others)
    return Facts(tuple(s for s in pattern.steps if s.occurrence), tuple(met), doubtful)


def order_facts(pattern: Pattern, facts: Facts) -> list[network.Edge]:
    """The first of a kind starts no later, the last no earlier, than any event of the kind that another step binds; and the first of one kind no later than
    the last of another where some event is of both."""
    at, out = network.place(pattern), []
    for s, o in facts.met:
        if s in at and o in at:
            one, other = (at[s], at[o]) if pattern.names[s].occurrence == "first" else (at[o], at[s])
            out.append((one, other, network.if_so(F.col(f"{o}_in_{s}"))))
            if pattern.names[s].occurrence == "first" and pattern.names[o].occurrence == "last":
                out.append((at[s], at[o], network.if_so(F.col(f"{s}_meets_{o}"))))
    return out


def sides(pattern: Pattern, events: DataFrame, closure: DataFrame | Kinds, windows: DataFrame, test, concepts: dict[str, set[str]] | None = None, facts: Facts | None = None) -> dict[str, DataFrame]:
    kinds, out, met = of_pattern(pattern, closure), {}, facts.met if facts else ()
    for s in pattern.steps:
        rows, more = selected(events, kinds, s, concepts and concepts[s.id], test is ta.plausible), []
        for one in (pattern.names[x] for x, other in met if other == s.id and x in pattern.names):
            more.append(f"in_{one.id}")  # an nth event is no particular one
            rows = kinds.marked(rows, {one.concept}, more[-1]).withColumn(more[-1], F.col(more[-1]) & F.coalesce(meeting(one), F.lit(False)) & F.col("event_id").isNotNull())
        for other in (pattern.names[x] for one, x in met if one == s.id and x in pattern.names and s.occurrence == "first" and pattern.names[x].occurrence == "last"):
            more.append(f"meets_{other.id}")
            shared = kinds.marked(selected(events, kinds, replace(s, occurrence=None)), {other.concept}, "_of_both").filter(F.col("_of_both") & meeting(other))
            rows = rows.join(shared.select("patient").distinct().withColumn(more[-1], F.lit(True)), "patient", "left").withColumn(more[-1], F.coalesce(more[-1], F.lit(False)))
        rows = named(rows, s.id, tuple(more))
        if pattern.scope != "any":
            rows = rows.join(windows.filter("w_start IS NOT NULL"), "patient").filter(in_scope(pattern, s.id, test))
            rows = rows.withColumn(f"{s.id}_inside", in_scope(pattern, s.id, ta.certain)).drop("w_start", "w_end")
        out[s.id] = rows
    return out


def bindings(pattern: Pattern, events: DataFrame, closure: DataFrame | Kinds, windows: DataFrame, test=ta.plausible, concepts=None, facts: Facts | None = None) -> DataFrame:
    """All bindings whose relations and scope each pass the test: patient and every step's columns."""
    return bound(pattern, sides(pattern, events, closure, windows, test, concepts, facts), lambda r: holds(r, test))


def bound(pattern: Pattern, views: dict[str, DataFrame], holding) -> DataFrame:
    """The bindings of the views for which holding(relation) is true of each relation."""
    done, out = set(), None
    for step, by in pattern.order():
        if out is None:
            out = views[step.id]
        elif by is None:
            out = out.join(views[step.id], "patient")
        else:
            other = by.source if by.target == step.id else by.target
            out = joined(out, views[step.id], by, other, step.id)
        seen = {*done, step.id}
        out = out.filter(both([holding(r) for r in pattern.relations if step.id in (r.source, r.target) and {r.source, r.target} <= seen]))
        done = seen
    return out


def with_windows(pattern: Pattern, found: DataFrame, windows: DataFrame) -> DataFrame:
    return found if pattern.scope == "any" else found.join(windows.select("patient", "w_start", "w_end"), "patient")


def jointly(pattern: Pattern) -> Column:
    """Whether a binding's constraints hold together in some world."""
    return network.feasible(pattern)


def in_all_scenarios(pattern: Pattern, facts: Facts, found: DataFrame, events: DataFrame, kinds: Kinds, windows: DataFrame, by: list[str]) -> DataFrame:
    """patient and by: where found (bindings that are certain in their scenario) has every scenario of the patient."""
    ids = [F.col(f"{s.id}_event_id") for s in facts.ordered]
    met = found.groupBy("patient", *by).agg(F.count_distinct(*ids).alias("_met"))
    if facts:  # scenarios of steps that share a kind can rule each other out
        only = Pattern(facts.ordered, scope="any")
        every = bindings(only, events, kinds, windows, ta.plausible, facts=facts).filter(network.feasible(only, order_facts(only, facts)))
        total = every.groupBy("patient").agg(F.count("*").alias("_every"))
        return met.join(total, "patient").filter("_met = _every").select("patient", *by)
    total = None
    for s in facts.ordered:
        n = selected(events, kinds, s).groupBy("patient").agg(F.count("*").alias(f"_n_{s.id}"))
        total = n if total is None else total.join(n, "patient")
    every = reduce(lambda a, b: a * b, [F.col(f"_n_{s.id}") for s in facts.ordered])
    return met.join(total, "patient").filter(F.col("_met") == every).select("patient", *by)


def exact_patients(pattern: Pattern, events: DataFrame, closure: DataFrame | Kinds, windows: DataFrame) -> DataFrame:
    """Patients with a binding that holds in all worlds; with first or last steps, with one for every event that can be it. Forests without such
    steps need semi-joins only: a step keeps the events that some event of each child supports."""
    kinds = of_pattern(pattern, closure)
    facts = facts_of(pattern, kinds)
    if facts:
        found = with_windows(pattern, bindings(pattern, events, kinds, windows, ta.plausible, facts=facts), windows)
        return in_all_scenarios(pattern, facts, found.filter(network.certain(pattern, order_facts(pattern, facts))), events, kinds, windows, [])
    if facts.ordered:
        return in_all_scenarios(pattern, facts, bindings(pattern, events, kinds, windows, ta.certain), events, kinds, windows, [])
    if not pattern.is_forest():
        if step := separator(pattern):
            return exact_by_separator(pattern, step, sides(pattern, events, kinds, windows, ta.certain))
        return bindings(pattern, events, kinds, windows, ta.certain).select("patient").distinct()
    views, tops = sides(pattern, events, kinds, windows, ta.certain), None
    for step, by in reversed(pattern.order()):
        rows = views[step.id]
        if by is None:
            own = rows.select("patient").distinct()
            tops = own if tops is None else tops.join(own, "patient", "left_semi")
            continue
        other = by.source if by.target == step.id else by.target
        views[other] = supported(views[other], rows, by, other, step.id)
    return tops


def without(pattern: Pattern, step: str) -> Pattern:
    return Pattern(tuple(s for s in pattern.steps if s.id != step), tuple(r for r in pattern.relations if step not in (r.source, r.target)), scope=pattern.scope)


def separator(pattern: Pattern) -> str | None:
    """A step without which the pattern is a forest, of those the one with the most relations."""
    found = [s.id for s in pattern.steps if len(pattern.steps) > 1 and without(pattern, s.id).is_forest()]
    return max(found, key=lambda i: sum(i in (r.source, r.target) for r in pattern.relations), default=None)


def exact_by_separator(pattern: Pattern, step: str, views: dict[str, DataFrame]) -> DataFrame:
    """Patients with a certain binding of a cycle: what is left of the pattern without the step is a forest, which is decided for each of the step's events at
    once. Steps related to it are listed once for each of its events that they fit; from there on all joins are semi-joins on patient and event."""
    keys = ("patient", "_separator")
    own = views[step]
    touching = {s.id: [r for r in pattern.relations if {r.source, r.target} == {s.id, step}] for s in pattern.steps if s.id != step}
    for other, by in touching.items():
        for r in by:  # first what of it has no partner at all goes
            own = supported(own, views[other], r, step, other)
    own = cut(own.withColumn("_separator", F.col(f"{step}_event_id")))  # every step related to it reads it
    left = {}
    for other, by in touching.items():
        if by:
            met = joined(own, views[other], by[0], step, other).filter(both([holds(r, ta.certain) for r in by]))
            left[other] = met.drop(*(c for c in own.columns if c not in keys))
        else:
            left[other] = views[other]
    rest, tops = without(pattern, step), own.select(*keys).distinct()
    for s, by in reversed(rest.order()):
        rows, keyed = left[s.id], "_separator" in left[s.id].columns
        if by is None:
            on = keys if keyed else ("patient",)
            tops = tops.join(rows.select(*on).distinct(), list(on), "left_semi")
            continue
        other = by.source if by.target == s.id else by.target
        if not keyed or "_separator" in left[other].columns:
            left[other] = supported(left[other], rows, by, other, s.id, keys if keyed else ("patient",))
        else:  # the other isn't related to the separator itself: it is listed for the events that its partners fit
            met = joined(rows, left[other], by, s.id, other).filter(holds(by, ta.certain))
            left[other] = met.select("_separator", *left[other].columns).dropDuplicates(["_separator", "patient", f"{other}_event_id"])
    return tops.select("patient").distinct()


def independent(pattern: Pattern, kinds: Kinds) -> bool:
    """Whether no two steps can bind one event but those of one relation."""
    concepts, related = pattern.concepts(), {frozenset((r.source, r.target)) for r in pattern.relations}
    ids = [s.id for s in pattern.steps]
    return not any(kinds.meet(concepts[a], concepts[b]) for k, a in enumerate(ids) for b in ids[:k] if frozenset((a, b)) not in related)


def possible_patients(pattern: Pattern, events: DataFrame, closure: DataFrame | Kinds, windows: DataFrame) -> DataFrame:
    """Patients with a binding that holds in some world. Where another step can bind the events of an nth, counted or rising step, some of them may have none:
    statuses() calls them unresolved."""
    kinds = of_pattern(pattern, closure)
    facts = facts_of(pattern, kinds)
    if not facts and pattern.is_forest() and independent(pattern, kinds):
        views = {s.id: forest.timed(selected(events, kinds, s, None, True), windows, pattern.scope) for s in pattern.steps}
        concepts = pattern.concepts()
        return forest.possible(pattern, views, lambda a, b: kinds.meet(concepts[a], concepts[b]), {r.id: width_of(r) for r in pattern.relations})
    if not facts.ordered and not any(s.nth or s.count or s.rise for s in pattern.steps):  # such steps rest on events that a patient must keep
        events = events.join(hulls(pattern, events, kinds, windows).filter("NOT refuted").select("patient"), "patient", "left_semi")
    found = with_windows(pattern, bindings(pattern, events, kinds, windows, ta.plausible, facts=facts), windows)
    return found.filter(network.feasible(pattern, order_facts(pattern, facts))).select("patient").distinct()


def hulls(pattern: Pattern, events: DataFrame, closure: DataFrame | Kinds, windows: DataFrame) -> DataFrame:
    """patient and refuted, one row for each patient of windows: whether the hull of each step's candidates, all of them together as one event, already rules the
    pattern out, or a step has none. One aggregation of the events; what it refutes needs no binding."""
    kinds = of_pattern(pattern, closure)
    rows, parts = events, []
    for s in pattern.steps:
        rows = kinds.marked(rows, {s.concept}, f"_is_{s.id}")
        own = F.col(f"_is_{s.id}") & F.coalesce(meeting(s), F.lit(False))
        parts += [f(F.when(own, F.col(c))).alias(f"{s.id}_{c}") for c, f in (("lo", F.min), ("hi", F.max), ("end_lo", F.min), ("end_hi", F.max))]
    found = windows.join(rows.groupBy("patient").agg(*parts), "patient", "left")
    lows, highs = network.scoped(pattern, *network.ranges(pattern))
    order = [(2 * k, 2 * k + 1, 0) for k in range(len(pattern.steps))]
    there = both([F.col(f"{s.id}_lo").isNotNull() for s in pattern.steps] + ([F.col("w_start").isNotNull()] if pattern.scope != "any" else []))
    return found.select("patient", F.when(there, ~ta.feasible(F.array(*lows), F.array(*highs), order + network.demands(pattern))).otherwise(True).alias("refuted"))


def witnesses(pattern: Pattern, events: DataFrame, closure: DataFrame | Kinds, windows: DataFrame) -> DataFrame:
    """patient, {step}_event_id, {step}_at and replayed: of each patient with a possible match the binding with the least event ids, the earliest times at
    which all of it holds, and whether these, set into the ranges, the events' own order, the relations and the scope one by one, meet every one of
    them. Bindings are reduced where they are made; steps bound to a first, nth, counted or rising event are refused."""
    if derived := [s.id for s in pattern.steps if s.occurrence or s.nth or s.count or s.rise]:
        raise ValueError(f"steps {derived} rest on other events than those bound")
    found = with_windows(pattern, bindings(pattern, events, closure, windows), windows).filter(network.feasible(pattern))
    lows, highs = network.scoped(pattern, *network.ranges(pattern))
    edges = network.structure(pattern) + network.demands(pattern)
    at = found.withColumns({"_lows": F.array(*lows), "_highs": F.array(*highs)}).withColumn("_at", ta.earliest(F.col("_lows"), edges))
    kept = [F.col("_at")[j] - F.col("_at")[i] >= w for i, j, w in edges]
    inside = F.forall(F.zip_with("_at", "_lows", lambda t, x: t >= x), lambda ok: ok) & F.forall(F.zip_with("_at", "_highs", lambda t, x: t <= x), lambda ok: ok)
    ids = [F.col(f"{s.id}_event_id") for s in pattern.steps]
    times = [F.col("_at")[2 * k].alias(f"{s.id}_at") for k, s in enumerate(pattern.steps)]
    best = at.select("patient", F.struct(*ids, *times, (both(kept) & inside).alias("replayed")).alias("b")).groupBy("patient").agg(F.min("b").alias("b"))
    return best.select("patient", "b.*")


def widest(pattern: Pattern) -> Pattern:
    """The pattern with each relation as wide as some affordable set makes it."""
    sets, relations = list(pattern.sets()), []
    for r in pattern.relations:
        values = [x for s in sets for x in s if x.target == r.id]
        most = max([r.most, *(int(x.value) for x in values if x.kind == "raise_max")]) if r.most is not None else None
        relations.append(Relation(r.id, r.kind, r.source, r.target, r.least, most, max([r.grace, *(int(x.value) for x in values if x.kind == "raise_grace")])))
    return Pattern(pattern.steps, tuple(relations), (), scope=pattern.scope)


def fits(found: DataFrame, pattern: Pattern, kinds: Kinds) -> tuple[DataFrame, list[Column]]:
    """found with marks, and for each affordable set, in their order, whether a binding is of its concepts."""
    out = []
    for chosen in pattern.sets():
        own, test = pattern.relaxed(chosen), F.lit(True)
        for s in own.steps:
            if len(pattern.concepts()[s.id]) > 1:
                mark = f"_{s.id}_{s.concept}"
                found = found if mark in found.columns else kinds.marked(found, {s.concept}, mark, f"{s.id}_kind")
                test = test & F.col(mark)
        out.append(test)
    return found, out


def priced(pattern: Pattern, spark) -> DataFrame:
    """k, cost, size and relaxations of each affordable set, in their order; the empty set is the first."""
    rows = [(k, sum(x.cost for x in s), len(s), ",".join(sorted(x.id for x in s))) for k, s in enumerate(pattern.sets()) if s]
    return spark.createDataFrame(rows or [(-1, None, 0, "")], "k int, cost decimal(18,6), size int, relaxations string")


def relaxed_patients(pattern: Pattern, events: DataFrame, closure: DataFrame | Kinds, windows: DataFrame) -> DataFrame:
    """patient, cost, size and relaxations (ids, comma-joined) of the cheapest set that admits some binding for certain. The widest pattern is bound
    once; a binding then meets the sets in their order."""
    kinds = of_pattern(pattern, closure)
    facts, wide = facts_of(pattern, kinds), widest(pattern)
    found = bindings(wide, events, kinds, windows, ta.plausible if facts else ta.certain, pattern.concepts(), facts)
    found, of_sets = fits(with_windows(pattern, found, windows) if facts else found, pattern, kinds)
    patterns = [pattern.relaxed(chosen) for chosen in pattern.sets()]
    own = (lambda p: network.certain(p, order_facts(p, facts))) if facts else (lambda p: both([holds(r, ta.certain) for r in p.relations]))
    ways = [F.when(fit & own(p), F.lit(k)) for k, (fit, p) in enumerate(zip(of_sets, patterns, strict=True)) if k]
    none = F.lit(None).cast("int")
    if facts.ordered:
        each = found.withColumn("k", F.explode(F.filter(F.array(none, *ways), lambda k: k.isNotNull())))
        met = in_all_scenarios(pattern, facts, each, events, kinds, windows, ["k"])
    else:
        met = found.select("patient", F.coalesce(*ways, none).alias("k")).filter("k IS NOT NULL")
    return met.groupBy("patient").agg(F.min("k").alias("k")).join(F.broadcast(priced(pattern, events.sparkSession)), "k").drop("k")  # as many rows as sets


def decided_at_once(pattern: Pattern, events: DataFrame, kinds: Kinds, windows: DataFrame) -> DataFrame:
    """patient, _exact, _possible, cost, size and relaxations from one pass over the bindings of the widest pattern."""
    found = with_windows(pattern, bindings(widest(pattern), events, kinds, windows, ta.plausible, pattern.concepts()), windows)
    found, of_sets = fits(found, pattern, kinds)
    inside = both([F.col(f"{s.id}_inside") for s in pattern.steps]) if pattern.scope != "any" else F.lit(True)
    sure = [fit & inside & both([holds(r, ta.certain) for r in p.relations]) for fit, p in zip(of_sets, map(pattern.relaxed, pattern.sets()), strict=True)]
    may = of_sets[0] & both([holds(r, ta.plausible) for r in pattern.relations])
    cheapest = F.coalesce(*(F.when(s, F.lit(k)) for k, s in enumerate(sure)))
    marked = found.select("patient", cheapest.alias("k"), F.when(may, F.when(sure[0], True).otherwise(network.feasible(pattern))).alias("may"))
    best = marked.groupBy("patient").agg(F.min("k").alias("k"), F.bool_or("may").alias("_possible"))
    return best.join(F.broadcast(priced(pattern, events.sparkSession)), "k", "left").withColumn("_exact", F.col("k") == 0).drop("k")


def statuses(pattern: Pattern, events: DataFrame, closure: DataFrame | Kinds, windows: DataFrame) -> DataFrame:
    """patient, status (excluded, exact, possible, unresolved, relaxed or none), cost and relaxations, one row for each patient of windows."""
    kinds = of_pattern(pattern, closure)
    facts = facts_of(pattern, kinds)
    flag = lambda df, name: df.select("patient", F.lit(True).alias(name))
    if any(True for s in pattern.sets() if s) and not facts.ordered and not facts.doubtful and not any(s.count or s.rise for s in pattern.steps):
        out = windows.join(decided_at_once(pattern, events, kinds, windows), "patient", "left")
    else:
        out = windows.join(flag(exact_patients(pattern, events, kinds, windows), "_exact"), "patient", "left").join(flag(possible_patients(pattern, events, kinds, windows), "_possible"), "patient", "left")
        if any(True for s in pattern.sets() if s):
            out = out.join(relaxed_patients(pattern, events, kinds, windows), "patient", "left")
        else:
            out = out.withColumns({"cost": F.lit(None).cast("decimal(18,6)"), "relaxations": F.lit(None).cast("string")})
    status = F.when(F.col("w_start").isNull(), "excluded").when(F.col("_exact"), "exact").when(F.col("_possible"), "unresolved" if facts.doubtful else "possible").when(F.col("relaxations").isNotNull(), "relaxed").otherwise("none")
    only = lambda c: F.when(F.col("status") == "relaxed", F.col(c)).alias(c)
    return out.withColumn("status", status).select("patient", "status", only("cost"), only("relaxations"))


def candidates(pattern: Pattern, postings: DataFrame) -> DataFrame:
    """Patients with a posting for every step: the union over the step's concepts, intersected with the rest, rarest first."""
    sizes = {r[0]: r[1] for r in postings.groupBy("concept").count().filter(F.col("concept").isin(sorted(set().union(*pattern.concepts().values())))).collect()}  # as many rows as the pattern has concepts
    steps = sorted(pattern.concepts().values(), key=lambda cs: sum(sizes.get(c, 0) for c in cs))
    out = None
    for cs in steps:
        own = postings.filter(F.col("concept").isin(sorted(cs))).select("patient").distinct()
        out = own if out is None else out.join(own, "patient", "left_semi")
    return out


def time_pruned(pattern: Pattern, postings: DataFrame, windows: DataFrame) -> DataFrame:
    """Patients whose postings' time summaries leave every `after` relation and the scope open. Postings: patient, concept, min_lo, max_hi, max_end."""
    out = windows.filter("w_start IS NOT NULL") if pattern.scope != "any" else windows
    for s in pattern.steps:
        own = postings.filter(F.col("concept").isin(sorted(pattern.concepts()[s.id]))).groupBy("patient").agg(F.min("min_lo").alias(f"{s.id}_lo"), F.max("max_hi").alias(f"{s.id}_hi"))
        out = out.join(own, "patient").filter(in_scope(pattern, s.id, ta.plausible))
    highest = {r.id: max([r.most or 0, *(int(x.value) for x in pattern.relaxations if x.target == r.id and x.kind == "raise_max")]) for r in pattern.relations}
    for r in (r for r in pattern.relations if r.kind == "after"):
        bounds = ta.difference(F.col(f"{r.source}_lo"), F.col(f"{r.source}_hi"), F.col(f"{r.target}_lo"), F.col(f"{r.target}_hi"))
        out = out.filter(ta.plausible(bounds, r.least, highest[r.id] if r.most is not None else None))
    return out.select("patient")



def split_by_first(firsts: DataFrame, seconds: DataFrame, least: int, most: int) -> DataFrame:
    """patient and status (exact, possible, none) of "the first of these, then one of those least to most later", for disjoint uncertain point
    events: one scenario for each event that can be first, in which it starts no later than any other's latest start. Exact
    if every scenario has a certain partner, possible if some has a plausible one."""
    two = firsts.groupBy("patient").agg(F.min(F.struct("hi", "event_id")).alias("one"), F.min("hi").alias("_least"))
    other = firsts.join(two.select("patient", F.col("one.event_id").alias("_holder")), "patient").filter("event_id <> _holder").groupBy("patient").agg(F.min("hi").alias("_next"))
    scenarios = firsts.join(two, "patient").join(other, "patient", "left").withColumn("_others", F.when(F.col("event_id") == F.col("one.event_id"), F.col("_next")).otherwise(F.col("_least")))
    scenarios = scenarios.filter("_others IS NULL OR lo <= _others").select("patient", F.col("event_id").alias("a_event_id"), F.col("lo").alias("a_lo"), F.coalesce(F.least("hi", "_others"), "hi").alias("a_hi"))
    second = seconds.select("patient", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    met = join_ranges(scenarios, second, ["patient"], (F.col("a_lo") + least, F.col("a_hi") + most), (F.col("b_lo"), F.col("b_hi")), max(most - least, ta.UNITS["hour"]))
    bounds = ta.difference(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"))
    judged = met.groupBy("patient", "a_event_id").agg(F.bool_or(ta.certain(bounds, least, most)).alias("sure"), F.bool_or(ta.plausible(bounds, least, most)).alias("may"))
    every = scenarios.join(judged, ["patient", "a_event_id"], "left").groupBy("patient").agg(F.bool_and(F.coalesce("sure", F.lit(False))).alias("sure"), F.bool_or(F.coalesce("may", F.lit(False))).alias("may"))
    return every.select("patient", F.when(F.col("sure"), "exact").when(F.col("may"), "possible").otherwise("none").alias("status"))
