"""Patients whose events share time variables: a network of differences, kept as tables.

An event's start and end may name a variable of its patient; two times of one name are one instant, in all that is known of either. The
network of a patient is the ranges of its variables and their order: no event ends before it starts. Ranges are intersected by aggregation
and drawn tight along the order, round by round, until nothing moves. What is then known of two variables is the distance of
their ranges and, where these overlap, whether one is surely no later than the other; that order is closed by doubling over overlapping
variables only (all that lie between two such overlap both), so that a long chain of events stays pairs of near ones. Together they are
the network's shortest paths: a relation is certain if they say so, and a binding is possible if they and the pattern hold together.

Bindings are bucketed range joins like any other; each row decides itself (plans.network). No patient is ever one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import timealg as ta
from trailmark.lineage import cut
from trailmark.operators.store import shares_variables
from trailmark.plans import compile as plans
from trailmark.plans import network
from trailmark.plans.pattern import Pattern, Relation

NAMES = ("start_name", "end_name", "start_after", "end_after")


def with_names(events: DataFrame) -> DataFrame:
    """events with the names of their times: given ones, or own ones made from the event's id; a point has one time."""
    own = lambda var, tag: F.coalesce(F.concat(F.lit("v:"), F.col(var).cast("string")), F.concat(F.lit(tag), F.col("event_id").cast("string")))
    point = F.col("end_var").isNull() & (F.col("end_lo") == F.col("lo")) & (F.col("end_hi") == F.col("hi"))
    return events.withColumn("start_name", own("start_var", "s:")).withColumn("end_name", F.when(point, F.col("start_name")).otherwise(own("end_var", "e:")))


def variables(named: DataFrame) -> DataFrame:
    """patient, name, lo and hi: what is known of each variable from all the times that name it."""
    times = F.array(F.struct(F.col("start_name").alias("name"), F.col("lo").alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("end_name").alias("name"), F.col("end_lo").alias("lo"), F.col("end_hi").alias("hi")))
    return named.select("patient", F.inline(times)).groupBy("patient", "name").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))


def order(named: DataFrame) -> DataFrame:
    """patient, a and b: a is no later than b."""
    return named.filter("start_name <> end_name").select("patient", F.col("start_name").alias("a"), F.col("end_name").alias("b")).distinct()


def tightened(known: DataFrame, ordered: DataFrame) -> DataFrame:
    """The variables with the ranges that their order leaves: no earlier than any before, no later than any after. Only what moved moves others."""
    known, ordered = cut(known.withColumn("moved", F.lit(True))), cut(ordered)
    while known.filter("moved").limit(1).count():
        fresh = known.filter("moved")
        low = ordered.join(fresh.select("patient", F.col("name").alias("a"), "lo"), ["patient", "a"]).groupBy("patient", F.col("b").alias("name")).agg(F.max("lo").alias("low"))
        high = ordered.join(fresh.select("patient", F.col("name").alias("b"), "hi"), ["patient", "b"]).groupBy("patient", F.col("a").alias("name")).agg(F.min("hi").alias("high"))
        both = known.join(low, ["patient", "name"], "left").join(high, ["patient", "name"], "left")
        moved = F.coalesce(F.col("low") > F.col("lo"), F.lit(False)) | F.coalesce(F.col("high") < F.col("hi"), F.lit(False))
        known = cut(both.select("patient", "name", F.greatest("lo", "low").alias("lo"), F.least("hi", "high").alias("hi"), moved.alias("moved")))
    return known.drop("moved")


def no_earlier(known: DataFrame, ordered: DataFrame) -> DataFrame:
    """patient, name and after: the variables that are surely no earlier than it, of those whose range begins before its own has ended."""
    side = lambda name, *of: known.select("patient", F.col("name").alias(name), *of)
    pairs = ordered.join(side("a", F.col("hi").alias("hi")), ["patient", "a"]).join(side("b", F.col("lo").alias("lo")), ["patient", "b"])
    pairs, before = cut(pairs.filter("lo < hi").select("patient", "a", "hi", "b", "lo")), 0
    while (count := pairs.count()) != before:
        before = count
        further = pairs.select("patient", F.col("a").alias("b"), F.col("b").alias("_b"), F.col("lo").alias("_lo"))
        steps = pairs.join(further, ["patient", "b"]).filter("_lo < hi AND a <> _b").select("patient", "a", "hi", F.col("_b").alias("b"), F.col("_lo").alias("lo"))
        pairs = cut(pairs.unionByName(steps).distinct())
    return pairs.groupBy("patient", F.col("a").alias("name")).agg(F.collect_set("b").alias("after"))


def resolved(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events with their names, tightened ranges and the variables surely no earlier than their times; and the patients whose ranges leave no world."""
    named = with_names(events)
    ordered = order(named)
    known = tightened(variables(named), ordered)
    after = no_earlier(known, ordered)
    of = known.join(after, ["patient", "name"], "left").withColumn("after", F.coalesce("after", F.array().cast("array<string>")))
    of = cut(of)
    start = of.select("patient", F.col("name").alias("start_name"), F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("after").alias("start_after"))
    end = of.select("patient", F.col("name").alias("end_name"), F.col("lo").alias("end_lo"), F.col("hi").alias("end_hi"), F.col("after").alias("end_after"))
    rows = named.drop("lo", "hi", "end_lo", "end_hi").join(start, ["patient", "start_name"]).join(end, ["patient", "end_name"])
    return rows, of.filter("lo > hi").select("patient").distinct()


def no_later(i: str, one: str, j: str, other: str) -> Column:
    """Whether a time of one step is surely no later than one of another."""
    its = F.col(f"{j}_{other}_name")
    return (F.col(f"{i}_{one}_name") == its) | F.array_contains(f"{i}_{one}_after", its)


def relation_bounds(r: Relation) -> list[tuple[tuple[Column, Column], int | None, int | None]]:
    """The relation's constraints as (bounds of y - x, lo, hi), by the network's shortest paths."""
    a, b, zero = r.source, r.target, F.lit(0).cast("long")

    def bounds(one: str) -> tuple[Column, Column]:
        low, high = (F.col(f"{a}_lo"), F.col(f"{a}_hi")) if one == "start" else (F.col(f"{a}_end_lo"), F.col(f"{a}_end_hi"))
        least, most = ta.difference(low, high, F.col(f"{b}_lo"), F.col(f"{b}_hi"))
        return F.greatest(least, F.when(no_later(a, one, b, "start"), zero)), F.least(most, F.when(no_later(b, "start", a, one), zero))

    if r.kind == "after":
        return [(bounds("start"), r.least, r.most)]
    return [(bounds("start"), 0, None), (bounds("end"), None, r.grace)]


def statuses(pattern: Pattern, events: DataFrame, closure: DataFrame, windows: DataFrame) -> DataFrame:
    """patient and status (excluded, inconsistent, exact, possible or none) of the patients of whose events some share variables (start_var, end_var; null for own
    ones); all others are left to the closed forms of plans.compile. Steps bound to a first, nth, counted or rising event are refused."""
    if derived := [s.id for s in pattern.steps if s.occurrence or s.nth or s.count or s.rise]:
        raise ValueError(f"steps {derived} rest on independent times")
    kinds = plans.of_pattern(pattern, closure)
    sharing = shares_variables(events).filter("shared").select("patient")
    rows, broken = resolved(events.join(sharing, "patient", "left_semi"))
    views = {}
    for s in pattern.steps:
        own = plans.named(kinds.of(rows, {s.concept}).filter(plans.meeting(s)), s.id, NAMES)
        if pattern.scope != "any":
            own = own.join(windows.filter("w_start IS NOT NULL"), "patient").filter(plans.in_scope(pattern, s.id, ta.plausible))
            own = own.withColumn(f"{s.id}_inside", plans.in_scope(pattern, s.id, ta.certain)).drop("w_start", "w_end")
        views[s.id] = own
    holds = lambda r, test: plans.both([test(b, lo, hi) for b, lo, hi in relation_bounds(r)])
    found = plans.with_windows(pattern, plans.bound(pattern, views, lambda r: holds(r, ta.plausible)), windows)
    sure = plans.both([holds(r, ta.certain) for r in pattern.relations] + ([F.col(f"{s.id}_inside") for s in pattern.steps] if pattern.scope != "any" else []))
    judged = found.select("patient", sure.alias("exact"), F.when(sure, True).otherwise(network.feasible(pattern, variables=True)).alias("possible"))
    best = judged.groupBy("patient").agg(F.bool_or("exact").alias("exact"), F.bool_or("possible").alias("possible"))
    out = sharing.join(windows, "patient").join(broken.withColumn("broken", F.lit(True)), "patient", "left").join(best, "patient", "left")
    status = F.when(F.col("w_start").isNull(), "excluded").when(F.col("broken"), "inconsistent").when(F.col("exact"), "exact").when(F.col("possible"), "possible").otherwise("none")
    return out.select("patient", status.alias("status"))
