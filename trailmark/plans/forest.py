"""Possible matches of forests without their bindings.

Each event keeps the times at which it can start while everything below it in the forest still fits: one or more ranges. A child's
ranges, moved by its relation, are times that its parent's events may have; what several of them leave an event of the parent is united into
maximal ranges. Where the relation bounds a parent on one side only, the child's extreme of each patient is all that counts. Nothing is
enumerated but neighbours in time, and a patient matches if some event of the root has a time left.

An interval's end is only ever asked to be late enough, so that its latest end stands for it; a point's end is its start. Two steps that are
related may bind one event, which then has one time; forests in which other steps can do so too are left to joint decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import timealg as ta
from trailmark.operators.ranges import join_ranges, semi_join_ranges
from trailmark.plans.pattern import Pattern, Relation

OWN = ["patient", "event_id", "lo", "hi", "end_hi", "point"]


def timed(rows: DataFrame, windows: DataFrame, scope: str) -> DataFrame:
    """Candidates of a step with the times at which they can start in the scope."""
    point = (F.col("end_lo") == F.col("lo")) & (F.col("end_hi") == F.col("hi"))
    rows = rows.select("patient", "event_id", "lo", "hi", "end_hi", point.alias("point"))
    if scope == "any":
        return rows
    low, high = {"from_start": ("w_start", None), "within": ("w_start", "w_end"), "after": ("w_end", None)}[scope]
    inside = rows.join(windows.filter("w_start IS NOT NULL").select("patient", "w_start", "w_end"), "patient").withColumn("lo", F.greatest("lo", low))
    inside = inside.withColumn("hi", F.least("hi", high)) if high else inside
    return inside.filter("lo <= hi").select(*OWN)


def moved(r: Relation, child: str) -> tuple[Column | None, Column | None] | None:
    """The times that a child's range leaves its parent (None: no bound); None where that depends on the parent's end."""
    lo, hi = F.col("lo"), F.col("hi")
    plus = lambda x, k: None if k is None else x + k
    if r.kind == "after":
        return (plus(lo, None if r.most is None else -r.most), plus(hi, None if r.least is None else -r.least)) if child == r.target else (plus(lo, r.least), plus(hi, r.most))
    if child == r.source:
        return lo, F.when(F.col("point"), hi).otherwise(F.col("end_hi")) + r.grace
    return None


def extreme(rows: DataFrame, value: Column, low: bool) -> DataFrame:
    """patient, best (the least or greatest value), its event and next, the best of all other events; null where there is none."""
    rows = rows.select("patient", "event_id", value.alias("v"))
    pick, best = (F.min_by, F.min) if low else (F.max_by, F.max)
    order = F.struct("v", "event_id")
    one = rows.groupBy("patient").agg(pick(order, order).alias("_one"))
    rest = rows.join(one, "patient").filter(~F.col("event_id").eqNullSafe(F.col("_one.event_id"))).groupBy("patient").agg(best("v").alias("next"))
    return one.select("patient", F.col("_one.v").alias("best"), F.col("_one.event_id").alias("best_id")).join(rest, "patient", "left")


def united(rows: DataFrame) -> DataFrame:
    """The maximal ranges of each event."""
    w = Window.partitionBy("patient", "event_id").orderBy("lo", "hi")
    marked = rows.withColumn("_new", F.when(F.col("lo") <= F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, 0).otherwise(1))
    marked = marked.withColumn("_range", F.sum("_new").over(w))
    return marked.groupBy("patient", "event_id", "_range").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("end_hi").alias("end_hi"), F.first("point").alias("point")).select(*OWN)


def cut_to(pairs: DataFrame, low: Column, high: Column) -> DataFrame:
    """Pairs of a parent with times that it may have, as the parent with what is left of its range."""
    return pairs.withColumns({"lo": F.greatest("lo", low), "hi": F.least("hi", high)}).filter("lo <= hi").select(*OWN)


def narrowed_by(parent: DataFrame, child: DataFrame, r: Relation, step: str, meet: bool, width: int, last: bool) -> DataFrame:
    """parent with the times that some event of child (step) leaves. meet: both may bind one event. last: only the patients are wanted."""
    times, whole_parent, whole_child, far = moved(r, step), parent, child, None
    if r.kind == "during" and step == r.source:  # what begins after an ongoing event has it as a partner: no list of buckets is needed to find it
        ongoing = ~F.col("point") & (F.col("end_hi") >= ta.FOREVER)
        one = extreme(child.filter(ongoing), F.col("lo"), True)
        best = F.when(F.col("best_id").eqNullSafe(F.col("event_id")) & F.lit(meet), F.col("next")).otherwise(F.col("best"))
        far, child = cut_to(parent.join(one, "patient").filter(best.isNotNull()), best, F.col("hi")), child.filter(~ongoing)
    if times is None:  # parents that last: up to the latest child that begins before their end
        lasting = parent.filter(~F.col("point"))
        near = extreme(child, F.col("hi"), False)
        end = F.col("end_hi") + r.grace
        ongoing = lasting.filter(F.col("end_hi") >= ta.FOREVER).join(near, "patient")
        best = F.when(F.col("best_id").eqNullSafe(F.col("event_id")) & F.lit(meet), F.col("next")).otherwise(F.col("best"))
        far = ongoing.withColumn("hi", F.least("hi", best)).filter((F.col("lo") <= F.col("hi")) & best.isNotNull()).select(*OWN)
        bounded = lasting.filter(F.col("end_hi") < ta.FOREVER)
        its = child.select("patient", F.col("event_id").alias("_c_id"), F.col("lo").alias("_c_lo"), F.col("hi").alias("_c_hi"))
        met = join_ranges(bounded, its, ["patient"], (F.col("lo"), end), (F.col("_c_lo"), F.col("_c_hi")), width)
        met = met.filter(~F.col("event_id").eqNullSafe(F.col("_c_id"))) if meet else met
        far = far.unionByName(cut_to(met, F.col("lo"), F.least(F.col("_c_hi"), end)))
        parent, times = parent.filter("point"), (F.col("lo") - r.grace, F.col("hi"))
    low, high = times
    if low is None and high is None:
        out = parent.join(child.select("patient").distinct(), "patient", "left_semi") if not meet else None
        low = F.lit(-ta.FOREVER) if meet else low
    elif low is None or high is None:
        out = None
    elif last and not meet and far is None:
        its = child.select("patient", low.alias("_low"), high.alias("_high"))
        return semi_join_ranges(parent, its, ["patient"], (F.col("lo"), F.col("hi")), (F.col("_low"), F.col("_high")), width)
    else:
        its = child.select("patient", F.col("event_id").alias("_c_id"), low.alias("_low"), high.alias("_high"))
        met = join_ranges(parent, its, ["patient"], (F.col("lo"), F.col("hi")), (F.col("_low"), F.col("_high")), width)
        met = met.filter(~F.col("event_id").eqNullSafe(F.col("_c_id"))) if meet else met
        out = cut_to(met, F.col("_low"), F.col("_high"))
    if out is None:
        one = extreme(child, high if low is None else low, low is not None)
        best = F.when(F.col("best_id").eqNullSafe(F.col("event_id")) & F.lit(meet), F.col("next")).otherwise(F.col("best"))
        pairs = parent.join(one, "patient").filter(best.isNotNull())
        out = cut_to(pairs, F.col("lo") if low is None else best, F.col("hi") if high is None else best)
    if meet and (r.kind == "during" or ((r.least or 0) <= 0 <= (0 if r.most is None else r.most))):
        own = whole_child.select("patient", "event_id", F.col("lo").alias("_low"), F.col("hi").alias("_high"))
        same = whole_parent.join(own, ["patient", "event_id"])
        out = out.unionByName(cut_to(same, F.col("_low"), F.col("_high")))
    if far is not None:
        out = out.unionByName(far)
    return out if last else united(out)


def possible(pattern: Pattern, views: dict[str, DataFrame], meets, widths: dict[str, int]) -> DataFrame:
    """Patients of whom the views (timed candidates of each step) have a binding that holds in some world. meets(a, b): whether two steps may bind one event."""
    tops, order = None, pattern.order()
    left = {s.id: sum(1 for _, by in order if by is not None and s.id in (by.source, by.target)) for s in pattern.steps}
    views = dict(views)
    for step, by in reversed(order):
        if by is None:
            own = views[step.id].select("patient").distinct()
            tops = own if tops is None else tops.join(own, "patient", "left_semi")
            continue
        other = by.source if by.target == step.id else by.target
        left[other] -= 1
        is_root = next(b for s, b in order if s.id == other) is None
        views[other] = narrowed_by(views[other], views[step.id], by, step.id, meets(step.id, other), widths[by.id], is_root and left[other] == 0)
    return tops
