"""Ordered and counted conditions: first and last, envelopes, Nth, counts within spans, rises against earlier readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.lineage import cut


def occurrence(events: DataFrame, which: str = "first") -> DataFrame:
    """The first (last) event of each patient by the order of its ranges, and whether it is so in all worlds: every other event starts certainly
    later (earlier), or at the identical exact time."""
    keys = ("lo", "hi", "end_lo", "end_hi", "event_id") if which == "first" else ("hi", "lo", "end_hi", "end_lo", "event_id")
    pick = F.min_by if which == "first" else F.max_by
    best = events.groupBy("patient").agg(pick(F.struct("event_id", "lo", "hi"), F.struct(*keys)).alias("p"))  # combined before the shuffle: no history is one task
    picked = best.select("patient", F.col("p.event_id").alias("picked"), F.col("p.lo").alias("p_lo"), F.col("p.hi").alias("p_hi"))
    rest = events.select("patient", "event_id", "lo", "hi")
    test = (F.col("lo") > F.col("p_hi")) if which == "first" else (F.col("hi") < F.col("p_lo"))
    same = (F.col("lo") == F.col("hi")) & (F.col("p_lo") == F.col("p_hi")) & (F.col("lo") == F.col("p_lo"))
    sure = rest.join(picked, "patient").filter("event_id <> picked").groupBy("patient").agg(F.bool_and(test | same).alias("sure"))
    return picked.join(sure, "patient", "left").select("patient", "picked", "p_lo", "p_hi", F.coalesce("sure", F.lit(True)).alias("sure"))


def envelope(events: DataFrame, which: str = "first") -> DataFrame:
    """The range in which the true first (last) start lies."""
    f = F.min if which == "first" else F.max
    return events.groupBy("patient").agg(f("lo").alias("lo"), f("hi").alias("hi"))


def scenarios(events: DataFrame, which: str = "first") -> DataFrame:
    """One row for each event that can be its patient's first (last): the event with its start narrowed to the worlds in which it is, namely no
    later than any other's latest (no earlier than any other's earliest) start. A point's end is narrowed with it."""
    first = which == "first"
    bound, pick = ("hi", F.min_by) if first else ("lo", F.max_by)
    # combined before the shuffle: the bound of the others is the extreme one of all, or the next one for the event that has it
    order = F.struct(F.col(bound).alias("bound"), F.col("event_id").alias("id"))
    one = events.groupBy("patient").agg(pick(order, order).alias("_one"))
    both = events.join(one, "patient")
    rest = both.filter(F.col("event_id") != F.col("_one.id")).groupBy("patient").agg((F.min if first else F.max)(bound).alias("_next"))
    near = both.join(rest, "patient", "left").withColumn("_others", F.when(F.col("event_id") == F.col("_one.id"), F.col("_next")).otherwise(F.col("_one.bound")))
    open_ = F.col("_others").isNull() | ((F.col("lo") <= F.col("_others")) if first else (F.col("hi") >= F.col("_others")))
    new = {"hi": F.coalesce(F.least("hi", "_others"), "hi")} if first else {"lo": F.coalesce(F.greatest("lo", "_others"), "lo")}
    point = (F.col("end_lo") == F.col("lo")) & (F.col("end_hi") == F.col("hi")) if "end_lo" in events.columns else F.lit(False)
    ends = {f"end_{k}": F.when(point, v).otherwise(F.col(f"end_{k}")) for k, v in new.items() if "end_lo" in events.columns}
    return near.filter(open_).withColumns(new | ends).select(*events.columns)


def possible_occurrences(events: DataFrame, which: str = "first") -> DataFrame:
    """Events that can be the patient's first (last): no other must start before (after) them."""
    return events.join(scenarios(events, which).select("patient", "event_id"), ["patient", "event_id"], "left_semi").select(*events.columns)


def nth_envelope(events: DataFrame, n: int) -> DataFrame:
    """The range of the Nth start (from the last for negative n): Nth of the sorted lower and of the sorted upper bounds."""
    side = lambda c, name: events.select("patient", F.col(c), F.row_number().over(Window.partitionBy("patient").orderBy(F.col(c) if n > 0 else F.desc(c))).alias("_r")).filter(F.col("_r") == abs(n)).select("patient", F.col(c).alias(name))
    return side("lo", "nth_lo").join(side("hi", "nth_hi"), "patient")


def counted_within(events: DataFrame, n: int, span: int) -> DataFrame:
    """Exact events with at least n (themselves and simultaneous ones included) in the trailing span; `seen` counts them."""
    w = Window.partitionBy("patient").orderBy("lo").rangeBetween(-span, 0)
    return events.withColumn("seen", F.count("*").over(w)).filter(F.col("seen") >= n)


def counted_in_window(events: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """Exact events inside the window by which it has seen at least n."""
    inside = events.join(windows.filter("w_start IS NOT NULL"), "patient").filter("lo BETWEEN w_start AND w_end")
    w = Window.partitionBy("patient").orderBy("lo").rangeBetween(Window.unboundedPreceding, 0)
    return inside.withColumn("seen", F.count("*").over(w)).filter(F.col("seen") >= n)


def counted_uncertain(events: DataFrame, n: int, span: int) -> DataFrame:
    """event_id, certain and possible: whether n events lie in the span up to the event's start in all (some) worlds of independent times.
    At a time t of its range the event has forced company from those surely in [t - span, t] and allowed company from those that can be. Both are step
    functions of t that one sweep over the patient's bounds gives; their least and greatest values over each event's range come from extremes over 1, 2, 4, ...
    steps, two of which cover any range. So a dense history costs its length, not its square."""
    base = events.select("patient", "event_id", "lo", "hi")
    move = lambda t, forced, allowed: F.struct(t.alias("t"), F.lit(forced).alias("forced"), F.lit(allowed).alias("allowed"))
    both = F.col("hi") <= F.col("lo") + span  # only then it is surely there at some time
    stays = F.when(both, F.array(move(F.col("hi"), 1, 0), move(F.col("lo") + span + 1, -1, 0))).otherwise(F.array(move(F.col("hi"), 0, 0)))
    moves = base.select("patient", F.inline(F.concat(stays, F.array(move(F.col("lo"), 0, 1), move(F.col("hi") + span + 1, 0, -1)))))
    w = Window.partitionBy("patient").orderBy("t")
    steps = moves.groupBy("patient", "t").agg(F.sum("forced").alias("forced"), F.sum("allowed").alias("allowed"))
    steps = cut(steps.select("patient", "t", F.row_number().over(w).alias("i"), F.sum("forced").over(w).alias("forced"), F.sum("allowed").over(w).alias("allowed")))
    at = lambda name, i: steps.select("patient", F.col("t").alias(name), F.col("i").alias(i))
    placed = cut(base.join(at("lo", "_i"), ["patient", "lo"]).join(at("hi", "_j"), ["patient", "hi"]).select("patient", "event_id", "lo", "hi", "_i", "_j"))
    longest = placed.agg(F.max(F.col("_j") - F.col("_i"))).first()[0] or 0
    levels, wide = max(1, longest.bit_length()), steps.withColumns({"_least_0": F.col("forced"), "_most_0": F.col("allowed")})
    for k in range(1, levels):
        ahead = lambda c: F.lead(c, 1 << (k - 1)).over(w)  # noqa: B023, E731
        wide = wide.withColumns({f"_least_{k}": F.least(f"_least_{k - 1}", ahead(f"_least_{k - 1}")), f"_most_{k}": F.greatest(f"_most_{k - 1}", ahead(f"_most_{k - 1}"))})
    table = wide.select("patient", "i", "forced", "allowed", *(F.array(*(F.col(f"_{x}_{k}") for k in range(levels))).alias(x) for x in ("least", "most")))
    # the last step begins with the range's end, where the event itself is among the forced; all before it are covered by two stretches
    k = F.when(F.col("_j") > F.col("_i"), F.floor(F.log2(F.col("_j") - F.col("_i"))).cast("int"))
    stretch = lambda k: F.call_function("shiftleft", F.lit(1), k)
    k = F.when(stretch(k + 1) <= F.col("_j") - F.col("_i"), k + 1).when(stretch(k) > F.col("_j") - F.col("_i"), k - 1).otherwise(k)
    asked = placed.withColumn("_k", k).withColumn("_m", F.coalesce(F.col("_j") - stretch(F.col("_k")), F.col("_j")))
    of = lambda i, *names: table.select("patient", F.col("i").alias(i), *(F.col(c).alias(f"{c}{i}") for c in names))
    met = asked.join(of("_i", "least", "most"), ["patient", "_i"]).join(of("_m", "least", "most"), ["patient", "_m"]).join(of("_j", "forced", "allowed"), ["patient", "_j"])
    forced = F.least(F.get("least_i", "_k"), F.get("least_m", "_k"), F.col("forced_j") - both.cast("long"))
    allowed = F.greatest(F.get("most_i", "_k"), F.get("most_m", "_k"), F.col("allowed_j")) - 1
    return met.select("patient", "event_id", (forced >= n - 1).alias("certain"), (allowed >= n - 1).alias("possible"))


def risen(events: DataFrame, previous: int, within: int, factor: tuple[int, int], floor: int, falls: bool = False) -> DataFrame:
    """Exact readings at least factor (a fraction) times the greater of floor and the mean of up to `previous` readings in [t - within, t - 1];
    falls: at most the mean divided by the factor. In whole millionths: value * count * den >= num * sum."""
    w = Window.partitionBy("patient", "kind").orderBy("lo", "event_id")
    at = Window.partitionBy("patient", "kind", "lo").orderBy("event_id")  # readings of one time have the same earlier ones, which the first of them sees
    before = [F.lag(F.struct("lo", "micro"), i).over(w) for i in range(1, previous + 1)]
    rows = events.withColumn("_before", F.array(*before)).withColumn("_before", F.first("_before").over(at.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = F.filter("_before", lambda x: x.isNotNull() & (x["lo"] >= F.col("lo") - within))
    rows = rows.withColumn("_earlier", earlier).drop("_before").withColumn("base_n", F.size("_earlier")).filter("base_n > 0")
    rows = rows.withColumn("base_sum", F.aggregate("_earlier", F.lit(0).cast("long"), lambda a, x: a + x["micro"])).drop("_earlier")
    num, den = factor
    base = F.greatest(F.col("base_sum"), F.col("base_n") * floor)
    test = (F.col("micro") * F.col("base_n") * num <= base * den) if falls else (F.col("micro") * F.col("base_n") * den >= base * num)
    return rows.filter(test)


def latest_before(anchors: DataFrame, readings: DataFrame, within: int) -> DataFrame:
    """Each anchor (patient, at) with its latest reading in [at - within, at); of equal times the smallest event id. Anchors without one are left out. One sort of both sides
    together, no pairs: the last reading seen so far is carried along."""
    last = F.struct(F.col("lo").alias("t"), (-F.col("event_id")).alias("minus_id"), F.col("micro").alias("micro"))
    rows = readings.select("patient", F.col("lo").alias("t"), F.lit(1).alias("side"), last.alias("reading"), F.lit(None).cast("long").alias("anchor"))
    marks = anchors.select("patient", F.col("at").alias("t"), F.lit(0).alias("side"), F.lit(None).cast(rows.schema["reading"].dataType).alias("reading"), F.col("at").alias("anchor")).distinct()
    w = Window.partitionBy("patient").orderBy("t", "side", F.col("reading.minus_id")).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.unionByName(marks).withColumn("found", F.last("reading", ignorenulls=True).over(w)).filter("side = 0")
    return seen.filter(F.col("found.t") >= F.col("t") - within).select("patient", F.col("anchor").alias("at"), (-F.col("found.minus_id")).alias("event_id"), F.col("found.t").alias("t"), F.col("found.micro").alias("micro"))


def features(readings: DataFrame, windows: DataFrame) -> DataFrame:
    """Of each patient's readings in the window: latest value, latest minus earliest (with two times), count, minutes from the latest to the window's end."""
    inside = readings.join(windows.filter("w_start IS NOT NULL"), "patient").filter("lo >= w_start AND lo < w_end")
    key = F.struct("lo", (-F.col("event_id")).alias("minus_id"))
    first = F.struct("lo", "event_id")
    found = inside.groupBy("patient").agg(F.max_by("micro", key).alias("latest"), F.min_by("micro", first).alias("earliest"), F.count("*").alias("n"), F.min("lo").alias("t0"), F.max("lo").alias("t1"), F.first("w_end").alias("w_end"))
    return found.select("patient", "latest", F.when(F.col("t1") > F.col("t0"), F.col("latest") - F.col("earliest")).alias("change"), "n", F.expr("(w_end - t1) div 60000000").alias("recency_minutes"))


def exposures_paired(records: DataFrame) -> DataFrame:
    """Orders and stops of one item as exposures: a stop closes the latest order before it that is open; later orders leave earlier ones open. Records: patient, item, t, kind
    (start, stop), record_id."""
    w = Window.partitionBy("patient", "item").orderBy("t", "record_id")
    marked = records.withColumn("_next_kind", F.lead("kind").over(w)).withColumn("_next_t", F.lead("t").over(w))
    return marked.filter("kind = 'start'").select("patient", "item", F.col("record_id"), F.col("t").alias("s"), F.when(F.col("_next_kind") == "stop", F.col("_next_t")).alias("e"))
