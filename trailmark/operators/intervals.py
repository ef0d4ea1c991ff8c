"""Interval cohorts, bounded intervals, robust relaxation, and baseline-treatment-follow-up joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import timealg as ta
from trailmark.operators.ranges import join_by_start, join_ranges

RANK = {"CERTAIN": 3, "POSSIBLE": 2, "INCOMPARABLE": 1, "IMPOSSIBLE": 0}
ROLLED = {3: "CERTAIN_MATCH", 2: "POSSIBLE_MATCH", 1: "INCOMPARABLE", 0: "NO_RECORDED_MATCH"}


def renamed(rows: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return rows.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c not in keys))


def usual_length(rows: DataFrame) -> int:
    """About how long most intervals (s, e) are, by one aggregation: a width of buckets at which few intervals are listed under many."""
    return max(rows.agg(F.percentile_approx(F.col("e") - F.col("s"), 0.75, 100)).first()[0] or 0, ta.UNITS["hour"])


def pairs(left: DataFrame, right: DataFrame, keys: list[str], slack: int, width: int | None = None) -> DataFrame:
    """Pairs of different intervals (event_id, s, e) of one scope that touch or lie at most slack apart; columns a_* and b_*. width: of the buckets, best
    about the intervals' own length, which is measured where it isn't known."""
    width = width or usual_length(left) + 2 * slack
    met = join_by_start(renamed(left, "a", keys), renamed(right, "b", keys), keys, (F.col("a_s") - slack, F.col("a_e") + slack), (F.col("b_s"), F.col("b_e")), width)
    return met.filter("a_event_id <> b_event_id")


def gap(s: Column, e: Column, u: Column, least: int | None, most: int | None) -> Column:
    out = u > e
    if least is not None:
        out = out & (u - e >= least)
    return out & (u - e <= most) if most is not None else out


def overlap(s: Column, e: Column, u: Column, v: Column) -> Column:
    """How long two intervals overlap, zero where they don't."""
    return F.greatest(F.least(e, v) - F.greatest(s, u), F.lit(0))


def operator_result(operator: str, same_scope: Column, same_clock: Column, s: Column, e: Column, u: Column, v: Column, least: int | None = None, most: int | None = None) -> Column:
    """TRUE, FALSE or INCOMPARABLE of before, meets, overlaps or gap."""
    holds = {"before": e < u, "meets": e == u, "overlaps": (s < u) & (e > u) & (e < v), "gap": gap(s, e, u, least, most)}[operator]
    return F.when(same_scope & same_clock, F.when(holds, "TRUE").otherwise("FALSE")).otherwise("INCOMPARABLE")


def cohort(slots: list[DataFrame], constraints: list[tuple[int, int, str, int | None, int | None]], keys: list[str]) -> DataFrame:
    """Bindings of each slot to its own event under the operators (before, meets, overlaps, gap) between slots; columns s0_*, s1_*, ..."""
    out = renamed(slots[0], "s0", keys)
    for k in range(1, len(slots)):
        right = renamed(slots[k], f"s{k}", keys)
        by = next((c for c in constraints if {c[0], c[1]} == {k - 1, k} and c[2] == "gap" and c[4] is not None and c[1] == k), None)
        if by:
            end = F.col(f"s{k - 1}_e")
            out = join_ranges(out, right, keys, (end + (by[3] or 0), end + by[4]), (F.col(f"s{k}_s"), F.col(f"s{k}_s")), max(by[4], ta.UNITS["day"]))
        elif touch := next((c for c in constraints if max(c[0], c[1]) == k and c[2] in ("overlaps", "meets")), None):
            i = min(touch[0], touch[1])  # such intervals share an instant
            out = join_ranges(out, right, keys, (F.col(f"s{i}_s"), F.col(f"s{i}_e")), (F.col(f"s{k}_s"), F.col(f"s{k}_e")), 30 * ta.UNITS["day"])
        else:
            out = out.join(right, keys)
        out = out.filter(" AND ".join(f"s{j}_event_id <> s{k}_event_id" for j in range(k)))
        for i, j, op, least, most in (c for c in constraints if max(c[0], c[1]) == k):
            s, e, u, v = (F.col(f"s{i}_s"), F.col(f"s{i}_e"), F.col(f"s{j}_s"), F.col(f"s{j}_e"))
            out = out.filter({"before": e < u, "meets": e == u, "overlaps": (s < u) & (e > u) & (e < v), "gap": gap(s, e, u, least, most)}[op])
    return out


def bounded(operator: str, least: int | None = None, most: int | None = None) -> Column:
    """The certainty of an operator between pairs whose ends have ranges: a_s_lo, a_s_hi, a_e_lo, a_e_hi, b_..., and clocks a_clock, b_clock."""
    at = {"s": "a_s", "e": "a_e", "u": "b_s", "v": "b_e"}
    lows, highs = ({k: F.col(f"{c}_{x}") for k, c in at.items()} for x in ("lo", "hi"))
    return ta.classified(ta.atoms(operator, least, most), lows, highs, F.col("a_clock").eqNullSafe(F.col("b_clock")))


def rolled_up(classified: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """The best status of each scope's bindings."""
    rank = F.max(F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), F.col(status)))
    return classified.groupBy(*keys).agg(F.element_at(F.create_map(*(F.lit(x) for kv in ROLLED.items() for x in kv)), rank).alias("status"))


def before_rolled_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best status of "one before another" over all pairs of a scope's bounded intervals, from extremes alone: the earliest end and the latest
    start of each clock. For a pair that only one interval would make with itself, the next best of either side is taken."""
    end, start = F.greatest("e_lo", F.col("s_lo") + 1), F.least("s_hi", F.col("e_hi") - 1)
    ends, starts = F.struct(end.alias("t"), F.col("event_id").alias("id")), F.struct(start.alias("t"), F.col("event_id").alias("id"))
    best = rows.groupBy(*keys, "clock").agg(F.count("*").alias("n"), F.min("e_hi").alias("sure_end"), F.max("s_lo").alias("sure_start"), F.min(ends).alias("a"), F.max(starts).alias("b"))
    own = best.filter("a.id = b.id").select(*keys, "clock", F.col("a.id").alias("_id"))
    rest = rows.join(own, [*keys, "clock"]).filter("event_id <> _id").groupBy(*keys, "clock").agg(F.min(end).alias("a_next"), F.max(start).alias("b_next"))
    both = best.join(rest, [*keys, "clock"], "left")
    reach = lambda a, b: F.coalesce(a + 1 <= b, F.lit(False))
    possible = F.when(F.col("a.id") != F.col("b.id"), reach(F.col("a.t"), F.col("b.t"))).otherwise(reach(F.col("a_next"), F.col("b.t")) | reach(F.col("a.t"), F.col("b_next")))
    judged = both.select(*keys, "n", F.when((F.col("sure_end") < F.col("sure_start")) & possible, RANK["CERTAIN"]).when(possible, RANK["POSSIBLE"]).otherwise(RANK["IMPOSSIBLE"]).alias("rank"))
    scope = judged.groupBy(*keys).agg(F.max("rank").alias("rank"), F.count("*").alias("clocks"), F.sum("n").alias("n")).filter("n > 1")
    rank = F.greatest("rank", F.when(F.col("clocks") > 1, RANK["INCOMPARABLE"]).otherwise(0))
    return scope.select(*keys, F.element_at(F.create_map(*(F.lit(x) for kv in ROLLED.items() for x in kv)), rank).alias("status"))


def robust(pairs_: DataFrame, options: list[tuple[str, int, int | None, int | None]], keys: list[str], budget: int) -> DataFrame:
    """The cheapest option (name, cost, least and most gap) under which some pair is certain: keys, option and cost. Variants are tried on one
    set of pairs; of equal cost the first name counts."""
    bound = {"s": "a_s", "e": "a_e", "u": "b_s", "v": "b_e"}
    told = lambda least, most: reduce(lambda x, y: x & y, [F.col(f"{bound[a]}_hi") - F.col(f"{bound[b]}_lo") <= k for a, b, k in ta.atoms("gap", least, most)], F.lit(True))  # noqa: E731  what is certain must hold at the bounds, which is cheap to see
    tried = F.array(*(F.when(told(least, most) & (bounded("gap", least, most) == "CERTAIN"), F.struct(F.lit(cost).alias("cost"), F.lit(name).alias("option"))) for name, cost, least, most in options if cost <= budget))
    found = pairs_.select(*keys, F.array_min(F.array_compact(tried)).alias("best")).filter("best IS NOT NULL")
    return found.groupBy(*keys).agg(F.min("best").alias("best")).select(*keys, "best.option", "best.cost")


def baseline_followup(exposures: DataFrame, readings: DataFrame, lead: tuple[int, int], lag: tuple[int, int], least: int, within_interval: bool = False) -> DataFrame:
    """Exposures (patient, event_id, s, e) with each baseline reading of at least `least` in [s - lead[1], s - lead[0]], and each follow-up of the same unit in
    [s + lag[0], s + lag[1]]; pairs without follow-up stay, with nulls. change: follow-up minus baseline."""
    r = lambda p: renamed(readings.select("patient", "event_id", "unit", "lo", "micro"), p, ["patient"])
    width = max(lead[1], lag[1])
    eligible = join_ranges(exposures.select("patient", F.col("event_id").alias("x_id"), "s", "e"), r("b").filter(F.col("b_micro") >= least), ["patient"], (F.col("s") - lead[1], F.col("s") - lead[0]), (F.col("b_lo"), F.col("b_lo")), width)
    later = join_ranges(eligible, r("f"), ["patient"], (F.col("s") + lag[0], F.least(F.col("s") + lag[1], F.col("e")) if within_interval else F.col("s") + lag[1]), (F.col("f_lo"), F.col("f_lo")), width).filter("b_unit = f_unit").select("x_id", "b_event_id", "f_event_id", "f_micro")
    return eligible.join(later, ["x_id", "b_event_id"], "left").select("patient", "x_id", "b_event_id", "b_micro", "f_event_id", "f_micro", (F.col("f_micro") - F.col("b_micro")).alias("change"))


def in_windows(anchors: DataFrame, readings: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Readings that lie in some of the windows (from, to) around anchors (anchor_id, patient, at): distinct anchor_id, event_id."""
    spans = F.explode(F.array(*(F.struct((F.col("at") + a).alias("w_lo"), (F.col("at") + b).alias("w_hi")) for a, b in offsets)))
    listed = anchors.select("anchor_id", "patient", spans.alias("w")).select("anchor_id", "patient", "w.w_lo", "w.w_hi")
    width = max(b - a for a, b in offsets)
    met = join_ranges(listed, readings.select("patient", "event_id", F.col("lo").alias("r_lo")), ["patient"], (F.col("w_lo"), F.col("w_hi")), (F.col("r_lo"), F.col("r_lo")), width)
    return met.select("anchor_id", "event_id").distinct()


def aligned(left: DataFrame, right: DataFrame, alignment: DataFrame) -> DataFrame:
    """Pairs of a patient's records with comparable: whether the two clocks are declared aligned."""
    both = left.withColumnRenamed("clock", "l_clock").join(right.withColumnRenamed("clock", "r_clock"), "patient")
    declared = alignment.select("patient", "l_clock", "r_clock", F.lit(True).alias("comparable"))
    return both.join(declared, ["patient", "l_clock", "r_clock"], "left").withColumn("comparable", F.coalesce("comparable", F.lit(False)))


def aligned_counts(left: DataFrame, right: DataFrame, alignment: DataFrame) -> DataFrame:
    """patient, pairs and comparable: how many pairs of a patient's records there are, and how many of them on aligned clocks, without making them."""
    side = lambda df, c, n: df.groupBy("patient", F.col("clock").alias(c)).agg(F.count("*").alias(n))
    both = side(left, "l_clock", "_l").join(side(right, "r_clock", "_r"), "patient")  # as many rows as pairs of clocks
    declared = alignment.select("patient", "l_clock", "r_clock", F.lit(True).alias("_aligned"))
    met = both.join(declared, ["patient", "l_clock", "r_clock"], "left").withColumn("_n", F.col("_l") * F.col("_r"))
    return met.groupBy("patient").agg(F.sum("_n").alias("pairs"), F.sum(F.when(F.col("_aligned"), F.col("_n")).otherwise(0)).alias("comparable"))
