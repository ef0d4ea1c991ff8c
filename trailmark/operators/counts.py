"""Counts under uncertain times: where a count can be reached, steps that rest on it, and what left-out records reach.

How many of a patient's records can lie in the span up to a time is a step function of that time. One sweep over all records'
reaches gives it for all of them: a record counts itself wherever it can be, so the others are one fewer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.timealg import UNITS
from trailmark.operators.ranges import join_ranges
from trailmark.plans.pattern import Pattern


def reachable(events: DataFrame, n: int, span: int) -> DataFrame:
    """patient, from_ and to_: the maximal ranges of times at which n of the patient's records can lie in the span up to that time."""
    moves = events.select("patient", F.inline(F.array(F.struct(F.col("lo").alias("t"), F.lit(1).alias("d")), F.struct((F.col("hi") + span + 1).alias("t"), F.lit(-1).alias("d")))))
    w = Window.partitionBy("patient").orderBy("t")
    held = moves.groupBy("patient", "t").agg(F.sum("d").alias("d")).select("patient", F.col("t").alias("from_"), (F.lead("t").over(w) - 1).alias("to_"), (F.sum("d").over(w) >= n).alias("held"))
    fresh = held.withColumn("_new", F.when(F.lag("held").over(Window.partitionBy("patient").orderBy("from_")), 0).otherwise(1))
    island = fresh.withColumn("_island", F.sum("_new").over(Window.partitionBy("patient").orderBy("from_"))).filter("held")
    return island.groupBy("patient", "_island").agg(F.min("from_").alias("from_"), F.max("to_").alias("to_")).drop("_island")


def narrowed(events: DataFrame, n: int, span: int) -> DataFrame:
    """The events, once for each maximal range of their start (lo, hi) at which n - 1 other records can be in the span up to it. A record whose
    count can't be reached anywhere is gone; a point's end is narrowed with its start."""
    reach = reachable(events, n, span)
    met = join_ranges(events, reach, ["patient"], (F.col("lo"), F.col("hi")), (F.col("from_"), F.col("to_")), max(span, UNITS["hour"]))
    new = {"lo": F.greatest("lo", "from_"), "hi": F.least("hi", "to_")}
    point = (F.col("end_lo") == F.col("lo")) & (F.col("end_hi") == F.col("hi"))
    ends = {f"end_{k}": F.when(point, v).otherwise(F.col(f"end_{k}")) for k, v in new.items()}
    return met.withColumns(new | ends).select(*events.columns)


def refined(two_pass: DataFrame, possible: DataFrame) -> DataFrame:
    """patient and status: what two passes left unresolved is possible where a narrowed record fits (`possible`: patient), and none elsewhere."""
    marked = two_pass.join(possible.select("patient").distinct().withColumn("_fits", F.lit(True)), "patient", "left")
    status = F.when(F.col("status") != "unresolved", F.col("status")).when(F.col("_fits"), "possible").otherwise("none")
    return marked.select("patient", status.alias("status"))


def reached(excluded: DataFrame, windows: DataFrame, kind: str) -> DataFrame:
    """The left-out records that can change a derived step: of an nth step or a count in a span (kind nth, span) all of its concepts, since one
    before the window can shift ranks and counts; of a count in the window (kind window) those that overlap it."""
    if kind in ("nth", "span"):
        return excluded.join(windows.filter("w_start IS NOT NULL").select("patient"), "patient", "left_semi")
    if kind != "window":
        raise ValueError(f"kind of a derived step: {kind}")
    return excluded.join(windows, "patient").filter("x_lo <= w_end AND x_hi >= w_start").select(*excluded.columns)


def coupled(pattern: Pattern, closure: DataFrame, step: str) -> DataFrame:
    """other and concept: the other steps that can bind an event which `step` counts, with the concepts they share. Where there are some, a possible
    match isn't claimed: one event can't be in two places of the count at once."""
    concepts = pattern.concepts()
    listed = closure.sparkSession.createDataFrame([(i, c) for i, cs in concepts.items() for c in sorted(cs)], "other string, ancestor string")
    own = closure.filter(F.col("ancestor").isin(sorted(concepts[step]))).select("concept")
    return listed.filter(F.col("other") != step).join(closure, "ancestor").join(own, "concept", "left_semi").select("other", "concept").distinct()
