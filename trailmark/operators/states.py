"""State coverage over a window: segments, coalescing, conflicts, verdicts. Intervals are half-open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.timealg import UNITS
from trailmark.operators.ranges import join_ranges


def segments(records: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, from_, to_ and status (SUPPORTED, REFUTED, CONFLICT or UNKNOWN) of each elementary piece of each window (w_start, w_end), by a sweep: a record (positive, s, e) adds one
    where it begins and takes one away where it ends, and running sums say what holds between cuts."""
    clipped = records.join(windows, keys).select(*keys, "positive", F.greatest("s", "w_start").alias("s"), F.least("e", "w_end").alias("e")).filter("s < e")
    step = lambda t, n: F.struct(F.col(t).alias("t"), F.when(F.col("positive"), n).otherwise(0).alias("p"), F.when(F.col("positive"), 0).otherwise(n).alias("q"))
    moves = clipped.select(*keys, F.inline(F.array(step("s", 1), step("e", -1))))
    edge = lambda c: windows.select(*keys, F.col(c).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("q"))
    cuts = moves.unionByName(edge("w_start")).unionByName(edge("w_end")).groupBy(*keys, "t").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    w = Window.partitionBy(*keys).orderBy("t")
    held = cuts.select(*keys, F.col("t").alias("from_"), F.lead("t").over(w).alias("to_"), F.sum("p").over(w).alias("p"), F.sum("q").over(w).alias("q")).filter("to_ IS NOT NULL")
    status = F.when((F.col("p") > 0) & (F.col("q") > 0), "CONFLICT").when(F.col("p") > 0, "SUPPORTED").when(F.col("q") > 0, "REFUTED").otherwise("UNKNOWN")
    return held.select(*keys, "from_", "to_", status.alias("status"))


def coalesced(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Adjacent pieces of one status joined."""
    w = Window.partitionBy(*keys).orderBy("from_")
    fresh = (F.lag("status").over(w).eqNullSafe(F.col("status")) & F.lag("to_").over(w).eqNullSafe(F.col("from_"))).cast("int")
    island = F.sum(1 - F.col("_same")).over(w)
    return pieces.withColumn("_same", fresh).withColumn("_island", island).groupBy(*keys, "_island", "status").agg(F.min("from_").alias("from_"), F.max("to_").alias("to_")).drop("_island")


def verdicts(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """HOLDS, VIOLATED, UNKNOWN or BLOCKED_SOURCE_CONFLICT throughout each window, and how long each status lasts."""
    length = F.col("to_") - F.col("from_")
    total = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, length)), F.lit(0)).alias(s.lower())
    found = pieces.groupBy(*keys).agg(*(total(s) for s in ("SUPPORTED", "REFUTED", "UNKNOWN", "CONFLICT")))
    verdict = F.when(F.col("conflict") > 0, "BLOCKED_SOURCE_CONFLICT").when(F.col("refuted") > 0, "VIOLATED").when(F.col("unknown") > 0, "UNKNOWN").otherwise("HOLDS")
    return found.withColumn("verdict", verdict)


def point_conflicts(points: DataFrame, records: DataFrame, keys: list[str], width: int = 30 * UNITS["day"]) -> DataFrame:
    """Points (positive, t) inside an interval of the other polarity, or at the time of a point of the other polarity: keys, t."""
    held = records.select(*keys, F.col("positive").alias("r_positive"), "s", "e")
    inside = join_ranges(points, held, keys, (F.col("t"), F.col("t")), (F.col("s"), F.col("e")), width).filter("positive <> r_positive AND t < e").select(*keys, "t")
    both = points.groupBy(*keys, "t").agg((F.bool_or("positive") & F.bool_or(~F.col("positive"))).alias("both")).filter("both").select(*keys, "t")
    return inside.unionByName(both).distinct()
