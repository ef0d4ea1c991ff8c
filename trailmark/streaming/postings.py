"""Postings and pattern alerts kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.sources.model import with_concepts


def daily_postings(events: DataFrame, closure: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """day, patient, concept, n, first_at and last_at of a stream of events (patient, event_id, kind, ts). Events that come again within the
    lateness are counted once; a day is closed when the watermark has passed it. Postings of the store are sums and extremes of
    these rows, so that they can be folded in as they come."""
    once = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["patient", "event_id"])
    listed = with_concepts(once, closure).select("patient", "concept", "ts")
    found = listed.groupBy(F.window("ts", "1 day").alias("day"), "patient", "concept").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return found.select(F.col("day.start").alias("day"), "patient", "concept", "n", "first_at", "last_at")


def folded(postings: DataFrame) -> DataFrame:
    """patient, concept, n, first_at and last_at from daily postings."""
    return postings.groupBy("patient", "concept").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def followed_within(firsts: DataFrame, seconds: DataFrame, span: str, lateness: str = "2 hours") -> DataFrame:
    """Pairs of a first and a second event of one patient, the second at most span later, of two streams (patient, event_id, ts). Watermarks on both sides and
    the bounded range let old rows go from the state."""
    a = firsts.select("patient", F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts")).withWatermark("a_ts", lateness)
    b = seconds.select(F.col("patient").alias("b_patient"), F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts")).withWatermark("b_ts", lateness)
    return a.join(b, F.expr(f"patient = b_patient AND b_ts >= a_ts AND b_ts <= a_ts + INTERVAL {span}")).drop("b_patient")
