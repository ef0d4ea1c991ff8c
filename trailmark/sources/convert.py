"""Source records as events: latest versions only, performed ones only, codes through a catalogue, mentions as uncertain points, orders and stops as exposures.

Records are patient, record_id, source, kind, system, code, lo, hi, status, supersedes (a record of the same source) and mentions (array of concept,
assertion, experiencer). Each record has one outcome: an event of its own, events of its mentions, an order or a stop, or a reason to
leave it out. A stop closes the latest order of its concept that is still open and can have begun by then: with orders at their earliest and
stops at their latest time this is the matching of brackets, found by running depths, without a loop over records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.timealg import FOREVER

EVENT = ("patient", "event_id", "kind", "concept", "source", "lo", "hi", "end_lo", "end_hi")


def outcomes(records: DataFrame, codes: DataFrame, performed: list[str], letters: list[str]) -> DataFrame:
    """records with concept (of its code) and outcome: superseded, not_performed, letter, uncoded, unknown_code or coded. codes: system, code, concept, one
    concept for each."""
    later = records.filter("supersedes IS NOT NULL").select("patient", "source", F.col("supersedes").alias("record_id")).distinct().withColumn("_later", F.lit(True))
    known = codes.select("system", "code", "concept")
    rows = records.join(later, ["patient", "source", "record_id"], "left").join(known, ["system", "code"], "left")
    outcome = F.when(F.col("_later"), "superseded").when(~F.coalesce(F.col("status").isin(performed), F.lit(False)), "not_performed").when(F.col("kind").isin(letters), "letter")
    outcome = outcome.when(F.col("code").isNull(), "uncoded").when(F.col("concept").isNull(), "unknown_code").otherwise("coded")
    return rows.withColumn("outcome", outcome).drop("_later")


def mentioned(rows: DataFrame, records: DataFrame, at_letter: bool) -> DataFrame:
    """An event for each present mention of the patient's own: at the letter's time, or at any time from the patient's first record to it."""
    first = records.groupBy("patient").agg(F.min("lo").alias("_first"))
    each = rows.filter("outcome = 'letter'").join(first, "patient").select("*", F.posexplode("mentions").alias("_i", "_m")).filter("_m.assertion = 'present' AND _m.experiencer = 'patient'")
    lo = F.col("lo") if at_letter else F.col("_first")
    return each.select("patient", F.concat_ws("#", "record_id", "_i").alias("event_id"), F.lit("mention").alias("kind"), F.col("_m.concept").alias("concept"), "source", lo.alias("lo"), "hi", lo.alias("end_lo"), F.col("hi").alias("end_hi"))


def exposures(orders: DataFrame, stops: DataFrame) -> DataFrame:
    """Orders (event columns) with their ends: those of the stop that closes them, no earlier than the order's start; open ones have none."""
    side = lambda df, opens, t: df.select("patient", "concept", F.lit(opens).alias("opens"), F.col(t).alias("t"), "record_id", "source", "lo", "hi")
    rows = side(orders, 1, "lo").unionByName(side(stops, -1, "hi"))
    order = Window.partitionBy("patient", "concept").orderBy("t", F.desc("opens"), "lo", "hi", "record_id")
    rows = rows.withColumn("_sum", F.sum("opens").over(order))
    least = F.least(F.min("_sum").over(order), F.lit(0))  # stops without an open order don't count
    rows = rows.withColumn("_level", F.col("_sum") - least + F.when(F.col("opens") < 0, 1).otherwise(0))
    level = Window.partitionBy("patient", "concept", "_level").orderBy("t", F.desc("opens"), "lo", "hi", "record_id")
    after = lambda c: F.when(F.lead("opens").over(level) < 0, F.lead(c).over(level))
    closed = rows.withColumns({"_stop_lo": after("lo"), "_stop_hi": after("hi")}).filter("opens > 0")
    end_lo = F.when(F.col("_stop_hi").isNull(), F.col("lo")).otherwise(F.greatest("_stop_lo", "lo"))
    end_hi = F.when(F.col("_stop_hi").isNull(), F.lit(FOREVER)).otherwise(F.greatest(F.col("_stop_hi"), F.greatest("_stop_lo", "lo")))
    return closed.select("patient", F.col("record_id").cast("string").alias("event_id"), F.lit("exposure").alias("kind"), "concept", "source", "lo", "hi", end_lo.alias("end_lo"), end_hi.alias("end_hi"))


def converted(records: DataFrame, codes: DataFrame, performed: list[str], letters: list[str], order: Column, stop: Column, at_letter: bool = False) -> DataFrame:
    """The events of all records. order and stop: which coded records begin and end exposures."""
    rows = outcomes(records, codes, performed, letters)
    coded = rows.filter("outcome = 'coded'")
    begins, ends = F.coalesce(order, F.lit(False)), F.coalesce(stop, F.lit(False))
    points = coded.filter(~begins & ~ends).select("patient", F.col("record_id").cast("string").alias("event_id"), "kind", "concept", "source", "lo", "hi", F.col("lo").alias("end_lo"), F.col("hi").alias("end_hi"))
    return points.unionByName(mentioned(rows, records, at_letter)).unionByName(exposures(coded.filter(begins), coded.filter(ends & ~begins))).select(*EVENT)
