"""Records around anchors: features for each variable, rankings with missing values, reviewed mappings, measurement selection, merged sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import scalars
from trailmark.lineage import cut


def latest_of_each(anchors: DataFrame, readings: DataFrame, variables: dict[str, int]) -> DataFrame:
    """patient, at, the latest value of each variable in its own look-back before the anchor (one for each patient), how many there are and whether all
    are. variables: kind to look-back; of equal times the smallest event id counts."""
    wanted = readings.filter(F.col("kind").isin(sorted(variables)))
    met = anchors.select("patient", "at").join(wanted.select("patient", "kind", "event_id", "lo", "micro"), "patient", "left")
    inside = {k: (F.col("kind") == k) & (F.col("lo") < F.col("at")) & (F.col("lo") >= F.col("at") - span) for k, span in variables.items()}
    key = lambda ok: F.when(ok, F.struct("lo", (-F.col("event_id")).alias("minus_id")))
    found = met.groupBy("patient", "at").agg(*(F.max_by(F.when(ok, F.col("micro")), key(ok)).alias(k) for k, ok in inside.items()))
    available = sum((F.col(k).isNotNull().cast("int") for k in variables), F.lit(0))
    return found.withColumn("available", available).withColumn("complete", F.col("available") == len(variables))


def ranked_missing_last(rows: DataFrame, distance: str, *ties: str) -> DataFrame:
    """rows with rank, by distance and then ties; rows without a distance come last and have no rank. Ranks come from counts of ranges, so that no
    task sees all rows."""
    order = [F.col(distance).asc_nulls_last(), *ties]
    # ranges are drawn anew whenever they are planned: rows and counts must be of the same ones
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return ranged.join(F.broadcast(offsets), "_part").withColumn("rank", F.when(F.col(distance).isNotNull(), place.cast("long"))).drop("_part", "_before")


def mapping_outcomes(decisions: DataFrame) -> DataFrame:
    """mapping, status and decision: PENDING without decisions, else the latest one's (ACCEPTED or WITHDRAWN), INVALID where the first isn't an acceptance
    or a decision doesn't supersede the one before. decisions: mapping, decision, seq, supersedes, action; a mapping without any has one row
    with a null decision."""
    w = Window.partitionBy("mapping").orderBy("seq")
    chained = decisions.withColumn("_wrong", F.when(F.col("decision").isNull(), False).when(F.lag("decision").over(w).isNull(), F.col("supersedes").isNotNull() | (F.col("action") != "accept")).otherwise(~F.col("supersedes").eqNullSafe(F.lag("decision").over(w))))
    last = chained.groupBy("mapping").agg(F.bool_or("_wrong").alias("wrong"), F.max_by("action", "seq").alias("action"), F.max_by("decision", "seq").alias("decision"))
    status = F.when(F.col("wrong"), "INVALID").when(F.col("decision").isNull(), "PENDING").when(F.col("action") == "accept", "ACCEPTED").otherwise("WITHDRAWN")
    return last.select("mapping", status.alias("status"), "decision")


def mapping_rules(outcomes: DataFrame, mappings: DataFrame) -> DataFrame:
    """if_class and then_class of the accepted mappings (mapping, source_class, target_class); none at all while some mapping isn't accepted."""
    blocked = outcomes.filter("status <> 'ACCEPTED'").limit(1).withColumn("_blocked", F.lit(True)).select("_blocked")
    rules = mappings.join(outcomes.filter("status = 'ACCEPTED'").select("mapping"), "mapping", "left_semi").select(F.col("source_class").alias("if_class"), F.col("target_class").alias("then_class"))
    return rules.join(F.broadcast(blocked), F.lit(True), "left").filter("_blocked IS NULL").drop("_blocked")  # against one row at most


def selected_measurements(claims: DataFrame, variables: DataFrame) -> DataFrame:
    """Accepted point claims (claim, record, time_var, scope, value, accepted, support) with their time variable's bounds: record, t_lo, t_hi, value and
    supports, a row for each record, and problem where its time is missing, of another scope, or its claims differ."""
    chosen = claims.filter("accepted")
    both = chosen.join(variables.select("time_var", F.col("scope").alias("_scope"), "t_lo", "t_hi"), "time_var", "left")
    found = both.groupBy("record").agg(F.min("t_lo").alias("t_lo"), F.max("t_hi").alias("t_hi"), F.min("value").alias("value"), F.max("value").alias("_most"), F.count_distinct("support").alias("supports"), F.bool_or(F.col("_scope").isNull()).alias("_missing"), F.bool_or(F.col("_scope") != F.col("scope")).alias("_other"))
    problem = F.when(F.col("_missing"), "MISSING_TIME").when(F.col("_other"), "TIME_SCOPE_MISMATCH").when(F.col("value") != F.col("_most"), "CONFLICTING_VALUES")
    return found.select("record", "t_lo", "t_hi", F.when(problem.isNull(), F.col("value")).alias("value"), "supports", problem.alias("problem"))


def measurement_rows(rows: DataFrame, *content: str) -> DataFrame:
    """rows with an id made from their content, so that the same reading has the same id wherever it is read."""
    return rows.withColumn("row_id", scalars.digest(*(F.col(c) for c in content)))


def merged_sources(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """The rows of all sources, their ids made disjoint by the source's name."""
    out = None
    for name, rows in sorted(sources.items()):
        own = rows.withColumn(key, F.concat(F.lit(f"{name}:"), F.col(key).cast("string")))
        out = own if out is None else out.unionByName(own)
    return out


def period_start(kind: Column, at: Column, starts: Column, summaries: list[str]) -> Column:
    """When a reading counts: readings that sum up a period are timed at its start."""
    return F.when(kind.isin(summaries), starts).otherwise(at)


def of_class(rows: DataFrame, closure: DataFrame, wanted: str, kind: str = "kind") -> DataFrame:
    """Slot candidates: rows whose kind has the class among its named ancestors; the catalogue is bounded."""
    kinds = closure.filter(F.col("ancestor") == wanted).select(F.col("concept").alias(kind))
    return rows.join(F.broadcast(kinds), kind, "left_semi")


def with_events_for_all(patients: DataFrame, views: list[DataFrame]) -> DataFrame:
    """Patients that still have a kept event for every step."""
    for view in views:
        patients = patients.join(view.select("patient"), "patient", "left_semi")
    return patients


def converted(value: Column, unit: Column, factors: dict[tuple[str, str], str], target: str) -> Column:
    """A decimal value in the target unit, by exact decimal factors; null for units without one."""
    out = F.when(unit == target, value.cast("decimal(38,9)"))
    for (source, to), factor in sorted(factors.items()):
        if to == target:
            out = out.when(unit == source, (value * F.lit(factor).cast("decimal(18,6)")).cast("decimal(38,9)"))
    return out


def age_range(birth: Column, years: Column) -> tuple[Column, Column]:
    """The first and the last day on which somebody born on that day is so many years old; a day that a month lacks is its last."""
    return F.add_months(birth, 12 * years), F.date_sub(F.add_months(birth, 12 * (years + 1)), 1)


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9_-]+\z"), F.lit(False))
