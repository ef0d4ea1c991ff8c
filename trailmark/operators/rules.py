"""Set-level rules over statuses: comparability by coverage, records that the ingest left out, two-pass conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.plans.pattern import Pattern
from trailmark.sources.model import Kinds, with_concepts


def uncovered(pattern: Pattern, windows: DataFrame, coverage: DataFrame, sources: DataFrame) -> DataFrame:
    """patient and step for each step that no source able to record it covers in the patient's window. sources: (source, concept), bounded by the catalogue."""
    out = None
    for s in pattern.steps:
        able = sources.filter(F.col("concept").isin(sorted(pattern.concepts()[s.id]))).select("source").distinct()
        covered = coverage.join(F.broadcast(able), "source", "left_semi").join(windows, "patient").filter("c_lo <= w_end AND c_hi >= w_start").select("patient").distinct()
        rows = windows.filter("w_start IS NOT NULL").join(covered, "patient", "left_anti").select("patient", F.lit(s.id).alias("step"))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_coverage(statuses: DataFrame, missing: DataFrame) -> DataFrame:
    """none becomes not_comparable where a step isn't covered; `steps` lists those, sorted."""
    listed = missing.groupBy("patient").agg(F.array_join(F.array_sort(F.collect_set("step")), ",").alias("steps"))
    joined = statuses.join(listed, "patient", "left")
    hit = (F.col("status") == "none") & F.col("steps").isNotNull()
    return joined.withColumn("status", F.when(hit, "not_comparable").otherwise(F.col("status"))).withColumn("steps", F.when(hit, F.col("steps")))


def touched(pattern: Pattern, excluded: DataFrame, closure: DataFrame, windows: DataFrame) -> DataFrame:
    """patient: those with a record that was left out, of a step's concept, whose start the scope admits."""
    wanted = sorted(set().union(*pattern.concepts().values()))
    rows = with_concepts(excluded.withColumnRenamed("concept", "kind"), closure).filter(F.col("concept").isin(wanted)).join(windows.filter("w_start IS NOT NULL"), "patient")
    return rows.filter(admits_start(pattern.scope)).select("patient").distinct()


def admits_start(scope: str) -> Column:
    """Whether the scope admits some start in [x_lo, x_hi]."""
    return {"any": F.lit(True), "from_start": F.col("x_hi") >= F.col("w_start"), "within": (F.col("x_hi") >= F.col("w_start")) & (F.col("x_lo") <= F.col("w_end")), "after": F.col("x_hi") >= F.col("w_end")}[scope]


def refuse_structural(pattern: Pattern, excluded: DataFrame, structural: set[str]) -> None:
    """Records of structural classes can't be seen to be left out: a pattern that names one can't be answered beside left-out records, and is refused."""
    named = sorted(set().union(*pattern.concepts().values()) & structural)
    if named and excluded.limit(1).count():
        raise ValueError(f"records of {', '.join(named)} could have been left out unseen")


def undetermined(pattern: Pattern, findings: DataFrame, closure: DataFrame, windows: DataFrame, steps: list[str]) -> DataFrame:
    """patient, step, reach and admitted: how many undetermined findings (patient, kind, x_lo, x_hi, finding) are of each of the steps' concepts, and how many of
    them start where the scope admits it. Such a finding acts as a record that the ingest left out of that step; windows of null are out of the question."""
    concepts, kinds = pattern.concepts(), Kinds(closure, set().union(*(pattern.concepts()[s] for s in steps)))
    rows, out = findings.filter("finding = 'undetermined'").join(windows.filter("w_start IS NOT NULL"), "patient"), None
    for s in steps:
        own = kinds.of(rows, concepts[s]).groupBy("patient").agg(F.count("*").alias("reach"), F.count_if(admits_start(pattern.scope)).alias("admitted")).select("patient", F.lit(s).alias("step"), "reach", "admitted")
        out = own if out is None else out.unionByName(own)
    return out


def with_undetermined(statuses: DataFrame, reach: DataFrame) -> DataFrame:
    """Statuses after undetermined findings, step by step: where one of a step is admitted, none becomes not_comparable, relaxed unresolved and possible
    incomplete; `steps` lists the steps that it holds for, sorted, whatever the status."""
    admitted = reach.filter("admitted > 0").groupBy("patient").agg(F.array_join(F.array_sort(F.collect_set("step")), ",").alias("steps"))
    return with_exclusions(statuses, admitted.select("patient")).join(admitted, "patient", "left")


def with_exclusions(statuses: DataFrame, touched_: DataFrame) -> DataFrame:
    """none becomes not_comparable, relaxed unresolved, and possible incomplete where a left-out record could have been the step's."""
    joined = statuses.join(touched_.withColumn("_touched", F.lit(True)), "patient", "left")
    hit = F.coalesce("_touched", F.lit(False))
    status = F.when(hit & (F.col("status") == "none"), "not_comparable").when(hit & (F.col("status") == "relaxed"), "unresolved").otherwise(F.col("status"))
    return joined.withColumn("complete", ~(hit & (F.col("status") == "possible"))).withColumn("status", status).drop("_touched")


def two_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """The status of an uncertain condition from the passes with certain tags only and with possible ones too; first, second: patient, status, relaxations."""
    both = first.alias("a").join(second.alias("b"), "patient", "full_outer")
    a, b = F.col("a.status"), F.col("b.status")
    same = (a == "relaxed") & (b == "relaxed") & F.col("a.relaxations").eqNullSafe(F.col("b.relaxations"))
    status = F.when(a.isin("exact", "possible", "unresolved", "excluded"), a).when(same, a).when((a == "none") & (b == "none"), a).otherwise("unresolved")
    return both.select("patient", status.alias("status"))
