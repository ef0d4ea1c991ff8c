"""Evidence: selection as known at a time, revision chains, claim decisions and conflicts; admission of source rows; rule closure; audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.lineage import cut


def as_known(entries: DataFrame, cutoff: Column, sources: list[str]) -> DataFrame:
    """entries (id, source, supersedes, operation, available) with state: EXCLUDED_SOURCE, UNKNOWN_AVAILABILITY, AFTER_CUTOFF, INELIGIBLE_REVISION_ANCESTOR, REVISION_FORK,
    SUPERSEDED, WITHDRAWAL or ACTIVE."""
    first = F.when(~F.col("source").isin(sources), "EXCLUDED_SOURCE").when(F.col("available").isNull(), "UNKNOWN_AVAILABILITY").when(F.col("available") > cutoff, "AFTER_CUTOFF").otherwise("ELIGIBLE")
    marked = entries.withColumn("state", first)
    later = marked.filter("state = 'ELIGIBLE' AND supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("id")).agg(F.count("*").alias("_successors"))
    before = marked.select(F.col("id").alias("supersedes"), (F.col("state") == "ELIGIBLE").alias("_ancestor"))
    joined = marked.join(later, "id", "left").join(before, "supersedes", "left")
    broken = F.col("supersedes").isNotNull() & ~F.coalesce("_ancestor", F.lit(False))
    state = F.when(F.col("state") != "ELIGIBLE", F.col("state")).when(broken, "INELIGIBLE_REVISION_ANCESTOR").when(F.col("_successors") > 1, "REVISION_FORK").when(F.col("_successors") == 1, "SUPERSEDED").when(F.col("operation") == "withdraw", "WITHDRAWAL").otherwise("ACTIVE")
    return joined.withColumn("state", state).select(*entries.columns, "state")


def decided(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """claims with the latest decision (claim, at, decision): accept, reject, withdraw, or pending."""
    latest = decisions.groupBy("claim").agg(F.max_by("decision", F.struct("at", "decision")).alias("decision"))
    return claims.join(latest, "claim", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def variants(rows: DataFrame, key: str, content: list[str]) -> DataFrame:
    """key, copies and conflict: equal rows of a key coalesce, different ones conflict."""
    hashed = rows.select(key, F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256).alias("_h"))
    return hashed.groupBy(key).agg(F.count("*").alias("copies"), (F.min("_h") != F.max("_h")).alias("conflict"))


def admitted(rows: DataFrame, reasons: dict[str, tuple[str, Column]], identity: list[str], order: list[str]) -> DataFrame:
    """rows with outcome (admitted, unsupported, invalid or duplicate) and every failing reason, sorted. reasons: name to (outcome, test that fails). A duplicate is a repeated row that
    is otherwise admitted, the first in order being kept."""
    failing = F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, (_, test) in reasons.items()))))
    of = lambda kind: [n for n, (k, _) in reasons.items() if k == kind]
    has = lambda names: F.arrays_overlap("reasons", F.array(*map(F.lit, names))) if names else F.lit(False)
    marked = rows.withColumn("reasons", failing)
    rank = F.row_number().over(Window.partitionBy(F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256), F.size("reasons") == 0).orderBy(*order))
    outcome = F.when(has(of("invalid")), "invalid").when(has(of("unsupported")), "unsupported").when(F.col("_nth") > 1, "duplicate").otherwise("admitted")
    return marked.withColumn("_nth", rank).withColumn("outcome", outcome).withColumn("reasons", F.array_join("reasons", ",")).drop("_nth")


def outcome_counts(admitted_: DataFrame) -> DataFrame:
    return admitted_.groupBy("outcome", "reasons").agg(F.count("*").alias("n"))


def chained(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Forward chaining of class rules (if_class, then_class) over facts (entity, class) to the fixpoint. The rules are a bounded catalogue, which is closed
    first, by doubling chains of rules; facts then meet it once."""
    closed, count = cut(rules.select("if_class", "then_class").distinct()), -1
    while (now := closed.count()) != count:
        x, y = closed.alias("x"), closed.alias("y")
        further = x.join(y, F.col("x.then_class") == F.col("y.if_class")).select("x.if_class", "y.then_class")
        closed, count = cut(closed.unionByName(further).distinct()), now
    own = facts.select("entity", "class")
    derived = own.join(F.broadcast(closed), F.col("class") == F.col("if_class")).select("entity", F.col("then_class").alias("class"))
    return own.unionByName(derived).distinct()


def clashes(facts: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Entities in two classes (a, b) that are declared disjoint."""
    x, y = facts.alias("x"), facts.alias("y")
    return x.join(F.broadcast(disjoint), F.col("x.class") == F.col("a")).join(y, (F.col("x.entity") == F.col("y.entity")) & (F.col("y.class") == F.col("b"))).select("x.entity", "a", "b").distinct()


def audited(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and problem (missing, extra or different) by a full outer join, nulls equal."""
    e, a = expected.withColumn("_e", F.lit(True)).alias("e"), actual.withColumn("_a", F.lit(True)).alias("a")
    both = e.join(a, F.col(f"e.{key}") == F.col(f"a.{key}"), "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~same, "different")
    return both.select(F.coalesce(f"e.{key}", f"a.{key}").alias(key), problem.alias("problem")).filter("problem IS NOT NULL")


def first_report(reports: DataFrame, negative: list[str], positive: list[str]) -> DataFrame:
    """patient, finding and at: the first report (patient, at, report, id) that isn't negative; positive ones are found, others undetermined; none if all are negative."""
    kind = F.when(F.col("report").isin(negative), "negative").when(F.col("report").isin(positive), "found").otherwise("undetermined")
    marked = reports.withColumn("kind", kind).filter("kind <> 'negative'").groupBy("patient").agg(F.min_by(F.struct("kind", "at"), F.struct("at", "id")).alias("f"))
    return reports.select("patient").distinct().join(marked, "patient", "left").select("patient", F.coalesce("f.kind", F.lit("none")).alias("finding"), F.col("f.at").alias("at"))
