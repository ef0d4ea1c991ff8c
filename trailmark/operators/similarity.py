"""Explainable similarity: concept distances, weighted mixtures with coverage, ranking, retrieval metrics.

Concept sets are exploded and met by joins on the concept, so that sizes of intersections come from aggregation; the reference side
is one query patient (or few), its expanded concepts bounded by the catalogue.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 12


def information_content(concepts: DataFrame, n_patients: int) -> DataFrame:
    """concept and ic: -ln((count + 1) / (patients + 1)), rounded half even to 12 places."""
    counts = concepts.select("patient", "concept").distinct().groupBy("concept").count()
    return counts.select("concept", F.bround(-F.log((F.col("count") + 1) / F.lit(n_patients + 1)), PLACES).alias("ic"))


def _shared(concepts: DataFrame, reference: int) -> tuple[DataFrame, DataFrame]:
    rows = concepts.select("patient", "concept").distinct()
    wanted = rows.filter(F.col("patient") == reference).select("concept")
    return rows, wanted


def jaccard(concepts: DataFrame, reference: int) -> DataFrame:
    """patient, both and either: sizes of the intersection and the union with the reference's set; the distance is 1 - both / either."""
    rows, wanted = _shared(concepts, reference)
    size = wanted.count()
    sets = rows.join(F.broadcast(wanted.withColumn("_in", F.lit(1))), "concept", "left").groupBy("patient").agg(F.count("*").alias("own"), F.sum(F.coalesce("_in", F.lit(0))).alias("both"))  # the wanted set is one patient's
    return sets.filter(F.col("patient") != reference).select("patient", F.col("both").cast("long").alias("both"), (F.col("own") + size - F.col("both")).cast("long").alias("either"))


def simgic(concepts: DataFrame, ic: DataFrame, reference: int) -> DataFrame:
    """patient and distance: 1 - ic of the intersection / ic of the union."""
    rows, wanted = _shared(concepts, reference)
    weight = F.round(F.col("ic") * F.lit(1e12)).cast("long")  # whole numbers add up exactly in any order
    weighed = rows.join(F.broadcast(ic.select("concept", weight.alias("weight"))), "concept")
    total = weighed.filter(F.col("patient") == reference).agg(F.sum("weight")).first()[0] or 0
    own, both = F.sum("weight").alias("own"), F.sum(F.when(F.col("_in"), F.col("weight")).otherwise(0)).alias("both")
    sums = weighed.join(F.broadcast(wanted.withColumn("_in", F.lit(True))), "concept", "left").groupBy("patient").agg(own, both)
    either = F.col("own") + F.lit(total) - F.col("both")
    distance = F.when(either == 0, F.lit(0.0)).otherwise(1 - F.col("both").cast("double") / either.cast("double"))
    return sums.filter(F.col("patient") != reference).select("patient", F.round(distance, 9).alias("distance"))


def resnik(recorded: DataFrame, closure: DataFrame, ic: DataFrame, reference: int) -> DataFrame:
    """patient and distance: 1 - the mean over the reference's concepts of the best shared ancestor's ic over the concept's own; recorded: patient, kind."""
    expanded = recorded.select("patient", "kind").distinct().join(F.broadcast(closure), F.col("kind") == F.col("concept")).select("patient", "kind", "ancestor").join(F.broadcast(ic.select(F.col("concept").alias("ancestor"), "ic")), "ancestor")
    own = expanded.filter(F.col("patient") == reference).select(F.col("kind").alias("r_kind"), "ancestor", F.col("ic").alias("r_ic"))
    best_own = own.groupBy("r_kind").agg(F.max("r_ic").alias("own_ic"))
    met = expanded.select("patient", "ancestor", "ic").distinct().join(F.broadcast(own), "ancestor").groupBy("patient", "r_kind").agg(F.max("ic").alias("best"))
    scored = met.join(F.broadcast(best_own), "r_kind").withColumn("share", F.when(F.col("own_ic") > 0, F.col("best") / F.col("own_ic")).otherwise(0.0))
    kinds = best_own.count()
    return scored.groupBy("patient").agg(F.round(1 - F.sum("share") / kinds, 9).alias("distance")).filter(F.col("patient") != reference)


def weighted(components: list[tuple[Column, int]], least_coverage: Decimal) -> tuple[Column, Column, Column]:
    """ranking distance, coverage and whether it is rankable, of (distance or null, weight): missing mass counts as 1."""
    total = sum(w for _, w in components)
    seen = sum((F.when(d.isNotNull(), w).otherwise(0) for d, w in components), F.lit(0))
    mass = sum((F.coalesce(d, F.lit(0)).cast("decimal(18,9)") * w for d, w in components), F.lit(0).cast("decimal(18,9)"))
    coverage = seen.cast("decimal(18,9)") / total
    return ((total - seen).cast("decimal(18,9)") + mass) / total, coverage, coverage >= F.lit(least_coverage)


def ranked(rows: DataFrame, distance: str, key: str, k: int) -> DataFrame:
    """The k nearest, ties by key, with their rank: a heap in each task, then one merge of k rows each."""
    top = rows.orderBy(F.col(distance).asc_nulls_last(), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(distance).asc_nulls_last(), key)).cast("long"))  # k rows


def eligible(rows: DataFrame, predicates: list[Column]) -> DataFrame:
    """filter_state: excluded where a predicate is false, unresolved where one is unknown, else eligible."""
    false = F.lit(False)
    unknown = F.lit(False)
    for p in predicates:
        false, unknown = false | F.coalesce(~p, F.lit(False)), unknown | p.isNull()
    return rows.withColumn("filter_state", F.when(false, "excluded").when(unknown, "unresolved").otherwise("eligible"))


def retrieval(ranks: DataFrame, k: int) -> DataFrame:
    """query, precision, recall, reciprocal rank and average precision at k, of (query, rank, relevant)."""
    w = Window.partitionBy("query").orderBy("rank")
    hits = ranks.withColumn("hits", F.sum("relevant").over(w))
    at = F.col("rank") <= k
    return hits.groupBy("query").agg(
        F.round(F.sum(F.when(at, F.col("relevant"))) / k, 9).alias("precision"), F.round(F.sum(F.when(at, F.col("relevant"))) / F.sum("relevant"), 9).alias("recall"),
        F.round(F.coalesce(1 / F.min(F.when(F.col("relevant") == 1, F.col("rank"))), F.lit(0.0)), 9).alias("reciprocal_rank"), F.round(F.coalesce(F.sum(F.when(F.col("relevant") == 1, F.col("hits") / F.col("rank"))) / F.sum("relevant"), F.lit(0.0)), 9).alias("average_precision"),
    )


def measure_metrics(distances: dict[str, DataFrame], relevant: DataFrame, at_precision: int = 5, at_recall: int = 10) -> DataFrame:
    """measure, average_precision, precision, recall and reciprocal_rank of each ranking (key and distance) against the relevant keys: how soon each measure
    finds them. Ranks, and the place of each hit among the hits, come from counts of ranges; no task sees a whole ranking."""
    from trailmark.operators.records import ranked_missing_last

    out = None
    for name, rows in sorted(distances.items()):
        ranks = ranked_missing_last(rows.filter("distance IS NOT NULL").select("patient", "distance"), "distance", "patient")
        hits = ranks.join(relevant.select("patient").distinct(), "patient", "left_semi").select("patient", F.col("rank").alias("at"))
        hits = ranked_missing_last(hits, "at", "patient")
        n = F.count("*")
        share = lambda x, of: F.when(n > 0, F.round(x / of, 9)).otherwise(0.0)  # noqa: B023, E731
        own = hits.agg(
            share(F.sum(F.col("rank") / F.col("at")), n).alias("average_precision"), F.round(F.count_if(F.col("at") <= at_precision) / at_precision, 9).alias("precision"), share(F.count_if(F.col("at") <= at_recall), n).alias("recall"), F.coalesce(F.round(1 / F.min("at"), 9), F.lit(0.0)).alias("reciprocal_rank")
        ).select(F.lit(name).alias("measure"), "*")
        out = own if out is None else out.unionByName(own)
    return out
