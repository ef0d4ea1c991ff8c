"""Model tables: their schemas, and the driver's tables read as them.

Events are points or intervals of one patient, with a kind, a source, a clock and a range for each end. The concept closure is a
small reference table of (concept, ancestor), reflexive, made when the catalogue is loaded and bounded by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions import timealg as ta
from trailmark.lineage import cut

MINUTE, HOUR, DAY = (ta.UNITS[u] for u in ("minute", "hour", "day"))
#: Direct broader concepts of the event types (fixed values).
PARENTS = {"click": "interaction", "view": "interaction", "purchase": "conversion", "signup": "conversion", "error": "incident", "interaction": "activity", "conversion": "activity"}
#: Values above this were left out by the ingest (fixed value).
EXCLUDED_ABOVE = 480

EVENTS = T.StructType([T.StructField(n, t) for n, t in (("patient", T.LongType()), ("event_id", T.LongType()), ("kind", T.StringType()), ("source", T.StringType()), ("clock", T.StringType()), ("lo", T.LongType()), ("hi", T.LongType()), ("end_lo", T.LongType()), ("end_hi", T.LongType()), ("value", T.DoubleType()), ("micro", T.LongType()))])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def closure(spark: SparkSession, parents: dict[str, str] = PARENTS) -> DataFrame:
    """concept and ancestor, with each concept its own ancestor."""
    rows = []
    for concept in {*parents, *parents.values()}:
        at: str | None = concept
        while at:
            rows.append((concept, at))
            at = parents.get(at)
    return spark.createDataFrame(sorted(rows), "concept string, ancestor string")


def transitive(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """The reflexive closure of (concept, parent) for catalogues with many parents, by doubling paths until nothing is new."""
    nodes = edges.select(F.col("concept").alias("a")).union(edges.select("parent")).distinct()
    found = edges.select(F.col("concept").alias("a"), F.col("parent").alias("b")).union(nodes.select("a", F.col("a").alias("b"))).distinct()
    before = -1
    for _ in range(rounds):
        found = cut(found)
        count = found.count()
        if count == before:
            break
        before = count
        found = found.union(found.alias("x").join(found.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")).distinct()
    return found.select(F.col("a").alias("concept"), F.col("b").alias("ancestor"))


def events(spark: SparkSession, sf_dir: str, uncertain: bool = False) -> DataFrame:
    """The events table as point events; uncertain: with ranges of up to an hour to either side, by event id."""
    t = ta.micros_of(F.col("ts"))
    before, after = ((F.col("event_id") % 5) * (10 * MINUTE), (F.col("event_id") % 7) * (10 * MINUTE)) if uncertain else (F.lit(0), F.lit(0))
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("patient"), "event_id", F.col("event_type").alias("kind"), F.col("event_type").alias("source"), F.lit("utc").alias("clock"), (t - before).alias("lo"), (t + after).alias("hi"), "value", F.round(F.col("value") * 1_000_000).cast("long").alias("micro")
    )
    return rows.withColumn("end_lo", F.col("lo")).withColumn("end_hi", F.col("hi"))


def windows(rows: DataFrame) -> DataFrame:
    """patient, w_start and w_end: day 5 to day 20 of each history; null (no window) for every tenth patient."""
    first = rows.groupBy("patient").agg(F.min("lo").alias("first"))
    at = lambda days: F.when(F.col("patient") % 10 != 0, F.col("first") + days * DAY)
    return first.select("patient", at(5).alias("w_start"), at(20).alias("w_end"))


def coverage(rows: DataFrame) -> DataFrame:
    """patient, source, c_lo and c_hi: the period in which a source could have recorded; none for every fourth patient."""
    return rows.filter("patient % 4 <> 0").groupBy("patient", "source").agg(F.min("lo").alias("c_lo"), F.max("hi").alias("c_hi"))


def excluded(rows: DataFrame) -> DataFrame:
    """patient, source, concept, x_lo and x_hi of records that the ingest left out."""
    return rows.filter(F.col("value") > EXCLUDED_ABOVE).groupBy("patient", "source", F.col("kind").alias("concept"), F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi")).agg(F.count("*").alias("n"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with items as interval events of their customer: first to last shipping."""
    days = lambda f: ta.micros_of(f("l_shipdate").cast("timestamp_ntz"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(days(F.min).alias("s"), days(F.max).alias("e"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("patient"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("status"))
    return orders.join(lines.filter("s < e"), "event_id").select("patient", "event_id", "kind", "status", "s", "e")


def with_concepts(rows: DataFrame, concepts: DataFrame, kind: str = "kind") -> DataFrame:
    """One row for each event and concept that it stands for; the catalogue is a bounded reference table."""
    return rows.join(F.broadcast(concepts), F.col(kind) == F.col("concept")).drop("concept").withColumnRenamed("ancestor", "concept")


def of_concept(rows: DataFrame, concepts: DataFrame, wanted: str) -> DataFrame:
    """Events that stand for a concept."""
    kinds = concepts.filter(F.col("ancestor") == wanted).select(F.col("concept").alias("kind"))
    return rows.join(F.broadcast(kinds), "kind", "left_semi")


def unknown_concepts(concepts: DataFrame, wanted: list[str]) -> list[str]:
    """Those of the wanted concepts that the catalogue lacks: asking for them is an error, never an empty match."""
    known = {r[0] for r in concepts.filter(F.col("ancestor").isin(wanted)).select("ancestor").distinct().collect()}  # at most as many as wanted
    return sorted(set(wanted) - known)


#: How many kinds of the wanted concepts are named in a plan at most; beyond, they are joined.
MOST_KINDS = 10_000


class Kinds:
    """The kinds that stand for each of the wanted concepts, from one read of the catalogue. Few of them are named in filters, which reach
    the scan; those of a large catalogue stay a table. Asking for a concept that the catalogue lacks is an error, never an empty match."""

    def __init__(self, concepts: DataFrame, wanted: set[str]):
        self.table, self.sets = concepts.select("concept", "ancestor"), None
        rows = self.table.filter(F.col("ancestor").isin(sorted(wanted))).distinct().limit(MOST_KINDS + 1).collect()
        if len(rows) <= MOST_KINDS:
            self.sets = {c: {r.concept for r in rows if r.ancestor == c} for c in wanted}
        missing = sorted(c for c, kinds in self.sets.items() if not kinds) if self.sets is not None else unknown_concepts(concepts, sorted(wanted))
        if missing:
            raise ValueError(f"unknown concepts: {', '.join(missing)}")

    def of(self, rows: DataFrame, wanted: set[str]) -> DataFrame:
        """Events that stand for any of the concepts, once each."""
        if self.sets is not None:
            return rows.filter(F.col("kind").isin(sorted(set().union(*(self.sets[c] for c in wanted)))))
        return rows.join(self.table.filter(F.col("ancestor").isin(sorted(wanted))).select(F.col("concept").alias("kind")), "kind", "left_semi")

    def marked(self, rows: DataFrame, wanted: set[str], name: str, kind: str = "kind") -> DataFrame:
        """rows with whether their kind stands for any of the concepts."""
        if self.sets is not None:
            return rows.withColumn(name, F.col(kind).isin(sorted(set().union(*(self.sets[c] for c in wanted)))))
        named = self.table.filter(F.col("ancestor").isin(sorted(wanted))).select(F.col("concept").alias(kind)).distinct().withColumn(name, F.lit(True))
        return rows.join(named, kind, "left").withColumn(name, F.coalesce(name, F.lit(False)))

    def meet(self, one: set[str], other: set[str]) -> bool:
        """Whether some kind stands for concepts of both."""
        if self.sets is not None:
            return bool(set().union(*(self.sets[c] for c in one)) & set().union(*(self.sets[c] for c in other)))
        side = lambda cs: self.table.filter(F.col("ancestor").isin(sorted(cs))).select("concept").distinct()
        return bool(side(one).join(side(other), "concept").limit(1).count())


def offset_micros(text: Column, origin: Column) -> Column:
    """Zoned date and time text minus a zoned origin, in microseconds."""
    return F.unix_micros(F.to_timestamp(text)) - F.unix_micros(F.to_timestamp(origin))
