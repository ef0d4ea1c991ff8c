"""Reading foreign shapes into model tables: whole-document JSON, CSV with a fixed header, dates written in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "array<bigint>"
DOCUMENT = f"""profile string, dataset_id string, closure struct<version: string, ancestors: map<string, array<string>>>, patients array<struct<patient_id: string, clock_id: string,
events: array<struct<event_id: string, concepts: array<string>, source: string, start: {RANGE}, end: {RANGE}, start_var: string, end_var: string, proper: boolean>>,
coverage: array<struct<source: string, lo: bigint, hi: bigint, basis: string>>, excluded: array<struct<source: string, concept: string, start: {RANGE}, reason: string>>,
series: array<struct<event_id: string, item_class: string, value_lexical: string, unit: string>>>>"""


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """events, event_concepts, coverage, excluded, series and closure of JSON documents of one cohort each; anything but the schema fails the read."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    people = docs.select(F.explode("patients").alias("p")).select("p.*")
    e = people.select(F.col("patient_id").alias("patient"), "clock_id", F.explode("events").alias("e"))
    start, end = (lambda i: F.get(F.col("e.start"), F.lit(i))), (lambda i: F.get(F.col("e.end"), F.lit(i)))
    point = F.col("e.end").isNull()
    events = e.select(
        "patient", F.col("e.event_id").alias("event_id"), F.col("e.source").alias("source"), F.col("clock_id").alias("clock"), start(0).alias("lo"), start(1).alias("hi"), F.when(point, start(0)).otherwise(end(0)).alias("end_lo"), F.when(point, start(1)).otherwise(end(1)).alias("end_hi"),
        (~point & end(1).isNull()).alias("ongoing"), F.col("e.start_var").alias("start_var"), F.col("e.end_var").alias("end_var"), F.coalesce("e.proper", F.lit(False)).alias("proper"),
    )
    listed = lambda field: people.select(F.col("patient_id").alias("patient"), F.inline(field))
    closure = docs.select(F.explode("closure.ancestors").alias("concept", "ancestors")).select("concept", F.explode(F.array_union("ancestors", F.array("concept"))).alias("ancestor")).distinct()
    return {
        "events": events, "event_concepts": e.select("patient", F.col("e.event_id").alias("event_id"), F.explode("e.concepts").alias("concept")).distinct(), "coverage": listed("coverage"),
        "excluded": listed("excluded").select("patient", "source", "concept", F.get("start", F.lit(0)).alias("x_lo"), F.get("start", F.lit(1)).alias("x_hi"), "reason"), "series": listed("series"), "closure": closure,
    }


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header must be the schema's names in order, and whose every field must have its type."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def preflight(rows: DataFrame, item: str, unit: str, value: str) -> DataFrame:
    """Counters of each item before any is accepted: rows, missing values, distinct units, least and greatest."""
    return rows.groupBy(item).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.count_distinct(unit).alias("units"), F.min(value).alias("least"), F.max(value).alias("greatest"))


#: Ways to write a date, as (pattern with year, month and day groups, order of the groups) (fixed values).
DATES = [(r"\b(\d{4})-(\d{2})-(\d{2})\b", (1, 2, 3)), (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", (3, 1, 2)), (r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", (3, 2, 1))]


def mention_days(text: Column) -> Column:
    """The distinct days that a text names, sorted; parts that are no date are left out."""

    days = F.concat(*(F.transform(F.arrays_zip(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)).alias(n) for g, n in zip(o, "ymd", strict=True))), _day) for p, o in DATES))
    return F.array_sort(F.array_distinct(F.filter(days, lambda d: d.isNotNull())))


def _day(x: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", x["y"].cast("int"), x["m"].cast("int"), x["d"].cast("int")), "yyyy-MM-dd")


def narrowed(lo: Column, hi: Column, days: Column) -> dict[str, Column]:
    """A range of days narrowed to the one day that a text names, where it names just one and that lies within; else left as it is."""
    one = (F.size(days) == 1) & F.get(days, F.lit(0)).between(lo, hi)
    return {"lo": F.when(one, F.get(days, F.lit(0))).otherwise(lo), "hi": F.when(one, F.get(days, F.lit(0))).otherwise(hi), "narrowed": F.coalesce(one, F.lit(False))}
