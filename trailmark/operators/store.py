"""Derived tables of a snapshot: closure use, postings, sources, buckets, digests, Merkle roots; publishing and opening one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import scalars
from trailmark.lineage import cut
from trailmark.sources.model import with_concepts

SORTED = {"events": ["patient", "lo", "hi", "event_id"], "postings": ["concept", "patient"], "coverage": ["patient", "source", "c_lo"]}


def postings(events: DataFrame, closure: DataFrame) -> DataFrame:
    """patient, concept, n, min_lo, max_hi and max_end (null if any event is ongoing) over distinct events."""
    rows = with_concepts(events.select("patient", "event_id", "kind", "lo", "hi", "end_hi"), closure).drop("kind").distinct()
    return rows.groupBy("patient", "concept").agg(F.count("*").alias("n"), F.min("lo").alias("min_lo"), F.max("hi").alias("max_hi"), F.when(~F.bool_or(F.col("end_hi").isNull()), F.max("end_hi")).alias("max_end"))


def source_concepts(events: DataFrame, closure: DataFrame) -> DataFrame:
    return with_concepts(events.select("source", "kind").distinct(), closure).select("source", "concept").distinct()


def indexed(patients: DataFrame, key: str = "patient") -> DataFrame:
    """key, patient_idx (dense, from zero, in key order) and bucket. Places come from counts of ranges of keys, so that no task
    sees all patients."""
    distinct = patients.select(key).distinct()
    ranged = cut(distinct.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + F.col("offset")
    return ranged.join(F.broadcast(offsets), "_part").select(key, place.cast("long").alias("patient_idx"), scalars.bucket_of(F.col(key)).alias("bucket"))


def loaded(events: DataFrame, closure: DataFrame, wanted: list[str]) -> DataFrame:
    """Events of wanted concepts, with the sorted concepts that each stands for."""
    rows = with_concepts(events, closure).filter(F.col("concept").isin(wanted))
    return rows.groupBy("patient", "event_id", "lo", "hi").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts"))


def shares_variables(events: DataFrame) -> DataFrame:
    """patient and shared: whether some time variable (start_var, end_var) names times of two of the patient's events."""
    named = events.select("patient", "event_id", F.explode(F.array("start_var", "end_var")).alias("variable")).filter("variable IS NOT NULL")
    twice = named.groupBy("patient", "variable").agg((F.min("event_id") != F.max("event_id")).alias("two"))
    return events.select("patient").distinct().join(twice.groupBy("patient").agg(F.bool_or("two").alias("shared")), "patient", "left").select("patient", F.coalesce("shared", F.lit(False)).alias("shared"))


def bucket_digests(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """bucket, n and digest: a chain-free content digest of each bucket, the SHA-256 of its row digests' sums. Sums of two
    independent 60-bit words of each row's SHA-256, so that rows need no order and no task holds a bucket."""
    text = scalars.digest(*(F.col(c) for c in columns))
    words = [F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = rows.select(scalars.bucket_of(F.col(key)).alias("bucket"), *(w.alias(f"w{i}") for i, w in enumerate(words))).groupBy("bucket").agg(F.count("*").alias("n"), *(F.sum(f"w{i}").alias(f"w{i}") for i in range(4)))
    return sums.select("bucket", "n", F.sha2(F.concat_ws(":", "n", *(F.col(f"w{i}").cast("string") for i in range(4))), 256).alias("digest"))


def merkle_levels(leaves: DataFrame, key: str, digest: str) -> DataFrame:
    """level, node, hash: a binary hash tree over leaves in key order; leaves and inner nodes are hashed with different prefixes, and a
    node without a partner is carried up."""
    table = indexed(leaves, key).join(leaves, key)
    level = cut(table.select(F.lit(0).alias("level"), F.col("patient_idx").alias("node"), F.sha2(F.concat(F.lit("\x00"), F.col(digest)), 256).alias("hash")))
    out, n, depth = level, level.count(), 0
    while n > 1:
        depth += 1
        pairs = level.groupBy(F.floor(F.col("node") / 2).alias("node")).agg(F.count("*").alias("n"), F.min_by("hash", level["node"]).alias("left"), F.max_by("hash", level["node"]).alias("right"))
        level = cut(pairs.select(F.lit(depth).alias("level"), "node", F.when(F.col("n") == 1, F.col("left")).otherwise(F.sha2(F.concat(F.lit("\x01"), "left", "right"), 256)).alias("hash")))
        out, n = out.unionByName(level), -(-n // 2)
    return out


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes the tables as Parquet, those with a patient by bucket and sorted for reads, under a name made from their contents; a
    snapshot that is there already is left alone. Returns its path."""
    import hashlib

    names = []
    spark = next(iter(tables.values())).sparkSession
    staging = f"{folder}/_staging-{hashlib.sha256(repr(sorted(tables)).encode()).hexdigest()[:12]}"
    for name, rows in sorted(tables.items()):
        order = SORTED.get(name, [])
        if "patient" in rows.columns:
            rows = rows.withColumn("bucket", scalars.bucket_of(F.col("patient")))
            rows.repartition("bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(f"{staging}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{staging}/{name}")
        back = spark.read.parquet(f"{staging}/{name}")
        found = bucket_digests(back, back.columns[0], sorted(c for c in back.columns if c != "bucket")).orderBy("bucket").collect()  # a row for each bucket
        names.append((name, [(r.bucket, r.n, r.digest) for r in found]))
    identity = hashlib.sha256(repr(names).encode()).hexdigest()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (staging, f"{folder}/{identity}"))
    system = target.getFileSystem(conf)
    if system.exists(target):
        system.delete(source, True)
    elif not system.rename(source, target):
        raise OSError(f"could not publish {identity}")
    return f"{folder}/{identity}"


def attach(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a snapshot, each also a view of its name."""
    out = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    for n, rows in out.items():
        rows.createOrReplaceTempView(n)
    return out


def verified(spark: SparkSession, path: str, names: list[str]) -> bool:
    """Whether a snapshot's contents still have the digest that is its name."""
    import hashlib

    listed = []
    for name in sorted(names):
        back = spark.read.parquet(f"{path}/{name}")
        found = bucket_digests(back, back.columns[0], sorted(c for c in back.columns if c != "bucket")).orderBy("bucket").collect()
        listed.append((name, [(r.bucket, r.n, r.digest) for r in found]))
    return hashlib.sha256(repr(listed).encode()).hexdigest() == path.rstrip("/").rsplit("/", 1)[-1]
