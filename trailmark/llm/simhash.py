"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Fingerprints that differ in at most two bits share at least six of their eight positional bytes:
the guaranteed minimum. Postings are keyed by KEYED positions and their bytes, since single bytes would put every 256th fingerprint
into one. A pair that shares s positional bytes meets in C(s, KEYED) postings, so counting a pair's postings counts its shared
bytes; pairs that reach the count of the guaranteed minimum are retained and verified by the bits of the difference. A posting of
many members emits no pairs: its members send themselves to the fingerprints one bit away, and two members at most two bits apart
are just those that meet at such a centre. (A pair within two bits either meets in small postings only, and is counted in full, or
has both its members in a large one.) Only distinct fingerprints are indexed, so copies of a text cost one row. Linked fingerprints
then become components by star contraction.

Cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer than three words
make one shingle; repeated rows and tied documents share a fingerprint and a component; a null id takes part, but a component's
id is its smallest non-null id; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import column, cut, text_column

SHINGLE, SEED, MOST_BITS, SMALL_POSTING = 3, 42, 2, 16
#: Positions that key a posting, and the postings in which fingerprints of the guaranteed minimum of shared bytes meet.
KEYED = 5
LEAST_POSTINGS = comb(8 - MOST_BITS, KEYED)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    count = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for a in range(0, count, 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (64 bits as a signed long) for each row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x) for x in text_column(batch, "text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(found.view(np.int64))], ["key", "fp"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp bigint").withColumnRenamed("key", key)


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def postings(distinct: DataFrame) -> DataFrame:
    """positions (a number for each choice), bytes (those there) and members of each posting with more than one fingerprint."""
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(8), KEYED)]
    keyed = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("positions"), F.col("fp").bitwiseAND(_signed(m)).alias("bytes")) for i, m in enumerate(masks)))
    # few bytes become many rows here: dealt out by number, partitions aren't joined by their size before
    spread = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.select("fp", F.inline(keyed)).groupBy("positions", "bytes").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)


def links(distinct: DataFrame) -> DataFrame:
    """a < b, fingerprints that differ in 1 or 2 bits; enough of them to connect all that are linked."""
    found = cut(postings(distinct))
    pairs = F.flatten(
        F.transform("members", lambda x, i: F.transform(F.slice("members", i + 2, F.greatest(F.size("members") - i - 1, F.lit(0))), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))))
    )
    few = found.filter(F.size("members") <= SMALL_POSTING).select(F.inline(pairs))
    tallied = few.groupBy("a", "b").agg(F.count("*").alias("shared_postings"))
    verified = tallied.filter((F.col("shared_postings") >= LEAST_POSTINGS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)).select("a", "b")
    many = found.filter(F.size("members") > SMALL_POSTING).select(F.explode("members").alias("fp")).distinct()
    centres = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_signed(1 << i)) for i in range(64)))
    met = many.select("fp", F.explode(centres).alias("centre")).groupBy("centre").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("near"))
    stars = met.filter(F.size("near") > 1).select("a", F.explode("near").alias("b")).filter("a <> b")
    return verified.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that it is connected with) for each node of the edges (a, b), by large and small stars."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        sides = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            sides = sides.filter("v < u")
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = sides.join(least, "u")
        if large:
            return met.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        return met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()

    state, edges = None, cut(edges)
    while True:
        edges = cut(stars(stars(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp and component_id (the smallest key of its component) for each row."""
    rows = cut(fingerprints(docs, key, text))
    distinct = rows.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(distinct.select("fp")))
    members = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(members.join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", grouped: Callable[[DataFrame, str, str], DataFrame] = classes) -> DataFrame:
    """One row of each component that grouped() finds: the one with the smallest key, null last, and of one key's texts that with the smallest hash. Of
    rows with the same key and text any one is kept."""
    row = F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("text"))
    found = grouped(docs.select(row.alias("_row"), F.col(text).alias("_text")), "_row", "_text")
    first = cut(found.filter("_row = component_id").groupBy(F.col("_row.key").alias("_kept"), F.col("_row.text").alias("_kept_text")).count())
    kept = docs.join(first, docs[key].eqNullSafe(first["_kept"]) & (F.xxhash64(docs[text].cast("string")) == first["_kept_text"]), "left_semi")
    if not first.filter("count > 1").limit(1).count():  # rows are thin here, and whole ones dear to shuffle
        return kept
    own = "_hash"
    while own in docs.columns:
        own += "_"
    return kept.withColumn(own, F.xxhash64(F.col(text).cast("string"))).dropDuplicates([key, own]).drop(own)
