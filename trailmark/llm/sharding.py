"""Contiguous shards of near-equal bytes, from a global prefix sum.

Rows are put in the order of their key, checksum and size by a range partitioning of thin rows (no text), which a checkpoint then
holds fast. Each partition adds up its own sizes; the partitions' totals (one row for each partition) are summed to offsets; a
row's global place is its partition's offset plus its place within. A row goes to the shard whose equal share of all bytes holds
the row's middle byte, so that cuts fall at equal targets and shards are contiguous.

Cases: a null text weighs the fixed overhead only, as does an empty one; its checksum is that of no bytes; null keys come first;
repeated rows and ties in the key are ordered by checksum and size, so that only equal rows are interchangeable; a row larger
than a share is one row of one shard, and shards that it spans are empty; an empty table gives an empty table; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import column, cut

SHARDS, OVERHEAD = 24, 8


def ordered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, size, crc and part, in the order of the parts and within each."""
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    thin = docs.select(F.col(key).alias("key"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("crc"))
    ranged = thin.repartitionByRange("key", "crc", "size").sortWithinPartitions("key", "crc", "size")
    return cut(ranged.withColumn("part", F.spark_partition_id()))


def placed(rows: DataFrame) -> DataFrame:
    """Each row with first_byte and place, both counted from the start of all rows."""

    def run(batches):
        done_bytes = done_rows = 0
        for batch in batches:
            sizes = np.asarray(column(batch, "size"))
            before = done_bytes + np.cumsum(sizes) - sizes
            place = done_rows + np.arange(len(sizes))
            done_bytes, done_rows = done_bytes + int(sizes.sum()), done_rows + len(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(place)], [*batch.schema.names, "own_bytes", "own_rows"])

    kind = rows.schema["key"].dataType.simpleString()
    local = rows.mapInArrow(run, f"key {kind}, size bigint, crc bigint, part int, own_bytes bigint, own_rows bigint")
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    return local.join(F.broadcast(offsets), "part").select("key", "size", "crc", (F.col("own_bytes") + F.col("bytes_before")).alias("first_byte"), (F.col("own_rows") + F.col("rows_before")).alias("place"))


def shards(docs: DataFrame, count: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot (the place within the shard), grown_shard (null: this law moves rows when the
    number of shards grows)."""
    rows = ordered(docs, key, text)
    total = rows.agg(F.sum("size")).first()[0] or 1
    middle = F.expr(f"cast({count} * (2 * first_byte + size) div (2 * {total}) as int)")
    found = placed(rows).withColumn("shard", F.least(middle, F.lit(count - 1)))
    starts = found.groupBy("shard").agg(F.min("place").alias("start"))  # as many rows as shards
    return found.join(F.broadcast(starts), "shard").select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "first_byte"
    )


#: SQL has no CRC-32, so it is worked out from its table, which a rule gives.
ORACLE_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_value(n, 0, 0, 0, 0, 0, 0, 0, 0), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
data AS (SELECT doc_id, strlen(coalesce(text, '')) + {OVERHEAD} AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
thin AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM data, crc),
placed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, crc, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_byte, sum(size) OVER () AS total FROM thin),
dealt AS (SELECT *, least({SHARDS} * (2 * first_byte + size) // (2 * total), {SHARDS - 1})::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY first_byte) - 1 AS slot, NULL::INTEGER AS grown_shard, first_byte FROM dealt
"""
