"""What the operators share: reading tables, cutting lineage, moving Arrow strings to numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from trailmark.lineage import cut, shared_dir, staged

__all__ = ["CHUNK", "column", "cut", "flat", "shared_dir", "slices", "staged", "table", "take_ranges", "text_column"]

#: Code points (or bytes) that one numpy pass inside a task works on; longer documents are passed alone.
CHUNK = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    found = batch.column(batch.schema.get_field_index(name))
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def text_column(batch: pa.RecordBatch, name: str) -> pa.LargeStringArray:
    """The column's strings, nulls as empty strings."""
    return pc.fill_null(column(batch, name).cast(pa.large_string()), "")


def flat(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings, one after the other, and the offsets of each."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(strings: pa.LargeStringArray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    ends, a = flat(strings)[1], 0
    while a < len(strings):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all ranges [start, start + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
