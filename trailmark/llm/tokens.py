"""Token ids in training order, as fixed-stride binary shards.

Documents are encoded once and packed: a document's ids, then one separator, are appended to the task's stream, which is cut every
`length` ids; the last sequence of a task is filled up with separators. The packed sequences are written to the shared folder, so
that their tasks and places there are fixed whatever is lost or run again, and are counted. A sequence's number is its task's first
number (a prefix sum over tasks) plus its place; a keyed Feistel permutation of 0 .. n - 1, cycle-walking back into that range,
turns numbers into global slots. Slots are cut into equal ranges, one for each shard. A shard is written as records of `length`
little-endian unsigned integers of 16 bits (32 for larger vocabularies), and the record of a slot is the slot less the shard's
first, so that any slot's bytes are at a known offset: reading is sequential and can go on from any slot.

Slots depend on the seed and the numbers of the sequences alone; which ids a sequence has depends on how the input is split into tasks.

A shard is written under a name of its attempt and then renamed, so that tasks may be lost, repeated or run twice.

Cases: a null or empty text is one separator; repeated rows are each written; very long texts run over as many sequences as they
need; an empty table writes no records; a null id is listed as null; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm import bpe
from trailmark.llm.common import column, cut, shared_dir, staged

LENGTH, SHARD_BYTES, LEAST_SHARDS, SEED, ROUNDS = 2048, 64 << 20, 48, 20_240_229, 6


def permuted(numbers: np.ndarray, size: int, seed: int = SEED) -> np.ndarray:
    """Each number's place under a keyed permutation of 0 .. size - 1: a balanced Feistel network on the next even number of bits,
    applied again while the result is outside."""
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "little")) for i in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            mixed = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(size))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def packed(docs: DataFrame, path: str, separator: int, length: int, key: str, text: str) -> DataFrame:
    """task, place (of the sequence in its task), payload (binary) and docs (doc, doc_start, start and n of each piece) for each sequence. One
    Python step does it all: a second one would be a second worker beside each task's."""
    rows, kind = bpe._rows(docs, key, text)
    vocabulary, code = bpe.shipped(docs.sparkSession, path), "<u2" if separator < 1 << 16 else "<u4"
    width = np.dtype(code).itemsize

    def run(batches):
        task = TaskContext.get().partitionId()
        rest, held, made = np.zeros(0, code), [], 0  # what is left of the stream, and its pieces

        def sequences(stream: np.ndarray, pieces: list[tuple]) -> pa.RecordBatch:
            """pieces: key, first id in its document, first id in the stream, ids; in the stream's order."""
            nonlocal made
            count = len(stream) // length
            listed: list[list[dict]] = [[] for _ in range(count)]
            for k, doc_start, start, n in pieces:
                while n and start // length < count:
                    here = min(n, length - start % length)
                    listed[start // length].append({"doc": k, "doc_start": doc_start, "start": start % length, "n": here})
                    doc_start, start, n = doc_start + here, start + here, n - here
            places = made + np.arange(count)
            made += count
            data = stream[: count * length].tobytes()
            payload = [data[i * length * width : (i + 1) * length * width] for i in range(count)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(count, task, np.int32)), pa.array(places), pa.array(payload, pa.binary()), pa.array(listed, piece_kind)], ["task", "place", "payload", "docs"])

        for _, keys, ids, offsets in bpe.encoded(batches, vocabulary.value):
            piece_kind = pa.list_(pa.struct([("doc", keys.type), ("doc_start", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))
            counts = np.diff(offsets) + 1
            stream = np.full(len(rest) + int(counts.sum()), separator, code)
            stream[: len(rest)] = rest
            first = len(rest) + np.cumsum(counts) - counts
            inside = np.ones(len(stream), bool)
            inside[: len(rest)] = inside[first + counts - 1] = False
            stream[inside] = ids
            pieces = [*held, *zip(keys.to_pylist(), [0] * len(counts), first.tolist(), counts.tolist(), strict=True)]
            yield sequences(stream, pieces)
            used = len(stream) // length * length
            rest = stream[used:]
            held = [(k, d + max(0, used - s), max(0, s - used), n - max(0, used - s)) for k, d, s, n in pieces if s + n > used]
        if len(rest):
            yield sequences(np.append(rest, np.full(length - len(rest), separator, code)).astype(code), held)

    return rows.mapInArrow(run, f"task int, place bigint, payload binary, docs array<struct<doc: {kind}, doc_start: bigint, start: int, n: int>>")


def slotted(sequences: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """The rows of packed(), which must be a written table, with their global slot and with compressed payloads; and how many there are."""
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    counts = cut(sequences.groupBy("task").agg(F.count("*").alias("n")))
    size = counts.agg(F.sum("n")).first()[0] or 0
    firsts = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = sequences.join(F.broadcast(firsts), "task").select((F.col("first") + F.col("place")).alias("number"), "payload", "docs")

    def run(batches):
        squeeze = zstandard.ZstdCompressor()
        for batch in batches:
            slots = permuted(np.asarray(column(batch, "number")), size, seed)
            payload = [squeeze.compress(x.as_buffer()) for x in column(batch, "payload")]
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(payload, pa.binary()), column(batch, "docs")], ["slot", "payload", "docs"])

    return numbered.mapInArrow(run, f"slot bigint, payload binary, docs {numbered.schema['docs'].dataType.simpleString()}"), size


class Written(NamedTuple):
    folder: str
    sequences: DataFrame  #: slot, shard, record, docs
    length: int
    code: str


def write(docs: DataFrame, path: str, separator: int, folder: str | None = None, length: int = LENGTH, seed: int = SEED, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS) -> Written:
    """Writes all documents' ids to shards in `folder` (of the shared folder where it isn't given)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    code = "<u2" if separator < 1 << 16 else "<u4"
    placed, size = slotted(staged(packed(docs, path, separator, length, key, text), "sequences", compression="zstd"), seed)
    count = max(1, min(size, max(least_shards, -(-size * length * np.dtype(code).itemsize // shard_bytes))))
    per = max(1, -(-size // count))  # slots of each shard
    ranges = placed.withColumn("shard", F.expr(f"slot div {per}").cast("int")).repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "slot")
    pieces = placed.schema["docs"].dataType.simpleString()

    def stored(batches):
        context, out, name, shard, record = TaskContext.get(), None, None, None, 0
        store, root = fs.FileSystem.from_uri(folder)
        expand = zstandard.ZstdDecompressor()

        def close():
            if out is not None:
                out.close()
                store.move(name, shard_file(root, shard))

        for batch in batches:
            for own, slot, payload in zip(column(batch, "shard").to_pylist(), column(batch, "slot").to_pylist(), column(batch, "payload"), strict=True):
                if own != shard:
                    close()
                    shard, record = own, 0
                    store.create_dir(root, recursive=True)
                    name = f"{shard_file(root, shard)}.{context.taskAttemptId()}"
                    out = store.open_output_stream(name)
                if slot != own * per + record:
                    raise ValueError(f"slot {slot} isn't record {record} of shard {own}")
                out.write(expand.decompress(payload.as_buffer()))
                record += 1
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("slot", "shard", "docs")], ["slot", "shard", "docs"])
        close()

    written = cut(ranges.mapInArrow(stored, f"slot bigint, shard int, docs {pieces}"))
    return Written(folder, written.select("slot", "shard", (F.col("slot") - F.col("shard") * per).alias("record"), "docs"), length, code)


def shard_file(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:08d}.bin"


def records(folder: str, shard: int, length: int, code: str, start: int = 0) -> Iterator[np.ndarray]:
    """The records of a shard from number `start` on, read in sequence."""
    store, root = fs.FileSystem.from_uri(folder)
    stride = length * np.dtype(code).itemsize
    with store.open_input_file(shard_file(root, shard)) as file:
        file.seek(start * stride)
        while data := file.read(stride):
            yield np.frombuffer(data, code)


def read_back(found: Written, separator: int) -> DataFrame:
    """slot, shard, byte_offset, n_tokens (without separators), ids_sha256 (of the record's bytes) and doc_ids of each sequence, read from
    the shards."""
    folder, length, code = found.folder, found.length, found.code
    stride = length * np.dtype(code).itemsize

    def run(batches):
        shard, reader, at = None, None, 0
        for batch in batches:
            out: list[list] = [[], []]
            for own, record in zip(column(batch, "shard").to_pylist(), column(batch, "record").to_pylist(), strict=True):
                if own != shard or record != at:
                    shard, at, reader = own, record, records(folder, own, length, code, record)
                ids, at = next(reader), at + 1
                out[0].append(int((ids != separator).sum()))
                out[1].append(hashlib.sha256(ids.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("slot", "shard", "record", "doc_ids")), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["slot", "shard", "record", "doc_ids", "n_tokens", "ids_sha256"])

    rows = found.sequences.select("slot", "shard", "record", F.array_distinct(F.transform("docs", lambda d: d["doc"])).alias("doc_ids"))
    kind = rows.schema["doc_ids"].dataType.simpleString()
    read = rows.mapInArrow(run, f"slot bigint, shard int, record bigint, doc_ids {kind}, n_tokens bigint, ids_sha256 string")
    return read.select("slot", "shard", (F.col("record") * stride).alias("byte_offset"), "n_tokens", "ids_sha256", "doc_ids")
