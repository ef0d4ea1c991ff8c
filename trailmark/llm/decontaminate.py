"""Benchmark decontamination with suffix arrays over the training text.

Every task cuts its documents into shards and builds a word suffix array of each: suffixes sorted by prefix doubling, first by
four packed word numbers, then by pairs of ranks until no tie is left. Word numbers come from the words of the test block, all
other words and document ends being zero, so a suffix ends for good at the first word that no test text has. The suffixes of the
test texts are binary-searched in every shard, those that begin with the same `size` words at once. The range of suffixes that
begin with a window gives all its occurrences. Each word of a document that is hit is then searched in the test texts' own suffix array, which gives
the longest verbatim match from there, of whatever length, and where it stands; longest_of_items() gives each test text's longest match
with any document, also one shorter than a window, and where it is.

The test texts are a stated query set: they come in blocks of about BLOCK_BYTES, equal texts and all, and each block is searched against all
documents. Only one block at a time is in the driver and on executors: its result is written before the next one is read.

A window is `size` consecutive words of an item; an item of fewer, but not none, is one window. Words are
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased.

Cases: a null or empty text has no words and no hits; items without words never occur; equal items all count; items with a null
id count as hits and are not listed by id; repeated rows are each decided; very long texts are taken whole, alone in their
shard; an empty benchmark leaves all documents clean; an empty table gives an empty table; further columns are ignored by
search() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import column, cut, flat, slices, staged, text_column

WINDOW, BLOCK_BYTES = 10, 8 << 20
#: Lower-cased bytes, zero for those that no word has.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 0 for b in range(256)], np.uint8)
MATCH = "struct<item: string, item_start: bigint, start: bigint, length: bigint>"
RESULT = f"n_words bigint, n_hit bigint, longest bigint, items array<string>, starts array<bigint>, ends array<bigint>, matches array<{MATCH}>"


def words(texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and how many each text has."""
    data, offsets = flat(texts)
    data = BYTES[data]
    inside = data != 0
    begins = inside.copy()
    if len(inside) > 1:
        begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    kept = data[inside]
    starts = np.flatnonzero(begins[inside])
    ends = np.append(starts, len(kept)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    before = np.searchsorted(np.flatnonzero(begins), offsets)
    return found, np.diff(before)


def packed(numbers: np.ndarray, bits: int, per: int) -> np.ndarray:
    """The numbers of `per` words from each place on as one key."""
    out = np.zeros(len(numbers), np.int64)
    padded = np.append(numbers, np.zeros(per, np.int64))
    for k in range(per):
        out = out << bits | padded[k : k + len(numbers)]
    return out


def suffix_array(numbers: np.ndarray, bits: int, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with a number, sorted by the numbers from there up to the next zero, and the packed keys of all places."""
    keys = packed(numbers, bits, per)
    zeros = np.append(np.flatnonzero(numbers == 0), len(numbers))
    array = np.flatnonzero(numbers)
    run = zeros[np.searchsorted(zeros, array)] - array
    order = np.argsort(keys[array], kind="stable")
    array, run = array[order], run[order]
    rank = np.zeros(len(numbers) + 1, np.int64)
    fresh = np.append(True, keys[array[1:]] != keys[array[:-1]]) if len(array) else np.zeros(0, bool)
    depth = per
    while True:
        begins = np.flatnonzero(fresh)
        group = begins[np.cumsum(fresh) - 1] + 1  # a group's rank is the slot where it begins
        rank[array] = group
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        tied = np.flatnonzero(tied & (run >= depth))  # suffixes that end earlier equal the rest of their group
        if not len(tied):
            return array, keys
        places, groups = array[tied], group[tied]
        further = rank[np.minimum(places + depth, len(numbers))]
        order = np.lexsort((further, groups))
        array[tied], run[tied], further = places[order], run[tied][order], further[order]
        fresh[tied[1:][(groups[1:] == groups[:-1]) & (further[1:] != further[:-1])]] = True
        depth *= 2


class Tests:
    """A block of test texts: its vocabulary, its suffix array, the different heads of `size` words of its suffixes, and the items that own each
    head as a window."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        found, counts = words(pa.array([t or "" for _, t in items], pa.large_string()))
        self.vocabulary, self.names, self.size = pc.unique(found), [i for i, _ in items], size
        self.bits = max(1, (len(self.vocabulary) + 1).bit_length())
        self.per = max(1, 62 // self.bits)
        of = np.repeat(np.arange(len(counts)), counts)
        self.numbers = np.zeros(len(found) + len(counts) + size, np.int64)
        spots = np.arange(len(found)) + of  # a zero after each item keeps suffixes inside it
        self.numbers[spots] = np.asarray(pc.index_in(found, self.vocabulary)).astype(np.int64) + 1
        self.begins = np.cumsum(counts) - counts + np.arange(len(counts))
        self.array = suffix_array(self.numbers, self.bits, self.per)[0]
        self.item = np.searchsorted(self.begins, self.array, "right") - 1
        # suffixes with one head are neighbours in the array
        heads = self.numbers[self.array[:, None] + np.arange(size)]
        heads *= np.cumprod(heads != 0, axis=1)
        fresh = np.append(True, (heads[1:] != heads[:-1]).any(axis=1))[: len(heads)]
        self.windows = heads[fresh]
        self.lengths = (self.windows != 0).sum(axis=1)
        head = np.cumsum(fresh) - 1
        # a head is a window of the items that have it whole, or that are no longer than it
        valid = (self.lengths[head] == size) | (self.array == self.begins[self.item])
        owned = np.unique(head[valid] * max(1, len(items)) + self.item[valid])
        self.owners = owned % max(1, len(items))
        self.bounds = np.searchsorted(owned // max(1, len(items)), np.arange(len(self.windows) + 1))

    def items_of(self, window: int) -> np.ndarray:
        return self.owners[self.bounds[window] : self.bounds[window + 1]]


def bounds(array: np.ndarray, keys: np.ndarray, tests: Tests, bits: int, per: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of the suffix array that begins with it, by binary search of all windows at once."""
    chunks = -(-tests.size // per)
    padded = np.zeros((len(tests.windows), chunks * per), np.int64)
    padded[:, : tests.size] = tests.windows
    wanted, masks = np.zeros((chunks, len(padded)), np.int64), np.zeros((chunks, len(padded)), np.int64)
    for c in range(chunks):
        for k in range(per):
            wanted[c] = wanted[c] << bits | padded[:, c * per + k]
            masks[c] = masks[c] << bits | np.where(tests.lengths > c * per + k, (1 << bits) - 1, 0)
    out = []
    for upper in (False, True):
        low, high = np.zeros(len(padded), np.int64), np.full(len(padded), len(array), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            place = array[np.minimum(middle, len(array) - 1)]
            less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
            for c in range(chunks):
                at = place + c * per
                own = np.where(at < len(keys), keys[np.minimum(at, len(keys) - 1)], 0) & masks[c]
                less |= equal & (own < wanted[c])
                equal &= own == wanted[c]
            right = open_ & (less | (equal & upper))
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        out.append(low)
    return out[0], out[1]


def common_length(own: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray) -> np.ndarray:
    """How many words are the same from each place of `own` and from its partner's place of `other` on; zeros equal nothing."""
    out = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero((at < len(own)) & (there < len(other)))
    while len(open_):
        x, y = at[open_] + out[open_], there[open_] + out[open_]
        inside = (x < len(own)) & (y < len(other))
        open_, x, y = open_[inside], x[inside], y[inside]
        same = (own[x] == other[y]) & (own[x] != 0)
        open_ = open_[same]
        out[open_] += 1
    return out


def best_matches(array: np.ndarray, numbers: np.ndarray, other: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of `other` the longest common beginning with any suffix of `numbers`, whose suffix array is `array`, and a place of that one: it
    is a neighbour of where the suffix would be inserted."""
    if not len(array):
        return np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(array), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) >> 1
        there, at = array[middle], places[open_]
        same = common_length(numbers, there, other, at)
        value = lambda source, i: np.where(i < len(source), source[np.minimum(i, len(source) - 1)], 0)
        less = value(numbers, there + same) < value(other, at + same)
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    sides = [array[np.clip(low - 1, 0, len(array) - 1)], array[np.minimum(low, len(array) - 1)]]
    before, after = (common_length(numbers, there, other, places) for there in sides)
    return np.maximum(before, after), np.where(before > after, *sides)


def numbered(texts: pa.LargeStringArray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts with a zero after each, the places of words, and how many each text has."""
    found, counts = words(texts)
    numbers = np.zeros(len(found) + len(counts), np.int64)
    spots = np.arange(len(found)) + np.repeat(np.arange(len(counts)), counts)
    numbers[spots] = np.asarray(pc.fill_null(pc.index_in(found, tests.vocabulary), -1)).astype(np.int64) + 1
    return numbers, spots, counts


def shard(texts: pa.LargeStringArray, tests: Tests) -> list[tuple]:
    """A row like RESULT for each text."""
    numbers, spots, counts = numbered(texts, tests)
    ends = np.cumsum(counts)
    array, keys = suffix_array(numbers, tests.bits, tests.per)
    out = [(int(n), 0, 0, [], [], [], []) for n in counts]
    if not len(array) or not len(tests.windows):
        return out
    low, high = bounds(array, keys, tests, tests.bits, tests.per)
    seen = np.flatnonzero((high > low) & (np.diff(tests.bounds) > 0))
    if not len(seen):
        return out
    sizes = high[seen] - low[seen]
    window = np.repeat(seen, sizes)
    before = np.cumsum(sizes) - sizes
    start = array[np.arange(int(sizes.sum())) + np.repeat(low[seen] - before, sizes)]
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + tests.lengths[window], -1)
    hit = np.cumsum(edge[:-1]) > 0
    begins = ends - counts + np.arange(len(counts))  # of each document
    of = lambda places: np.searchsorted(begins, places, "right") - 1
    document = of(start)
    total = np.bincount(np.repeat(np.arange(len(counts)), counts), hit[spots], len(counts)).astype(np.int64)
    # each occurrence counts for each item that has the window, without pairs of equal windows and items
    pair = np.unique(document * len(tests.windows) + window)
    names: dict[int, set] = {}
    for d, w in zip((pair // len(tests.windows)).tolist(), (pair % len(tests.windows)).tolist(), strict=True):
        names.setdefault(d, set()).update(tests.items_of(w).tolist())
    rise = np.flatnonzero(np.diff(np.append(0, hit.astype(np.int8))) == 1)
    fall = np.flatnonzero(np.diff(np.append(hit.astype(np.int8), 0)) == -1) + 1
    runs = of(rise)
    # from each word that is hit its longest match, of which those inside the match from the word before are left out; and items shorter than a window
    at = np.flatnonzero(hit)
    length, there = best_matches(tests.array, tests.numbers, numbers, at)
    inside = np.append(False, (at[1:] == at[:-1] + 1) & (length[1:] < length[:-1]))[: len(at)]
    at, length, there = (x[(length >= tests.size) & ~inside] for x in (at, length, there))
    brief = np.flatnonzero(tests.lengths[window] < tests.size)
    item = np.append(np.searchsorted(tests.begins, there, "right") - 1, tests.owners[tests.bounds[window[brief]]])
    at, length, there = np.append(at, start[brief]), np.append(length, tests.lengths[window[brief]]), np.append(there, tests.begins[item[len(at) :]])
    order = np.lexsort((length, at))
    at, length, there, item = at[order], length[order], there[order], item[order]
    matched = of(at)
    for d in np.flatnonzero(total).tolist():
        mine, own = (slice(*np.searchsorted(x, [d, d + 1])) for x in (runs, matched))
        matches = [{"item": tests.names[i], "item_start": t, "start": s, "length": n} for i, t, s, n in zip(item[own].tolist(), (there[own] - tests.begins[item[own]]).tolist(), (at[own] - begins[d]).tolist(), length[own].tolist(), strict=True)]
        listed = sorted({str(tests.names[i]) for i in names[d] if tests.names[i] is not None})
        out[d] = (int(counts[d]), int(total[d]), int(length[own].max()), listed, (rise[mine] - begins[d]).tolist(), (fall[mine] - begins[d]).tolist(), matches)
    return out


def _merge(rows: DataFrame, blocks: int) -> DataFrame:
    """One row for each document from its rows of all blocks: spans that overlap are joined before they are counted."""
    if blocks == 1:
        return rows

    def run(batches):
        for batch in batches:
            out = []
            for starts, ends in zip(column(batch, "starts").to_pylist(), column(batch, "ends").to_pylist(), strict=True):
                joined: list[list[int]] = []
                for a, b in sorted(zip(starts, ends, strict=True)):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                out.append(joined)
            rest = {f.name: column(batch, f.name) for f in batch.schema if f.name not in ("starts", "ends")}
            rest["n_hit"] = pa.array([sum(b - a for a, b in x) for x in out], pa.int64())
            rest |= {k: pa.array([[x[i] for x in y] for y in out], pa.list_(pa.int64())) for i, k in enumerate(("starts", "ends"))}
            yield pa.RecordBatch.from_arrays([rest[f.name] for f in batch.schema], [f.name for f in batch.schema])

    firsts = [F.first(c).alias(c) for c in ("key", "n_words", "n_hit")]
    listed = lambda c: F.flatten(F.collect_list(c))
    joined = rows.groupBy("row").agg(*firsts, F.max("longest").alias("longest"), F.array_sort(F.array_distinct(listed("items"))).alias("items"), *(listed(c).alias(c) for c in ("starts", "ends", "matches")))
    ordered = joined.select(*rows.columns)
    return ordered.mapInArrow(run, ordered.schema)


def blocks_of(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks of about block_bytes the items make, and these, read one by one; items are dealt by row, so that equal ones don't meet in one."""
    tests = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    weight = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-weight // block_bytes))
    if count > 1:
        tests = cut(tests.withColumn("n", F.monotonically_increasing_id()))
    parts = (tests if count == 1 else tests.filter(F.pmod(F.xxhash64("n"), F.lit(count)) == k).select("item", "text") for k in range(count))
    return count, ([tuple(r) for r in block.collect()] for block in parts)  # about block_bytes each


def of_blocks(spark, count: int, blocks: Iterator[list[tuple]], searched) -> DataFrame:
    """The union of searched(broadcast block); of several, each is written before the next is sent."""
    if count == 1:
        return searched(spark.sparkContext.broadcast(next(blocks)))
    found = []
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        found.append(staged(searched(sent), "matches"))
        sent.unpersist()
    return reduce(DataFrame.unionByName, found)


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs: key, n_words, n_hit (words inside occurrences of windows), longest (words of the longest verbatim
    match that holds a window), items (ids of the items that occur, as strings, sorted), the hit spans' starts and ends, in words, and
    matches: the maximal verbatim matches that hold a window, each at one of its places in the test texts (item, item_start, start, length)."""
    spark = docs.sparkSession
    count, blocks = blocks_of(benchmark, block_bytes)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    if count > 1:  # numbered once: every block must see the same numbers
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", " + RESULT
    names = ["n_words", "n_hit", "longest", "items", "starts", "ends", "matches"]
    match = pa.struct([("item", pa.string()), *((c, pa.int64()) for c in ("item_start", "start", "length"))])
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(match))

    def searched(sent) -> DataFrame:
        def run(batches):
            own = Tests(sent.value, size)
            for batch in batches:
                texts = text_column(batch, "text")
                for a, b in slices(texts):
                    found = zip(*shard(texts.slice(a, b - a), own), strict=True)
                    yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(a, b - a) for c in kept), *(pa.array(v, t) for v, t in zip(found, kinds, strict=True))], [*kept, *names])

        return rows.mapInArrow(run, schema)

    return _merge(of_blocks(spark, count, blocks, searched), count).select(F.col("key").alias(key), *names)


def longest_of_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, length, item_start, key and start of a longest verbatim match of each test text with any row of docs, of whatever length: every test
    suffix is searched in every shard. Items that share no word with any document are left out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def searched(sent) -> DataFrame:
        def run(batches):
            own, best = Tests(sent.value, 1), {}
            for batch in batches:
                texts = text_column(batch, "text")
                for a, b in slices(texts):
                    numbers, _, counts = numbered(texts.slice(a, b - a), own)
                    begins = np.cumsum(counts) - counts + np.arange(len(counts))
                    length, there = best_matches(suffix_array(numbers, own.bits, own.per)[0], numbers, own.numbers, own.array)
                    order = np.argsort(length, kind="stable")
                    for i in order[np.append(own.item[order[1:]] != own.item[order[:-1]], True)[: len(order)]].tolist():
                        item, d = int(own.item[i]), int(np.searchsorted(begins, there[i], "right")) - 1
                        if length[i] > best.get(item, (0,))[0]:
                            best[item] = (int(length[i]), int(own.array[i] - own.begins[item]), column(batch, "key")[a + d], int(there[i] - begins[d]))
                key_kind = column(batch, "key").type
            if best:
                parts = [*zip(*best.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([own.names[i] for i in best], pa.string()), pa.array(list(best), pa.int64()), pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array([k.as_py() for k in parts[2]], key_kind), pa.array(parts[3], pa.int64())], ["item", "number", "length", "item_start", "key", "start"])

        found = rows.mapInArrow(run, f"item string, number bigint, length bigint, item_start bigint, key {kind}, start bigint")
        return found.groupBy("item", "number").agg(F.max_by(F.struct("length", "item_start", "key", "start"), F.struct("length", -F.col("item_start"))).alias("best")).select("item", "best.*")

    return of_blocks(spark, *blocks_of(benchmark, block_bytes), searched).withColumnRenamed("key", key)


def digested(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text has an occurrence. The decision depends on the text only, so rows are matched by key and
    a hash of the text; nulls match nulls."""
    digest = F.xxhash64(F.col(text).cast("string"))
    rows = docs.select(F.struct(F.col(key).alias("k"), digest.alias("h")).alias("both"), F.col(text).alias("text"))
    hits = search(rows, benchmark, size, "both", "text").filter("n_hit > 0").select("both.k", "both.h").distinct()
    bad = hits.alias("bad")
    return docs.join(bad, docs[key].eqNullSafe(F.col("bad.k")) & (digest == F.col("bad.h")), "left_anti")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i + 1 : i + least(len(w), {WINDOW})], ' ') AS words FROM b, LATERAL (SELECT unnest(range(greatest(len(w) - {WINDOW} + 1, 1))) AS i) WHERE len(w) > 0),
dw AS (SELECT r, k, i, array_to_string(w[i + 1 : i + k], ' ') AS words FROM d, (SELECT DISTINCT k FROM iw), LATERAL (SELECT unnest(range(len(w) - k + 1)) AS i) WHERE len(w) >= k),
m AS (SELECT r, dw.k, i, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.words = iw.words),
hits AS (SELECT r, count(DISTINCT p) AS n FROM m, LATERAL (SELECT unnest(range(i, i + k)) AS p) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, hits.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
