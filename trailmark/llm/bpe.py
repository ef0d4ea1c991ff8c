"""Byte-level BPE, encoding and decoding.

Pre-tokenisation uses no regular expression. Each code point gets a symbol (letter, number, other, kinds of white space,
apostrophe before a contraction). A symbol is a function from automaton states to states; blocks of symbols are composed
(composition is associative), the block functions give the state at each block's start, and a second pass gives the state
at every code point, which says whether a token begins there. Distinct slices are merged pair by pair, all unseen ones of a
chunk together in numpy, and kept in a bounded cache.

Cases: a null text counts as empty; an empty text has no ids; repeated rows are encoded each; very long texts are passed
whole, alone in their chunk; an empty table gives an empty table; further columns are ignored; ids of null are null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import column, slices, take_ranges, text_column

OTHER, LETTER, NUMBER, SPACE_IN_RUN, SPACE_LAST, BLANK_LAST, APOSTROPHE_1, APOSTROPHE_2, BREAK = range(9)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, IN_SPACES, ONE_LEFT, TWO_LEFT, CLOSED = range(9)
STATES = 9
#: Code points of the White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Contractions that are tokens of their own (fixed values).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
BLOCK = 512
CACHE = 1 << 18
LONG_SLICE = 400


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]."""
    follow, begins = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), bool)
    for symbol, run in ((OTHER, IN_OTHERS), (LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS)):
        follow[symbol], begins[symbol, [run, AFTER_BLANK]] = run, False
    follow[LETTER, ONE_LEFT], follow[LETTER, TWO_LEFT] = CLOSED, ONE_LEFT
    begins[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    follow[SPACE_IN_RUN], begins[SPACE_IN_RUN, IN_SPACES] = IN_SPACES, False
    follow[SPACE_LAST], follow[BLANK_LAST], follow[BREAK] = CLOSED, AFTER_BLANK, START
    for symbol, left in ((APOSTROPHE_1, ONE_LEFT), (APOSTROPHE_2, TWO_LEFT)):
        follow[symbol] = left
        follow[symbol, [IN_OTHERS, AFTER_BLANK]], begins[symbol, [IN_OTHERS, AFTER_BLANK]] = IN_OTHERS, False
    return follow, begins


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point: OTHER, LETTER, NUMBER or SPACE_IN_RUN."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[WHITE_SPACE] = SPACE_IN_RUN
    return out


def symbols(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The symbol at each code point; breaks are the places of separators."""
    out = classes()[points]
    out[breaks] = BREAK
    space = np.flatnonzero(out == SPACE_IN_RUN)
    last = space[(space + 1 < len(out))]
    after = out[last + 1]
    last = last[(after != SPACE_IN_RUN) & (after != BREAK)]
    quotes = np.flatnonzero((points == ord("'")) & (out == OTHER))
    padded = np.append(points, np.zeros(2, points.dtype))
    padded[breaks] = 0
    one, two = padded[quotes + 1], padded[quotes + 2]
    out[last] = np.where(points[last] == 0x20, BLANK_LAST, SPACE_LAST)
    for size, symbol in ((1, APOSTROPHE_1), (2, APOSTROPHE_2)):
        for word in (w for w in CONTRACTIONS if len(w) == size):
            out[quotes[(one == ord(word[0])) & ((size == 1) | (two == ord(word[-1])))]] = symbol
    return out


def boundaries(marks: np.ndarray) -> np.ndarray:
    """True where a slice begins, by composing transition functions over blocks."""
    follow, begins = (x.reshape(-1) for x in automaton())
    n = len(marks)
    rows = max(1, -(-n // BLOCK))
    grid = np.full(rows * BLOCK, BREAK, np.uint8)
    grid[:n] = marks
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T).astype(np.intp) * STATES
    composed = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    for j in range(BLOCK):
        composed = follow[grid[j][:, None] + composed]
        if j % 64 == 63 and (composed == composed[:, :1]).all():  # every block function is constant from here on
            composed = composed[:, :1]
            if j + 1 < BLOCK:
                state = composed[:, 0]
                for k in range(j + 1, BLOCK):
                    state = follow[grid[k] + state]
                composed = state[:, None]
            break
    if composed.shape[1] == 1:
        at = np.append(np.uint8(START), composed[:-1, 0])
    else:
        at, state = np.empty(rows, np.uint8), START
        for row, function in enumerate(composed.tolist()):
            at[row] = state
            state = function[state]
    out = np.empty((BLOCK, rows), bool)
    for j in range(BLOCK):
        place = grid[j] + at
        out[j], at = begins[place], follow[place]
    return out.T.reshape(-1)[:n]


class Ranks:
    """A rank file's tokens, with a hash table from pairs of ids to the id of their join."""

    def __init__(self, data: bytes):
        self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for token, rank in self.ids.items():
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self.slot(keys)
        self.probes = 1
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += bool(len(keys))
        self.forget()

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's join, or the largest int32 where the pair has none."""
        keys = a.astype(np.int64) << 20 | b
        out, at, open_ = np.full(len(keys), np.iinfo(np.int32).max, np.int32), self.slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == keys
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (found != -1)
            if not more.any():
                break
            keys, at, open_ = keys[more], (at[more] + 1) & ((1 << self.bits) - 1), open_[more]
        return out

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has: again and again, in every word at once, its
        leftmost pair of least rank becomes one."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        live, done_words, done_sizes, done_ids = np.flatnonzero(lengths <= LONG_SLICE), [], [], []
        for i in np.flatnonzero(lengths > LONG_SLICE).tolist():
            found = self.merged_long(words[i])
            done_words.append([i]), done_sizes.append([len(found)]), done_ids.append(found)
        lengths = lengths[live]
        ids = self.of_byte[np.frombuffer(b"".join(w for w in words if len(w) <= LONG_SLICE), np.uint8)]
        none = np.iinfo(np.int32).max
        ranks = None
        while len(live):
            ends = np.cumsum(lengths)
            if ranks is None:
                ranks = np.full(len(ids), none, np.int32)
                inner = np.ones(len(ids), bool)
                inner[ends - 1] = False
                inner = np.flatnonzero(inner)
                ranks[inner] = self.joined(ids[inner], ids[inner + 1])
            least = np.minimum.reduceat(ranks, ends - lengths)
            done = least == none
            if done.any():
                keep = np.repeat(~done, lengths)
                done_words.append(live[done]), done_sizes.append(lengths[done]), done_ids.append(ids[~keep])
                ids, ranks, live, lengths, least = ids[keep], ranks[keep], live[~done], lengths[~done], least[~done]
                if not len(live):
                    break
                ends = np.cumsum(lengths)
            places = np.flatnonzero(ranks == np.repeat(least, lengths))
            owner = np.searchsorted(ends, places, "right")
            places = places[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each word
            ids[places] = least
            keep = np.ones(len(ids), bool)
            keep[places + 1] = False
            ids, ranks, places, lengths = ids[keep], ranks[keep], places - np.arange(len(places)), lengths - 1
            ends = np.cumsum(lengths)
            ranks[places] = none
            right = places[places + 1 < ends]
            ranks[right] = self.joined(ids[right], ids[right + 1])
            left = places[places > ends - lengths] - 1
            ranks[left] = self.joined(ids[left], ids[left + 1])
        if not words:
            return ids, lengths
        which, sizes, ids = np.concatenate(done_words), np.concatenate(done_sizes), np.concatenate(done_ids)
        order = np.argsort(which)
        return ids[take_ranges((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]

    def merged_long(self, word: bytes) -> np.ndarray:
        """The same for one long slice, with a heap of pairs and a linked list."""
        ids, n = [int(self.of_byte[b]) for b in word], len(word)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := self.pairs.get(ids[x] << 20 | ids[after[x]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[after[x]]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the offsets of each text's."""
        joined = "\n".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        breaks = (np.cumsum(lengths + 1) - 1)[:-1]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        marks = symbols(points, breaks)
        starts = np.flatnonzero(boundaries(marks))
        wide = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.cumsum(wide, dtype=np.int64)
        data = joined.encode("utf-8", "surrogatepass")
        offsets = np.append(at[starts] - wide[starts], at[-1]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        text_of = np.searchsorted(breaks, starts, "right")
        real = marks[starts] != BREAK
        coded = pieces.dictionary_encode()
        place = self.places(coded.dictionary.to_pylist())[np.asarray(coded.indices)[real]]
        begin, sizes = self.begin[place], self.size[place]
        return self.flat[take_ranges(begin, sizes)], np.append(0, np.cumsum(np.bincount(text_of[real], sizes, len(texts)).astype(np.int64)))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each word's ids are in the cache, which gets those it lacks."""
        found = list(map(self.cache.get, words))
        unseen = [w for w, place in zip(words, found, strict=True) if place is None]
        if len(self.cache) + len(unseen) > CACHE:
            self.forget()
            found, unseen = [None] * len(words), words
        if unseen:
            ids, sizes = self.merged(unseen)
            new = range(len(self.begin), len(self.begin) + len(unseen))
            self.cache.update(zip(unseen, new, strict=True))
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(sizes) - sizes)
            self.size, self.flat = np.append(self.size, sizes), np.append(self.flat, ids)
        out = np.fromiter((-1 if x is None else x for x in found), np.int64, len(words))
        if unseen:
            out[out < 0] = new
        return out

    def forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_ranks: dict[str, Ranks] = {}


def ranks(data: bytes) -> Ranks:
    """One Ranks per Python worker and vocabulary."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _ranks:
        _ranks[name] = Ranks(data)
    return _ranks[name]


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes for the executors; a vocabulary's size doesn't grow with the data."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(batches: Iterator[pa.RecordBatch], data: bytes) -> Iterator[tuple[Ranks, pa.Array, np.ndarray, np.ndarray]]:
    """(coder, keys, ids, offsets) for chunks of rows with key and text."""
    coder = ranks(data)
    for batch in batches:
        texts, keys = text_column(batch, "text"), column(batch, "key")
        for a, b in slices(texts):
            yield coder, keys.slice(a, b - a), *coder.encode(texts.slice(a, b - a).to_pylist())


def _rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows, rows.schema["key"].dataType.simpleString()


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) for each row."""
    rows, kind = _rows(docs, key, text)
    vocabulary = shipped(docs.sparkSession, path)

    def run(batches):
        for _, keys, ids, offsets in encoded(batches, vocabulary.value):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([keys, lists], ["key", "ids"])

    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded (binary) for each row; null ids stay null."""
    rows = tokens.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    kind, vocabulary = rows.schema["key"].dataType.simpleString(), shipped(tokens.sparkSession, path)

    def run(batches):
        coder = ranks(vocabulary.value)
        for batch in batches:
            found = [None if x is None else coder.decode(np.array(x, np.int64)) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(found, pa.binary())], ["key", "decoded"])

    return rows.mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), n_bytes and decoded_sha256 for each
    row: encoded and decoded in one pass, so that ids don't leave the task."""
    rows, kind = _rows(docs, key, text)
    vocabulary = shipped(docs.sparkSession, path)
    names = ["key", "n_tokens", "ids_sha256", "n_bytes", "decoded_sha256"]

    def run(batches):
        for coder, keys, ids, offsets in encoded(batches, vocabulary.value):
            words, ends = ids.astype("<u4"), offsets.tolist()
            out: list[list] = [[], [], [], []]
            for a, b in zip(ends, ends[1:]):
                decoded = coder.decode(ids[a:b])
                for values, x in zip(out, (b - a, hashlib.sha256(words[a:b].tobytes()).hexdigest(), len(decoded), hashlib.sha256(decoded).hexdigest()), strict=True):
                    values.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names)

    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, n_bytes bigint, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
