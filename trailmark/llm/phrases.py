"""Phrase collocation mining by a weighted de Bruijn graph.

An edge is a phrase of LONGEST words with its count; it joins the nodes of its first and its last LONGEST - 1 words. Each word of a
piece begins one window of LONGEST words, or of as many as the piece still has: whole windows are edges, shorter ones piece ends. A
node's count is its flow: the weights of its outgoing edges and of the piece ends that equal it. Shorter phrases follow in the same
way, each from those one word longer. Frequent edges are compacted along unary nodes (one edge in, one out, of the same
weight, and no other flow) by pointer doubling; a path is a passage that always occurs whole.

What is rare is left out before it is shuffled, and nothing is lost by it: all parts of a phrase of LEAST occurrences have as many, so a
window ends where a rare word, pair or triple of words begins, as at a piece's end. Words are known by 62-bit hashes
of language and word, those that collide by numbers of their own; pairs and triples by hashes that may count several together. What
occurs LEAST times is broadcast where it is little, elsewhere windows aren't cut by it, with the same results. Texts
become rows of ROW word numbers, each followed by the next few, so that a long text is many rows.

Cases: null text is empty, null language `und`; pieces without words and texts without pieces have no phrases but may leave words; repeated
rows count each time; equal scores are ranked by count and then by the phrase's UTF-8 bytes; an empty table gives an empty table; further
columns are ignored whatever their names. Counts up to 10^14 are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import CHUNK, column, cut, flat, slices, staged, text_column
from trailmark.llm.similar import small

LONGEST, LEAST, MOST_RANK = 5, 100, 2000
#: Word numbers in a row of a stream, rows that one numpy pass works on, words that a task remembers or counts before it passes them on.
ROW, ROWS, MOST_HELD = 256, 4096, 1 << 18
#: Counted phrases that a task adds up before it passes them on.
MOST_ROWS = 1 << 20
#: Rows of streams that a task makes windows of at most, windows in a batch of them.
MOST_STREAM, BATCH = 1 << 20, 1 << 16
#: Bytes of numbers that are broadcast at most.
MOST_BROADCAST = 32 << 20
#: Lengths of phrases, from two words on, that are counted before windows are made.
PRUNED = 2
SEED = 42
#: A-Z lower-cased, what ends a piece a line feed, a tab a space.
PIECE_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Stands for a piece's end among the words; no byte of UTF-8.
END = b"\xff"
IDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words and piece ends of a text whose bytes are PIECE_BYTES, in lists of about CHUNK bytes."""
    a = 0
    while a < len(text):
        b = min((x for x in (text.find(b" ", a + CHUNK), text.find(b"\n", a + CHUNK)) if x >= 0), default=len(text))
        yield text[a:b].replace(b"\n", b" \xff ").split()
        a = b


def languages(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))


def texts_of(batch: pa.RecordBatch) -> Iterator[list[tuple[str, bytes]]]:
    """Language and bytes of the batch's texts, in lists of about CHUNK bytes."""
    texts, langs = text_column(batch, "text"), column(batch, "lang").to_pylist()
    for a, b in slices(texts):
        data, ends = flat(texts.slice(a, b - a))
        data = data.tobytes().translate(PIECE_BYTES)
        yield [(own, data[ends[k] : ends[k + 1]]) for k, own in enumerate(langs[a:b])]


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word (UTF-8 bytes), n and id of all words; ids are distinct but for hashes that collide."""

    def flushed(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for own, counts in found.items():
            counts.pop(END, None)
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
        found.clear()

    def run(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for group in texts_of(batch):
                for own, text in group:
                    counts = found.setdefault(own, Counter())
                    for words in tokens(text):
                        counts.update(words)
                if sum(map(len, found.values())) > MOST_HELD:
                    yield from flushed(found)
        yield from flushed(found)

    counted = rows.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return staged(counted.withColumn("id", F.shiftrightunsigned(F.xxhash64("lang", "word"), 2) + 1), "words")


def word_id(lang_seed: int, word: bytes) -> int:
    """As word_counts() has it."""
    return (xxhash.xxh64_intdigest(word, lang_seed) >> 2) + 1


def told_apart(words: DataFrame) -> tuple[DataFrame, dict[tuple[str, bytes], int]]:
    """The words with ids that are all distinct, and those that a hash doesn't tell apart: all but the first of each hash get numbers below zero, which no hash
    has. There is about one such pair for each 2^62 pairs of words, so that these few fit the driver."""
    shared = words.groupBy("id").agg(F.count("*").alias("of"), F.min(F.struct("lang", "word")).alias("keeps")).filter("of > 1")
    odd = words.join(shared, "id").filter(F.struct("lang", "word") != F.col("keeps")).select("lang", "word").orderBy("lang", "word").collect()
    if not odd:
        return words, {}
    own = {(r.lang, bytes(r.word)): -1 - k for k, r in enumerate(odd)}
    table = words.sparkSession.createDataFrame([(a, bytearray(b), k) for (a, b), k in own.items()], "lang string, word binary, _own bigint")
    apart = words.join(F.broadcast(table), ["lang", "word"], "left").withColumn("id", F.coalesce("_own", "id")).drop("_own")
    return staged(apart, "words"), own


def sent(numbers: DataFrame):
    """A broadcast of one column of longs, sorted, or None where they are too many."""
    numbers = cut(numbers)
    if 8 * numbers.count() > MOST_BROADCAST:
        return None
    return numbers.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in numbers.collect()], np.int64)))


def among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def streams(rows: DataFrame, odd: dict[tuple[str, bytes], int], frequent) -> DataFrame:
    """ids: rows of word numbers, zero where a piece ends or a word is rare, each with the LONGEST - 1 numbers that follow it."""

    def learnt(own: dict[bytes, int], lang: str, fresh: list[bytes]) -> None:
        seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
        ids = np.fromiter((word_id(seed, w) for w in fresh), np.int64, len(fresh))
        if odd:
            ids = np.fromiter((odd.get((lang, w), i) for w, i in zip(fresh, ids.tolist(), strict=True)), np.int64, len(fresh))
        if frequent is not None:
            ids[~among(frequent.value, ids)] = 0
        own.update(zip(fresh, ids.tolist(), strict=True))

    def rows_of(stream: np.ndarray) -> pa.RecordBatch:
        """The stream without its repeated zeros."""
        stream = stream[(stream != 0) | np.append(True, stream[:-1] != 0)]
        padded = np.append(stream, np.zeros(LONGEST - 1, np.int64))
        parts = [padded[a : a + ROW + LONGEST - 1] for a in range(0, max(1, len(stream)), ROW)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(np.concatenate(parts)))], ["ids"])

    def run(batches):
        memo: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            for group in texts_of(batch):
                found = []
                for own_lang, text in group:
                    own = memo.setdefault(own_lang, {END: 0})
                    for words in tokens(text):
                        if fresh := [w for w in set(words) if w not in own]:
                            learnt(own, own_lang, fresh)
                        found.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
                    found.append(np.zeros(1, np.int64))
                yield rows_of(np.concatenate(found))
                if sum(map(len, memo.values())) > MOST_HELD:
                    memo.clear()

    return staged(rows.mapInArrow(run, "ids array<bigint>"), "streams")


def passes(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word numbers of several rows, one after the other, and which of them are the rows' own and no zero."""
    for batch in batches:
        lists = column(batch, "ids")
        for a in range(0, len(lists), ROWS):
            some = lists.slice(a, ROWS)
            ids = some.flatten().to_numpy()
            ends = np.cumsum(some.value_lengths().to_numpy())
            own = ids != 0
            for k in range(1, LONGEST):
                own[ends - k] = False
            yield ids, own


def combined(table: np.ndarray) -> np.ndarray:
    """Columns of numbers with their count in the last row, equal ones added up."""
    order = np.lexsort(table[:-1])
    table = table[:, order]
    first = np.flatnonzero(np.append(True, (table[:-1, 1:] != table[:-1, :-1]).any(axis=0))[: table.shape[1]])
    return np.append(table[:-1, first], [np.add.reduceat(table[-1], first)] if len(first) else table[-1:], axis=0)


def held(tables: Iterator[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The tables as batches, their counts added up in the task over as many as MOST_ROWS columns before they are passed on."""
    parts, size = [], 0
    for table in tables:
        parts.append(table)
        size += table.shape[1]
        if size > MOST_ROWS:
            parts = [combined(np.concatenate(parts, axis=1))]
            size = parts[0].shape[1]
            if 2 * size > MOST_ROWS:  # little of it repeats
                yield pa.RecordBatch.from_arrays([pa.array(row) for row in parts[0]], names)
                parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(row) for row in combined(np.concatenate(parts, axis=1))], names)


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = (h + b.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def runs(ids: np.ndarray, known: list) -> tuple[list[np.ndarray], np.ndarray]:
    """Where phrases of 2, 3, ... words begin that may be frequent, all their parts being so, and hashes of the longest of them. known: for each length what
    is frequent, or None where all are taken; of the next length, those whose parts are frequent."""
    joined = lambda a: np.append(a[:-1] & a[1:], False)
    at, h, out = joined(ids != 0), ids, []
    for k in range(len(known) + 1):
        where = np.flatnonzero(at)
        longer = np.zeros(len(ids), np.int64)
        longer[where] = pair_of(h[where], ids[where + k + 1])
        if k < len(known) and known[k] is not None:
            at = np.zeros(len(ids), bool)
            at[where] = among(known[k].value, longer[where])
        out.append(at)
        h, at = longer, joined(at)
    return out, h


def frequent_phrases(found: DataFrame, known: list, least: int) -> DataFrame:
    """Hashes of phrases one word longer than the known ones that occur often enough, if no other shares their hash."""

    def tables(batches):
        for ids, own in passes(batches):
            at, h = runs(ids, known)
            yield np.stack(np.unique(h[at[-1] & own], return_counts=True))

    def run(batches):
        yield from held(tables(batches), ["phrase", "n"])

    return found.mapInArrow(run, "phrase bigint, n bigint").groupBy("phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("phrase")


def windows(found: DataFrame, known: list) -> DataFrame:
    """w1 to w5 and n: how often each window of at least two words occurs; zeros fill one that a piece's end or what is rare cuts short.
    A frequent window is in nearly all tasks and leaves each with its count: as many tasks as cores keep such rows from growing with windows and tasks both."""
    found = found.coalesce(max(found.sparkSession.sparkContext.defaultParallelism, -(-found.count() // MOST_STREAM)))

    def run(batches):
        for ids, own in passes(batches):
            at = runs(ids, known)[0][: len(known)]
            starts = np.flatnonzero(own & at[0])
            table, open_ = np.zeros((LONGEST, len(starts)), np.int64), np.ones(len(starts), bool)
            table[0] = ids[starts]
            for k in range(1, LONGEST):
                for n, may in enumerate(at[:k]):  # the phrases of n + 2 words that end with this one
                    open_ &= may[starts + k - 1 - n]
                table[k, open_] = ids[starts[open_] + k]
            for a in range(0, len(starts), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(row[a : a + BATCH]) for row in table], IDS)

    return staged(found.mapInArrow(run, ", ".join(f"{c} bigint" for c in IDS)).groupBy(*IDS).agg(F.count("*").alias("n")), "windows")


def nodes(found: DataFrame, least: int) -> DataFrame:
    """w1 to w4 of each node with its count n (its flow), and the words `before` and `after` it on frequent edges where the node is unary."""
    last = LONGEST
    frequent = found.filter((F.col(f"w{last}") != 0) & (F.col("n") >= least))
    rest = found.filter((F.col(f"w{last}") == 0) | (F.col("n") < least)).filter(F.col(f"w{last - 1}") != 0)
    none = F.lit(None).cast("bigint")
    part = lambda df, shift, before, after, into, out, other: df.select(*(F.col(f"w{i + shift}").alias(f"w{i}") for i in range(1, last)), before.alias("before"), after.alias("after"), into.alias("into"), out.alias("out"), other.alias("other"))
    parts = part(frequent, 0, none, F.col(f"w{last}"), none, F.col("n"), none).unionByName(part(frequent, 1, F.col("w1"), none, F.col("n"), none, none)).unionByName(part(rest, 0, none, none, none, none, F.col("n")))
    met = parts.groupBy(*IDS[:-1]).agg(F.sum("into").alias("into"), F.sum("out").alias("out"), F.sum("other").alias("other"), F.count("before").alias("ins"), F.count("after").alias("outs"), F.min("before").alias("before"), F.min("after").alias("after"))
    unary = (F.col("ins") == 1) & (F.col("outs") == 1) & F.col("other").isNull() & (F.col("into") == F.col("out"))
    flow = F.coalesce("out", F.lit(0)) + F.coalesce("other", F.lit(0))
    return staged(met.select(*IDS[:-1], flow.alias("n"), *(F.when(unary, F.col(c)).alias(c) for c in ("before", "after"))), "nodes")


def shorter(longer: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """Counts of phrases of so many words: the flow into those one word longer and the piece ends of just as many words."""
    ids = IDS[:words]
    ends = found.filter((F.col(f"w{words + 1}") == 0) & (F.col(f"w{words}") != 0))
    return longer.select(*ids, "n").unionByName(ends.select(*ids, "n")).groupBy(*ids).agg(F.sum("n").alias("n"))


def paths(met: DataFrame) -> DataFrame:
    """g (an edge), head (the first edge of its path) and place (1 for the edge after the head) of the edges that unary nodes join to one before."""
    inner = [F.col(c) for c in IDS[:-1]]
    links = cut(met.filter("before IS NOT NULL").select(F.array(*inner, F.col("after")).alias("g"), F.array(F.col("before"), *inner).alias("head"), F.lit(1).cast("long").alias("place")))
    while True:
        ahead = links.select(F.col("g").alias("head"), F.col("head").alias("_head"), F.col("place").alias("_place"))
        links = cut(links.join(ahead, "head", "left"))
        if not links.filter("_head IS NOT NULL").limit(1).count():  # no cycles: each occurrence of a unary node would go on for ever
            return links.select("g", "head", "place")
        links = links.select("g", F.coalesce("_head", "head").alias("head"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place"))


def passages(found: DataFrame) -> DataFrame:
    """head and words (how many) of each path of more than one edge."""
    return found.groupBy("head").agg((F.max("place") + LONGEST).alias("words"))


def divided(a: str, n: str, l: str, r: str) -> Column:
    """floor(1000 * a * n / (l * r)) in decimals of 38 digits."""
    d = lambda x: f"cast({x} AS decimal(15, 0))"
    return F.expr(f"(cast(1000 AS decimal(4, 0)) * {d(a)} * {d(n)}) div ({d(l)} * {d(r)})")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, most_rank: int = MOST_RANK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score and passage_words: the phrases of two to LONGEST words that occur `least` times and more often than any longer
    one around them, by how much likelier their words are together than apart at the cut where that is least. passage_words: the words of the passage
    that a phrase of LONGEST words is part of wherever it occurs."""
    rows = languages(docs, lang, text)
    words, odd = told_apart(word_counts(rows))
    common = words.filter(F.col("n") >= least)
    found = streams(rows, odd, sent(common.select("id")))
    known = []
    for _ in range(PRUNED):
        known.append(sent(frequent_phrases(found, known, least)))
    found = windows(found, known)
    met = nodes(found, least)
    lists = [found.filter(F.col(f"w{LONGEST}") != 0).select(*IDS, "n"), met.select(*IDS[:-1], "n")]
    for k in range(LONGEST - 2, 1, -1):
        lists.append(shorter(lists[-1], found, k))
    grams = None
    for counts in lists:
        ids = [c for c in IDS if c in counts.columns]
        own = counts.filter(F.col("n") >= least).select(F.array(*ids).alias("g"), F.col("n").alias("a"))
        grams = own if grams is None else grams.unionByName(own)
    grams = staged(grams, "grams")

    size = F.size("g")
    around = grams.filter(size > 2).select(F.explode(F.array(F.slice("g", 1, size - 1), F.slice("g", 2, size - 1))).alias("g"), "a").groupBy("g").agg(F.max("a").alias("_around"))
    kept = grams.join(around, "g", "left").filter("_around IS NULL OR _around < a").select("g", "a")
    # all parts of a frequent phrase are frequent
    counts = cut(grams.unionByName(common.select(F.array("id").alias("g"), F.col("n").alias("a"))))
    parts = lambda of, n: small(counts.select(F.col("g").alias(of), F.col("a").alias(n)), 64)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    langs = cut(common.select("id", "lang", F.col("word").cast("string").alias("word")))
    halves = kept.select("g", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("g", "a", "k", F.slice("g", F.lit(1), F.col("k")).alias("first"), F.slice("g", F.col("k") + 1, size - F.col("k")).alias("rest"), F.col("g")[0].alias("id"))
    halves = halves.join(parts("first", "l"), "first").join(parts("rest", "r"), "rest").join(small(langs.select("id", "lang"), 32), "id").join(totals, "lang")
    scored = halves.select("g", "lang", "a", "l", "r", "n", "k", divided("a", "n", "l", "r").alias("score"))
    best = scored.groupBy("g", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    named = kept.select("g", F.posexplode("g").alias("at", "id")).join(small(langs.select("id", "word"), 48), "id").groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    row = best.join(named, "g").select("g", "lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = cut(row.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most_rank))
    placed = paths(met)
    long_ones = passages(placed)
    of_path = placed.select("g", "head").unionByName(long_ones.select(F.col("head").alias("g"), "head")).join(long_ones, "head").select("g", F.col("words").alias("passage_words"))
    whole = F.when(F.size("g") == LONGEST, F.coalesce("passage_words", F.lit(LONGEST).cast("long")))
    return top.join(of_path, "g", "left").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", whole.alias("passage_words"))


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, w[i : i + k - 1] AS words FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, any_value(words) AS words, count(*)::HUGEINT AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
dropped AS (SELECT DISTINCT s.lang, s.phrase FROM counts s JOIN counts t ON s.lang = t.lang AND t.k > s.k AND t.f >= s.f AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ') WHERE s.k >= 2),
kept AS (SELECT * FROM counts c WHERE k >= 2 AND NOT EXISTS (SELECT 1 FROM dropped d WHERE d.lang = c.lang AND d.phrase = c.phrase)),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, t.n, x.f AS l, y.f AS r, h.k AS place, (1000 * c.f * t.n) // (x.f * y.f) AS score FROM kept c JOIN totals t ON t.lang = c.lang JOIN (SELECT unnest([1, 2, 3, 4]) AS k) h ON h.k < c.k
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : h.k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[h.k + 1 : c.k], ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) AS nr FROM cuts) WHERE nr = 1),
edges AS (SELECT lang, phrase, words, f FROM counts WHERE k = 5),
followed AS (SELECT x.lang, x.phrase, y.phrase AS next FROM edges x JOIN edges y ON x.lang = y.lang AND x.words[2 : 5] = y.words[1 : 4] AND x.f = y.f JOIN counts v ON v.lang = x.lang AND v.k = 4 AND v.phrase = array_to_string(x.words[2 : 5], ' ') AND v.f = x.f),
heads AS (SELECT lang, phrase AS head, phrase, 5 AS words FROM edges e WHERE NOT EXISTS (SELECT 1 FROM followed f WHERE f.lang = e.lang AND f.next = e.phrase) UNION ALL SELECT h.lang, h.head, f.next, h.words + 1 FROM heads h JOIN followed f ON f.lang = h.lang AND f.phrase = h.phrase),
long_ones AS (SELECT lang, phrase, max(words) OVER (PARTITION BY lang, head) AS passage_words FROM heads)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, p.passage_words::BIGINT AS passage_words
FROM best b LEFT JOIN long_ones p ON p.lang = b.lang AND p.phrase = b.phrase QUALIFY rank <= 2000
"""
