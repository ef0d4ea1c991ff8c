"""Near-duplicates by exact Jaccard similarity of word shingles, by prefix filtering.

A text is the set of its shingles of SHINGLE words (A-Z lower-cased, split at white space), as 64-bit hashes. Sets with a Jaccard
similarity of at least LEAST_PERCENT share one of the first n - ceil(n * LEAST_PERCENT / 100) + 1 of their n shingles, whatever
the common order of shingles is. The order puts those that are common in a sample of the texts last, so that a passage that
many texts share makes no candidates unless it is most of a text; the sample has no bearing on results. A posting is a shingle
with the sets that have it in that prefix; it is a sort, never a list. Neighbours in each posting, ordered by size, are paired first
and make components; then all pairs of a posting whose sizes and places
allow the similarity and that aren't in one component yet are tried too, by a join. So all links are found that components need,
while a large group of near copies doesn't become all its pairs. Only distinct sets are indexed.

Before two texts are compared in full, their parity bitmaps are: each shingle flips one bit of two to four for each shingle of the
set, so that the bits that differ are no more than the shingles that only one of the sets has. That loses no pair, texts that share a
passage only never meet, and of the pairs that are left each component tries the one with the fewest differing bits first. A bitmap of
BRIEF words of 64 bits is small enough to go with the members of postings and prunes within their join.

Another operator's components (SimHash's) can be given as a start: they stand as they are, only sets that they leave apart are compared, and what is
found joins them.

Cases: null and empty texts, and those without words, are one empty set and linked; fewer words than SHINGLE make one shingle;
repeated rows share a component; a component's id is its smallest non-null key; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import column, cut, staged, text_column
from trailmark.llm.simhash import LOWER, SEED, components

SHINGLE, LEAST_PERCENT = 5, 80
#: About how many texts tell which shingles are common, in how many of them a common one is, and how many are put last.
SAMPLE, COMMON, MOST_COMMON = 8_000, 3, 1 << 16
#: With how many members before it in a posting each is paired first.
NEIGHBOURS = 2
#: In how many rounds each component's most promising pair is compared before all that are left.
ROUNDS = 1
#: Links that one task unites at most.
MOST_LINKS = 1 << 18
#: Words of a small bitmap.
BRIEF = 4
BRIEF_NAMES = [f"w{i}" for i in range(BRIEF)]
#: Bytes of hashes or components that are broadcast at most.
MOST_BROADCAST = 2 << 20


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, distinct and sorted."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - shingle + 1)))


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def common_shingles(docs: DataFrame, text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Shingles in many texts of a sample, the most common last."""
    texts = docs.select(F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    every = max(1, docs.count() // SAMPLE)
    some = texts.filter(F.pmod("hash", F.lit(every)) == 0).dropDuplicates(["hash"]).select("text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([lists([shingle_set(x, shingle) for x in text_column(batch, "text").to_pylist()])], ["hashes"])

    counts = some.mapInArrow(run, "hashes array<bigint>").select(F.explode("hashes").alias("shingle")).groupBy("shingle").count().filter(F.col("count") >= COMMON)
    top = counts.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).collect()
    return np.array([r.shingle for r in reversed(top)], np.int64).view(np.uint64)


def bitmap(hashes: np.ndarray, places: int | None = None) -> np.ndarray:
    """The parity of the hashes in each of so many places: 64, 128, 256, ..., where it isn't given at least twice as many as there are hashes."""
    if places is None:
        places = 64
        while places < 2 * len(hashes):
            places *= 2
    counts = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def differing(x: Column, y: Column) -> Column:
    """In how many places two bitmaps differ; of different lengths, the longer one is folded."""
    short = F.least(F.size(x), F.size(y))

    def folded(bits: Column) -> Column:
        part = lambda i: F.slice(bits, i * short + 1, short)
        parts = F.transform(F.sequence(F.lit(0), (F.size(bits) / short - 1).cast("int")), part)
        zero = F.transform(part(F.lit(0)), lambda v: F.lit(0).cast("long"))
        return F.when(F.size(bits) == short, bits).otherwise(F.aggregate(parts, zero, lambda a, p: F.zip_with(a, p, lambda u, v: u.bitwiseXOR(v))))

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda a, n: a + n)


def prefixes(docs: DataFrame, key: str, text: str, last: np.ndarray, shingle: int, least_percent: int) -> DataFrame:
    """key, hash (of the text), node (of its set), size, bits (a bitmap), brief (a small one) and prefix for each row."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text"))
    by_hash = np.argsort(last)
    known = last[by_hash]

    def prefix(hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        most = n + (-n * least_percent // 100) + 1 if n else 0
        if not len(known):
            return hashes[:most]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, by_hash[at] + 1, 0)
        return hashes[np.argsort(rank, kind="stable")[:most]]

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x, shingle) for x in text_column(batch, "text").to_pylist()]
            nodes = np.fromiter(map(node_of, sets), np.uint64, len(sets)).view(np.int64)
            sizes = np.fromiter(map(len, sets), np.int32, len(sets))
            brief = np.stack([bitmap(x, 64 * BRIEF) for x in sets]).view(np.int64) if sets else np.zeros((0, BRIEF), np.int64)
            words = [pa.array(np.ascontiguousarray(brief[:, i])) for i in range(BRIEF)]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "hash"), pa.array(nodes), pa.array(sizes), lists(list(map(bitmap, sets))), pa.StructArray.from_arrays(words, BRIEF_NAMES), lists(list(map(prefix, sets)))], ["key", "hash", "node", "size", "bits", "brief", "prefix"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, hash bigint, node bigint, size int, bits array<bigint>, brief struct<{', '.join(f'{n}: bigint' for n in BRIEF_NAMES)}>, prefix array<bigint>")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast where it is known to be small; it must be cut or staged."""
    return F.broadcast(df) if row_bytes * df.count() <= MOST_BROADCAST else df


def may_be_similar(bits: Column, sizes: Column, least_percent: int) -> Column:
    """Whether sets of so many shingles together may be similar enough if so many bits differ."""
    return (100 + least_percent) * bits.cast("long") <= (100 - least_percent) * sizes.cast("long")


def hopeful(pairs: DataFrame, nodes: DataFrame, least_percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow the similarity, with apart: the bits that differ for each million of shingles."""
    side = lambda n: nodes.select(F.col("node").alias(n), F.col("size").alias(f"_size_{n}"), F.col("bits").alias(f"_bits_{n}"))
    sizes = (F.col("_size_a") + F.col("_size_b")).cast("long")
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", sizes.alias("_sizes"), differing(F.col("_bits_a"), F.col("_bits_b")).alias("_bits"))
    return both.filter(may_be_similar(F.col("_bits"), F.col("_sizes"), least_percent)).select("a", "b", F.expr("1000000L * _bits div greatest(_sizes, 1)").alias("apart"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, shingle: int, least_percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, from their whole texts; nodes has a text's hash for each node."""
    hashed = pairs.join(nodes.select(F.col("node").alias("a"), F.col("hash").alias("_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("hash").alias("_b")), "b")
    hashed = cut(hashed.select("a", "b", "_a", "_b"))
    wanted = cut(hashed.select(F.explode(F.array("_a", "_b")).alias("hash")).distinct())
    texts = docs.select(F.xxhash64(text).alias("hash"), F.col(text).cast("string").alias("text")).join(small(wanted, 8), "hash", "left_semi").dropDuplicates(["hash"])
    both = hashed.join(texts.toDF("_a", "_text_a"), "_a").join(texts.toDF("_b", "_text_b"), "_b").select("a", "b", "_text_a", "_text_b")

    def run(batches):
        for batch in batches:
            one, two = (map(shingle_set, column(batch, c).to_pylist(), repeat(shingle)) for c in ("_text_a", "_text_b"))
            similar = []
            for x, y in zip(one, two, strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(100 * shared >= least_percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes aren't in one component yet, with their components x and y."""
    side = lambda n, r: roots.select(F.col("node").alias(n), F.col("root").alias(r))
    met = pairs.join(side("a", "x"), "a", "left").join(side("b", "y"), "b", "left")
    return met.select(*pairs.columns, F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).filter("x <> y")


def linked(rows: DataFrame, thin: DataFrame, docs: DataFrame, text: str, shingle: int = SHINGLE, least_percent: int = LEAST_PERCENT, roots: DataFrame | None = None) -> DataFrame:
    """node and root for each node whose set is similar enough to another's; nodes that a chain of such pairs connects have one root. rows are prefixes(), thin has node, hash, size,
    bits and brief of each set; roots are of the nodes that are linked already."""
    check = lambda pairs: cut(verified(pairs, thin, docs, text, shingle, least_percent))

    def allowed(x: Column, y: Column) -> Column:
        # the sets share at most what follows their first common place in both orders
        left = F.least(x["size"] - x["place"], y["size"] - y["place"])
        return (100 * F.least(x["size"], y["size"]) >= least_percent * F.greatest(x["size"], y["size"])) & ((100 + least_percent) * left.cast("long") >= least_percent * (x["size"] + y["size"]).cast("long"))

    def pair(x: Column, y: Column) -> Column:
        return F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"))

    # one row of each set; few bytes of a shingle suffice where pairs are verified
    held = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix")).select(F.posexplode("prefix").alias("place", "shingle"), "size", "node").withColumn("shingle", F.col("shingle").bitwiseAND(F.lit((1 << 48) - 1)))
    order = Window.partitionBy("shingle").orderBy("size", "node")
    own = F.struct("size", "node", "place")
    near = [F.lag(own, i).over(order).alias(f"_{i}") for i in range(1, NEIGHBOURS + 1)]
    found = held.select("shingle", "size", "node", "place", *near, F.lead("node").over(order).alias("_next"))
    found = staged(found.filter("_1 IS NOT NULL OR _next IS NOT NULL").drop("_next"), "postings")  # shingles of one set only are gone
    sides = F.array(*(F.when(F.col(f"_{i}").isNotNull() & allowed(own, F.col(f"_{i}")), pair(own, F.col(f"_{i}"))) for i in range(1, NEIGHBOURS + 1)))
    met = found.select(F.inline(F.filter(sides, lambda p: p.isNotNull()))).filter("a <> b").distinct()
    roots = settled(cut(hopeful(met, thin, least_percent)), roots, check)
    # all other pairs of a posting that could still join two components
    flat = found.select("shingle", "size", "node", "place").join(small(roots, 16), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = cut(flat.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("shingle"))
    flat = flat.join(small(mixed, 8), "shingle", "left_semi").join(thin.select("node", "brief"), "node")
    step = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / least_percent))).cast("int")  # sizes that may pair are one step apart at most
    member = F.struct("size", "node", "place", "root", "brief")
    flat = staged(flat.select("shingle", step.alias("step"), member.alias("l")), "members")
    larger = flat.select("shingle", F.explode(F.array("step", F.col("step") - 1)).alias("step"), F.col("l").alias("r"))
    l, r = F.col("l"), F.col("r")
    ordered = F.struct(l["size"], l["node"]) < F.struct(r["size"], r["node"])
    bits = sum((F.bit_count(l["brief"][n].bitwiseXOR(r["brief"][n])) for n in BRIEF_NAMES), F.lit(0))
    hope = may_be_similar(bits, l["size"] + r["size"], least_percent)
    far = flat.join(larger, (flat["shingle"] == larger["shingle"]) & (flat["step"] == larger["step"]) & ordered & (l["root"] != r["root"]) & allowed(l, r) & hope)
    # those of them that were tried before have failed, and fail again
    return settled(cut(hopeful(far.select(F.inline(F.array(pair(l, r)))).distinct(), thin, least_percent)), roots, check)


def united(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it is connected with) for each node of the links (a, b); few links are one task's work, more go by stars."""

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())], ["node", "root"])

    return links.coalesce(1).mapInArrow(run, "node bigint, root bigint") if links.count() <= MOST_LINKS else components(links)


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The roots of all nodes when links (a, b) are added to what the roots say: only the links' own roots are united."""
    if roots is None:
        return cut(united(links))
    fresh = cut(united(cut(apart(links, roots).select(F.col("x").alias("a"), F.col("y").alias("b")))))
    moved = fresh.select(F.col("node").alias("root"), F.col("root").alias("_root"))
    every = roots.unionByName(fresh.select("node", F.col("node").alias("root")).join(roots, "node", "left_anti"))
    return cut(every.join(moved, "root", "left").select("node", F.coalesce("_root", "root").alias("root")))


def settled(left: DataFrame, roots: DataFrame | None, check) -> DataFrame:
    """The roots of all nodes linked once those of the pairs left (a, b, apart) are compared that components still need: each component's most promising pair
    first, round by round, then what is still apart."""
    for k in range(ROUNDS + 1):
        ends = cut(left.select("*", F.col("a").alias("x"), F.col("b").alias("y")) if roots is None else apart(left, roots))
        if roots is not None and not ends.limit(1).count():
            break
        best = ends.select("a", "b", "apart", F.explode(F.array("x", "y")).alias("end")).groupBy("end").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("p"))
        best = cut(best.select("p.a", "p.b").distinct() if k < ROUNDS else ends.select("a", "b"))
        roots = joined(roots, check(best))
        left = ends.drop("x", "y").join(best, ["a", "b"], "left_anti")
    return roots


def started(rows: DataFrame, docs: DataFrame, text: str, grouped: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """node and root of the sets of those texts that grouped() puts into one component; rows are prefixes()."""
    groups = grouped(docs.select(F.xxhash64(text).alias("hash"), F.col(text).alias("text")), "hash", "text").select("hash", F.col("component_id").alias("group")).distinct()
    found = cut(rows.select("hash", "node").distinct().join(groups, "hash").select("group", "node").distinct())
    least = cut(found.groupBy("group").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("group", "a"))
    return cut(united(cut(found.join(small(least, 16), "group").filter("a < node").select("a", F.col("node").alias("b")).distinct())))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least_percent: int = LEAST_PERCENT, start: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """key and component_id (the smallest key of its component) for each row. start(docs, key, text), if given, has components of its own, which those of similar sets are joined with."""
    rows = staged(prefixes(docs, key, text, common_shingles(docs, text, shingle), shingle, least_percent), "prefixes")
    nodes = staged(rows.groupBy("node").agg(F.min("hash").alias("hash"), F.min("key").alias("least"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("brief").alias("brief")), "nodes")
    roots = linked(rows, nodes.drop("least"), docs, text, shingle, least_percent, start and started(rows, docs, text, start))
    members = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    found = cut(members.join(least, "root").select("node", "component_id"))
    return rows.select("key", "node").join(found, "node").select(F.col("key").alias(key), "component_id")
