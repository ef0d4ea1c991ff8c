"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

Centres are fitted on a bounded sample (SAMPLE vectors, SAMPLE_BYTES) and kept apart, so that near copies aren't dealt over many
of them. Each distinct vector is indexed in the shards of its `overlap` most similar centres. A shard is a graph: each member's nearest members
and some others by hash are pruned (one is dropped if a kept one is nearer to it, by ALPHA, than the member is), and edges go both ways. A vector's
adjacency is the union of its lists in all its shards. Each vector is then searched once, in the shard of its most similar centre: best first
from the medoids of the shard's own clusters, and from whatever lies in the range on through all that is near it. Links are verified in
double precision. A link to a vector whose own search can't meet this one, since its shard lacks it, is counted for both.

A cell of more than SHARD members is several shards by hash, and its vectors are searched in each of them, in blocks: so a cell of a third of all
vectors is many tasks and loses no link. Pairs never leave a task: it gives each vector's number of links and a forest that
connects what its links connect, from which components follow. An audit compares the links of AUDIT vectors with brute force over all
vectors; below LEAST_RECALL the search is done again with twice the overlap and twice the steps, up to all shards for each vector.

Cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing; shorter ones are padded with zeros; equal
vectors are one vector of the graph and link with each other; repeated rows count each time; a null id takes part, but is never kept, and a component's id
is its smallest non-null one; an empty table gives an empty table; further columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import column, cut, staged
from trailmark.llm.simhash import components
from trailmark.llm.similar import small

COSINE = 0.95
#: Vectors that centres are fitted on at most, by number and by bytes, and bytes of all centres.
SAMPLE, SAMPLE_BYTES, CENTRE_BYTES = 20_000, 16 << 20, 8 << 20
#: About how many members a shard has, and in how many shards a vector is at first.
SHARD, OVERLAP = 4096, 4
#: Kept neighbours of a member, candidates for them by nearness and by hash, and how much nearer a kept one must be to drop another.
DEGREE, NEAREST, OTHERS, ALPHA = 24, 48, 16, 1.2
#: Medoids to start from, expansions of the best-first search, and how much less than the least similarity the range is expanded through.
MEDOIDS, STEPS, SLACK = 16, 48, 0.05
#: Vectors of one numpy pass, vectors that the audit takes, and the recall that it asks for.
BLOCK, AUDIT, LEAST_RECALL = 256, 1024, 0.97


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """The lists as rows of unit length, padded with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), dims))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)  # squares of very large or small components stay finite
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def unit(table: pa.Table) -> np.ndarray:
    vectors = table.column("unit").combine_chunks()
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def fitted(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """At most k centres; the first ones are vectors of the sample that aren't near each other."""
    chosen = sample[:1]
    best = sample @ chosen[0] if len(sample) else np.zeros(0)
    while len(chosen) < k:
        at = np.flatnonzero(best < 0.8)
        if not len(at):
            break
        chosen = np.vstack([chosen, sample[at[0]]])
        best = np.maximum(best, sample @ chosen[-1])
    for _ in range(rounds):
        home = (sample @ chosen.T).argmax(axis=1)
        sums = np.zeros_like(chosen)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        chosen = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), chosen)
    return chosen


def assigned(nodes: DataFrame, centres: np.ndarray, overlap: int, dims: int) -> DataFrame:
    """node, weight, unit (the vector of unit length), home (its most similar centre) and cells (the `overlap` most similar)."""

    def run(batches):
        for batch in batches:
            x = matrix(column(batch, "vector"), dims)
            similar = x @ centres.T
            cells = np.argpartition(-similar, min(overlap, len(centres)) - 1, axis=1)[:, :overlap].astype(np.int32)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]).astype(np.int32)), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([column(batch, "node"), column(batch, "weight"), lists(x), pa.array(similar.argmax(axis=1).astype(np.int32)), lists(cells)], ["node", "weight", "unit", "home", "cells"])

    return staged(nodes.mapInArrow(run, "node bigint, weight bigint, unit array<double>, home int, cells array<int>"), "assigned")


def pruned(x: np.ndarray, members: np.ndarray, pool: np.ndarray) -> list[np.ndarray]:
    """The candidates of each member that robust pruning keeps: nearest first, each drops those that it is nearer to by ALPHA."""
    vectors, rows = x[pool], np.arange(len(members))
    apart = 1 - np.einsum("bcd,bd->bc", vectors, x[members])
    alive = pool != members[:, None]
    out = []
    for _ in range(DEGREE):
        open_ = np.where(alive, apart, np.inf)
        best = open_.argmin(axis=1)
        there = np.isfinite(open_[rows, best])
        if not there.any():
            break
        out.append(np.where(there, pool[rows, best], -1))
        near = 1 - np.einsum("bcd,bd->bc", vectors, vectors[rows, best])
        alive &= ALPHA * near > apart
        alive[rows, best] = False
    return out


def shard_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a shard's graph, both ways: from and to."""
    n, sources, targets = len(x), [], []
    random = np.random.default_rng(n)
    for a in range(0, n, BLOCK):
        members = np.arange(a, min(n, a + BLOCK))
        similar = x[members] @ x.T
        nearest = np.argpartition(-similar, min(NEAREST, n - 1), axis=1)[:, : NEAREST + 1]
        pool = np.hstack([nearest, random.integers(0, n, (len(members), OTHERS))])
        for kept in pruned(x, members, pool):
            sources.append(members[kept >= 0])
            targets.append(kept[kept >= 0])
    one, two = (np.concatenate([np.zeros(0, np.int64), *p]) for p in (sources, targets))
    return np.concatenate([one, two]), np.concatenate([two, one])


def adjacency(members: DataFrame) -> DataFrame:
    """node and near, the union of its lists in all its shards."""

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        one, two = shard_graph(unit(table))
        return pa.table({"node": ids[one], "near": ids[two]})

    edges = members.groupBy("cell", "part").applyInArrow(build, "node bigint, near bigint")
    return edges.groupBy("node").agg(F.collect_set("near").alias("near"))


def gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of several ranges, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def medoids(x: np.ndarray) -> np.ndarray:
    """The members that are most similar to the centres of the shard's own clusters."""
    centres = fitted(x[:: max(1, len(x) // 1024)], MEDOIDS, 3)
    return np.unique((x @ centres.T).argmax(axis=0))


class Shard:
    """The members of a shard with the part of the union graph among them."""

    def __init__(self, table: pa.Table):
        self.x, self.ids = unit(table), table.column("node").to_numpy()
        order = np.argsort(self.ids)
        lists = table.column("near").combine_chunks()
        near, sizes = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
        at = np.minimum(np.searchsorted(self.ids[order], near), len(order) - 1)
        here = self.ids[order[at]] == near  # others are reached in their own shards
        rows = np.repeat(np.arange(len(sizes)), sizes)[here]
        self.near, self.sizes = order[at[here]], np.bincount(rows, minlength=len(sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.from_ = medoids(self.x)

    def compared(self, q: np.ndarray, found: np.ndarray, rows: np.ndarray, members: np.ndarray) -> np.ndarray:
        """The pairs of rows and the neighbours of members that aren't compared yet; their similarities go to found."""
        counts = self.sizes[members]
        wanted = np.zeros(found.shape, bool)
        wanted[np.repeat(rows, counts), self.near[gathered(self.starts[members], counts)]] = True
        wanted &= found < -1
        rows, members = np.nonzero(wanted)
        for a in range(0, len(rows), 1 << 16):
            part = slice(a, a + (1 << 16))
            found[rows[part], members[part]] = np.einsum("pd,pd->p", q[rows[part]], self.x[members[part]])
        return wanted

    def search(self, q: np.ndarray, steps: int, least: float) -> np.ndarray:
        """The similarity of each query and member, -2 where they were not compared."""
        found = np.full((len(q), len(self.x)), -2.0)
        found[:, self.from_] = q @ self.x[self.from_].T
        left, every = found.copy(), np.arange(len(q))
        for _ in range(steps):
            best = left.argmax(axis=1)
            rows = every[left[every, best] > -2]
            fresh = self.compared(q, found, rows, best[rows])
            left[fresh] = found[fresh]
            left[rows, best[rows]] = -2
        front = found >= least - SLACK
        while front.any():
            fresh = self.compared(q, found, *np.nonzero(front))
            front = fresh & (found >= least - SLACK)
        return found


def searched(members: DataFrame, queries: DataFrame, steps: int, least: float) -> DataFrame:
    """node and n (the weight of what it links with), and node and other (edges of forests that connect what links connect)."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        nodes, ns, others = [], [], []
        if index.num_rows and asked.num_rows:
            shard, q, ids = Shard(index), unit(asked), asked.column("node").to_numpy()
            weight, home = index.column("weight").to_numpy(), index.column("home").to_numpy()
            cells = asked.column("cells").combine_chunks()
            cells = cells.flatten().to_numpy().reshape(len(cells), -1)
            back, label = np.zeros(len(weight), np.int64), np.arange(len(weight))
            own_weight = asked.column("weight").to_numpy()
            for a in range(0, len(q), BLOCK):
                b = min(len(q), a + BLOCK)
                near = (shard.search(q[a:b], steps, least) >= least) & (ids[a:b, None] != shard.ids)
                n = near @ weight
                meets = np.zeros((b - a, len(weight)), bool)
                for k in range(cells.shape[1]):
                    meets |= cells[a:b, k, None] == home
                back += own_weight[a:b] @ (near & ~meets)
                nodes.append(ids[a:b])
                ns.append(n)
                others.append(np.full(b - a, -1))
                for k in np.flatnonzero(near.any(axis=1)):
                    joined = np.unique(label[near[k]])
                    label[np.isin(label, joined[1:])] = joined[0]
                    ends = np.append(shard.ids[joined], ids[a + k])
                    nodes.append(ends[1:])
                    ns.append(np.zeros(len(ends) - 1, np.int64))
                    others.append(np.full(len(ends) - 1, ends[0]))
            at = np.flatnonzero(back)
            nodes.append(shard.ids[at])
            ns.append(back[at])
            others.append(np.full(len(at), -1))
        flat = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))
        return pa.table({"node": flat(nodes), "n": flat(ns), "other": flat(others)})

    keys = ["cell", "part", "block"]
    queries = queries.toDF(*queries.columns)  # columns of its own, since both sides come from the same rows
    return staged(members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "node bigint, n bigint, other bigint"), "links")


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of shards and the vectors that are searched in them, both by cell, part and block."""
    cells = rows.select("node", "weight", "unit", "home", F.explode("cells").alias("cell"))
    sizes = cut(cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("cell") == F.col("home")).alias("asked")))  # one row for each centre
    sizes = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / SHARD).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil(F.col("asked") / SHARD)).cast("int").alias("blocks")))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = cells.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    queries = rows.select("node", "weight", "unit", "cells", F.col("home").alias("cell")).join(sizes, "cell")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).withColumn("part", upto("parts"))
    return members.select("node", "weight", "unit", "home", "cell", F.col("part").cast("int").alias("part"), "blocks"), queries.select("node", "weight", "unit", "cells", "cell", "part", F.col("block").cast("int").alias("block"))


def recall_of(nodes: DataFrame, found: DataFrame, dims: int, least: float) -> float:
    """The part of the links of AUDIT vectors, by hash, that was found; by brute force against all vectors."""
    asked = nodes.orderBy(F.xxhash64("vector")).limit(min(AUDIT, max(64, SAMPLE_BYTES // (8 * dims)))).select("node", "vector", "weight").toArrow()
    ids, q = asked.column("node").to_numpy(), matrix(asked.column("vector").combine_chunks(), dims)

    def run(batches):
        for batch in batches:
            x, own, weight = matrix(column(batch, "vector"), dims), column(batch, "node").to_numpy(), column(batch, "weight").to_numpy()
            n = weight @ ((x @ q.T >= least) & (own[:, None] != ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], ["node", "true"])

    true = nodes.mapInArrow(run, "node bigint, true bigint").groupBy("node").agg(F.sum("true").alias("true"))
    sums = true.join(found, "node", "left").agg(F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("found"), F.sum("true").alias("true")).first()
    return sums.found / sums.true if sums.true else 1.0


def linked(nodes: DataFrame, n: int, dims: int, least: float) -> tuple[DataFrame, float]:
    """The result of searched() and its audited recall."""
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * dims)))
    sample = matrix(nodes.orderBy(F.xxhash64("vector")).limit(most).select("vector").toArrow().column("vector").combine_chunks(), dims)
    k = 1 if n <= SHARD else max(1, min(-(-n * OVERLAP // SHARD), CENTRE_BYTES // (8 * dims), len(sample) // 8))
    centres, overlap, steps = fitted(sample, k), OVERLAP, STEPS
    while True:
        members, queries = dealt(assigned(nodes, centres, min(overlap, len(centres)), dims))
        members = members.join(adjacency(members), "node", "left")
        blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        found = searched(members.select("node", "weight", "unit", "home", "near", "cell", "part", blocks), queries, steps, least)
        recall = recall_of(nodes, found.groupBy("node").agg(F.sum("n").alias("n")), dims, least)
        if recall >= LEAST_RECALL or (overlap >= len(centres) and steps >= 8 * STEPS):
            return found, recall
        overlap, steps = 2 * overlap, 2 * steps


def classes(table: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = COSINE) -> DataFrame:
    """key, n_links, component_id and kept for each row."""
    rows = table.select(F.col(key).alias("key"), F.when(valid(F.col(vector)), F.col(vector)).alias("vector"))
    distinct = rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.count("*").alias("weight"), F.min("key").alias("least"))
    nodes = staged(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    shape = nodes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).first()
    alone = F.col("key").alias("component_id")
    if not shape.n:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), alone, F.col("key").isNotNull().alias("kept"))
    found, _ = linked(nodes, shape.n, shape.dims, least)
    roots = components(found.filter("other >= 0").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).filter("a <> b").distinct())
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    members = cut(nodes.join(roots, "node", "left").join(counts, "node", "left").select("vector", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(members.join(ids, "root").select("vector", "n_links", "component_id"))
    linked_rows = rows.filter("vector IS NOT NULL").join(small(known, 8 * shape.dims + 32), "vector").select("key", "n_links", "component_id")
    out = linked_rows.unionByName(rows.filter("vector IS NULL").select("key", F.lit(0).cast("long").alias("n_links"), alone))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE valid AS (SELECT vec_id, row_number() OVER () AS i, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.i, b.i AS j FROM valid a JOIN valid b ON a.i <> b.i AND list_cosine_similarity(a.v, b.v) >= 0.95),
reached(i, j) AS (SELECT i, i FROM valid UNION SELECT r.i, l.j FROM reached r JOIN links l ON l.i = r.j),
found AS (SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.i = v.i) AS n_links, (SELECT min(w.vec_id) FROM reached r JOIN valid w ON w.i = r.j WHERE r.i = v.i) AS component_id FROM valid v)
SELECT e.vec_id, coalesce(f.n_links, 0)::BIGINT AS n_links, coalesce(f.component_id, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(f.component_id, e.vec_id), false) AS kept FROM embeddings e LEFT JOIN found f USING (vec_id)
"""
