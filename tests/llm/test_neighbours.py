import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node long, unit string"


def rows_of(spark, vectors, ids=None):
    lists = [None if v is None else [None if x is None else float(x) for x in v] for v in vectors]
    return spark.createDataFrame([(i, v, 0, 7, "u") for i, v in zip(ids or range(len(lists)), lists, strict=True)], SCHEMA)


def brute(rows):
    vectors = []
    for r in rows:
        v = None if r.embedding is None or any(x is None or not np.isfinite(x) for x in r.embedding) else np.array(r.embedding, float)
        vectors.append(None if v is None or not len(v) or not v.any() else v / np.linalg.norm(v))
    dims = max((len(v) for v in vectors if v is not None), default=1)
    x = np.array([np.zeros(dims) if v is None else np.pad(v, (0, dims - len(v))) for v in vectors])
    near = (x @ x.T >= neighbours.COSINE) & ~np.eye(len(x), dtype=bool)
    out, ids = [], [r.vec_id for r in rows]
    for i, r in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            front = [j for k in front for j in np.flatnonzero(near[k]) if j not in seen and not seen.add(j)]
        least = min((ids[j] for j in seen if ids[j] is not None), default=None)
        out.append((r.vec_id, int(near[i].sum()), least, r.vec_id is not None and r.vec_id == least))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in neighbours.classes(df).collect()), key=str)


def groups(seed, n, dims=24, sizes=(60, 25, 3, 2, 2), noise=0.012):
    r = np.random.default_rng(seed)
    parts = [r.normal(size=(n, dims))]
    for k in sizes:
        centre = r.normal(size=dims)
        parts.append(centre / np.linalg.norm(centre) + r.normal(size=(k, dims)) * noise)
    return r.permutation(np.concatenate(parts))


def test_against_brute_force(spark):
    df = rows_of(spark, groups(1, 200))
    assert found(df) == brute(df.collect())


def test_many_shards_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 64)
    df = rows_of(spark, groups(2, 500, sizes=(150, 40, 2, 2, 2)))
    assert found(df) == brute(df.collect())


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0, 0, 0], [1, None, 0], [nan, 1, 0], [inf, 1, 0], [1, 2, 3], [1, 2, 3], [2, 4, 6], [-1, -2, -3], [1, 2], [1, 2, 0], [1e-30, 2e-30, 3e-30], [1e30, 2e30, 3e30]]
    df = rows_of(spark, vectors, [*range(6), None, 6, 6, 9, 10, 11, None, 13])
    assert found(df) == brute(df.collect())
    assert found(df.limit(0)) == [] and len(found(df.filter("vec_id < 3"))) == 3


def test_equal_vectors_are_one(spark):
    r = np.random.default_rng(4)
    df = rows_of(spark, np.concatenate([np.repeat(r.normal(size=(1, 8)), 400, axis=0), r.normal(size=(50, 8))]))
    assert found(df) == brute(df.collect())


def test_chain(spark):
    angles = np.arange(40) * 0.3  # cos 0.3 > 0.95 > cos 0.6
    df = rows_of(spark, np.stack([np.cos(angles), np.sin(angles), np.zeros(40)], axis=1)[:20])
    assert found(df) == brute(df.collect())


@pytest.mark.parametrize("seed", [5, 6])
def test_recall_of_one_pass(spark, monkeypatch, seed):
    """Of pairs near the limit, in many shards, without a second try."""
    monkeypatch.setattr(neighbours, "SHARD", 256)
    monkeypatch.setattr(neighbours, "LEAST_RECALL", 0)
    r = np.random.default_rng(seed)
    x = r.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[:300] + r.normal(size=(300, 32)) * 0.05
    df = rows_of(spark, np.concatenate([x, near]))
    want = {i: n for i, n, *_ in brute(df.collect())}
    got = {i: n for i, n, *_ in found(df)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 100


def test_audit_sees_what_is_missing(spark):
    df = rows_of(spark, groups(7, 100))
    nodes = df.select(F.col("embedding").alias("vector"), F.lit(1).cast("long").alias("weight"), F.col("vec_id").alias("node"))
    want = spark.createDataFrame([(i, n) for i, n, *_ in brute(df.collect())], "node long, n long")
    assert neighbours.recall_of(nodes, want, 24, neighbours.COSINE) == 1
    assert 0.4 < neighbours.recall_of(nodes, want.select("node", F.expr("n div 2").alias("n")), 24, neighbours.COSINE) < 0.6
