import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from trailmark.llm import similar, simhash


def shingles(t, k=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(x, y):
    return not x and not y or 5 * len(x & y) >= 4 * len(x | y) > 0


def brute(rows):
    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            ids[find(i)] = min(ids.get(find(i), r.doc_id), r.doc_id)
    return sorted((-1 if r.doc_id is None else r.doc_id, ids.get(find(i), -1)) for i, r in enumerate(rows))


def same(df):
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.component_id is None else r.component_id) for r in similar.classes(df).collect())
    assert got == brute(df.collect())
    return got


@pytest.fixture(scope="module")
def texts():
    r, words = random.Random(3), [f"w{i}" for i in range(400)]
    out = ["", "<null>", " \t", "one", "One", "one two", "<no id>", "ONE  two", "a b c d e", "a b c d e f"]
    passage = prose(50, 60, words)  # shared by many otherwise different texts
    for b in range(6):
        base = prose(b, r.choice((20, 60, 200)), words).split()
        for _ in range(9):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy[r.randint(0, 4) :]))
    return out + [prose(200 + i, r.randint(1, 60), words) + " " + passage for i in range(20)] + [out[12], out[30].upper()]


def test_equals_brute_force(spark, texts, monkeypatch):
    got = same(docs(spark, texts))
    assert len({c for _, c in got}) < len(texts) - 20
    monkeypatch.setattr(similar, "COMMON", 10**9)  # the order has no bearing on results
    monkeypatch.setattr(similar, "MOST_LINKS", 0)  # nor has the way links are united
    same(docs(spark, texts))
    assert similar.classes(docs(spark, texts).limit(0)).count() == 0


def test_bitmaps_allow_all_similar_pairs(spark):
    r = random.Random(5)
    rows = []
    for n in (1, 3, 40, 63, 64, 65, 100, 130, 500, 1000):
        for _ in range(12):
            base = {r.getrandbits(64) for _ in range(n)}
            other = {x for x in base if r.random() > 0.15} | {r.getrandbits(64) for _ in range(r.randint(0, n // 5))}
            x, y = (np.array(sorted(s), np.uint64) for s in (base, other))
            rows.append((len(base ^ other), *(similar.bitmap(v).view(np.int64).tolist() for v in (x, y))))
    found = spark.createDataFrame(rows, "apart long, x array<long>, y array<long>").select("*", similar.differing(F.col("x"), F.col("y")).alias("bits")).collect()
    assert all(row.bits <= row.apart and (row.bits - row.apart) % 2 == 0 for row in found) and any(len(row.x) != len(row.y) for row in found)


def test_stage_drops_near_copies(spark):
    import corpus_pipeline

    base = prose(1, 300, [f"w{i}" for i in range(500)])
    words = base.split()
    for i in (40, 100, 160, 220, 280):
        words[i] = f"other{i}"
    df = docs(spark, [base, " ".join(words), prose(2, 300, [f"w{i}" for i in range(500)])])
    a, b = (simhash.fingerprint(t) for t in (base, " ".join(words)))
    assert (a ^ b).bit_count() > simhash.MOST_BITS and alike(shingles(base), shingles(" ".join(words)))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 2]


def test_stage_joins_simhash_links_and_similar_sets(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(500)]
    passage, tails = prose(1, 61, words) + " ", [prose(i, 60, words) for i in (2, 3)]
    a, b = (passage * 60 + t for t in tails)  # what is repeated decides their bits
    c = passage * 2 + tails[1]
    bits = lambda x, y: (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count()
    assert bits(a, b) <= simhash.MOST_BITS < min(bits(a, c), bits(b, c))
    assert alike(shingles(b), shingles(c)) and not alike(shingles(a), shingles(b)) and not alike(shingles(a), shingles(c))
    df = docs(spark, [c, a, b, prose(9, 60, words), "", "<null>", a])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 3, 4]
    assert sorted(r.doc_id for r in simhash.keep_one(df, grouped=similar.classes).collect()) == [0, 1, 3, 4]


def test_start_equals_brute_force(spark, texts, monkeypatch):
    df = docs(spark, texts + [(prose(i, 61) + " ") * 40 + prose(70 + i + k, 60) for i in (1, 2) for k in (10, 20)])
    rows = df.collect()
    sets, prints, group = [shingles(r.text) for r in rows], [simhash.fingerprint(r.text or "") for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) or (prints[i] ^ prints[j]).bit_count() <= simhash.MOST_BITS:
                group = [group[j] if g == group[i] else g for g in group]
    key = lambda x: -1 if x is None else x
    least = {g: min((r.doc_id for r, h in zip(rows, group, strict=True) if h == g and r.doc_id is not None), default=-1) for g in group}
    want = sorted((key(r.doc_id), least[g]) for r, g in zip(rows, group, strict=True))
    assert want != brute(rows)
    found = lambda: sorted((key(r.doc_id), key(r.component_id)) for r in similar.classes(df, start=simhash.classes).collect())
    assert found() == want
    monkeypatch.setattr(similar, "MOST_LINKS", 0)
    assert found() == want
    assert similar.classes(df.limit(0), start=simhash.classes).count() == 0
