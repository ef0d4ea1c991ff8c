import random

from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from trailmark.llm import simhash


def brute(rows):
    fp = [(r.doc_id, simhash.fingerprint(r.text or "")) for r in rows]
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i][1] ^ fp[j][1]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (d, _) in enumerate(fp):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted((-1 if d is None else d, f, ids.get(find(i), -1)) for i, (d, f) in enumerate(fp))


def same(df):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fp % (1 << 64), -1 if r.component_id is None else r.component_id) for r in simhash.classes(df).collect())
    assert got == brute(df.collect())


def test_fingerprint_by_spark_hash(spark):
    text = "The quick  Brown\tfox jumps OVER the lazy dog É"
    words = [w.lower() if w.isascii() else w for w in text.split()]
    hashes = [spark.range(1).select(F.xxhash64(F.lit(" ".join(words[i : i + 3])))).first()[0] % (1 << 64) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(" \n") == 0


def test_awkward(spark):
    texts = ["", "<null>", " \t", "one", "One", "one two", "<no id>", prose(1, 400), prose(1, 400), prose(1, 400) + " tail", prose(2, 3000)]
    same(docs(spark, texts))
    assert simhash.classes(docs(spark, texts).limit(0)).count() == 0


def test_near_copies_and_large_postings(spark, monkeypatch):
    r = random.Random(3)
    base = prose(9, 300).split()
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(("new", "other", "third"))
        texts.append(" ".join(words))
    texts += [prose(100 + i, 60) for i in range(60)]
    same(docs(spark, texts))
    monkeypatch.setattr(simhash, "SMALL_POSTING", 2)
    same(docs(spark, texts))


def test_chain_of_links(spark):
    values, edges = list(range(1, 40)), []
    edges = [(a, a + 1) for a in values]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: 1 for v in range(1, 41)}


def test_keep_one(spark):
    df = docs(spark, [prose(1, 100), prose(1, 100), prose(2, 100), "<no id>"])
    df = df.unionByName(df.filter("doc_id = 0"))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in simhash.keep_one(df).collect()) == [-1, 0, 2]


def test_keep_one_keeps_columns_of_any_name(spark):
    df = docs(spark, [prose(1, 100), prose(2, 100)]).selectExpr("*", "doc_id AS _kept_text", "doc_id AS _hash", "doc_id AS _kept")
    df = df.unionByName(df)
    out = simhash.keep_one(df)
    assert out.columns == df.columns and sorted((r.doc_id, r._kept_text, r._hash, r._kept) for r in out.collect()) == [(i, i, i, i) for i in (0, 1)]


def test_keep_one_of_null_ids_and_of_two_texts_under_one_id(spark):
    a, b, c, d, e = (prose(i, 100) for i in range(20, 25))
    rows = [(None, a), (None, b), (None, b), (None, c), (3, c), (5, c), (5, d), (5, d), (7, e), (7, a), (9, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    assert sorted(map(key, simhash.keep_one(df).collect())) == sorted([(-1, b), (3, c), (5, d), (7, a), (7, e)])
