import zlib

from tests.llm.helpers import docs, prose
from trailmark.llm import sharding


def brute(rows, count):
    found = [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows]
    found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1]))
    total, before, out, slots = sum(x[1] for x in found), 0, [], {}
    for d, size, crc in found:
        s = min(count - 1, count * (2 * before + size) // (2 * total))
        out.append((-1 if d is None else d, size, crc, s, slots.setdefault(s, 0)))
        slots[s] += 1
        before += size
    return sorted(out)


def test_against_brute_force(spark):
    texts = ["", "<null>", "<no id>", *(prose(i, i % 40) for i in range(200)), "é" * 5000]
    df = docs(spark, texts)
    df = df.unionByName(df.filter("doc_id in (5, 77)")).repartition(5)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shards(df).collect())
    assert got == brute(df.collect(), 24)
    assert sharding.shards(df.limit(0)).count() == 0


def test_balance(spark):
    df = docs(spark, [prose(i, 30) for i in range(500)])
    sizes = {}
    for r in sharding.shards(df, 8).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert max(sizes.values()) - min(sizes.values()) < 2 * 250
