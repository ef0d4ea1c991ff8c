import numpy as np
import public_tokenizers

from tests.llm.helpers import docs, prose
from trailmark.llm import bpe, tokens

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SEPARATOR = 50256


def test_permutation():
    for size in (1, 2, 3, 10, 257, 5000):
        found = tokens.permuted(np.arange(size), size)
        assert sorted(found.tolist()) == list(range(size))
    assert tokens.permuted(np.arange(500), 500, 1).tolist() != tokens.permuted(np.arange(500), 500, 2).tolist()
    assert (np.abs(np.diff(tokens.permuted(np.arange(1000), 1000))) > 1).mean() > 0.9


def test_round_trip(spark):
    texts = ["", "<null>", "<no id>", prose(1, 900), *(prose(i, i % 50) for i in range(60))]
    df = docs(spark, texts).repartition(3)
    df = df.unionByName(df.filter("doc_id = 3"))
    out = tokens.write(df, PATH, SEPARATOR, length=64, least_shards=5)
    rows = out.sequences.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert {r.shard for r in rows} <= set(range(5)) and len({r.shard for r in rows}) > 2
    assert [r.shard for r in sorted(rows, key=lambda r: r.slot)] == sorted(r.shard for r in rows)
    found: dict = {}
    for r in rows:
        ids = next(tokens.records(out.folder, r.shard, 64, out.code, r.record))
        assert len(ids) == 64
        for d in r.docs:
            found.setdefault(d.doc, []).append((d.doc_start, ids[d.start : d.start + d.n].tolist()))
    coder = bpe.ranks(open(PATH, "rb").read())
    for r in df.collect():
        want = coder.encode([r.text or ""])[0].tolist() + [SEPARATOR]
        own = found[r.doc_id]
        got = [x for _, part in sorted(own) for x in part]
        assert sorted(got) == sorted(want * (2 if r.doc_id == 3 else 1))
        if r.doc_id != 3:
            assert got == want
    back = tokens.read_back(out, SEPARATOR).collect()
    assert len(back) == len(rows) and sum(r.n_tokens for r in back) == sum(len(coder.encode([r.text or ""])[0]) for r in df.collect())


def test_resumes_and_order_depends_on_key(spark):
    df = docs(spark, [prose(i, 40) for i in range(30)])
    a, b = (tokens.write(df, PATH, SEPARATOR, length=32, seed=s, least_shards=2) for s in (1, 2))
    whole = list(tokens.records(a.folder, 0, 32, a.code))
    assert [x.tolist() for x in tokens.records(a.folder, 0, 32, a.code, 3)] == [x.tolist() for x in whole[3:]]
    firsts = [sorted((r.slot, r.docs[0].doc) for r in x.sequences.collect()) for x in (a, b)]
    assert firsts[0] != firsts[1]


def test_tiny_documents_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = tokens.write(docs(spark, ["a", "", "b c", "d"]), PATH, SEPARATOR, length=64, least_shards=4)
        assert out.sequences.count() >= 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert tokens.read_back(tokens.write(docs(spark, []), PATH, SEPARATOR), SEPARATOR).count() == 0


def test_columns_by_hand(spark):
    """Every column of what is read back, from the shard files' bytes and the documents that were written."""
    import hashlib
    from pathlib import Path

    df = docs(spark, [prose(i, 5 + 13 * i) for i in range(20)] + ["", "<null>"]).repartition(3)
    out = tokens.write(df, PATH, SEPARATOR, length=32, least_shards=3)
    back, stride = tokens.read_back(out, SEPARATOR).collect(), 32 * np.dtype(out.code).itemsize
    files = [Path(p).read_bytes() for p in sorted(Path(out.folder.removeprefix("file://")).glob("shard-*.bin"))]
    assert sum(map(len, files)) == stride * len(back)
    per = max(r.slot for r in back if r.shard == 0) + 1
    coder = bpe.ranks(open(PATH, "rb").read())
    ids = {r.doc_id: coder.encode([r.text or ""])[0].tolist() + [SEPARATOR] for r in df.collect()}
    stream = {r.slot: r.docs for r in out.sequences.collect()}
    for r in back:
        record = files[r.shard][r.byte_offset : r.byte_offset + stride]
        assert (r.shard, r.byte_offset) == (r.slot // per, stride * (r.slot % per)) and r.ids_sha256 == hashlib.sha256(record).hexdigest()
        values = np.frombuffer(record, out.code).tolist()
        assert r.n_tokens == sum(v != SEPARATOR for v in values) and r.doc_ids == list(dict.fromkeys(d.doc for d in stream[r.slot]))
        assert all(values[d.start : d.start + d.n] == ids[d.doc][d.doc_start : d.doc_start + d.n] for d in stream[r.slot])
    assert sorted(r.slot for r in back) == list(range(len(back)))
