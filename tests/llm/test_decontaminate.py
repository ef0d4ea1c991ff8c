import random
import re

import pyarrow as pa

from tests.llm.helpers import docs, prose
from trailmark.llm import decontaminate as dc

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def split(t):
    return WORD.findall((t or "").encode().translate(LOWER))


def brute(t, items, size=10):
    words, hit, found = split(t), set(), set()
    for name, text in items:
        own = split(text)
        for j in range(max(1, len(own) - size + 1) if own else 0):
            w = own[j : j + size]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit |= set(range(p, p + len(w)))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def check(spark, texts, items, **more):
    df = docs(spark, texts)
    rows = dc.search(df, table(spark, items), **more).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows)
    assert got == sorted((-1 if r.doc_id is None else r.doc_id, *brute(r.text, items)) for r in df.collect())
    by = {(str(i)): split(t) for i, t in items}
    texts = {r.doc_id: split(r.text) for r in df.collect()}
    for r in rows:
        own = texts[r.doc_id]
        hit = {p for a, b in zip(r.starts, r.ends, strict=True) for p in range(a, b)}
        best = max((n for p in range(len(own)) for t in by.values() if (n := longest_at(own, p, [t])) >= 10 or n == len(t) > 0 and own[p : p + n] == t), default=0)
        assert len(hit) == r.n_hit and r.longest == best == max((m.length for m in r.matches), default=0)
        assert all(own[m.start : m.start + m.length] == by[m["item"]][m.item_start : m.item_start + m.length] for m in r.matches)


def longest_at(own, p, items):
    def common(x, y):
        return next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))

    return max((common(own[p:], t[j:]) for t in items for j in range(len(t)) if t[j] == own[p]), default=0)


def test_longest_match_of_all_owners(spark):
    shared = "zero one two three four five six seven eight nine"
    items = [(1, shared), (2, f"pre {shared} ten eleven twelve")]
    row = dc.search(docs(spark, [f"x pre {shared} ten eleven twelve y"]), table(spark, items)).first()
    assert row.longest == 14 and row["items"] == ["1", "2"] and [tuple(m) for m in row.matches] == [("2", 0, 1, 14)]


def test_longest_of_items_of_any_length(spark):
    r = random.Random(9)
    few = ["a", "b", "c", "d", "e", "f"]
    items = [(i, " ".join(r.choice(few) for _ in range(r.choice([1, 3, 9, 14])))) for i in range(12)] + [(20, "none of these"), (21, None)]
    texts = ["", "<null>", *(" ".join(r.choice([*few, "zz"]) for _ in range(r.randint(0, 40))) for _ in range(30))]
    df = docs(spark, texts)
    own = {x.doc_id: split(x.text) for x in df.collect()}
    want = {str(i): best for i, t in items if (best := max((longest_at(w, p, [split(t)]) for w in own.values() for p in range(len(w))), default=0))}
    for most in (dc.BLOCK_BYTES, 60):
        found = dc.longest_of_items(df.repartition(3), table(spark, items), block_bytes=most).collect()
        assert {x["item"]: x.length for x in found} == want
        by = {str(i): split(t) for i, t in items}
        assert all(own[x.doc_id][x.start : x.start + x.length] == by[x["item"]][x.item_start : x.item_start + x.length] for x in found)


def test_clean_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, prose(1, 30), "d"), (2, "fine", "e")], "doc_id long, text string, _digest string")
    assert [tuple(r) for r in dc.clean(df, table(spark, [(1, prose(1, 30))])).collect()] == [(2, "fine", "e")]


def test_random_against_brute_force(spark):
    r = random.Random(7)
    few = ["a", "b", "c", "dé", "9"]
    items = [(i, " ".join(r.choice(few) for _ in range(r.choice([0, 1, 3, 9, 10, 11, 14, 30])))) for i in range(25)]
    texts = ["", "<null>", "<no id>", "A, B! c"]
    for i in range(80):
        t = [r.choice([*few, "zz"] if i % 2 else few) for _ in range(r.randint(0, 60))]
        own = split(r.choice(items)[1])
        t[r.randint(0, len(t)) :] = [w.decode() for w in own] + t[3:9]
        texts.append(r.choice([" ", ", ", "\n-"]).join(t))
    check(spark, texts, items)
    check(spark, texts, [(i, t) for i, t in items if len(split(t)) >= 10])
    check(spark, texts, items, block_bytes=200)


def test_suffix_array_is_sorted():
    import numpy as np

    r = random.Random(1)
    for n in (1, 5, 200, 2000):
        numbers = np.array([r.choice([0, 1, 1, 1, 2]) for _ in range(n)], np.int64)
        array, _ = dc.suffix_array(numbers, 2, 3)
        tails = [tuple(np.append(numbers[p:], 0).tolist()[: np.append(numbers[p:], 0).tolist().index(0)]) for p in array.tolist()]
        assert tails == sorted(tails) and len(array) == (numbers > 0).sum()


def test_edges(spark):
    items = [(1, prose(1, 30)), (None, prose(2, 12)), (3, None), (1, prose(1, 30))]
    texts = [prose(1, 30), "x " + prose(2, 12), prose(1, 9), prose(3, 4000) + prose(1, 30)]
    rows = {r.doc_id: r for r in dc.search(docs(spark, texts), table(spark, items)).collect()}
    assert rows[0]["items"] == ["1"] and rows[0].longest == 30 and rows[0].starts == [0] and rows[0].ends == [30]
    assert rows[1].n_hit >= 12 and rows[1]["items"] == []
    assert dc.search(docs(spark, texts), table(spark, [])).filter("n_hit > 0").count() == 0
    assert dc.search(docs(spark, texts).limit(0), table(spark, items)).count() == 0
    kept = dc.clean(docs(spark, [*texts, "<null>", "fine words"]), table(spark, items))
    assert {r.doc_id for r in kept.collect()} >= {4, 5} and 0 not in {r.doc_id for r in kept.collect()}
    assert kept.columns == docs(spark, []).columns


def test_words():
    found, counts = dc.words(pa.array(["Ab,cd", "", "é9 ", "x"], pa.large_string()))
    assert found.to_pylist() == [b"ab", b"cd", "é9".encode(), b"x"] and counts.tolist() == [2, 0, 1, 1]


def test_blocks_over_rows_in_any_order(spark):
    """Several blocks see the same rows, also where the input has no fixed order."""
    texts = [prose(i, 60) for i in range(30)]
    df = docs(spark, texts).repartition(5)
    items = spark.createDataFrame([(i, " ".join(texts[i].split()[7:40])) for i in range(0, 30, 3)], "item_id long, text string")
    one = sorted(map(str, dc.search(df, items).collect()))
    assert one == sorted(map(str, dc.search(df, items, block_bytes=300).collect())) and sum("n_hit=0" in x for x in one) < 30
