import random
import re

from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from trailmark.llm import quality


def brute(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


TEXTS = ["", "<null>", "<no id>", " \n\t", "a b c d e a b c d e", "a b c d e f a b c d e", "x\nx\n\nx \ny\x0bz", "to " * 40, "é# *a* 漢|<>", prose(3, 200), prose(4, 60) + "\n" + prose(4, 60), "a b c d e f " * 30]


def test_statistics(spark):
    found = quality.decided(docs(spark, TEXTS), [])
    for r in found.collect():
        s = r.stats
        want = brute(r.row.text)
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == want, r.row.text
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)
    assert quality.decided(docs(spark, []), []).count() == 0


def test_statistics_of_repetitive_texts(spark, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choice("abc" if i % 2 else "abcdefghijkl") for _ in range(r.choice((4, 5, 6, 20, 80, 300)))) for i in range(80)]
    for bits in (quality.NUMBER_BITS, 62, 3):  # all hash bits compared, one of them, and texts beyond the numbers
        monkeypatch.setattr(quality, "NUMBER_BITS", bits)
        assert all(x.stats.n_repeat_words == brute(x.row.text)[4] for x in quality.measured(docs(spark, texts)).collect())


def test_clashing_columns_pass_untouched(spark):
    names = ["_raw", "_stats", "_kept", "_rule", "_base_failed", "row", "stats", "kept", "rule", "base_failed", "whole", "words", "_new", "n_words"]
    df = docs(spark, [prose(1, 40), "x", "<null>"]).select("doc_id", "text", *(F.lit(f"own {n}").alias(n) for n in names))
    out = quality.kept(df, labelled(spark, []))
    assert out.columns == df.columns and [tuple(r)[2:] for r in out.collect()] == [tuple(f"own {n}" for n in names)]


def test_no_python_in_the_plan(spark):
    plan = quality.decided(docs(spark, TEXTS), [(quality.Condition("symbols", True, 9),)])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_learns_and_spares(spark):
    good = [prose(i, 80) for i in range(150)]
    junk = [" ".join(w + "***" for w in prose(1000 + i, 60).split()) if i % 2 else prose(2000 + i, 60).upper() for i in range(100)]
    rows = docs(spark, good + junk)
    labels = labelled(spark, [(i, int(i < 150), 0) for i in range(250)] + [(None, 0, 0), (9999, 0, 0), (0, None, 0)])
    rules = quality.learn(rows, labels)
    assert rules and all(len(r) <= quality.MOST_CONDITIONS for r in rules)
    kept = {r.doc_id for r in quality.kept(rows, labels).collect()}
    assert len(kept & set(range(150, 250))) <= 3 and len(kept & set(range(150))) >= 147
    assert quality.kept(rows, labels).columns == rows.columns


def test_without_labels(spark):
    rows = docs(spark, TEXTS)
    assert quality.learn(rows, labelled(spark, [])) == []
    assert quality.learn(rows.limit(0), labelled(spark, [(1, 0, 0)])) == []
    conflicting = labelled(spark, [(9, 0, 0), (9, 1, 0)])
    assert quality.learn(rows, conflicting) == []


def test_order_of_rules(spark):
    a, b = (quality.Condition("words", True, 3),), (quality.Condition("words", True, 1),)
    rows = quality.measured(docs(spark, ["one two three", "one", ""])).select("row.doc_id", quality.verdict([a, b]).alias("v"))
    assert {r.doc_id: r.v for r in rows.orderBy(F.col("doc_id")).collect()} == {0: 1, 1: 2, 2: 0}


def brute_grown(rows, marks):
    """Sequential covering by hand: rows are (quality, part, values by feature)."""
    from math import log2

    holds = lambda c, v: v[c.feature] >= c.threshold if c.at_least else v[c.feature] < c.threshold
    candidates = [quality.Condition(f, up, t) for f, own in marks.items() for t in own for up in (True, False)]
    rules = []
    while len(rules) < quality.MOST_RULES:
        left = [r for r in rows if not any(all(holds(c, r[2]) for c in rule) for rule in rules)]
        rule, seen = [], [r for r in left if r[1] == "grow"]
        while len(rule) < quality.MOST_CONDITIONS:
            bad, good = sum(r[0] == 0 for r in seen), sum(r[0] == 1 for r in seen)
            if not bad or not good:
                break
            best = None
            for c in candidates:
                b, g = sum(r[0] == 0 and holds(c, r[2]) for r in seen), sum(r[0] == 1 and holds(c, r[2]) for r in seen)
                gain = b * (log2(b / (b + g)) - log2(bad / (bad + good))) if b >= quality.LEAST_COVERED else 0.0
                if best is None or (gain, b, str(c)) > best[:3]:
                    best = (gain, b, str(c), c)
            if best is None or best[0] <= 0:
                break
            rule.append(best[3])
            seen = [r for r in seen if holds(best[3], r[2])]
        if not rule:
            break
        scored = []
        for k in range(1, len(rule) + 1):
            met = [r[0] for r in left if r[1] == "prune" and all(holds(c, r[2]) for c in rule[:k])]
            scored.append((met.count(0), met.count(1)))
        k = max(range(len(rule)), key=lambda i: ((scored[i][0] - scored[i][1]) / sum(scored[i]) if sum(scored[i]) else -1.0, scored[i][0], -i))
        b, g = scored[k]
        if not b or b / (b + g) < quality.LEAST_PRECISION:
            break
        rules.append(tuple(rule[: k + 1]))
    return rules


def test_rules_grow_as_by_hand(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", {f: quality.FEATURES[f] for f in ("words", "symbols")})
    for seed in range(3):
        r = random.Random(seed)
        rows = []
        for _ in range(400):
            values = {"words": r.randint(1, 30), "symbols": r.randint(0, 20)}
            bad = (values["words"] < 8 and values["symbols"] >= 12) or values["words"] >= 27
            rows.append((int(not bad) if r.random() > 0.02 else int(bad), r.choice(["grow", "grow", "prune"]), values))
        marks = {"words": [4, 8, 9, 15, 27], "symbols": [3, 12, 13]}
        place = lambda f: F.size(F.filter(F.lit(marks[f]).cast("array<bigint>"), lambda t: t <= F.col(f)))
        df = spark.createDataFrame([(q, p, v["words"], v["symbols"]) for q, p, v in rows], "quality int, part string, words long, symbols long")
        df = df.withColumn("bins", F.array(*(F.struct(F.lit(f).alias("f"), place(f).alias("bin")) for f in marks)))
        found = quality.grown(df, marks)
        assert found == brute_grown(rows, marks) and found
