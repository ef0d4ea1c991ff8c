import re
from collections import Counter, defaultdict

from tests.llm.helpers import docs, prose
from trailmark.llm import divergence


def brute(rows):
    groups, docs_with = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, text = r.lang or "", (r.text or "").encode()
        found = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        found = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in found]
        groups[lang, r.source or ""].update(found)
        docs_with[lang].update(set(found))
    out = []
    for (lang, source), own in groups.items():
        kept = sorted(t for t, n in docs_with[lang].items() if n >= 3)
        total = Counter()
        for (x, _), c in groups.items():
            if x == lang:
                total.update(c)
        price = lambda c, n: {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}
        size = lambda c: sum(c[t] for t in kept)
        p, q = price(own, size(own)), price(total, size(total))
        pairs, terms = [], []
        for (x, other), c in groups.items():
            if x == lang and other != source:
                its = price(c, size(c))
                pairs.append((sum((p[t] - its[t]) ** 2 // its[t] for t in kept), other.encode()))
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if own[t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, divergence.MOST_RANK)):
            ranked = sorted(found, key=lambda v: (-v[0], v[1]))[:most]
            out += [(lang, source, part, item.decode(), value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def same(df):
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == brute(df.collect())


def fixture(spark, n=90):
    words = ("alpha", "Beta", "GAMMA", "élan", "Élan", "zwei", "drei", "the", "of", "x1y", "naïve", "q")
    texts = [["", "<null>", "12 34 !!", "only here"][i] if i < 4 else prose(i, 5 + 7 * (i % 11), words) for i in range(n)]
    rows = [(r.doc_id, r.text, [None, "en", "de", "en"][r.doc_id % 4], None if r.doc_id % 13 == 0 else f"s{r.doc_id % 17}", "t", 1) for r in docs(spark, texts).collect()]
    rows += [(1000 + k, t, "few", s, "t", 1) for k, (t, s) in enumerate([("once", "u"), ("twice", "v"), (None, None)])]  # a language that keeps no term
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, id int")


def test_against_brute_force(spark):
    same(fixture(spark))


def test_many_slices_and_blocks_and_early_flushes(spark, monkeypatch):
    for name, value in (("SLICE", 2), ("BLOCK", 3), ("MOST_HELD", 5), ("CHUNK", 16), ("MOST_RANK", 4)):
        monkeypatch.setattr(divergence, name, value)
    same(fixture(spark))


def test_empty_and_one_group(spark):
    assert divergence.audit(fixture(spark).limit(0)).count() == 0
    same(docs(spark, ["a b c"] * 5).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source"))


def test_long_text_of_one_word(spark):
    same(spark.createDataFrame([(k, ("w" * 70_000 + " ") * 40, "en", f"s{k}") for k in range(3)], "doc_id long, text string, lang string, source string"))


def test_prices_of_large_counts(spark):
    row = spark.sql("SELECT 123456789012L AS c, 90000000000000L AS n, 4000000L AS v").select(divergence.priced("c", "n", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (123456789012 + 1) // (90000000000000 + 4000000)
