import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import docs, prose
from trailmark.llm import phrases


def brute(rows, least, most_rank=phrases.MOST_RANK):
    counts, totals = defaultdict(Counter), Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates = {g: n for g, n in found.items() if len(g) > 1 and n >= least}
        scored = []
        for g, a in candidates.items():
            inside = lambda x: any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1))  # noqa: E731, B023
            if any(len(x) > len(g) and n >= a and inside(x) for x, n in candidates.items()):
                continue
            score, _, l, r = min((1000 * a * totals[lang] // (found[g[:k]] * found[g[k:]]), k, found[g[:k]], found[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:most_rank], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def same(df, least=4, **more):
    got = sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, least=least, **more).collect())
    assert got == brute(df.collect(), least, **more)
    return got


def fixture(spark):
    r = random.Random(5)
    texts = ["", "<null>", " \t ", "...", "one", "Ünï code, ünï code; ÜNÏ code\rünï code!"]
    for i in range(60):
        words = prose(i, 30).split()
        texts.append(" ".join(w + r.choice(["", "", "", ",", ".\n", "\t"]) for w in words) + " the quick brown fox jumps over the lazy dog again" * (i % 3))
    rows = [(x.doc_id, x.text, [None, "en", "de"][x.doc_id % 3], "w", 1) for x in docs(spark, texts).collect()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, word string, id int")


def test_against_brute_force(spark):
    assert len(same(fixture(spark))) > 30


def test_small_chunks_no_broadcasts_and_few_ranks(spark, monkeypatch):
    for name, value in (("CHUNK", 64), ("ROW", 7), ("ROWS", 3), ("MOST_HELD", 10), ("MOST_ROWS", 30), ("MOST_BROADCAST", 0)):
        monkeypatch.setattr(phrases, name, value)
    same(fixture(spark), most_rank=7)


def test_words_whose_hashes_collide(spark, monkeypatch):
    rows = phrases.languages(fixture(spark), "lang", "text")
    words = phrases.word_counts(rows)
    listed = words.collect()
    folded = spark.createDataFrame([(r.lang, r.word, r.n, r.id % 5 + 1) for r in listed], words.schema)
    apart, odd = phrases.told_apart(folded)
    found = {(r.lang, bytes(r.word)): r.id for r in apart.collect()}
    assert len(set(found.values())) == len(found) == len(listed) and len(odd) == len(listed) - 5
    assert {k: v for k, v in found.items() if v < 0} == odd


def test_hash_of_words_is_sparks(spark):
    import xxhash

    for r in phrases.word_counts(phrases.languages(fixture(spark), "lang", "text")).collect():
        assert r.id == phrases.word_id(xxhash.xxh64_intdigest(r.lang.encode(), phrases.SEED), bytes(r.word))


def test_a_long_passage_is_one_path(spark):
    passage = " ".join(f"w{i}" for i in range(300))
    texts = [passage] * 6 + [f"x{i} w5 w6 w7 w8 y{i}" for i in range(3)] + ["w100 w101"] * 2
    found = {r.phrase: r.passage_words for r in phrases.collocations(docs(spark, texts), least=5).collect()}
    # w5 .. w8 occur apart from the passage too: the path parts there
    assert found["w0 w1 w2 w3 w4"] == 9 and found["w6 w7 w8 w9 w10"] == found["w200 w201 w202 w203 w204"] == 295


def test_repeated_words_end(spark):
    same(docs(spark, ["a " * 500, "a a a", "b a " * 300]), least=3)


@pytest.mark.parametrize("most", [1 << 16, 1])
def test_windows_are_passed_on_once_a_core_not_once_a_split(spark, monkeypatch, most):
    rows = phrases.languages(docs(spark, ["a b c d e f. " * 30] * 40), "lang", "text")
    words, odd = phrases.told_apart(phrases.word_counts(rows))
    found = phrases.streams(rows.repartition(40), odd, phrases.sent(words.select("id")))
    known = [phrases.sent(phrases.frequent_phrases(found, [], 3))]
    monkeypatch.setattr(phrases, "staged", lambda df, tag: df)
    monkeypatch.setattr(phrases, "MOST_STREAM", most, raising=False)
    monkeypatch.setattr(phrases, "BATCH", 7, raising=False)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = phrases.windows(found.repartition(40), known)
        assert [r.n for r in made.collect()] == [40 * 30] * 5
        node = made._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    while node.nodeName() != "Exchange":
        node = node.children().apply(0)
    passed_on = node.metrics().apply("shuffleRecordsWritten").value()
    # where a task may take few rows, there are more tasks than cores
    assert (passed_on <= 5 * spark.sparkContext.defaultParallelism) == (most > 1)


def test_empty(spark):
    assert phrases.collocations(fixture(spark).limit(0)).count() == 0
    assert phrases.collocations(docs(spark, ["", "<null>"])).count() == 0


@pytest.mark.parametrize("least", [2, 9])
def test_thresholds(spark, least):
    same(fixture(spark).filter("doc_id < 25"), least=least)


def test_scores_pass_64_bits(spark):
    row = spark.sql("SELECT 90000000000000L AS a, 99999999999999L AS n, 90000000000001L AS l, 98765432109876L AS r").select(phrases.divided("a", "n", "l", "r").alias("s")).first()
    assert row.s == 1000 * 90000000000000 * 99999999999999 // (90000000000001 * 98765432109876)
