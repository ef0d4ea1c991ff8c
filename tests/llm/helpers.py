"""Small documents with the awkward cases: nulls, empties, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, ids string, a int, label string"


def docs(spark, texts, **columns):
    rows = [(i if t != "<no id>" else None, None if t == "<null>" else t, "en", f"src{i % 7}", len(t), "k", "x", 1, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, words=("alpha", "beta", "gamma", "delta", "eins", "zwei", "drei", "élan", "of", "the")):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))
