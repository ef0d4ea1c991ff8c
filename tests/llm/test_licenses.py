import random
import re
import time

from pyspark.sql import functions as F

from tests.llm.helpers import docs, prose
from trailmark.llm import licenses


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(t):
    w = words(t)
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    text = " " + " ".join(w) + " "
    found = [(m.start(), m.end(), r.priority, k, r.label) for k, r in enumerate(licenses.rules()) if r.keyword in text for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", text)]

    def beats(e, d):
        inside = e[0] <= d[0] and e[1] >= d[1]
        return inside and (e[2] < d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[3] < d[3]))

    left = [d for d in found if not any(beats(e, d) for e in found)]
    base = sorted({label for _, label in places})
    score = max([licenses.SURE[2] if places else 0.0, *(licenses.SURE[d[2]] for d in left)])
    return len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(base), ",".join(sorted({*base, *(d[4] for d in left)})), score, len(left)


def same(df):
    out = licenses.digested(licenses.scan(df)).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in out:
        assert tuple(r)[1:] == brute(texts[r.doc_id]), texts[r.doc_id]
    return out


TEXTS = [
    "", "<null>", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "CC BY NC cc-by-nc", "under the mit license under the mit license",
    "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "mit der Lizenz", "xcc by nc", "cc by ncx", "SPDX-License-Identifier: MIT", "É under  the\nMIT\tlicense é",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "CC BY-NC-SA 4.0 and CC0 1.0, GPL v3, GNU GPL v2 or any later version", "license " * 300, "<no id>",
]


def test_cases(spark):
    out = {r.doc_id: r for r in same(docs(spark, TEXTS))}
    assert out[2].labels == "mit" and out[4].labels == "cc-by-nc" and out[7].labels == "gpl-3" and out[5].n_base == 2 and out[9].labels == ""
    assert licenses.scan(docs(spark, [])).count() == 0


def test_random(spark):
    r = random.Random(2)
    parts = [t for t in TEXTS if t and t[0] != "<"] + [prose(i, 5) for i in range(8)]
    same(docs(spark, [r.choice([" ", ", ", "\n"]).join(r.choice(parts) for _ in range(r.randint(0, 5))) for _ in range(60)]))


def test_hundreds_of_rules_and_no_python(spark):
    assert len(licenses.rules()) > 300
    plan = licenses.digested(licenses.scan(docs(spark, TEXTS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stems_lose_nothing(spark):
    gate = re.compile("(?i)" + "|".join(s.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff") for s in [*licenses.STEMS, *(p for _, p in licenses.STEM_WORDS)]))
    for r in licenses.rules():
        plain = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\(\?:[^()]*\)\?", "", r.pattern)).replace(".{1,80}", "x")
        assert gate.search(plain) or gate.search(r.keyword), (r.pattern, plain)


def test_keywords_lose_nothing(spark, monkeypatch):
    texts = [
        "Released under the Expat License", "see the expat license", "Expat License", "Licensed under ASL 2.0", "asl-2.0", "of the PSF License", "psf license", "xasl 2 0",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document", *TEXTS,
    ]
    out = licenses.digested(licenses.scan(docs(spark, texts))).orderBy("doc_id").collect()
    want = {0: "mit", 1: "mit", 2: "mit", 3: "apache-2", 4: "apache-2", 5: "python-2", 6: "python-2", 7: "", 8: "wtfpl"}
    assert {r.doc_id: r.labels for r in out if r.doc_id in want} == want
    every = [licenses.Rule(r.label, "", r.pattern, r.priority) for r in licenses.rules()]
    monkeypatch.setattr(licenses, "rules", lambda: every)
    for r in out:
        assert r.doc_id is None or tuple(r)[1:] == brute(None if texts[r.doc_id] == "<null>" else texts[r.doc_id]), texts[r.doc_id]


def test_many_matches_take_linear_time(spark):
    text = "all rights reserved " * 12_000
    licenses.digested(licenses.scan(docs(spark, ["MIT License"]))).first()  # starts what is started once
    began = time.perf_counter()
    row = licenses.digested(licenses.scan(docs(spark, [text]))).first()
    assert (row.n_found, row.labels, row.n_words) == (12_000, "proprietary", 36_000) and time.perf_counter() - began < 10


def test_clashing_columns_travel_untouched(spark):
    names = ["_raw", "_license", "row", "whole", "low", "possible", "seen", "base", "found", "n_words", "key"]
    df = spark.createDataFrame([(1, "MIT License")], "doc_id long, text string").select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    out = licenses.scan(df)
    assert [tuple(r)[2:] for r in out.select("row.*").collect()] == [tuple(f"own {n}" for n in names)]
    assert licenses.digested(out).first().labels == "mit"


def test_each_keyword_is_part_of_its_pattern():
    for r in licenses.rules():
        always = re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\?", "", r.pattern)
        assert r.keyword in always, (r.keyword, r.pattern)
