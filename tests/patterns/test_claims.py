import itertools
import re

import pytest

from trailmark.operators import claims

ROWS = [("c1", "is", "claim"), ("c2", "is", "claim"), ("c3", "is", "other"), ("c1", "of", "p1"), ("c1", "of", "p2"), ("c2", "of", "p2"), ("c3", "of", "p1"), ("p1", "near", "p2"), ("p2", "near", "p2"), ("p2", "near", "p1"), ("p1", "is", "person"), ("p2", "is", "person"), ("c1", "of", "p1")]


def brute(pattern):
    names = sorted({x for w in pattern for x in w if x.startswith("?")})
    terms = sorted({x for r in ROWS for x in r})
    out = set()
    for values in itertools.product(terms, repeat=len(names)):
        of = dict(zip(names, values, strict=True))
        if all(tuple(of.get(x, x) for x in w) in set(ROWS) for w in pattern):
            out.add(tuple(sorted((n[1:], v) for n, v in of.items())))
    return out


@pytest.mark.parametrize(
    "pattern",
    [
        [("?c", "is", "claim"), ("?c", "of", "?p"), ("?p", "near", "?q"), ("?q", "is", "person")],
        [("?p", "near", "?p")],
        [("?c", "is", "claim")],
        [("?p", "is", "person"), ("?p", "near", "p1")],
        [("?c", "of", "?p"), ("?c", "of", "?q"), ("?p", "near", "?q"), ("?q", "near", "?p")],
        [("?c", "?what", "?p"), ("?p", "is", "person")],
    ],
)
def test_bindings(spark, pattern):
    found = claims.bindings(spark.createDataFrame(ROWS, "subject string, predicate string, object string"), pattern).collect()
    got = [tuple(sorted(r.asDict().items())) for r in found]
    assert len(got) == len(set(got)) and set(got) == brute(pattern)


def test_parts_and_amounts(spark):
    df = spark.createDataFrame(ROWS, "subject string, predicate string, object string")
    with pytest.raises(ValueError, match="common variable"):
        claims.bindings(df, [("?a", "of", "?b"), ("?c", "near", "?d")])
    with pytest.raises(ValueError, match="common variable"):
        claims.bindings(df, [("?a", "of", "?b"), ("?c", "is", "claim")])
    bound = spark.createDataFrame([("1.5", "g"), ("2", "mg"), ("x", "g"), ("3", "?"), (None, "g"), ("4\n", "g")], "value string, unit string")
    factors = spark.createDataFrame([("g", "1000"), ("mg", "1")], "unit string, factor string")
    rows = claims.as_rows(bound, "value", "unit", factors, "value", "unit").collect()
    assert sorted((r.value or "", r.unit, None if r.amount is None else float(r.amount)) for r in rows) == [("", "g", None), ("1.5", "g", 1500.0), ("2", "mg", 2.0), ("3", "?", None), ("4\n", "g", None), ("x", "g", None)] and len({r.row_id for r in rows}) == 6


def test_statements_are_dealt_out_few_times(spark, tmp_path):
    """Chains and a cycle of shared variables over many claims: no table of pairs of a claim's objects, and far fewer bytes shuffled than one join after another writes."""
    n = 4000
    rows = [(f"c{i}", "of", f"{k}{i % m}") for i in range(n) for k, m in (("p", 40), ("r", n), ("x", 1))] + [(f"r{i}", "at", f"s{i}") for i in range(n)] + [(f"s{i}", "of", f"q{i % 40}") for i in range(n)]
    rows += [(f"{k}{i}", "near", f"h{i}") for i in range(40) for k in "pq"] + [(f"c{i}", "is", "claim") for i in range(0, n, 2)] + [(f"p{i}", "is", "person") for i in range(40)] + [(f"r{i}", "is", "result") for i in range(n)]
    pattern = [("?c", "of", "?p"), ("?c", "of", "?r"), ("?c", "is", "claim"), ("?p", "is", "person"), ("?p", "near", "?h"), ("?r", "is", "result"), ("?r", "at", "?s"), ("?s", "of", "?q"), ("?q", "near", "?h")]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string").repartition(4)
    want = {(f"c{i}", f"h{i % 40}", f"p{i % 40}", f"q{i % 40}", f"r{i}", f"s{i}") for i in range(0, n, 2)}
    for distinct in (False, True):
        found = claims.bindings(df, pattern, distinct)
        assert {tuple(v for _, v in sorted(r.asDict().items())) for r in found.collect()} == want and found.count() == n // 2
    least = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(least)
    spark.conf.set(least, "-1")
    try:
        plan = claims.bindings(df, pattern)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(least, kept)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert 0 < len(keys) <= 4 and all(k.count("#") == 1 for k in keys)  # the last tables meet on one variable, each dealt out once
