import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trailmark.functions import scalars
from trailmark.functions import timealg as ta
from trailmark.operators import derived, evidence, intervals, records, rules, store
from trailmark.operators.ranges import join_by_length, join_by_start, join_ranges, semi_join_range, semi_join_ranges
from trailmark.plans import compile as plans
from trailmark.plans.pattern import Pattern, Relation, Relaxation, Step
from trailmark.sources import model


def test_range_join_reports_each_pair_once(spark):
    r = random.Random(3)
    make = lambda n: [(i, r.randint(0, 3), a := r.randint(-50, 50), a + r.choice([0, 0, 3, 40])) for i in range(n)]
    left, right = make(120), make(120)
    l = spark.createDataFrame(left, "a long, k long, a_lo long, a_hi long")
    x = spark.createDataFrame(right, "b long, k long, b_lo long, b_hi long")
    spans = (F.col("a_lo"), F.col("a_hi")), (F.col("b_lo"), F.col("b_hi"))
    want = {(p[0], q[0]) for p in left for q in right if p[1] == q[1] and p[2] <= q[3] and p[3] >= q[2]}
    for width in (1, 7, 1000):
        got = [(row.a, row.b) for row in join_ranges(l, x, ["k"], *spans, width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        got = [(row.a, row.b) for row in join_by_start(l, x, ["k"], *spans, width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {row.a for row in semi_join_ranges(l, x, ["k"], *spans, width).collect()} == {a for a, _ in want}
    got = [row.a for row in semi_join_range(l, x, ["k"], F.col("a_lo"), spans[1], 7, F.col("a_lo").between(F.col("b_lo"), F.col("b_hi"))).collect()]
    assert sorted(got) == sorted(p[0] for p in left if any(p[1] == q[1] and q[2] <= p[2] <= q[3] for q in right))


def test_joins_of_ranges_of_any_length(spark):
    """Points, short ranges and such of many millions of buckets: each pair once, each range under two buckets at most."""
    r = random.Random(6)
    make = lambda n: [(i, r.randint(0, 2), a := r.randint(-(10**4), 10**4) * r.choice([1, 10**12]), a + r.choice([0, 0, 3, 10**3, 2**40, 2**59])) for i in range(n)]
    left, right = [*make(90), (90, 0, 5, 4)], [*make(90), (90, 0, 9, 2)]  # the last ones are empty
    l, x = spark.createDataFrame(left, "a long, k long, a_lo long, a_hi long"), spark.createDataFrame(right, "b long, k long, b_lo long, b_hi long")
    spans = (F.col("a_lo"), F.col("a_hi")), (F.col("b_lo"), F.col("b_hi"))
    want = {(p[0], q[0]) for p in left[:-1] for q in right[:-1] if p[1] == q[1] and p[2] <= q[3] and p[3] >= q[2]}
    for width in (1, 7, 3 * ta.UNITS["day"], 2**59):
        found = join_by_length(l, x, ["k"], *spans, width)
        got = [(row.a, row.b) for row in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want and found.columns == ["k", "a", "a_lo", "a_hi", "b", "b_lo", "b_hi"]


def test_during_long_events(spark):
    """Events of thousands of years beside short ones, by buckets of a day, with the pairs that the relation has."""
    r = random.Random(7)
    day, schema = ta.UNITS["day"], "patient long, event_id long, kind string, lo long, hi long, end_lo long, end_hi long, micro long"
    rows = [(i % 3, i, r.choice("xy"), t, t, e, e, 0) for i in range(400) for t in [r.randint(0, 4000) * day] for e in [t + r.choice([1, 40, 2_000, 3_000_000]) * day]]
    kinds = spark.createDataFrame([("x", "x"), ("y", "y")], "concept string, ancestor string")
    pattern = Pattern((Step("a", "x"), Step("b", "y")), (Relation("r", "during", "a", "b", grace=2 * day),))
    df = spark.createDataFrame(rows, schema)
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and (x[2], y[2]) == ("x", "y") and y[3] >= x[3] and y[3] - x[5] <= 2 * day}
    got = [tuple(b) for b in plans.bindings(pattern, df, kinds, model.windows(df), ta.certain).select("a_event_id", "b_event_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pattern_checks():
    a, b = Step("a", "x"), Step("b", "y")
    with pytest.raises(ValueError):
        Pattern((a, a))
    with pytest.raises(ValueError):
        Pattern((a, b), (Relation("r", "after", "a", "zz"),))
    with pytest.raises(ValueError):
        Relation("r", "after", "a", "b", 5, 1)
    with pytest.raises(ValueError):
        ta.micros(1, "month")
    xs = (Relaxation("w1", "widen_concept", "a", Decimal(1), "p"), Relaxation("w2", "widen_concept", "a", Decimal(1), "q"), Relaxation("m", "raise_max", "r", Decimal("0.5"), 9))
    p = Pattern((a, b), (Relation("r", "after", "a", "b", 0, 3),), xs, Decimal(2))
    assert [[x.id for x in s] for s in p.sets()] == [[], ["m"], ["w1"], ["w2"], ["w1", "m"], ["w2", "m"]]
    assert p.concepts() == {"a": {"x", "p", "q"}, "b": {"y"}} and p.is_forest()


def test_closures_agree(spark):
    edges = spark.createDataFrame([*model.PARENTS.items()], "concept string, parent string")
    assert {tuple(r) for r in model.transitive(edges).collect()} == {tuple(r) for r in model.closure(spark).collect()}
    assert model.unknown_concepts(model.closure(spark), ["view", "nothing"]) == ["nothing"]


def test_decimals(spark):
    texts = ["1.5", "-0.000001", "0.0000001", "1e3", "x", "99999999999999999999", "007", ".5", "1.", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.micro_value(F.col("t")).alias("m"), scalars.is_decimal(F.col("t")).alias("d"), scalars.shortest_decimal(F.col("t")).alias("s")).collect()
    got = {r.t: (r.m, r.d) for r in rows}
    assert got["1.5"] == (1_500_000, True) and got["-0.000001"] == (-1, True) and got["0.0000001"] == (None, True) and got["x"] == (None, False)
    assert got["99999999999999999999"][0] is None and got["007"][0] == 7_000_000 and got[None][0] is None
    assert {r.t: r.s for r in rows}["1.5"] == "1.5"


def test_publish_is_content_named(spark, tmp_path):
    tables = {"events": spark.createDataFrame([(1, 5, 5, 9), (2, 6, 7, 8)], "patient long, lo long, hi long, event_id long"), "notes": spark.createDataFrame([("a", 1)], "k string, v int")}
    one = store.publish(tables, f"file://{tmp_path}")
    two = store.publish({k: t.repartition(3) for k, t in tables.items()}, f"file://{tmp_path}")
    assert one == two and store.verified(spark, one, ["events", "notes"])
    back = store.attach(spark, one, ["events", "notes"])
    assert back["events"].count() == 2 and spark.sql("SELECT count(*) FROM notes").first()[0] == 1
    other = store.publish({**tables, "notes": tables["notes"].withColumn("v", F.lit(2))}, f"file://{tmp_path}")
    assert other != one


def test_merkle_root_follows_every_leaf(spark):
    root = lambda rows: store.merkle_levels(spark.createDataFrame(rows, "patient long, digest string"), "patient", "digest").orderBy(F.desc("level")).first().hash
    rows = [(i, f"d{i}") for i in range(7)]
    assert root(rows) == root(rows[::-1]) != root([*rows[:-1], (6, "changed")])


def test_two_passes(spark):
    frame = lambda rows: spark.createDataFrame(rows, "patient long, status string, relaxations string")
    a = frame([(1, "exact", None), (2, "relaxed", "x"), (3, "relaxed", "x"), (4, "none", None), (5, "none", None)])
    b = frame([(1, "none", None), (2, "relaxed", "x"), (3, "relaxed", "y"), (4, "none", None), (5, "possible", None)])
    assert {r.patient: r.status for r in rules.two_passes(a, b).collect()} == {1: "exact", 2: "relaxed", 3: "unresolved", 4: "none", 5: "unresolved"}


def test_revisions(spark):
    rows = [(1, "s", None, "assert", 1), (2, "s", 1, "assert", 2), (3, "s", 2, "withdraw", 3), (4, "s", 2, "assert", 99), (5, "other", None, "assert", 1), (6, "s", 5, "assert", 1), (7, "s", None, "assert", None), (8, "s", None, "assert", 1), (9, "s", 8, "assert", 1), (10, "s", 8, "assert", 1)]
    df = spark.createDataFrame(rows, "id long, source string, supersedes long, operation string, available long")
    got = {r.id: r.state for r in evidence.as_known(df, F.lit(10), ["s"]).collect()}
    assert got == {1: "SUPERSEDED", 2: "SUPERSEDED", 3: "WITHDRAWAL", 4: "AFTER_CUTOFF", 5: "EXCLUDED_SOURCE", 6: "INELIGIBLE_REVISION_ANCESTOR", 7: "UNKNOWN_AVAILABILITY", 8: "REVISION_FORK", 9: "ACTIVE", 10: "ACTIVE"}


def test_shared_variables(spark):
    rows = spark.createDataFrame([(1, 1, "v", None), (1, 2, None, "v"), (2, 3, "v", "v"), (3, 4, None, None)], "patient long, event_id long, start_var string, end_var string")
    assert {r.patient: r.shared for r in store.shares_variables(rows).collect()} == {1: True, 2: False, 3: False}


def test_ranks_over_many_ranges(spark):
    """Every row once, its rank by all others, with wide rows and several ranges."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 7 != 0, (F.col("id") * 7919) % 5000).alias("distance"), F.repeat(F.lit("x"), 300).alias("wide"), F.sha2(F.col("id").cast("string"), 512).alias("more"))
    found = records.ranked_missing_last(rows, "distance", "id").cache()
    assert found.count() == found.select("id").distinct().count() == 20_000
    want = sorted(((i * 7919) % 5000, i) for i in range(20_000) if i % 7)
    assert {r.id: r.rank for r in found.select("id", "rank").collect()} == {i: k for k, (_, i) in enumerate(want, 1)} | {i: None for i in range(0, 20_000, 7)}


def test_identifiers_end_where_they_end(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",), ("a b",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(records.is_identifier(F.col("text"))).collect()] == [True, False, False, False, False]


def test_operator_results(spark):
    df = spark.createDataFrame([(0, 2, 3, 5), (0, 3, 3, 5), (0, 4, 3, 5), (3, 5, 0, 2)], "s long, e long, u long, v long")
    ask = lambda op, scope=True, clock=True, **k: [r[0] for r in df.select(intervals.operator_result(op, F.lit(scope), F.lit(clock), *map(F.col, "seuv"), **k)).collect()]
    assert ask("before") == ["TRUE", "FALSE", "FALSE", "FALSE"] and ask("meets") == ["FALSE", "TRUE", "FALSE", "FALSE"] and ask("overlaps") == ["FALSE", "FALSE", "TRUE", "FALSE"]
    assert ask("gap", least=1, most=1) == ["TRUE", "FALSE", "FALSE", "FALSE"] and ask("before", clock=False) == ask("meets", scope=False) == ["INCOMPARABLE"] * 4


def test_clashes(spark):
    facts = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (3, "q"), (3, "r")], "entity long, class string")
    disjoint = spark.createDataFrame([("p", "q"), ("r", "s")], "a string, b string")
    assert [tuple(r) for r in evidence.clashes(facts, disjoint).collect()] == [(1, "p", "q")]


def test_counts_over_dense_histories(spark):
    """Against the same counts by hand, with ranges over many steps."""
    import random

    r = random.Random(8)
    rows = [(p, 1000 * p + k, lo, lo + r.choice([0, 0, 3, 40])) for p in range(4) for k, lo in enumerate(r.randint(0, 200) for _ in range(60))]
    df = spark.createDataFrame(rows, "patient long, event_id long, lo long, hi long")
    for n, span in ((3, 5), (6, 20), (1, 0)):
        want = {}
        for p, i, lo, hi in rows:
            others = [x for x in rows if x[0] == p and x[1] != i]
            forced = min(sum(o[2] >= t - span and o[3] <= t for o in others) for t in range(lo, hi + 1))
            allowed = max(sum(o[3] >= t - span and o[2] <= t for o in others) for t in range(lo, hi + 1))
            want[i] = (forced >= n - 1, allowed >= n - 1)
        assert {x.event_id: (x.certain, x.possible) for x in derived.counted_uncertain(df, n, span).collect()} == want


def test_merkle_root_by_hand(spark):
    import hashlib

    from trailmark import queries

    from tests.conftest import SF

    hashed = lambda prefix, *parts: hashlib.sha256("".join((prefix, *parts)).encode()).hexdigest()
    rows = model.events(spark, SF).groupBy("patient").agg(F.count("*").alias("n"), F.sum("micro").alias("total"))
    leaves = [r.digest for r in rows.select("patient", scalars.digest(F.col("patient"), F.col("n"), F.col("total")).alias("digest")).orderBy("patient").collect()]
    level, want, depth = [hashed("\x00", x) for x in leaves], [], 0
    while True:
        want += [(depth, k, h) for k, h in enumerate(level)]
        if len(level) == 1:
            break
        level, depth = [hashed("\x01", *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)], depth + 1
    assert sorted(tuple(r) for r in queries.QUERIES["merkle_root"](spark, SF).select("level", "node", "hash").collect()) == want


def test_structural_classes_beside_left_out_records(spark):
    pattern = Pattern((Step("a", "x"), Step("b", "y")))
    left_out = spark.createDataFrame([(1, "x")], "patient long, concept string")
    rules.refuse_structural(pattern, left_out, {"z"})
    rules.refuse_structural(pattern, left_out.limit(0), {"y"})
    with pytest.raises(ValueError, match="records of y"):
        rules.refuse_structural(pattern, left_out, {"y", "z"})


def test_undetermined_findings(spark):
    windows = spark.createDataFrame([(1, 10, 20), (2, 10, 20), (3, None, None), (4, 10, 20)], "patient long, w_start long, w_end long")
    findings = spark.createDataFrame([(1, "x", 5, 12, "undetermined"), (1, "y", 30, 31, "undetermined"), (2, "x", 1, 2, "undetermined"), (3, "x", 12, 12, "undetermined"), (4, "x", 12, 12, "found"), (4, "z", 12, 12, "undetermined")], "patient long, kind string, x_lo long, x_hi long, finding string")
    closure = spark.createDataFrame([("x", "x"), ("y", "y"), ("z", "z")], "concept string, ancestor string")
    pattern = Pattern((Step("a", "x"), Step("b", "y")), scope="within")
    reach = rules.undetermined(pattern, findings, closure, windows, ["a", "b"])
    assert sorted(tuple(r) for r in reach.collect()) == [(1, "a", 1, 1), (1, "b", 1, 0), (2, "a", 1, 0)]
    statuses = spark.createDataFrame([(p, s) for p, s in ((1, "none"), (2, "none"), (3, "excluded"), (4, "relaxed"))], "patient long, status string")
    assert {r.patient: (r.status, r.steps) for r in rules.with_undetermined(statuses, reach).collect()} == {1: ("not_comparable", "a"), 2: ("none", None), 3: ("excluded", None), 4: ("relaxed", None)}


def test_interval_pairs_of_any_width(spark):
    r = random.Random(4)
    rows = [(k, r.randint(0, 2), a := r.randint(0, 10**9), a + r.choice([0, 10**6, 10**9, 10**10])) for k in range(150)]
    df = spark.createDataFrame(rows, "event_id long, patient long, s long, e long")
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] != y[0] and x[1] == y[1] and x[2] - 50 <= y[3] and x[3] + 50 >= y[2]}
    for width in (None, 10**7, 10**12):
        found = [(p.a_event_id, p.b_event_id) for p in intervals.pairs(df, df, ["patient"], 50, width).select("a_event_id", "b_event_id").collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert intervals.usual_length(df) in (ta.UNITS["hour"], 10**10) and intervals.usual_length(df.limit(0)) == ta.UNITS["hour"]
