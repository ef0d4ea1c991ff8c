"""Conditions, counts under uncertain times, and records, against enumeration and hand-made cases."""

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from trailmark.operators import counts, records
from trailmark.plans import compile as plans
from trailmark.plans.conditions import condition, duration, excluded_kinds
from trailmark.plans.pattern import Pattern, Step
from trailmark.sources import model


def test_conditions():
    c = condition({"unit": "mg", "gt": "1.5", "le": "2"})
    assert c.lower == (Decimal("1.5"), False) and c.upper == (Decimal(2), True) and c.micro_bounds() == (1_500_001, 2_000_001)
    assert condition({"unit": "mg", "eq": "0.0000005"}).micro_bounds() == (1, 1)  # no whole millionth
    assert condition({"unit": "mg", "ge": "1"}).contains(c) and not c.contains(condition({"unit": "mg", "ge": "1"}))
    assert not condition({"unit": "g", "ge": "1"}).contains(c) and condition({"unit": "mg", "gt": "1.5"}).contains(c) and not condition({"unit": "mg", "lt": "2"}).contains(c)
    for bad in ({"unit": "mg"}, {"unit": " mg", "ge": "1"}, {"unit": "mg", "ge": "1", "gt": "1"}, {"unit": "mg", "eq": "1", "lt": "2"}, {"unit": "mg", "gt": "1", "le": "1"}, {"unit": "mg", "ge": "NaN"}, {"unit": "mg", "ge": 1}, {"unit": "mg", "ge": "1", "other": "2"}):
        with pytest.raises(ValueError):
            condition(bad)
    assert duration("1.5", "second") == 1_500_000 and excluded_kinds(["mention"]) == ("mention",)
    for bad in (("0", "day"), ("-1", "day"), ("0.0000001", "second"), ("1", "month")):
        with pytest.raises(ValueError):
            duration(*bad)
    for bad in ([], ["mention", "mention"], ["order"]):
        with pytest.raises(ValueError):
            excluded_kinds(bad)


@pytest.mark.parametrize("seed", range(4))
def test_narrowed_counts_against_worlds(spark, seed):
    r = random.Random(seed)
    n, span, rows = r.choice((1, 2, 3)), r.choice((0, 2, 3)), []
    for p in range(25):
        for i in range(r.randint(1, 4)):
            lo = r.randint(0, 8)
            rows.append((p, 10 * p + i, "k", lo, hi := lo + r.randint(0, 3), lo, hi))
    found = counts.narrowed(spark.createDataFrame(rows, "patient long, event_id long, kind string, lo long, hi long, end_lo long, end_hi long"), n, span).collect()
    got = {}
    for x in found:
        assert (x.end_lo, x.end_hi) == (x.lo, x.hi)
        got.setdefault(x.event_id, []).append((x.lo, x.hi))
    for p, i, _, lo, hi, *_ in rows:
        others = [range(a, b + 1) for q, j, _, a, b, *_ in rows if q == p and j != i]
        fit = [t for t in range(lo, hi + 1) if any(sum(t - span <= x <= t for x in w) >= n - 1 for w in itertools.product(*others))]
        runs = [[t for _, t in g] for _, g in itertools.groupby(enumerate(fit), lambda x: x[1] - x[0])]
        assert sorted(got.get(i, [])) == [(g[0], g[-1]) for g in runs]


def test_unknown_concepts_are_refused(spark):
    closure = model.closure(spark)
    events = spark.createDataFrame([], "patient long, event_id long, kind string, lo long, hi long, end_lo long, end_hi long, micro long")
    windows = spark.createDataFrame([], "patient long, w_start long, w_end long")
    with pytest.raises(ValueError, match="unknown concepts: veiw"):
        plans.exact_patients(Pattern((Step("a", "veiw"),)), events, closure, windows)
    assert plans.exact_patients(Pattern((Step("a", "view"),)), events, closure, windows).count() == 0


def test_mappings(spark):
    rows = [("a", 1, 1, None, "accept"), ("a", 2, 2, 1, "withdraw"), ("b", None, None, None, None), ("c", 3, 3, None, "accept"), ("d", 4, 4, None, "withdraw"), ("e", 5, 5, None, "accept"), ("e", 6, 6, 9, "withdraw")]
    out = records.mapping_outcomes(spark.createDataFrame(rows, "mapping string, decision int, seq int, supersedes int, action string"))
    assert {r.mapping: r.status for r in out.collect()} == {"a": "WITHDRAWN", "b": "PENDING", "c": "ACCEPTED", "d": "INVALID", "e": "INVALID"}
    mappings = spark.createDataFrame([("c", "x", "y"), ("a", "z", "y")], "mapping string, source_class string, target_class string")
    assert records.mapping_rules(out, mappings).count() == 0
    assert [tuple(r) for r in records.mapping_rules(out.filter("mapping = 'c'"), mappings).collect()] == [("x", "y")]


def test_ranking_and_scalars(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else (i * 7) % 11) for i in range(60)], "id long, distance long").repartition(5)
    out = {r.id: r.rank for r in records.ranked_missing_last(df, "distance", "id").collect()}
    want = sorted((d, i) for i, d in [(i, (i * 7) % 11) for i in range(60) if i % 5])
    assert out == {**{i: None for i in range(0, 60, 5)}, **{i: k for k, (_, i) in enumerate(want, 1)}}
    row = spark.sql("SELECT date'2020-02-29' AS b, 'a-B_9' AS x, 'a b' AS y").select(*records.age_range(F.col("b"), F.lit(1)), records.is_identifier(F.col("x")), records.is_identifier(F.col("y"))).first()
    assert [str(v) for v in row] == ["2021-02-28", "2022-02-27", "True", "False"]
    zoned = spark.sql("SELECT '2020-01-01T00:00:01.5+02:00' AS t, '2019-12-31T22:00:00Z' AS o").select(model.offset_micros(F.col("t"), F.col("o"))).first()[0]
    assert zoned == 1_500_000


def test_metrics_of_measures(spark):
    from trailmark.operators import similarity

    rank = lambda ids: spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)] + [(99, None)], "patient long, distance double")
    relevant = spark.createDataFrame([(1,), (2,), (3,), (99,)], "patient long")
    found = {r.measure: tuple(r)[1:] for r in similarity.measure_metrics({"good": rank([1, 2, 3, 4, 5, 6]), "late": rank([4, 5, 6, 7, 1, 8, 2, 9, 10, 11, 12, 3]), "none": rank([7, 8])}, relevant).collect()}
    assert found["good"] == (1.0, 0.6, 1.0, 1.0) and found["none"] == (0.0, 0.0, 0.0, 0.0)
    assert found["late"] == (round((1 / 5 + 2 / 7 + 3 / 12) / 3, 9), 0.2, round(2 / 3, 9), 0.2)
