import itertools
import random

import pytest

from trailmark.operators.reasoning import Has, Is, Rule, derived

RULES = [
    Rule("chain", Is("y", "b"), (Is("x", "b"), Has("x", "p", "y"), Is("y", "a"))),
    Rule("start", Is("x", "b"), (Is("x", "a"), Is("x", "s"))),
    Rule("back", Is("x", "c"), (Has("x", "p", "y"), Is("y", "b"))),
    Rule("both", Is("z", "d"), (Has("x", "p", "y"), Has("y", "q", "z"))),
    Rule("more", Is("x", "e"), (Is("x", "d"), Has("x", "q", "y"), Has("y", "p", "z"), Is("z", "c"))),
]


def brute(classes, properties, rules):
    known = set(classes)
    while True:
        new = set()
        for s, e in itertools.product({x[0] for x in classes} | {x[0] for x in properties}, [None]):
            entities = {x[1] for x in known if x[0] == s} | {x[1] for x in properties if x[0] == s} | {x[3] for x in properties if x[0] == s}
            for rule in rules:
                names = sorted({v for a in rule.when for v in a.variables})
                for values in itertools.product(entities, repeat=len(names)):
                    of = dict(zip(names, values, strict=True))
                    if all((s, of[a.variable], a.kind) in known if isinstance(a, Is) else (s, of[a.subject], a.name, of[a.object]) in properties for a in rule.when):
                        new.add((s, of[rule.then.variable], rule.then.kind))
        if new <= known:
            return known
        known |= new


@pytest.mark.parametrize("seed", range(3))
def test_fixpoint(spark, seed):
    r = random.Random(seed)
    classes = {(s, r.randint(0, 5), r.choice("as")) for s in range(4) for _ in range(7)}
    properties = {(s, r.randint(0, 5), r.choice("pq"), r.randint(0, 5)) for s in range(4) for _ in range(7)}
    found = derived(spark.createDataFrame(sorted(classes) * 2, "patient long, entity long, class string"), spark.createDataFrame(sorted(properties), "patient long, subject long, property string, object long"), RULES, ["patient"]).collect()
    assert len(found) == len(set(found)) and {tuple(x) for x in found} == brute(classes, properties, RULES)


def test_scopes_do_not_meet(spark):
    classes = spark.createDataFrame([(1, 1, 7, "a"), (1, 1, 7, "s"), (1, 2, 8, "a")], "patient long, episode long, entity long, class string")
    properties = spark.createDataFrame([(1, 1, 7, "p", 8), (1, 2, 7, "p", 8)], "patient long, episode long, subject long, property string, object long")
    out = {tuple(x) for x in derived(classes, properties, RULES[:2], ["patient", "episode"]).collect()}
    assert (1, 1, 7, "b") in out and (1, 2, 8, "b") not in out and (1, 1, 8, "b") not in out


def test_checks(spark):
    with pytest.raises(ValueError, match="unknown variable"):
        Rule("r", Is("z", "a"), (Is("x", "b"),))
    with pytest.raises(ValueError, match="parts"):
        Rule("r", Is("x", "a"), (Is("x", "b"), Is("y", "c")))
    with pytest.raises(ValueError, match="to itself"):
        Rule("r", Is("x", "a"), (Has("x", "p", "x"),))
    empty = spark.createDataFrame([], "patient long, entity long, class string")
    assert derived(empty, spark.createDataFrame([], "patient long, subject long, property string, object long"), RULES, ["patient"]).count() == 0
