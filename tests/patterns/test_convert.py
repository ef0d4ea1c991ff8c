import random

from pyspark.sql import functions as F

from trailmark.functions.timealg import FOREVER
from trailmark.sources import convert

SCHEMA = "patient long, record_id long, source string, kind string, system string, code string, lo long, hi long, status string, supersedes long, mentions array<struct<concept: string, assertion: string, experiencer: string>>"


def brute(rows):
    """One record after the other, orders as a stack."""
    out = []
    later = {(p, s, x) for p, _, s, *_, x, _ in rows if x is not None}
    concepts = {"c0": "heart", "c1": "lung", "c2": "heart"}
    stacks: dict = {}
    moves = []
    for p, i, s, kind, _, code, lo, hi, status, _, mentions in rows:
        if (p, s, i) in later or status != "done":
            continue
        if kind == "letter":
            first = min(r[6] for r in rows if r[0] == p)
            out += [(p, f"{i}#{k}", "mention", m[0], s, first, hi, first, hi) for k, m in enumerate(mentions or []) if m[1:] == ("present", "patient")]
        elif concept := concepts.get(code):
            if kind in ("order", "stop"):
                moves.append((lo if kind == "order" else hi, kind == "stop", lo, hi, i, p, concept, s))
            else:
                out.append((p, str(i), kind, concept, s, lo, hi, lo, hi))
    ends = {}
    for _, stops, lo, hi, i, p, concept, s in sorted(moves):
        stack = stacks.setdefault((p, concept), [])
        if not stops:
            stack.append(i)
        elif stack:
            ends[stack.pop()] = (lo, hi)
    for _, stops, lo, hi, i, p, concept, s in moves:
        if not stops:
            a, b = ends.get(i, (None, None))
            out.append((p, str(i), "exposure", concept, s, lo, hi, lo if b is None else max(a, lo), FOREVER if b is None else max(b, a, lo)))
    return sorted(out)


def test_converted_as_by_hand(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        lo = r.randint(0, 60)
        kind = r.choice(["order", "order", "stop", "stop", "letter", "observation"])
        mentions = [(r.choice(["heart", "lung"]), r.choice(["present", "absent"]), r.choice(["patient", "family"])) for _ in range(r.randint(0, 3))] if kind == "letter" and r.random() < 0.9 else None
        rows.append((r.randint(0, 9), i, r.choice("ab"), kind, "local", r.choice(["c0", "c1", "c2", "c3", None]), lo, lo + r.choice([0, 0, 3]), r.choice(["done"] * 5 + ["cancelled", None]), r.choice([None] * 5 + [r.randint(0, 399)]), mentions))
    df = spark.createDataFrame(rows, SCHEMA)
    codes = spark.createDataFrame([("local", "c0", "heart"), ("local", "c1", "lung"), ("local", "c2", "heart")], "system string, code string, concept string")
    found = convert.converted(df, codes, ["done"], ["letter"], F.col("kind") == "order", F.col("kind") == "stop")
    assert sorted(tuple(x) for x in found.collect()) == brute(rows)
    counts = {x.outcome: x["count"] for x in convert.outcomes(df, codes, ["done"], ["letter"]).groupBy("outcome").count().collect()}
    assert sum(counts.values()) == 400 and set(counts) == {"superseded", "not_performed", "letter", "uncoded", "unknown_code", "coded"}
    at = convert.converted(df, codes, ["done"], ["letter"], F.col("kind") == "order", F.col("kind") == "stop", at_letter=True).filter("kind = 'mention'")
    assert at.join(df.select(F.col("record_id").cast("string").alias("id"), F.col("lo").alias("own")), F.substring_index("event_id", "#", 1) == F.col("id")).filter("lo <> own").count() == 0
