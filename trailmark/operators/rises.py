"""Readings against the mean of the ones before them, where times are uncertain.

At a time t of its range a reading's base is the last `previous` of the readings of its kind in [t - within, t - 1]. Each other reading is
forced to be there, allowed, or neither, and a choice of last ones is possible if it can be later than all forced ones left out: chosen
readings are put as late, others as early or as far out as they can be. The least and the greatest sums of such choices decide t;
they change only where a bound of a reading passes, so that each stretch between such times is tried once.

Only readings that can still be among the last ones matter: what ends before `previous` readings that surely come before t and later than it can't be.
So each reading is joined with its neighbours in time, not with its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.timealg import UNITS
from trailmark.operators.ranges import join_ranges

Reading = tuple[int, int, int, int]  # lo, hi, id, value


def sums(t: int, others: list[Reading], previous: int, within: int) -> Iterator[tuple[int, int, int]]:
    """(n, least, greatest sum) of the bases that are possible at t, n being how many readings they have; (0, 0, 0) where it can be empty."""
    allowed = [o for o in others if o[0] <= t - 1 and o[1] >= t - within]
    forced = [o for o in allowed if o[0] >= t - within and o[1] <= t - 1]
    latest = lambda o: (min(o[1], t - 1), o[2])
    for last in allowed:  # the chosen one that comes first of them
        bound = latest(last)
        must = [o for o in forced if o is not last and (o[0], o[2]) >= bound]
        free = sorted(o[3] for o in allowed if o is not last and latest(o) > bound and not any(o is m for m in must))
        more = previous - 1 - len(must)
        if 0 <= more <= len(free):
            held = last[3] + sum(o[3] for o in must)
            yield previous, held + sum(free[:more]), held + sum(free[len(free) - more :])
    held, free = sum(o[3] for o in forced), sorted(o[3] for o in allowed if not any(o is m for m in forced))
    for n in range(len(forced), min(previous - 1, len(allowed)) + 1):
        more = n - len(forced)
        yield n, held + sum(free[:more]), held + sum(free[len(free) - more :])


def judged(lo: int, hi: int, value: int, others: list[Reading], previous: int, within: int, factor: tuple[int, int], floor: int, falls: bool) -> tuple[bool, list[tuple[int, int]]]:
    """Whether the reading rises (falls) at all times of its range in all worlds, and the stretches of its range at which it does in some."""
    num, den = factor
    points = {lo} | {x for o in others for x in (o[0] + 1, o[0] + 2, o[1] + 1, o[1] + 2, o[0] + within + 1, o[1] + within + 1) if lo < x <= hi}
    starts = sorted(points)

    def meets(n: int, total: int) -> bool:
        base = max(total, n * floor)
        return n > 0 and (value * n * num <= base * den if falls else value * n * den >= base * num)

    sure, spans = True, []
    for k, t in enumerate(starts):
        found = list(sums(t, others, previous, within))
        may = any(meets(n, most if falls else least) for n, least, most in found)
        sure = sure and all(meets(n, least if falls else most) for n, least, most in found)
        end = starts[k + 1] - 1 if k + 1 < len(starts) else hi
        if may:
            spans = [*spans[:-1], (spans[-1][0], end)] if spans and spans[-1][1] == t - 1 else [*spans, (t, end)]
    return sure, spans


def near(events: DataFrame, previous: int, within: int) -> DataFrame:
    """patient, event_id and others: the readings of its kind that can be among the last ones before it."""
    keys = ["patient", "kind"]
    # those that end before an event begins, in the order of their ends; of the last `previous` of them, the least beginning
    marks = events.select(*keys, F.inline(F.array(F.struct(F.col("hi").alias("t"), F.lit(1).alias("own"), "event_id", F.col("lo").alias("v")), F.struct(F.col("lo").alias("t"), F.lit(0).alias("own"), "event_id", F.lit(None).cast("long").alias("v")))))
    order = Window.partitionBy(*keys).orderBy("t", "own", "event_id")  # an event's beginning before what ends with it
    ranked = marks.withColumn("n", F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    asked = ranked.filter("own = 0 AND n > 0").select(*keys, "event_id", F.explode(F.sequence(F.greatest(F.col("n") - previous + 1, F.lit(1)), F.col("n"))).alias("n"), F.col("n").alias("of"))
    bound = asked.join(ranked.filter("own = 1").select(*keys, "n", "v"), [*keys, "n"]).groupBy("patient", "event_id").agg(F.when(F.count("*") == previous, F.min("v")).alias("from_"))
    left = events.select(*keys, "event_id", "lo", "hi").join(bound, ["patient", "event_id"], "left").withColumn("from_", F.greatest(F.col("lo") - within, "from_"))
    right = events.select(*keys, F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), F.col("event_id").alias("o_id"), F.col("micro").alias("o_micro"))
    met = join_ranges(left, right, keys, (F.col("from_"), F.col("hi") - 1), (F.col("o_lo"), F.col("o_hi")), max(within, UNITS["hour"])).filter("event_id <> o_id")
    return met.groupBy("patient", "event_id").agg(F.collect_list(F.struct("o_lo", "o_hi", "o_id", "o_micro")).alias("others"))


def uncertain(events: DataFrame, previous: int, within: int, factor: tuple[int, int], floor: int, falls: bool = False) -> DataFrame:
    """patient, event_id, certain and spans (from_, to_) of the readings that rise, or fall, in some world."""
    rows = events.select("patient", "event_id", "lo", "hi", "micro").join(near(events, previous, within), ["patient", "event_id"])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                others = [(o["o_lo"], o["o_hi"], o["o_id"], o["o_micro"]) for o in r["others"]]
                sure, spans = judged(r["lo"], r["hi"], r["micro"], others, previous, within, factor, floor, falls)
                if spans:
                    out.append({"patient": r["patient"], "event_id": r["event_id"], "certain": sure, "spans": [{"from_": a, "to_": b} for a, b in spans]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("patient", pa.int64()), ("event_id", pa.int64()), ("certain", pa.bool_()), ("spans", pa.list_(pa.struct([("from_", pa.int64()), ("to_", pa.int64())])))])
    return rows.mapInArrow(run, "patient bigint, event_id bigint, certain boolean, spans array<struct<from_: bigint, to_: bigint>>")


def selected(events: DataFrame, previous: int, within: int, factor: tuple[int, int], floor: int, falls: bool, possible: bool) -> DataFrame:
    """The readings that rise in all worlds; possible: each stretch of a reading's range at which it can. A point's end is narrowed with its start."""
    found = uncertain(events, previous, within, factor, floor, falls)
    if not possible:
        return events.join(found.filter("certain"), ["patient", "event_id"], "left_semi")
    met = events.join(found.select("patient", "event_id", F.inline("spans")), ["patient", "event_id"])
    point = (F.col("end_lo") == F.col("lo")) & (F.col("end_hi") == F.col("hi"))
    return met.withColumns({"lo": F.col("from_"), "hi": F.col("to_"), "end_lo": F.when(point, F.col("from_")).otherwise(F.col("end_lo")), "end_hi": F.when(point, F.col("to_")).otherwise(F.col("end_hi"))}).select(*events.columns)
