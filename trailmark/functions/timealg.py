"""Column algebra of uncertain times.

An event's start lies in [lo, hi] and its end in [end_lo, end_hi]; an ongoing event's end_hi is FOREVER, a point's end is its
start. All are long microseconds. A world is one choice of all times; a constraint lo <= y - x <= hi is certain if it holds in all
worlds and plausible if in some. Bounds here are closed forms for events without shared time variables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOREVER = 1 << 60
#: Microseconds from 0001-01-01 to 1970-01-01 (fixed value).
EPOCH = 62_135_596_800_000_000
UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def micros(amount: int, unit: str) -> int:
    """An amount of a fixed unit; calendar units have no fixed length and are refused."""
    if unit not in UNITS:
        raise ValueError(f"not a unit of fixed length: {unit}")
    return amount * UNITS[unit]


def micros_of(ts: Column) -> Column:
    """A timestamp without zone as microseconds since 0001-01-01."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) + EPOCH


def tightened(lo: Column, hi: Column, end_lo: Column, end_hi: Column, proper: Column | None = None) -> dict[str, Column]:
    """Ranges narrowed by start <= end, or start < end where proper; `empty` marks an event that has no world."""
    p = F.when(proper, 1).otherwise(0) if proper is not None else F.lit(0)
    return {"lo": lo, "hi": F.least(hi, end_hi - p), "end_lo": F.greatest(end_lo, lo + p), "end_hi": end_hi, "empty": lo + p > end_hi}


def difference(x_lo: Column, x_hi: Column, y_lo: Column, y_hi: Column, same: Column | None = None) -> tuple[Column, Column]:
    """The least and greatest y - x; both zero where x and y are the same instant."""
    least, most = y_lo - x_hi, y_hi - x_lo
    if same is None:
        return least, most
    return F.when(same, F.lit(0)).otherwise(least), F.when(same, F.lit(0)).otherwise(most)


def certain(bounds: tuple[Column, Column], lo: int | None, hi: int | None) -> Column:
    out = F.lit(True)
    if lo is not None:
        out = out & (bounds[0] >= lo)
    return out & (bounds[1] <= hi) if hi is not None else out


def plausible(bounds: tuple[Column, Column], lo: int | None, hi: int | None) -> Column:
    out = F.lit(lo is None or hi is None or lo <= hi)
    if lo is not None:
        out = out & (bounds[1] >= lo)
    return out & (bounds[0] <= hi) if hi is not None else out


def _raised(x: Column, edges: list[tuple[int, int, int]]) -> Column:
    """All times raised at once by what the edges (i, j, w: x[j] - x[i] >= w) ask of them."""

    def node(value: Column, at: Column) -> Column:
        own = [F.when(at == j, F.get(x, F.lit(i)) + w) for i, j, w in edges]
        return F.greatest(value, *own) if own else value  # greatest() skips nulls

    return F.transform(x, node) if edges else x


def earliest(lows: Column, edges: list[tuple[int, int, int]]) -> Column:
    """The least times that meet all edges, where there are such: longest paths by raising all times as often as there are nodes. The expression
    doesn't grow with the rounds."""
    return F.aggregate(F.sequence(F.lit(1), F.size(lows)), lows, lambda x, _: _raised(x, edges))


def feasible(lows: Column, highs: Column, edges: list[tuple[int, int, int]]) -> Column:
    """Whether times x with lows <= x <= highs and x[j] - x[i] >= w for all edges (i, j, w) exist. What still moves after as many rounds as
    there are nodes never settles."""
    return F.transform(F.array(earliest(lows, edges)), lambda x: (_raised(x, edges) == x) & F.forall(F.zip_with(x, highs, lambda a, b: a <= b), lambda ok: ok))[0]


def allen(s: Column, e: Column, u: Column, v: Column) -> Column:
    """The one of the thirteen relations that [s, e] has to [u, v]; null unless both are proper."""
    cases = [
        (e < u, "before"), (s > v, "after"), (e == u, "meets"), (s == v, "met_by"), ((s == u) & (e == v), "equals"), ((s == u) & (e < v), "starts"), ((s == u) & (e > v), "started_by"),
        ((e == v) & (s > u), "finishes"), ((e == v) & (s < u), "finished_by"), ((s > u) & (e < v), "during"), ((s < u) & (e > v), "contains"), ((s < u) & (e > u) & (e < v), "overlaps"), ((s > u) & (s < v) & (e > v), "overlapped_by"),
    ]
    out = F.lit(None).cast("string")
    for holds, name in reversed(cases):
        out = F.when(holds, name).otherwise(out)
    return F.when((s < e) & (u < v), out)


#: Atoms a - b <= k of each operator, over s, e (left) and u, v (right); inverses swap the sides (fixed values).
ATOMS = {
    "before": [("e", "u", -1)], "meets": [("e", "u", 0), ("u", "e", 0)], "overlaps": [("s", "u", -1), ("u", "e", -1), ("e", "v", -1)],
    "starts": [("s", "u", 0), ("u", "s", 0), ("e", "v", -1)], "during": [("u", "s", -1), ("e", "v", -1)], "finishes": [("u", "s", -1), ("e", "v", 0), ("v", "e", 0)],
    "equals": [("s", "u", 0), ("u", "s", 0), ("e", "v", 0), ("v", "e", 0)],
}
INVERSES = {"after": "before", "met_by": "meets", "overlapped_by": "overlaps", "started_by": "starts", "contains": "during", "finished_by": "finishes"}


def atoms(operator: str, least: int | None = None, most: int | None = None) -> list[tuple[str, str, int]]:
    """The difference atoms of a named relation, of a gap (u - e), a duration (e - s) or a minimum overlap."""
    if operator in INVERSES:
        swap = {"s": "u", "e": "v", "u": "s", "v": "e"}
        return [(swap[a], swap[b], k) for a, b, k in ATOMS[INVERSES[operator]]]
    if operator in ATOMS:
        return ATOMS[operator]
    if operator == "minimum_overlap":
        return [(a, b, -(least or 0)) for a in ("s", "u") for b in ("e", "v")]
    if operator not in ("gap", "duration"):
        raise ValueError(f"unknown operator: {operator}")
    low, high = ("e", "u") if operator == "gap" else ("s", "e")
    return ([(low, high, -least)] if least is not None else []) + ([(high, low, most)] if most is not None else [])


def classified(found: list[tuple[str, str, int]], lows: dict[str, Column], highs: dict[str, Column], comparable: Column, proper: bool = True) -> Column:
    """IMPOSSIBLE, INCOMPARABLE, CERTAIN or POSSIBLE for the atoms over four instants, each with its own range: infeasible first,
    then clocks, then whether each atom is entailed by the ranges."""
    names = ["s", "e", "u", "v"]
    at = {n: i for i, n in enumerate(names)}
    edges = [(at[a], at[b], -k) for a, b, k in found] + ([(0, 1, 1), (2, 3, 1)] if proper else [])
    possible = feasible(F.array(*(lows[n] for n in names)), F.array(*(highs[n] for n in names)), edges)
    entailed = F.lit(True)
    for a, b, k in found:
        bound = highs[a] - lows[b]
        entailed = entailed & (bound <= k)
    return F.when(~possible & comparable, "IMPOSSIBLE").when(~comparable, "INCOMPARABLE").when(entailed, "CERTAIN").otherwise("POSSIBLE")
