"""Bindings decided jointly: the differences among the times of a binding's events as one network inside a column expression.

Nodes are the start and the end of each step. An edge (i, j, w) says x[j] - x[i] >= w; its weight may be a column, and NEVER says nothing.
What every binding has (its events' own order, events that two steps share, order facts, shared time variables) is its structure;
relations and scope are what the pattern asks. A binding is feasible if both hold together in some world, and certain if its structure leaves
no world in which what is asked fails: each single demand's opposite is tried against the structure.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions import timealg as ta
from trailmark.plans.pattern import Pattern

NEVER = -(1 << 61)
Edge = tuple[int, int, Column | int]


def if_so(condition: Column) -> Column:
    """The weight of an edge that holds on a condition."""
    return F.when(condition, F.lit(0).cast("long")).otherwise(F.lit(NEVER))


def place(pattern: Pattern) -> dict[str, int]:
    """The node of each step's start; its end is the next one."""
    return {s.id: 2 * k for k, s in enumerate(pattern.steps)}


def structure(pattern: Pattern, variables: bool = False) -> list[Edge]:
    """Starts before ends, a point's end at its start, and steps with one event at one time. variables: nodes carry the names of their time variables
    (start_name, end_name) and of those that are surely no earlier (start_after, end_after)."""
    at, out = place(pattern), []
    for i, n in at.items():
        point = (F.col(f"{i}_end_lo") == F.col(f"{i}_lo")) & (F.col(f"{i}_end_hi") == F.col(f"{i}_hi"))
        out += [(n, n + 1, 0), (n + 1, n, if_so(F.col(f"{i}_start_name") == F.col(f"{i}_end_name") if variables else point))]
    for (i, n), (j, m) in combinations(at.items(), 2):
        if variables:
            for a, x in (("start", n), ("end", n + 1)):
                for b, y in (("start", m), ("end", m + 1)):
                    one, two = F.col(f"{i}_{a}_name"), F.col(f"{j}_{b}_name")
                    out += [(x, y, if_so((one == two) | F.array_contains(f"{i}_{a}_after", two))), (y, x, if_so((one == two) | F.array_contains(f"{j}_{b}_after", one)))]
        else:
            same = if_so(F.coalesce(F.col(f"{i}_event_id") == F.col(f"{j}_event_id"), F.lit(False)))
            out += [(n, m, same), (m, n, same), (n + 1, m + 1, same), (m + 1, n + 1, same)]
    return out


def demands(pattern: Pattern) -> list[Edge]:
    at, out = place(pattern), []
    for r in pattern.relations:
        a, b = at[r.source], at[r.target]
        if r.kind == "after":
            out += ([(a, b, r.least)] if r.least is not None else []) + ([(b, a, -r.most)] if r.most is not None else [])
        else:
            out += [(a, b, 0), (b, a + 1, -r.grace)]
    return out


def ranges(pattern: Pattern) -> tuple[list[Column], list[Column]]:
    names = [(f"{s.id}_{e}lo", f"{s.id}_{e}hi") for s in pattern.steps for e in ("", "end_")]
    return [F.col(a) for a, _ in names], [F.col(b) for _, b in names]


def scoped(pattern: Pattern, lows: list[Column], highs: list[Column]) -> tuple[list[Column], list[Column]]:
    """Ranges with every start inside the scope."""
    start = lambda k: k % 2 == 0
    if pattern.scope in ("from_start", "within"):
        lows = [F.greatest(x, F.col("w_start")) if start(k) else x for k, x in enumerate(lows)]
    if pattern.scope == "within":
        highs = [F.least(x, F.col("w_end")) if start(k) else x for k, x in enumerate(highs)]
    if pattern.scope == "after":
        lows = [F.greatest(x, F.col("w_end")) if start(k) else x for k, x in enumerate(lows)]
    return lows, highs


def feasible(pattern: Pattern, more: list[Edge] = (), variables: bool = False) -> Column:
    """Whether the binding's structure, more and what the pattern asks hold together in some world."""
    lows, highs = scoped(pattern, *ranges(pattern))
    return ta.feasible(F.array(*lows), F.array(*highs), structure(pattern, variables) + list(more) + demands(pattern))


def certain(pattern: Pattern, more: list[Edge] = (), variables: bool = False) -> Column:
    """Whether the structure and more leave some world, and what the pattern asks holds in each."""
    (lows, highs), own = ranges(pattern), structure(pattern, variables) + list(more)
    holds = lambda lo, hi, edges: ta.feasible(F.array(*lo), F.array(*hi), edges)
    out = holds(lows, highs, own)
    for i, j, w in demands(pattern):
        out = out & ~holds(lows, highs, [*own, (j, i, 1 - w)])
    for k in range(0, len(lows), 2):
        if pattern.scope in ("from_start", "within", "after"):
            early = F.col("w_end" if pattern.scope == "after" else "w_start") - 1
            out = out & ~holds(lows, [F.least(h, early) if n == k else h for n, h in enumerate(highs)], own)
        if pattern.scope == "within":
            out = out & ~holds([F.greatest(x, F.col("w_end") + 1) if n == k else x for n, x in enumerate(lows)], highs, own)
    return out
