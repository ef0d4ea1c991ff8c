"""Patterns: steps bound to events of concepts, relations between their times, priced relaxations, a scope.

A pattern is checked when it is made; relaxation sets are listed cheapest first. `after` means min <= start(to) - start(from) <= max;
`during` means start(to) >= start(from) and start(to) - end(from) <= grace. Scopes tie every step's start to the patient's window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from decimal import Decimal
from itertools import combinations

SCOPES = ("any", "from_start", "within", "after")


@dataclass(frozen=True)
class Step:
    id: str
    concept: str
    occurrence: str | None = None  #: first, last or None for any
    at_least: int | None = None  #: least value, in millionths
    below: int | None = None
    nth: int | None = None  #: the nth event from the start, or from the end if negative
    count: tuple[int, int] | None = None  #: an event with so many, itself included, in the span of so many microseconds up to it
    rise: tuple[int, int, int, int, int] | None = None  #: a reading at least num / den times the mean of up to `previous` ones `within` microseconds before, or times a floor: (previous, within, num, den, floor)
    falls: bool = False  #: the rise turned round: at most the mean divided by num / den

    def __post_init__(self):
        if self.occurrence not in (None, "first", "last"):
            raise ValueError(f"occurrence of {self.id}: {self.occurrence}")
        if sum(x is not None for x in (self.occurrence, self.nth, self.count, self.rise)) > 1 or self.nth == 0 or (self.count and (self.count[0] < 1 or self.count[1] < 0)):
            raise ValueError(f"one derived condition at most, of whole numbers: {self.id}")
        if self.falls and not self.rise:
            raise ValueError(f"{self.id} falls by nothing")
        if None not in (self.at_least, self.below) and self.at_least >= self.below:
            raise ValueError(f"no value can meet the condition of {self.id}")


@dataclass(frozen=True)
class Relation:
    id: str
    kind: str
    source: str
    target: str
    least: int | None = None
    most: int | None = None
    grace: int = 0

    def __post_init__(self):
        if self.kind not in ("after", "during") or self.source == self.target:
            raise ValueError(f"relation {self.id}")
        if None not in (self.least, self.most) and self.least > self.most:
            raise ValueError(f"empty range of {self.id}")


@dataclass(frozen=True)
class Relaxation:
    id: str
    kind: str  #: widen_concept, raise_max or raise_grace
    target: str
    cost: Decimal
    value: str | int

    def __post_init__(self):
        if self.kind not in ("widen_concept", "raise_max", "raise_grace") or self.cost <= 0:
            raise ValueError(f"relaxation {self.id}")


@dataclass(frozen=True)
class Pattern:
    steps: tuple[Step, ...]
    relations: tuple[Relation, ...] = ()
    relaxations: tuple[Relaxation, ...] = ()
    budget: Decimal = Decimal(0)
    scope: str = "any"
    names: dict[str, Step] = field(init=False, compare=False, default_factory=dict)

    def __post_init__(self):
        self.names.update({s.id: s for s in self.steps})
        ids = [x.id for part in (self.steps, self.relations, self.relaxations) for x in part]
        if len(set(ids)) != len(ids) or not self.steps or self.scope not in SCOPES:
            raise ValueError("ids must be distinct, steps there and the scope known")
        for r in self.relations:
            if r.source not in self.names or r.target not in self.names:
                raise ValueError(f"relation {r.id} names an unknown step")
            if r.kind == "during" and self.names[r.source].nth:
                raise ValueError(f"{r.source} is known by its start only")
        known = {*self.names, *(r.id for r in self.relations)}
        for x in self.relaxations:
            if x.target not in known:
                raise ValueError(f"relaxation {x.id} has no target")

    def sets(self) -> Iterator[tuple[Relaxation, ...]]:
        """Affordable sets of relaxations with at most one for each kind and target, in the order of cost, size and ids."""
        found = []
        for n in range(len(self.relaxations) + 1):
            for chosen in combinations(self.relaxations, n):
                targets = {(x.kind, x.target) for x in chosen}
                cost = sum((x.cost for x in chosen), Decimal(0))
                if len(targets) == n and cost <= self.budget:
                    found.append((cost, n, sorted(x.id for x in chosen), chosen))
        yield from (chosen for *_, chosen in sorted(found, key=lambda x: x[:3]))

    def relaxed(self, chosen: tuple[Relaxation, ...]) -> Pattern:
        steps, relations = {s.id: s for s in self.steps}, {r.id: r for r in self.relations}
        for x in chosen:
            if x.kind == "widen_concept":
                steps[x.target] = replace(steps[x.target], concept=str(x.value))
            else:
                relations[x.target] = replace(relations[x.target], **{"most" if x.kind == "raise_max" else "grace": int(x.value)})
        return Pattern(tuple(steps.values()), tuple(relations.values()), (), Decimal(0), self.scope)

    def concepts(self) -> dict[str, set[str]]:
        """Each step's concept and those that an affordable set may widen it to."""
        out = {s.id: {s.concept} for s in self.steps}
        for chosen in self.sets():
            for x in chosen:
                if x.kind == "widen_concept":
                    out[x.target].add(str(x.value))
        return out

    def order(self) -> list[tuple[Step, Relation | None]]:
        """Steps in an order in which each but the first of a connected part has a relation to an earlier one."""
        left, out, placed = list(self.steps), [], set()
        while left:
            step, by = next(((s, r) for s in left for r in self.relations if {r.source, r.target} & placed and s.id in (r.source, r.target) and ({r.source, r.target} - {s.id}) <= placed), (left[0], None))
            out.append((step, by))
            placed.add(step.id)
            left.remove(step)
        return out

    def is_forest(self) -> bool:
        parent = {s.id: s.id for s in self.steps}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in self.relations:
            a, b = root(r.source), root(r.target)
            if a == b:
                return False
            parent[a] = b
        return True
