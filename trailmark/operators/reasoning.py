"""Facts that rules derive within each scope, to the fixpoint.

A rule says that an entity is of a class where a conjunction of class and property facts of one scope (a patient, or a patient and an
episode) holds. Each round joins only what the round before has found with what is known, once for each place of the rule where
it can stand, and keeps what is new. Scopes are part of every join key, so that histories never meet and a round is as many keys as entities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.lineage import cut


@dataclass(frozen=True)
class Is:
    """The entity that the variable stands for is of the class."""

    variable: str
    kind: str

    @property
    def variables(self) -> tuple[str, ...]:
        return (self.variable,)


@dataclass(frozen=True)
class Has:
    """The subject has the property with the object."""

    subject: str
    name: str
    object: str

    @property
    def variables(self) -> tuple[str, ...]:
        return (self.subject, self.object)


@dataclass(frozen=True)
class Rule:
    id: str
    then: Is
    when: tuple[Is | Has, ...]

    def __post_init__(self):
        known = {v for atom in self.when for v in atom.variables}
        if self.then.variable not in known:
            raise ValueError(f"rule {self.id} derives something of an unknown variable")
        if any(isinstance(atom, Has) and atom.subject == atom.object for atom in self.when):
            raise ValueError(f"rule {self.id} has a property from a variable to itself")
        if len(self.order(0)) < len(self.when):
            raise ValueError(f"rule {self.id} falls into parts without a common variable")

    def order(self, first: int) -> list[int]:
        """The places of the conjunction from `first` on, each but that one with a variable seen before."""
        out, seen = [first], set(self.when[first].variables)
        while (more := next((k for k, atom in enumerate(self.when) if k not in out and seen & set(atom.variables)), None)) is not None:
            out.append(more)
            seen |= set(self.when[more].variables)
        return out


def matching(atom: Is | Has, classes: DataFrame, properties: DataFrame, scope: list[str]) -> DataFrame:
    if isinstance(atom, Is):
        return classes.filter(F.col("class") == atom.kind).select(*scope, F.col("entity").alias(f"_{atom.variable}"))
    return properties.filter(F.col("property") == atom.name).select(*scope, F.col("subject").alias(f"_{atom.subject}"), F.col("object").alias(f"_{atom.object}"))


def fired(rule: Rule, known: DataFrame, fresh: DataFrame, properties: DataFrame, place: int, scope: list[str]) -> DataFrame:
    """What the rule derives where the fact at the place is a fresh one."""
    out, seen = None, set()
    for k in rule.order(place):
        atom = rule.when[k]
        own = matching(atom, fresh if k == place else known, properties, scope)
        out = own if out is None else out.join(own, [*scope, *(f"_{v}" for v in sorted(seen & set(atom.variables)))])
        seen |= set(atom.variables)
    return out.select(*scope, F.col(f"_{rule.then.variable}").alias("entity"), F.lit(rule.then.kind).alias("class"))


def derived(classes: DataFrame, properties: DataFrame, rules: list[Rule], scope: list[str]) -> DataFrame:
    """All class facts (scope, entity, class), given and derived, once each. properties: scope, subject, property and object."""
    fresh = cut(classes.select(*scope, "entity", "class").distinct())
    found, first = [fresh], True
    while True:
        known = reduce(DataFrame.unionByName, found)
        parts = []
        for rule in rules:
            # a rule of properties alone fires in the first round only
            places = [k for k, atom in enumerate(rule.when) if isinstance(atom, Is)] or ([0] if first else [])
            parts += [fired(rule, known, fresh, properties, k, scope) for k in places]
        if not parts:
            return known
        fresh, first = cut(reduce(DataFrame.unionByName, parts).distinct().join(known, [*scope, "entity", "class"], "left_anti")), False
        if not fresh.limit(1).count():
            return known
        found.append(fresh)
