"""Claims kept as statements (subject, predicate, object), and the rows that a pattern of statements finds in them.

A pattern is a list of statements whose parts are constants or variables (names that begin with "?"). Each statement of the pattern is a
filter of the table, with a column for each variable. Variables that statements have as their subject are taken one by one, those that tie
the fewest columns together first, of as many those that are objects too: all tables with the variable become one, joined on it, after those of it alone, such as its class, have
reduced them. So objects meet what is said about them before the statements of their subject meet each other, and what is no match goes
early. Each such table is staged: it would be dealt out anew anyway, and the shuffle files behind it can go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import scalars
from trailmark.lineage import released, staged

PARTS = ("subject", "predicate", "object")


def is_variable(part: str) -> bool:
    return part.startswith("?")


def found(statements: DataFrame, wanted: tuple[str, str, str]) -> DataFrame:
    """What one statement of a pattern matches: a column for each of its variables."""
    rows, names = statements, {}
    for column, part in zip(PARTS, wanted, strict=True):
        if not is_variable(part):
            rows = rows.filter(F.col(column) == part)
        elif part in names:
            rows = rows.filter(F.col(column) == F.col(names[part]))
        else:
            names[part] = column
    return rows.select(*(F.col(c).alias(v[1:]) for v, c in names.items()))


def connected(parts: list[set[str]]) -> bool:
    """Whether common variables tie all parts together."""
    reached, before = set(parts[0]), None
    while reached != before:
        before, reached = reached, reached.union(*(p for p in parts if p & reached))
    return all(p & reached for p in parts if p)


def met(tables: list[DataFrame], on: str) -> DataFrame:
    """Tables joined on a variable that all of them have, and on what else they share. That is compared as ranges: as keys of the join it would have both sides dealt out again."""
    out, left = tables[0], tables[1:]
    while left:
        p = left.pop(min(range(len(left)), key=lambda k: len(set(left[k].columns) & set(out.columns))))
        more = [c for c in p.columns if c in out.columns and c != on]
        out = out.join(p.withColumnsRenamed({c: f"_{c}" for c in more}), on)
        for c in more:
            out = out.filter(F.col(c).between(F.col(f"_{c}"), F.col(f"_{c}"))).drop(f"_{c}")
    return out


def bindings(statements: DataFrame, pattern: list[tuple[str, str, str]], distinct: bool = False) -> DataFrame:
    """One row for each assignment of the pattern's variables under which all of its statements are among the given ones. Statements count once; those that are known
    to be distinct are read as they are, for each statement of the pattern. A pattern that falls into parts without a common variable is refused."""
    parts = [(found(statements, w), w) for w in pattern]
    if not connected([set(p.columns) for p, _ in parts]):
        raise ValueError("the pattern falls into parts without a common variable")
    if not distinct:
        statements = staged(statements.select(*PARTS).distinct(), "statements", compression="zstd")
        parts = [(found(statements, w), w) for w in pattern]
    single: dict[str, list[DataFrame]] = {}
    for p, _ in parts:
        if len(p.columns) == 1:
            single.setdefault(p.columns[0], []).append(p)
    tables = [(p, w[0][1:] if is_variable(w[0]) else None) for p, w in parts if len(p.columns) > 1]
    if not tables:
        (name, (out, *others)), = single.items()
        return met([out, *others], name)
    subjects, objects = {s for _, s in tables if s} | set(single), {w[2] for w in pattern}
    while subjects:
        touching = {v: [(p, s) for p, s in tables if v in p.columns] for v in sorted(subjects)}
        v = min(touching, key=lambda v: (len(set().union(*(p.columns for p, _ in touching[v]))), f"?{v}" not in objects))
        subjects.remove(v)
        own = [p for p, _ in sorted(touching[v], key=lambda t: t[1] != v)]  # what is said about it first
        for one in single.get(v, []):
            own[0] = own[0].join(one, v, "left_semi")
        tables = [(p, s) for p, s in tables if v not in p.columns]
        out = met(own, v)
        if len(own) > 1 and (tables or subjects):
            out = staged(out, "bindings", compression="zstd")
            released(statements.sparkSession)
        tables.append((out, None if len(own) > 1 else touching[v][0][1]))
    out, left = tables[0][0], [p for p, _ in tables[1:]]
    while left:  # what only common objects tie together
        p = left.pop(next(k for k, p in enumerate(left) if set(p.columns) & set(out.columns)))
        out = out.join(p, [c for c in p.columns if c in out.columns])
    return out


def as_rows(bound: DataFrame, value: str, unit: str, factors: DataFrame, *content: str) -> DataFrame:
    """The bindings as measurement rows: amount, the value in the target unit of factors (unit, factor; a bounded table), null where the unit has none or the value is
    no number, and row_id, made from the content, so that the same claim has the same id wherever it is read."""
    number: Column = F.when(F.col(value).rlike(r"^[+-]?[0-9]{1,18}(\.[0-9]{1,9})?\z"), F.col(value).cast("decimal(27,9)"))
    known = factors.select(F.col("unit").alias(unit), F.col("factor").cast("decimal(18,9)").alias("_factor"))
    return bound.join(known, unit, "left").withColumn("amount", (number * F.col("_factor")).cast("decimal(38,12)")).drop("_factor").withColumn("row_id", scalars.digest(*(F.col(c) for c in content)))
