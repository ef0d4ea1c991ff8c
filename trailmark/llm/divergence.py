"""How far the sources of a language diverge in their terms, by sparse merges of pairs of groups.

A group is a (language, source). Terms are counted once, in tasks that combine what they see; a language keeps the terms of at
least LEAST_DOCS of its documents. A term's price in a group is 1 + floor(10^9 * (count + 1) / (N + V)), N being the group's
count of kept terms and V how many the language keeps; f(p, q) = floor((p - q)^2 / q) is what a group's price p costs against q.

A language's terms are dealt into slices by hash and numbered within each in their order, so that a group is one sorted array of
term numbers, with their prices, for each slice. A pair task co-groups the arrays of two blocks of sources in one slice and
merges each unordered pair: the shorter array's numbers are searched in the longer one, shared terms are priced against each
other, one-sided ones against the price of no occurrence, and those that neither has are one product; each pair is priced both ways.
Neither a group nor a language is ever whole in a task: slices have about SLICE terms and blocks about BLOCK sources.

Exact for counts up to 2 * 10^14. Cases: null language, source and text are ''; a document without terms makes its group known; repeated
rows count each time; equal values are ranked by the item's UTF-8 bytes; an empty table gives an empty table; further columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import CHUNK, column, flat, slices, staged, text_column
from trailmark.llm.similar import small

LEAST_DOCS, MOST_RANK = 3, 200
#: About how many terms a slice and how many sources a block has.
SLICE, BLOCK = 4096, 8
#: Counts that a task holds before it passes them on.
MOST_HELD = 1 << 18
#: A-Z lower-cased, bytes of terms as they are, all others a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text whose bytes are TERM_BYTES, in lists of about CHUNK bytes."""
    a = 0
    while a < len(text):
        b = text.find(b" ", a + CHUNK)
        b = len(text) if b < 0 else b
        yield text[a:b].split()
        a = b


def counted(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term (UTF-8 bytes), n and docs: partial counts of what tasks saw; a null term stands for the group itself."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))))

    def flushed(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (own_lang, own_source), (n, seen) in found.items():
            names, size = [None, *n], len(n) + 1
            arrays = [pa.array([own_lang]).take(pa.array(np.zeros(size, np.int64))), pa.array([own_source]).take(pa.array(np.zeros(size, np.int64))), pa.array(names, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(seen[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])
        found.clear()

    def run(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            texts, groups = text_column(batch, "text"), list(zip(column(batch, "lang").to_pylist(), column(batch, "source").to_pylist(), strict=True))
            for a, b in slices(texts):
                data, ends = flat(texts.slice(a, b - a))
                data = data.tobytes().translate(TERM_BYTES)
                for k, group in enumerate(groups[a:b]):
                    n, seen = found.setdefault(group, (Counter(), Counter()))
                    own: set[bytes] = set()
                    for words in terms(data[ends[k] : ends[k + 1]]):
                        n.update(words)
                        own.update(words)
                    seen.update(own)
                if sum(len(n) for n, _ in found.values()) > MOST_HELD:
                    yield from flushed(found)
        yield from flushed(found)

    return rows.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")


def kept_terms(docs: DataFrame, **names: str) -> DataFrame:
    """lang, source, term and n of the terms that each language keeps, with the language's own count (lang_n) and whether the row is the term's
    first; a null term for each group."""
    partial = counted(docs, **names).repartition("lang", "term")  # the counts, the terms' totals: all within this one shuffle
    term = Window.partitionBy("lang", "term")
    rows = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = rows.withColumns({"lang_n": F.sum("n").over(term), "_docs": F.sum("docs").over(term), "first": F.col("source") == F.min("source").over(term)})
    return staged(rows.filter(F.col("term").isNull() | (F.col("_docs") >= LEAST_DOCS)).select("lang", "source", "term", "n", "lang_n", "first"), "terms")


def priced(count: str, total: str, kinds: str) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + kinds)), in two divisions so that no product passes 64 bits."""
    whole, part = f"greatest({total} + {kinds}, 1L)", f"(({count} + 1) * 31250L)"  # without kept terms there is nothing to price
    return F.expr(f"1L + ({part} div {whole}) * 32000L + (({part} % {whole}) * 32000L) div {whole}")


def cost(p: np.ndarray, q: np.ndarray) -> int:
    d = p - q
    return int((d * d // q).sum())


def merged(x: tuple[np.ndarray, np.ndarray, int], y: tuple[np.ndarray, np.ndarray, int], kinds: int) -> tuple[int, int]:
    """The cost of x against y and of y against x over a slice of so many terms; each has its sorted term numbers, their prices and the price of
    no occurrence."""
    if len(x[0]) > len(y[0]):
        return merged(y, x, kinds)[::-1]
    (ids, p, p0), (others, q, q0) = x, y
    at = np.searchsorted(others, ids)
    hit = np.zeros(len(ids), bool)
    inside = at < len(others)
    hit[inside] = others[at[inside]] == ids[inside]
    alone = np.ones(len(others), bool)
    alone[at[hit]] = False
    shared, absent = int(hit.sum()), kinds - len(ids) - int(alone.sum())
    both, mine, its = (p[hit], q[at[hit]]), p[~hit], q[alone]
    zeros = (np.array([p0]), np.array([q0]))
    there = (cost(*both) if shared else 0) + cost(mine, np.int64(q0)) + cost(np.int64(p0), its) + absent * cost(*zeros)
    back = (cost(*both[::-1]) if shared else 0) + cost(np.int64(q0), mine) + cost(its, np.int64(p0)) + absent * cost(*zeros[::-1])
    return there, back


def pair_costs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language) and value, both ways for each pair. groups: lang, source, n, kinds."""
    most = groups.agg(F.max("kinds").alias("kinds"), F.max("sources").alias("sources")).first()
    n_slices, n_blocks = max(1, -(-(most.kinds or 0) // SLICE)), max(1, -(-(most.sources or 0) // BLOCK))
    cut = F.pmod(F.xxhash64("term"), F.lit(n_slices)).cast("int")
    numbered = kept.filter("term IS NOT NULL").withColumn("slice", cut).withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "slice").orderBy("term")))
    sizes = kept.filter("term IS NOT NULL AND first").groupBy("lang", cut.alias("slice")).agg(F.count("*").alias("in_slice"))
    known = small(groups.select("lang", "source", F.col("n").alias("total"), "kinds"), 64)
    held = numbered.filter("n > 0").join(known, ["lang", "source"]).select("lang", "slice", "source", F.struct("id", priced("n", "total", "kinds").alias("p")).alias("t"))
    arrays = held.groupBy("lang", "slice", "source").agg(F.array_sort(F.collect_list("t")).alias("t")).select("lang", "slice", "source", F.col("t.id").alias("ids"), F.col("t.p").alias("prices"))
    grid = groups.select("lang", "source", priced("0L", "n", "kinds").alias("none"), F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"))
    grid = grid.join(arrays, ["lang", "slice", "source"], "left").join(sizes, ["lang", "slice"], "left").withColumn("block", F.pmod(F.xxhash64("source"), F.lit(n_blocks)).cast("int"))
    rows = grid.select("lang", "slice", "source", "none", "ids", "prices", F.coalesce("in_slice", F.lit(0)).cast("long").alias("in_slice"), "block")
    x = rows.select("*", F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(n_blocks - 1))).alias("j"))
    y = rows.select("*", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"))
    y = y.toDF(*y.columns)  # columns of its own, since both sides come from the same rows

    def sides(table: pa.Table) -> list[tuple]:
        as_array = lambda v: np.array(v or [], np.int64)
        return [(r["source"], (as_array(r["ids"]), as_array(r["prices"]), r["none"]), r["in_slice"], r["lang"], r["block"]) for r in table.to_pylist()]

    def pair_task(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        others = sides(right)
        for a, own, kinds, own_lang, i in sides(left):
            for b, its, _, _, j in others:
                if i != j or a < b:
                    out.append((own_lang, a, b, *merged(own, its, kinds)))
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate((("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("there", pa.int64()), ("back", pa.int64())))})

    keys = ["lang", "slice", "i", "j"]
    found = x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(pair_task, "lang string, a string, b string, there bigint, back bigint")
    both = found.groupBy("lang", "a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    return both.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("there").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("back").alias("value")))))


def term_costs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term dearer in the group than in the language) and value."""
    known = small(groups.select("lang", "source", F.col("n").alias("total"), "kinds", "lang_total"), 64)
    rows = kept.filter("term IS NOT NULL AND n > 0").join(known, ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").cast("string").alias("item"), priced("n", "total", "kinds").alias("p"), priced("lang_n", "lang_total", "kinds").alias("q"))
    return rows.filter("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(docs: DataFrame, **names: str) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: each group against each other source of its language, and the MOST_RANK terms that set it
    most apart from its language."""
    kept = kept_terms(docs, **names)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum((F.col("first") & F.col("term").isNotNull()).cast("long")).alias("kinds"), F.count_if(F.col("term").isNull()).alias("sources"))
    groups = staged(sums.join(langs, "lang"), "groups")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
    return ranked(pair_costs(kept, groups), "pair").unionByName(ranked(term_costs(kept, groups), "term").filter(F.col("rank") <= MOST_RANK))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT row_id) >= 3),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(k.term)::HUGEINT AS kinds, coalesce(sum(k.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept k USING (lang) GROUP BY lang),
groups AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
priced AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + l.kinds) AS p FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
costs AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM priced x JOIN priced y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair_part AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN costs USING (lang, source, item)),
dearer AS (SELECT p.lang, p.source, p.term AS item, p.p, 1 + (1000000000 * (k.n + 1)) // (l.total + l.kinds) AS q FROM priced p JOIN kept k USING (lang, term) JOIN langs l USING (lang) WHERE p.n > 0),
term_part AS (SELECT lang, source, 'term' AS part, item, ((p - q) * (p - q)) // q AS value FROM dearer WHERE p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair_part UNION ALL SELECT * FROM term_part))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
