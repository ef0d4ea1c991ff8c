"""Quality rules: a learned decision list over native text statistics.

Sequential covering: a rule is a conjunction of thresholds on statistics. It grows on two thirds of the labelled rows, each time by
the condition of most information gain, until it covers no good rows or nothing is gained; it is pruned on the other third to
the prefix with the best (bad - good) / (bad + good), and kept while it is precise there. What it covers is taken away, and the
next rule grows. Candidate thresholds are quantiles of the labelled rows, counted by Spark in one aggregation for each
growth step. The list is an ordered Spark conditional expression: the first rule that holds rejects.

Everything here is DataFrame functions: one pass over the text gives all statistics, with no shuffle of text.

Cases: a null or empty text has no words and fails the base rule; repeated rows are each decided; a null id is kept as it is, and
cannot be labelled; labels without a document, without a quality, or with both qualities are not used; without usable labels of both kinds the
list is empty; very long texts are taken whole; an empty table gives an empty table; further columns, whatever their names, pass
through kept() untouched (they travel in one struct, beside which decided() adds its own).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import cut

#: Characters that count as white space between words, and those that count as symbols (fixed values).
SPACE, SYMBOLS = r"[\x20\x09-\x0D]", "[#*$%&|<>]"
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
#: The most labelled rows that a list is learned from (a hash sample; the bound is documented and doesn't follow the table).
MOST_LABELS = 20_000
#: Bits of a packed window that hold its number; longer texts have all their windows sorted whole.
NUMBER_BITS = 21
#: Partitions of the labelled rows' statistics.
PARTS = 4
QUANTILES, MOST_RULES, MOST_CONDITIONS, LEAST_PRECISION, LEAST_COVERED = 24, 8, 3, 0.95, 10
#: Statistics that rules look at, as parts in a million of the text's words, characters or lines, or counts.
FEATURES = {
    "words": "n_words",
    "word_length": "1000000 * word_chars div greatest(n_words, 1)",
    "symbols": "1000000 * n_symbols div greatest(word_chars, 1)",
    "capitals": "1000000 * n_capitals div greatest(word_chars, 1)",
    "exclamations": "1000000 * n_exclamations div greatest(word_chars, 1)",
    "digits": "1000000 * n_digits div greatest(word_chars, 1)",
    "repeated_words": "1000000 * n_repeat_words div greatest(n_words, 1)",
    "repeated_lines": "1000000 * n_dup_lines div greatest(n_lines, 1)",
    "distinct_words": "1000000 * n_distinct_words div greatest(n_words, 1)",
}


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with further columns; the generator keeps the optimiser from computing them again for each use."""
    kept = rows.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_new"))
    return kept.select(*rows.columns, "_new.*")


def windows_of(words: Column) -> Column:
    """The hash of the WINDOW words from each word on, where there are so many; words: their hashes."""
    at = lambda i: [F.get(words, i + k) for k in range(1, WINDOW)]
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - WINDOW + 1, F.lit(0))), lambda h, i: F.xxhash64(h, *at(i)))


def repeated(windows: Column, places: Column) -> Column:
    """How many words lie in windows whose hash is there twice or more; places: ascending numbers of windows, all of those among them."""

    def counted(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(ordered, i)["h"], F.lit(False))
        found = F.filter(F.transform(ordered, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"])), lambda i: i.isNotNull())
        begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        step = lambda s, p: F.struct((p + WINDOW).alias("end"), (s["total"] + p + WINDOW - F.greatest(s["end"], p)).alias("total"))
        return F.aggregate(F.sort_array(found), begin, step, lambda s: s["total"])

    return let(F.array_sort(F.transform(places, lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i")))), counted)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct of all columns of docs) and stats (a struct of whole-text counts) for each row of docs."""
    # each step is one projection, so that splits, sorts and sizes are compiled and words are split once
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("whole"))
    trimmed, white = F.btrim("whole", F.lit(" \t\n\x0b\f\r")), F.split("whole", "\n", -1)
    rows = once(
        rows, words=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+", -1)), lines=F.filter(white, lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        marks=F.regexp_replace("whole", r"[^#*$%&|<>\p{Lu}!0-9]+", ""),  # all that is counted by kind
    ).drop("whole")
    chars = lambda pattern: (F.length("marks") - F.length(F.regexp_replace("marks", pattern, ""))).cast("long")
    counts = {"n_symbols": chars(SYMBOLS), "n_capitals": chars(r"\p{Lu}"), "n_exclamations": chars("!"), "n_digits": chars("[0-9]")}
    counts |= {"n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"), "n_lines": F.size("lines").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}
    rows = once(rows, hashes=F.transform("words", lambda w: F.xxhash64(w)), **counts).drop("words", "lines", "marks")
    rows = once(rows, windows=let(F.col("hashes"), windows_of), n_distinct_words=F.size(F.array_distinct("hashes")).cast("long")).drop("hashes")
    # windows whose upper hash bits are met twice, by one sort of longs: those bits, then the window's number
    low = (1 << NUMBER_BITS) - 1
    packed = F.transform("windows", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = once(rows, packed=F.when(some & (F.size("windows") <= low), F.sort_array(packed)), some=some)

    def suspects(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(x.bitwiseXOR(F.get(ordered, i)).bitwiseAND(F.lit(~low)) == 0, F.lit(False))
        return F.filter(F.transform(ordered, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x.bitwiseAND(F.lit(low)).cast("int"))), lambda i: i.isNotNull())

    places = F.when(F.col("packed").isNotNull(), let(F.col("packed"), suspects)).otherwise(F.sequence(F.lit(0), F.size("windows") - 1))
    n_repeat_words = F.when(F.col("some"), let(F.col("windows"), lambda w: repeated(w, places))).otherwise(0).cast("long")
    rows = once(rows, n_repeat_words=n_repeat_words)
    return rows.select("row", F.struct("n_words", "word_chars", "n_distinct_words", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols", "n_capitals", "n_exclamations", "n_digits").alias("stats"))


def base_failed() -> Column:
    return F.expr(f"stats.n_words < {LEAST_WORDS} or 100 * stats.n_repeat_words > {MOST_REPEATED_PERCENT} * stats.n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: int

    def holds(self, stats: str = "stats.") -> Column:
        value = F.expr(_prefixed(FEATURES[self.feature], stats))
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold}"


def _prefixed(expression: str, prefix: str) -> str:
    return re.sub(r"\b(n_\w+|word_chars)\b", rf"{prefix}\1", expression)


Rule = tuple[Condition, ...]


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def verdict(rules: list[Rule], stats: str = "stats.") -> Column:
    """The number of the first rule that holds, from 1; 0 for none."""
    out = F.lit(0)
    for number, rule in reversed([*enumerate(rules, 1)]):
        out = F.when(all_of([c.holds(stats) for c in rule]), number).otherwise(out)
    return out


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most_labels: int = MOST_LABELS) -> list[Rule]:
    """Rules that reject rows labelled quality 0 and spare rows labelled 1."""
    usable = labels.filter(F.col(key).isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("least"), F.max("quality").alias("most")).filter("least = most")
    count = usable.count()
    share = min(1.0, most_labels / max(1, count))
    sample = usable.filter(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < round(share * 1_000_000)).select("_key", F.col("least").alias("quality"))
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(sample), "_key")  # at most about most_labels short rows
    values = [F.expr(_prefixed(e, "stats.")).cast("long").alias(name) for name, e in FEATURES.items()]
    part = F.when(F.pmod(F.xxhash64("row._key", F.lit("part")), F.lit(3)) < 2, "grow").otherwise("prune").alias("part")
    # few thin rows from here on: a few partitions, so that a step of growing is a short job
    rows = cut(measured(chosen).select("row.quality", part, *values).repartition(PARTS))
    # half of the candidate thresholds from the bad rows and half from all of them
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    quantiles = [F.percentile_approx(F.when(F.col("quality") == q, F.col(f)), shares, 10_000).alias(f"{f}{q}") for f in FEATURES for q in (0, 1)]
    found = rows.agg(*quantiles).first()
    marks = {f: sorted({x for q in (0, 1) for v in found[f"{f}{q}"] or [] for x in (v, v + 1)}) for f in FEATURES}
    place = lambda f: F.size(F.filter(F.lit(marks[f]).cast("array<bigint>"), lambda t: t <= F.col(f)))
    binned = [F.struct(F.lit(f).alias("f"), place(f).alias("bin")) for f in FEATURES if marks[f]]
    return grown(cut(rows.withColumn("bins", F.array(*binned))), marks) if binned else []


def counted(rows: DataFrame, covered: Column, marks: dict[str, list[int]]) -> tuple[int, int, dict[Condition, tuple[int, int]]]:
    """Bad and good rows in all, and under each candidate condition, among the growing rows that `covered` holds for."""
    found = rows.filter((F.col("part") == "grow") & covered).select("quality", F.inline("bins")).groupBy("f", "bin").agg(F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good")).collect()  # a row for each feature and bin
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in found:
        by.setdefault(r.f, {})[r.bin] = (int(r.bad), int(r.good))
    out, total = {}, (0, 0)
    for f, bins_ in by.items():
        total = tuple(map(sum, zip(*bins_.values(), strict=True)))
        for i, t in enumerate(marks[f], 1):
            above = tuple(sum(v[k] for b, v in bins_.items() if b >= i) for k in (0, 1))
            out[Condition(f, True, t)] = above
            out[Condition(f, False, t)] = (total[0] - above[0], total[1] - above[1])
    return *total, out


def grown(rows: DataFrame, marks: dict[str, list[int]]) -> list[Rule]:
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        left = all_of([~all_of([_on_values(c) for c in rule]) for rule in rules])
        rule: list[Condition] = []
        bad, good, found = counted(rows, left, marks)
        while bad and good and len(rule) < MOST_CONDITIONS:
            now = log2(bad / (bad + good))
            gain = lambda c: c[1][0] * (log2(c[1][0] / sum(c[1])) - now) if c[1][0] >= LEAST_COVERED else 0.0  # noqa: B023, E731
            best = max(found.items(), key=lambda c: (gain(c), c[1][0], str(c[0])), default=None)
            if best is None or gain(best) <= 0:
                break
            rule.append(best[0])
            bad, good, found = counted(rows, left & all_of([_on_values(c) for c in rule]), marks)
        if not rule:
            break
        pruned = rows.filter((F.col("part") == "prune") & left)
        prefixes = [all_of([_on_values(c) for c in rule[:k]]) for k in range(1, len(rule) + 1)]
        sums = pruned.agg(*(F.coalesce(F.sum(F.when(p, q)), F.lit(0)).alias(f"{name}{k}") for k, p in enumerate(prefixes) for name, q in (("bad", 1 - F.col("quality")), ("good", F.col("quality"))))).first()
        scored = [(sums[f"bad{k}"], sums[f"good{k}"]) for k in range(len(rule))]
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in scored]
        k = max(range(len(rule)), key=lambda i: (worth[i], scored[i][0], -i))
        b, g = scored[k]
        if not b or b / (b + g) < LEAST_PRECISION:
            break
        rules.append(tuple(rule[: k + 1]))
    return rules


def _on_values(c: Condition) -> Column:
    return F.col(c.feature) >= c.threshold if c.at_least else F.col(c.feature) < c.threshold


def decided(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """row and stats as in measured(), with base_failed, rule (the rule that rejects, or 0) and kept."""
    out = measured(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def kept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that neither the base rule nor the learned list rejects."""
    return decided(docs, learn(docs, labels, key, text), text).filter("kept").select("row.*")


#: The base columns; what the learned list decides isn't SQL.
BASE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT r, i, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS words FROM d, LATERAL (SELECT unnest(range(len(w) - {WINDOW - 1})) AS i)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, words) AS n FROM win) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT p) AS n FROM twice, LATERAL (SELECT unnest(range(i, i + {WINDOW})) AS p) GROUP BY r),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN hit USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM base
"""
