"""Line dedup by distinct-site spread.

A line's spread is the number of different sites that have it. Sites go into a HyperLogLog sketch for each line hash, and so do the
texts, so that copies of one document on many sites don't make its lines look like boilerplate; sketches merge by aggregation.
Where an estimate lies within MARGIN of the threshold, sites and texts are counted exactly. A line that stands on at least
least_sites sites in as many different texts is boilerplate and goes from all documents but the one with the smallest key, so that
no text is lost altogether. Lines of more than LONG_WORDS words don't recur by chance: for these least_sites_long sites suffice.

Lines are split at \\n and compared after spaces around them are trimmed; lines without letters or digits are never boilerplate.

Cases: a null text stays null, an empty one empty; null sites count as one site; repeated rows with one key and text are treated
alike; the first holder of a line is the row with the smallest key, null last; very long texts are taken whole; an empty table
gives an empty table; further columns pass through untouched, whatever their names (names that begin with _line_ are ours).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import cut

LEAST_SITES, MARGIN, LG_K = 10, 0.3, 10
LONG_WORDS, LEAST_SITES_LONG = 50, 2
#: How many parts the copies of one text are dealt over where they meet its boilerplate lines.
PARTS = 8
#: Bytes of boilerplate lines that are broadcast at most, and of one of them.
MOST_BROADCAST, ROW_BYTES = 8 << 20, 64


def split(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def line_hash(line: Column) -> Column:
    """The hash of a trimmed line, odd for long ones and even for others; null for one without letters or digits."""
    trimmed = F.trim(line)
    long = F.when(F.length(trimmed) > 2 * LONG_WORDS, F.regexp_count(trimmed, F.lit("[^ ]+")) > LONG_WORDS).otherwise(False)
    return F.when(line.rlike(r"[\p{L}\p{N}]"), F.xxhash64(trimmed).bitwiseAND(F.lit(-2)).bitwiseOR(long.cast("long")))


def distinct_texts(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """text (a hash), site, holder (the least key there; order: whether it is null, key) and lines (distinct hashes), a row for each text on each site."""
    lines = F.array_distinct(F.filter(F.transform(split(text), line_hash), lambda h: h.isNotNull()))
    rows = docs.filter(F.col(text).isNotNull()).select(
        F.xxhash64(text).alias("text"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("key")).alias("holder"), lines.alias("lines")
    )
    return rows.groupBy("text", "site").agg(F.min("holder").alias("holder"), F.first("lines").alias("lines"))


def boilerplate(texts: DataFrame, least_sites: int = LEAST_SITES, least_sites_long: int = LEAST_SITES_LONG) -> DataFrame:
    """line, first (its holder and text) of each line hash of distinct_texts() on enough sites and in enough texts."""
    least = F.when(F.col("line") % 2 != 0, least_sites_long).otherwise(least_sites)
    lines = texts.select(F.explode("lines").alias("line"), "site", "text", F.struct("holder", "text").alias("first"))
    sketched = lines.groupBy("line").agg(*(F.hll_sketch_agg(c, LG_K).alias(c) for c in ("site", "text")), F.min("first").alias("first"))
    estimated = sketched.select("line", "first", *(F.hll_sketch_estimate(c).alias(f"{c}s") for c in ("site", "text"))).withColumn("spread", F.least("sites", "texts"))
    estimated = cut(estimated.filter(F.col("spread") >= (1 - MARGIN) * least))
    near = estimated.filter(F.col("spread") <= (1 + MARGIN) * least)
    # made distinct first, so that a common line is a row for each site, or each text, and not for each pair of them
    exact = lambda c: lines.join(near.select("line"), "line", "left_semi").select("line", c).distinct().groupBy("line").count().filter(F.col("count") >= least).select("line")
    sure = estimated.filter(F.col("spread") > (1 + MARGIN) * least).select("line", "first")
    return sure.unionByName(near.join(exact("site"), "line").join(exact("text"), "line").select("line", "first"))


def without_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", least_sites: int = LEAST_SITES, least_sites_long: int = LEAST_SITES_LONG) -> DataFrame:
    """docs with boilerplate lines deleted from text, but for each line's first holder; _line_count and _line_gone count lines before and those deleted."""
    texts = cut(distinct_texts(docs, key, text, site))
    found = cut(boilerplate(texts, least_sites, least_sites_long))
    found = F.broadcast(found) if ROW_BYTES * found.count() <= MOST_BROADCAST else found  # where they are known to be few, a common line needs no task of its own
    own = (F.col("first.text") == F.col("_line_text")).alias("own")
    once = texts.groupBy("text").agg(F.first("lines").alias("lines"))
    gone = once.select(F.col("text").alias("_line_text"), F.explode("lines").alias("line")).join(found, "line").groupBy("_line_text").agg(F.collect_list(F.struct("line", own, F.col("first.holder.key").alias("key"))).alias("_line_found"))
    dealt = docs.withColumn("_line_text", F.when(F.col(text).isNull(), F.xxhash64(key)).otherwise(F.xxhash64(text))).withColumn("_line_part", F.pmod(F.xxhash64(F.col(key)), F.lit(PARTS)))
    rows = dealt.join(gone.withColumn("_line_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), ["_line_text", "_line_part"], "left")
    others = F.transform(F.filter("_line_found", lambda x: ~(x["own"] & x["key"].eqNullSafe(F.col(key)))), lambda x: x["line"])
    left = F.filter(split(text), lambda x: ~F.coalesce(F.array_contains(F.col("_line_others"), line_hash(x)), F.lit(False)))
    some = F.col("_line_found").isNotNull() & F.col(text).isNotNull()
    marked = rows.withColumn("_line_others", F.when(some, others)).withColumn("_line_left", F.when(some, left))
    counted = marked.withColumn("_line_count", F.when(F.col(text).isNull(), 0).otherwise(F.size(split(text))).cast("long")).withColumn("_line_gone", F.when(F.col("_line_left").isNull(), 0).otherwise(F.col("_line_count") - F.size("_line_left")).cast("long"))
    new = F.when(F.col("_line_left").isNotNull(), F.array_join("_line_left", "\n")).otherwise(F.col(text))
    return counted.withColumn(text, new).select(*docs.columns, "_line_count", "_line_gone")


def sql(least_sites_long: int = LEAST_SITES_LONG) -> str:
    return rf"""
WITH texts AS (SELECT DISTINCT text, coalesce(source, '') AS site FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT text, site, unnest(string_split(text, chr(10))) AS piece FROM texts),
lines AS (SELECT DISTINCT text, site, trim(piece, ' ') AS line FROM pieces WHERE regexp_matches(piece, '[\p{{L}}\p{{N}}]')),
spread AS (SELECT line FROM lines GROUP BY line HAVING least(count(DISTINCT site), count(DISTINCT text)) >= CASE WHEN len(regexp_extract_all(line, '[^ ]+')) > {LONG_WORDS} THEN {least_sites_long} ELSE {LEAST_SITES} END),
held AS (SELECT line, min(doc_id) AS holder FROM (SELECT DISTINCT line, text FROM lines) JOIN spread USING (line) JOIN documents USING (text) GROUP BY line),
rows_ AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
parts AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM rows_ WHERE text IS NOT NULL),
marked AS (SELECT p.*, h.line IS NOT NULL AND h.holder IS DISTINCT FROM p.doc_id AS gone FROM parts p LEFT JOIN held h ON h.line = trim(p.piece, ' ') AND regexp_matches(p.piece, '[\p{{L}}\p{{N}}]')),
joined AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(piece, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(kept) AS text_sha256, length(kept)::BIGINT AS n_chars
FROM rows_ LEFT JOIN joined USING (r)
"""


ORACLE_SQL = sql()
