"""Registered queries of the pattern engine over the driver's tables, each beside DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import scalars
from trailmark.functions import timealg as ta
from trailmark.lineage import cut
from trailmark.operators import derived, evidence, intervals, reasoning, rises, rules, shared, similarity, states, store
from trailmark.operators.ranges import join_ranges
from trailmark.plans import compile as plans
from trailmark.plans.pattern import Pattern, Relation, Relaxation, Step
from trailmark.sources import model
from trailmark.sources.model import DAY, HOUR, MINUTE, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The model of sources.model in DuckDB's SQL.
BASE = f"""
ev AS (SELECT user_id AS patient, event_id, event_type AS kind, epoch_us(ts) + {ta.EPOCH} AS t, value, CAST(round(value * 1000000) AS BIGINT) AS micro,
  epoch_us(ts) + {ta.EPOCH} - (event_id % 5) * {10 * MINUTE} AS lo, epoch_us(ts) + {ta.EPOCH} + (event_id % 7) * {10 * MINUTE} AS hi FROM events),
closure(concept, ancestor) AS (VALUES {", ".join(f"('{c}', '{a}')" for c, a in (("click", "click"), ("click", "interaction"), ("click", "activity"), ("view", "view"), ("view", "interaction"), ("view", "activity"), ("purchase", "purchase"), ("purchase", "conversion"), ("purchase", "activity"), ("signup", "signup"), ("signup", "conversion"), ("signup", "activity"), ("error", "error"), ("error", "incident"), ("interaction", "interaction"), ("interaction", "activity"), ("conversion", "conversion"), ("conversion", "activity"), ("incident", "incident"), ("activity", "activity")))}),
win AS (SELECT patient, CASE WHEN patient % 10 <> 0 THEN min(t) + {5 * DAY} END AS w_start, CASE WHEN patient % 10 <> 0 THEN min(t) + {20 * DAY} END AS w_end FROM ev GROUP BY patient),
uwin AS (SELECT patient, CASE WHEN patient % 10 <> 0 THEN min(lo) + {5 * DAY} END AS w_start, CASE WHEN patient % 10 <> 0 THEN min(lo) + {20 * DAY} END AS w_end FROM ev GROUP BY patient),
cov AS (SELECT patient, kind AS source, min(t) AS c_lo, max(t) AS c_hi FROM ev WHERE patient % 4 <> 0 GROUP BY ALL),
exc AS (SELECT patient, kind AS concept, t AS x_lo, t AS x_hi FROM ev WHERE value > {model.EXCLUDED_ABOVE}),
expo AS (SELECT o_custkey AS patient, o_orderkey AS event_id, o_orderpriority AS kind, o_orderstatus AS status, s, e FROM orders JOIN (SELECT l_orderkey, epoch_us(min(l_shipdate)) + {ta.EPOCH} AS s, epoch_us(max(l_shipdate)) + {ta.EPOCH} AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE s < e)
"""


def query(sql: str | None = None):
    """Registers a query under its name, with SQL over BASE."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {BASE.strip()}\n{sql.strip()}"  # sql may begin with a comma and more tables
        return f

    return register


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str, uncertain: bool = False):
        self.events = model.events(spark, sf_dir, uncertain)
        self.closure, self.windows = model.closure(spark), model.windows(self.events)


VIEW_PURCHASE = Pattern((Step("a", "view"), Step("b", "purchase")), (Relation("r", "after", "a", "b", 0, 24 * HOUR),), scope="within")
CHAIN = Pattern((Step("a", "view"), Step("b", "click"), Step("c", "purchase")), (Relation("r1", "after", "a", "b", 0, 12 * HOUR), Relation("r2", "after", "b", "c", 0, 12 * HOUR)), scope="within")
TREE = Pattern((Step("a", "view"), Step("b", "click"), Step("c", "error")), (Relation("r1", "after", "a", "b", 0, 12 * HOUR), Relation("r2", "after", "a", "c", 0, 12 * HOUR)))
CYCLE = Pattern((Step("a", "view"), Step("b", "click"), Step("c", "purchase")), (Relation("r1", "after", "a", "b", 0, 24 * HOUR), Relation("r2", "after", "b", "c", 0, 24 * HOUR), Relation("r3", "after", "a", "c", 0, 30 * HOUR)))
RELAXED = Pattern(
    (Step("a", "signup"), Step("b", "purchase")), (Relation("r", "after", "a", "b", 0, 2 * HOUR),),
    (Relaxation("longer", "raise_max", "r", Decimal("1.5"), 8 * HOUR), Relaxation("wider", "widen_concept", "a", Decimal(2), "conversion"), Relaxation("both_wider", "widen_concept", "b", Decimal(1), "conversion")), Decimal(3), "within",
)


@query("SELECT ancestor AS concept, count(*)::BIGINT AS n_events, count(DISTINCT patient)::BIGINT AS n_patients FROM ev JOIN closure ON kind = concept GROUP BY ancestor")
def closure_expand(spark, d):
    m = Model(spark, d)
    return model.with_concepts(m.events, m.closure).groupBy("concept").agg(F.count("*").alias("n_events"), F.count_distinct("patient").alias("n_patients"))


@query("SELECT patient, ancestor AS concept, count(*)::BIGINT AS n, min(lo) AS min_lo, max(hi) AS max_hi, max(hi) AS max_end FROM ev JOIN closure ON kind = concept GROUP BY ALL")
def postings(spark, d):
    m = Model(spark, d, True)
    return store.postings(m.events, m.closure)


@query("SELECT DISTINCT kind AS source, ancestor AS concept FROM ev JOIN closure ON kind = concept")
def source_concepts(spark, d):
    m = Model(spark, d)
    return store.source_concepts(m.events, m.closure)


@query("SELECT patient, (row_number() OVER (ORDER BY patient) - 1)::BIGINT AS patient_idx, (('0x' || substr(sha256(patient::VARCHAR), 1, 8))::BIGINT % 8)::INTEGER AS bucket FROM (SELECT DISTINCT patient FROM ev)")
def bucket_index(spark, d):
    return store.indexed(Model(spark, d).events)


@query("SELECT DISTINCT patient FROM ev WHERE kind = 'signup' INTERSECT SELECT patient FROM ev WHERE kind = 'error'")
def candidate_intersection(spark, d):
    m = Model(spark, d)
    return plans.candidates(Pattern((Step("a", "signup"), Step("b", "error"))), store.postings(m.events, m.closure))


@query(f"""SELECT w.patient FROM win w JOIN (SELECT patient, min(t) AS lo, max(t) AS hi FROM ev WHERE kind = 'error' GROUP BY 1) a USING (patient) JOIN (SELECT patient, min(t) AS lo, max(t) AS hi FROM ev WHERE kind = 'signup' GROUP BY 1) b USING (patient)
WHERE w_start IS NOT NULL AND a.hi >= w_start AND a.lo <= w_end AND b.hi >= w_start AND b.lo <= w_end AND b.hi - a.lo >= {3 * DAY} AND b.lo - a.hi <= {4 * DAY}""")
def time_prune(spark, d):
    m = Model(spark, d)
    p = Pattern((Step("a", "error"), Step("b", "signup")), (Relation("r", "after", "a", "b", 3 * DAY, 4 * DAY),), scope="within")
    return plans.time_pruned(p, store.postings(m.events, m.closure), m.windows)


@query("SELECT patient, event_id, lo, hi, string_agg(ancestor, ',' ORDER BY ancestor) AS concepts FROM ev JOIN closure ON kind = concept WHERE ancestor IN ('conversion', 'activity', 'incident') GROUP BY patient, event_id, lo, hi")
def load_events(spark, d):
    m = Model(spark, d, True)
    return store.loaded(m.events, m.closure, ["conversion", "activity", "incident"])


PAIR_EXACT = f"SELECT DISTINCT a.patient FROM ev a JOIN ev b ON a.patient = b.patient AND b.t - a.t BETWEEN 0 AND {24 * HOUR} JOIN win w ON w.patient = a.patient WHERE a.kind = 'view' AND b.kind = 'purchase' AND a.t BETWEEN w_start AND w_end AND b.t BETWEEN w_start AND w_end"


@query(f"SELECT w.patient, CASE WHEN w_start IS NULL THEN 'excluded' WHEN x.patient IS NOT NULL THEN 'exact' ELSE 'none' END AS status FROM win w LEFT JOIN ({PAIR_EXACT}) x USING (patient)")
def pair_exact(spark, d):
    m = Model(spark, d)
    exact = plans.exact_patients(VIEW_PURCHASE, m.events, m.closure, m.windows).withColumn("_x", F.lit(True))
    return m.windows.join(exact, "patient", "left").select("patient", F.when(F.col("w_start").isNull(), "excluded").when(F.col("_x"), "exact").otherwise("none").alias("status"))


@query(f"""SELECT DISTINCT a.patient FROM ev a JOIN ev b ON a.patient = b.patient AND b.t - a.t BETWEEN 0 AND {12 * HOUR} JOIN ev c ON c.patient = b.patient AND c.t - b.t BETWEEN 0 AND {12 * HOUR} JOIN win w ON w.patient = a.patient
WHERE a.kind = 'view' AND b.kind = 'click' AND c.kind = 'purchase' AND a.t BETWEEN w_start AND w_end AND b.t BETWEEN w_start AND w_end AND c.t BETWEEN w_start AND w_end""")
def chain3_exact(spark, d):
    m = Model(spark, d)
    return plans.exact_patients(CHAIN, m.events, m.closure, m.windows)


@query(f"SELECT DISTINCT a.patient FROM ev a JOIN ev b ON a.patient = b.patient AND b.t - a.t BETWEEN 0 AND {12 * HOUR} JOIN ev c ON c.patient = a.patient AND c.t - a.t BETWEEN 0 AND {12 * HOUR} WHERE a.kind = 'view' AND b.kind = 'click' AND c.kind = 'error'")
def tree_exact(spark, d):
    m = Model(spark, d)
    return plans.exact_patients(TREE, m.events, m.closure, m.windows)


@query(f"""SELECT a.patient, count(*)::BIGINT AS n_bindings FROM ev a JOIN ev b ON a.patient = b.patient AND b.t - a.t BETWEEN 0 AND {24 * HOUR} JOIN ev c ON c.patient = b.patient AND c.t - b.t BETWEEN 0 AND {24 * HOUR} AND c.t - a.t BETWEEN 0 AND {30 * HOUR}
WHERE a.kind = 'view' AND b.kind = 'click' AND c.kind = 'purchase' GROUP BY a.patient""")
def cycle_exact(spark, d):
    m = Model(spark, d)
    return plans.bindings(CYCLE, m.events, m.closure, m.windows, ta.certain).groupBy("patient").agg(F.count("*").alias("n_bindings"))


PAIR_POSSIBLE = f"""SELECT DISTINCT a.patient FROM ev a JOIN ev b ON a.patient = b.patient JOIN uwin w ON w.patient = a.patient WHERE a.kind = 'view' AND b.kind = 'purchase' AND w_start IS NOT NULL
AND greatest(a.lo, w_start) <= least(a.hi, w_end) AND greatest(b.lo, w_start) <= least(b.hi, w_end) AND least(b.hi, w_end) - greatest(a.lo, w_start) >= 0 AND greatest(b.lo, w_start) - least(a.hi, w_end) <= {24 * HOUR}"""


@query(PAIR_POSSIBLE)
def pair_possible(spark, d):
    m = Model(spark, d, True)
    return plans.possible_patients(VIEW_PURCHASE, m.events, m.closure, m.windows)


@query(f"""SELECT DISTINCT patient FROM (SELECT a.patient, greatest(b.lo, w_start, greatest(a.lo, w_start)) AS b_lo, least(b.hi, w_end, least(a.hi, w_end) + {12 * HOUR}) AS b_hi, c.lo AS c_lo, c.hi AS c_hi, w_start, w_end,
  greatest(a.lo, w_start) <= least(a.hi, w_end) AS a_ok FROM ev a JOIN ev b ON a.patient = b.patient AND b.kind = 'click' JOIN ev c ON c.patient = b.patient AND c.kind = 'purchase' JOIN uwin w ON w.patient = a.patient WHERE a.kind = 'view' AND w_start IS NOT NULL)
WHERE a_ok AND b_lo <= b_hi AND greatest(c_lo, w_start, b_lo) <= least(c_hi, w_end, b_hi + {12 * HOUR})""")
def chain3_possible(spark, d):
    m = Model(spark, d, True)
    return plans.possible_patients(CHAIN, m.events, m.closure, m.windows)


FIRST_THEN = Pattern((Step("a", "signup", occurrence="first"), Step("b", "purchase")), (Relation("r", "after", "a", "b", 0, 10 * DAY),))
FIRST_LAST = Pattern((Step("a", "signup", occurrence="first"), Step("b", "purchase", occurrence="last")), (Relation("r", "after", "a", "b", 0, 26 * DAY),))
SCENARIOS = """first_ AS (SELECT k.patient, k.event_id, k.lo, least(k.hi, min(o.hi)) AS hi FROM ev k LEFT JOIN ev o ON o.patient = k.patient AND o.kind = k.kind AND o.event_id <> k.event_id WHERE k.kind = 'signup' GROUP BY k.patient, k.event_id, k.lo, k.hi HAVING min(o.hi) IS NULL OR k.lo <= min(o.hi)),
last_ AS (SELECT k.patient, k.event_id, greatest(k.lo, max(o.lo)) AS lo, k.hi FROM ev k LEFT JOIN ev o ON o.patient = k.patient AND o.kind = k.kind AND o.event_id <> k.event_id WHERE k.kind = 'purchase' GROUP BY k.patient, k.event_id, k.lo, k.hi HAVING max(o.lo) IS NULL OR k.hi >= max(o.lo))"""


@query(f""", {SCENARIOS} SELECT patient FROM (SELECT a.patient, a.event_id, coalesce(bool_or(b.lo - a.hi >= 0 AND b.hi - a.lo <= {10 * DAY}), false) AS sure FROM first_ a LEFT JOIN ev b ON b.patient = a.patient AND b.kind = 'purchase' GROUP BY ALL) GROUP BY patient HAVING bool_and(sure)""")
def ordered_exact(spark, d):
    m = Model(spark, d, True)
    return plans.exact_patients(FIRST_THEN, m.events, m.closure, m.windows)


@query(f", {SCENARIOS} SELECT DISTINCT a.patient FROM first_ a JOIN last_ b ON a.patient = b.patient AND b.hi - a.lo >= 0 AND b.lo - a.hi <= {26 * DAY}")
def ordered_possible(spark, d):
    m = Model(spark, d, True)
    return plans.possible_patients(FIRST_LAST, m.events, m.closure, m.windows)


DURING = Pattern((Step("x", "1-URGENT"), Step("y", "2-HIGH")), (Relation("r", "during", "x", "y", grace=2 * DAY),))


def _exposure_events(spark, d):
    rows = model.exposures(spark, d)
    return rows.select("patient", "event_id", "kind", F.col("s").alias("lo"), F.col("s").alias("hi"), F.col("e").alias("end_lo"), F.col("e").alias("end_hi"), F.lit(0).cast("long").alias("micro"))


@query(f"SELECT x.patient, count(*)::BIGINT AS n FROM expo x JOIN expo y ON x.patient = y.patient AND y.s >= x.s AND y.s - x.e <= {2 * DAY} WHERE x.kind = '1-URGENT' AND y.kind = '2-HIGH' GROUP BY x.patient")
def during_grace(spark, d):
    kinds = spark.createDataFrame([(k, k) for k in ("1-URGENT", "2-HIGH")], "concept string, ancestor string")
    rows = _exposure_events(spark, d)
    return plans.bindings(DURING, rows, kinds, model.windows(rows), ta.certain).groupBy("patient").agg(F.count("*").alias("n"))


@query("""SELECT scope, count(DISTINCT patient)::BIGINT AS n_patients, count(*)::BIGINT AS n_events FROM (SELECT 'from_start' AS scope, e.patient FROM ev e JOIN uwin w USING (patient) WHERE kind = 'error' AND lo >= w_start
UNION ALL SELECT 'within', e.patient FROM ev e JOIN uwin w USING (patient) WHERE kind = 'error' AND lo >= w_start AND hi <= w_end UNION ALL SELECT 'after', e.patient FROM ev e JOIN uwin w USING (patient) WHERE kind = 'error' AND lo >= w_end) GROUP BY scope""")
def anchors_scope(spark, d):
    m, out = Model(spark, d, True), None
    for scope in ("from_start", "within", "after"):
        rows = plans.bindings(Pattern((Step("a", "error"),), scope=scope), m.events, m.closure, m.windows, ta.certain).agg(F.count_distinct("patient").alias("n_patients"), F.count("*").alias("n_events")).select(F.lit(scope).alias("scope"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _occurrence_sql(which):
    order = "lo, hi, lo, hi, event_id" if which == "first" else "hi DESC, lo DESC, event_id DESC"
    test = "e.lo > p.hi" if which == "first" else "e.hi < p.lo"
    return f"""SELECT p.patient, p.event_id AS picked, p.lo AS p_lo, p.hi AS p_hi, coalesce(bool_and({test} OR (e.lo = e.hi AND p.lo = p.hi AND e.lo = p.lo)), true) AS sure
FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY {order}) AS r FROM ev WHERE kind = 'purchase') p LEFT JOIN (SELECT * FROM ev WHERE kind = 'purchase') e ON e.patient = p.patient AND e.event_id <> p.event_id WHERE r = 1 GROUP BY ALL"""


@query(_occurrence_sql("first"))
def first_target(spark, d):
    return derived.occurrence(model.events(spark, d, True).filter("kind = 'purchase'"), "first")


@query(_occurrence_sql("last"))
def last_target(spark, d):
    return derived.occurrence(model.events(spark, d, True).filter("kind = 'purchase'"), "last")


@query("SELECT patient, min(lo) AS lo, min(hi) AS hi FROM ev WHERE kind = 'purchase' GROUP BY patient")
def envelope_first(spark, d):
    return derived.envelope(model.events(spark, d, True).filter("kind = 'purchase'"))


@query("SELECT e.patient, e.event_id FROM ev e WHERE kind = 'purchase' AND NOT EXISTS (SELECT 1 FROM ev o WHERE o.patient = e.patient AND o.kind = 'purchase' AND o.event_id <> e.event_id AND o.hi < e.lo)")
def first_possible_set(spark, d):
    return derived.possible_occurrences(model.events(spark, d, True).filter("kind = 'purchase'")).select("patient", "event_id")


@query("""SELECT patient, l.lo AS nth_lo, h.hi AS nth_hi FROM (SELECT patient, lo, row_number() OVER (PARTITION BY patient ORDER BY lo) AS r FROM ev WHERE kind = 'view') l JOIN (SELECT patient, hi, row_number() OVER (PARTITION BY patient ORDER BY hi) AS r FROM ev WHERE kind = 'view') h USING (patient, r) WHERE r = 3""")
def nth_envelope(spark, d):
    return derived.nth_envelope(model.events(spark, d, True).filter("kind = 'view'"), 3)


@query("""SELECT patient, l.lo AS nth_lo, h.hi AS nth_hi FROM (SELECT patient, lo, row_number() OVER (PARTITION BY patient ORDER BY lo DESC) AS r FROM ev WHERE kind = 'view') l JOIN (SELECT patient, hi, row_number() OVER (PARTITION BY patient ORDER BY hi DESC) AS r FROM ev WHERE kind = 'view') h USING (patient, r) WHERE r = 2""")
def nth_from_last(spark, d):
    return derived.nth_envelope(model.events(spark, d, True).filter("kind = 'view'"), -2)


@query(f"SELECT patient, event_id, seen FROM (SELECT patient, event_id, count(*) OVER (PARTITION BY patient ORDER BY t RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) AS seen FROM ev WHERE kind = 'error') WHERE seen >= 3")
def count_span(spark, d):
    return derived.counted_within(model.events(spark, d).filter("kind = 'error'"), 3, 24 * HOUR).select("patient", "event_id", "seen")


@query("SELECT patient, event_id, seen FROM (SELECT e.patient, event_id, count(*) OVER (PARTITION BY e.patient ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM ev e JOIN win w ON e.patient = w.patient WHERE kind = 'error' AND t BETWEEN w_start AND w_end) WHERE seen >= 4")
def count_window(spark, d):
    m = Model(spark, d)
    return derived.counted_in_window(m.events.filter("kind = 'error'"), m.windows, 4).select("patient", "event_id", "seen")


UNCERTAIN_SPAN = 24 * HOUR


@query(f"""SELECT patient, event_id, coalesce(min(forced) >= 2, false) AS certain, coalesce(max(allowed) >= 2, false) AS possible FROM (
SELECT p.patient, p.event_id, p.tau, count(*) FILTER (o.lo >= tau - {UNCERTAIN_SPAN} AND o.hi <= tau) AS forced, count(*) FILTER (o.hi >= tau - {UNCERTAIN_SPAN} AND o.lo <= tau) AS allowed
FROM (SELECT e.patient, e.event_id, unnest(list_distinct(list_value(e.lo, e.hi) || list_filter(flatten(list(list_value(o.lo, o.lo - 1, o.lo + {UNCERTAIN_SPAN}, o.lo + {UNCERTAIN_SPAN} + 1, o.hi, o.hi - 1, o.hi + 1, o.hi + {UNCERTAIN_SPAN}, o.hi + {UNCERTAIN_SPAN} + 1))), lambda x: x BETWEEN e.lo AND e.hi))) AS tau
  FROM ev e LEFT JOIN ev o ON o.patient = e.patient AND o.kind = 'error' AND o.event_id <> e.event_id WHERE e.kind = 'error' GROUP BY e.patient, e.event_id, e.lo, e.hi) p
LEFT JOIN ev o ON o.patient = p.patient AND o.kind = 'error' AND o.event_id <> p.event_id GROUP BY ALL) GROUP BY patient, event_id""")
def count_span_uncertain(spark, d):
    return derived.counted_uncertain(model.events(spark, d, True).filter("kind = 'error'"), 3, UNCERTAIN_SPAN)


@query("SELECT patient, count(*)::BIGINT AS n, min(t) AS first_at, max(t) AS last_at FROM ev WHERE kind IN ('purchase', 'signup') AND micro >= 100000000 AND micro < 250000000 GROUP BY patient HAVING count(*) >= 2")
def value_condition(spark, d):
    m = Model(spark, d)
    rows = plans.selected(m.events, m.closure, Step("a", "conversion", at_least=100_000_000, below=250_000_000))
    return rows.groupBy("patient").agg(F.count("*").alias("n"), F.min("lo").alias("first_at"), F.max("lo").alias("last_at")).filter("n >= 2")


def _rise_sql(test):
    return f"""SELECT e.patient, e.event_id, e.base_n::BIGINT AS base_n, e.base_sum::BIGINT AS base_sum FROM (SELECT e.patient, e.event_id, e.micro, count(*) AS base_n, sum(p.micro) AS base_sum FROM ev e, LATERAL (SELECT o.micro FROM ev o WHERE o.patient = e.patient AND o.kind = e.kind AND o.t BETWEEN e.t - {7 * DAY} AND e.t - 1 ORDER BY o.t DESC, o.event_id DESC LIMIT 3) p GROUP BY ALL) e WHERE {test}"""


@query(_rise_sql("micro * base_n * 2 >= greatest(base_sum, base_n * 20000000) * 5"))
def rise_prev_k(spark, d):
    return derived.risen(model.events(spark, d), 3, 7 * DAY, (5, 2), 20_000_000).select("patient", "event_id", F.col("base_n").cast("long").alias("base_n"), "base_sum")


@query(_rise_sql("micro * base_n * 5 <= greatest(base_sum, base_n * 20000000) * 2"))
def fall_prev_k(spark, d):
    return derived.risen(model.events(spark, d), 3, 7 * DAY, (5, 2), 20_000_000, falls=True).select("patient", "event_id", F.col("base_n").cast("long").alias("base_n"), "base_sum")


def _relaxed_sql(win, extra="true"):
    pair = lambda a, b, most: f"SELECT DISTINCT a.patient FROM ev a JOIN ev b ON a.patient = b.patient AND b.t - a.t BETWEEN 0 AND {most} JOIN {win} w ON w.patient = a.patient WHERE a.kind IN {a} AND b.kind IN {b} AND a.t BETWEEN w_start AND w_end AND b.t BETWEEN w_start AND w_end"
    one, two = "('signup')", "('purchase')"
    conv = "('signup', 'purchase')"
    options = [("1.000000", 1, "both_wider", pair(one, conv, 2 * HOUR)), ("1.500000", 1, "longer", pair(one, two, 8 * HOUR)), ("2.000000", 1, "wider", pair(conv, two, 2 * HOUR)), ("2.500000", 2, "both_wider,longer", pair(one, conv, 8 * HOUR)), ("3.000000", 2, "both_wider,wider", pair(conv, conv, 2 * HOUR))]
    union = " UNION ALL ".join(f"SELECT patient, {k} AS k, {c}::DECIMAL(18,6) AS cost, {n} AS size, '{ids}' AS relaxations FROM ({q})" for k, (c, n, ids, q) in enumerate(options))
    return f"SELECT patient, arg_min(cost, k) AS cost, arg_min(size, k)::INTEGER AS size, arg_min(relaxations, k) AS relaxations FROM ({union}) GROUP BY patient", pair(one, two, 2 * HOUR)


@query(_relaxed_sql("win")[0])
def relaxed_cheapest(spark, d):
    m = Model(spark, d)
    return plans.relaxed_patients(RELAXED, m.events, m.closure, m.windows)


@query(f"""SELECT w.patient, CASE WHEN w_start IS NULL THEN 'excluded' WHEN x.patient IS NOT NULL THEN 'exact' WHEN r.patient IS NOT NULL THEN 'relaxed' ELSE 'none' END AS status,
CASE WHEN w_start IS NOT NULL AND x.patient IS NULL THEN r.cost END AS cost, CASE WHEN w_start IS NOT NULL AND x.patient IS NULL THEN r.relaxations END AS relaxations FROM win w LEFT JOIN ({_relaxed_sql("win")[1]}) x USING (patient) LEFT JOIN ({_relaxed_sql("win")[0]}) r USING (patient)""")
def statuses_full(spark, d):
    m = Model(spark, d)
    return plans.statuses(RELAXED, m.events, m.closure, m.windows)


STATUS_SQL = f"SELECT w.patient, w_start, w_end, CASE WHEN w_start IS NULL THEN 'excluded' WHEN x.patient IS NOT NULL THEN 'exact' WHEN r.patient IS NOT NULL THEN 'relaxed' ELSE 'none' END AS status FROM win w LEFT JOIN ({_relaxed_sql('win')[1]}) x USING (patient) LEFT JOIN ({_relaxed_sql('win')[0]}) r USING (patient)"


@query(f"""SELECT s.patient, CASE WHEN s.status = 'none' AND steps IS NOT NULL THEN 'not_comparable' ELSE s.status END AS status, CASE WHEN s.status = 'none' THEN steps END AS steps FROM ({STATUS_SQL}) s LEFT JOIN (
SELECT patient, string_agg(step, ',' ORDER BY step) AS steps FROM win, (VALUES ('a'), ('b')) v(step) WHERE w_start IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cov c WHERE c.patient = win.patient AND c.source IN ('signup', 'purchase') AND c_lo <= w_end AND c_hi >= w_start) GROUP BY patient) u USING (patient)""")
def coverage_rule(spark, d):
    m = Model(spark, d)
    sources = store.source_concepts(m.events, m.closure)
    missing = rules.uncovered(RELAXED, m.windows, model.coverage(m.events), sources)
    return rules.with_coverage(plans.statuses(RELAXED, m.events, m.closure, m.windows), missing).select("patient", "status", "steps")


@query(f"""SELECT s.patient, CASE WHEN t.patient IS NOT NULL AND s.status = 'none' THEN 'not_comparable' WHEN t.patient IS NOT NULL AND s.status = 'relaxed' THEN 'unresolved' ELSE s.status END AS status, true AS complete FROM ({STATUS_SQL}) s LEFT JOIN (
SELECT DISTINCT x.patient FROM exc x JOIN win w USING (patient) WHERE x.concept IN ('signup', 'purchase') AND w_start IS NOT NULL AND x_hi >= w_start AND x_lo <= w_end) t USING (patient)""")
def exclusion_rule(spark, d):
    m = Model(spark, d)
    touched = rules.touched(RELAXED, model.excluded(m.events), m.closure, m.windows)
    return rules.with_exclusions(plans.statuses(RELAXED, m.events, m.closure, m.windows), touched).select("patient", "status", "complete")


@query("""SELECT patient, a.event_id AS a_id, b.event_id AS b_id, CASE WHEN a.e < b.s THEN 'before' WHEN a.s > b.e THEN 'after' WHEN a.e = b.s THEN 'meets' WHEN a.s = b.e THEN 'met_by' WHEN a.s = b.s AND a.e = b.e THEN 'equals' WHEN a.s = b.s AND a.e < b.e THEN 'starts' WHEN a.s = b.s THEN 'started_by'
WHEN a.e = b.e AND a.s > b.s THEN 'finishes' WHEN a.e = b.e THEN 'finished_by' WHEN a.s > b.s AND a.e < b.e THEN 'during' WHEN a.s < b.s AND a.e > b.e THEN 'contains' WHEN a.s < b.s THEN 'overlaps' ELSE 'overlapped_by' END AS relation
FROM expo a JOIN expo b USING (patient) WHERE a.event_id < b.event_id AND a.s <= b.e AND a.e >= b.s""")
def allen_relation(spark, d):
    """How intervals that touch are related; all other pairs are before or after each other."""
    rows = model.exposures(spark, d).select("patient", "event_id", "s", "e")
    both = intervals.pairs(rows, rows, ["patient"], 0, 1200 * DAY).filter("a_event_id < b_event_id")
    return both.select("patient", F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), ta.allen(*map(F.col, ("a_s", "a_e", "b_s", "b_e"))).alias("relation"))


@query(f"SELECT a.event_id AS a_id, b.event_id AS b_id, greatest(least(a.e, b.e) - greatest(a.s, b.s), 0) AS overlap, b.s > a.e AND b.s - a.e BETWEEN {DAY} AND {20 * DAY} AS in_gap FROM expo a JOIN expo b ON a.patient = b.patient AND a.event_id <> b.event_id AND a.s - {20 * DAY} <= b.e AND a.e + {20 * DAY} >= b.s")
def gap_overlap(spark, d):
    rows = model.exposures(spark, d).select("patient", "event_id", "s", "e")
    near = intervals.pairs(rows, rows, ["patient"], 20 * DAY, 1200 * DAY)
    a = [F.col(c) for c in ("a_s", "a_e", "b_s", "b_e")]
    return near.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), intervals.overlap(*a).alias("overlap"), intervals.gap(a[0], a[1], a[2], DAY, 20 * DAY).alias("in_gap"))


@query(f"""SELECT a.patient, a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id FROM expo a JOIN expo b ON a.patient = b.patient AND a.event_id <> b.event_id AND a.s < b.s AND a.e > b.s AND a.e < b.e JOIN expo c ON c.patient = a.patient AND c.event_id <> a.event_id AND c.event_id <> b.event_id AND c.s > b.e AND c.s - b.e BETWEEN 0 AND {60 * DAY} WHERE a.status = 'F' AND b.status = 'O'""")
def interval_cohort(spark, d):
    rows = model.exposures(spark, d)
    pick = lambda *only: rows.filter(F.col("status").isin(*only)).select("patient", "event_id", "s", "e") if only else rows.select("patient", "event_id", "s", "e")
    found = intervals.cohort([pick("F"), pick("O"), pick()], [(0, 1, "overlaps", None, None), (1, 2, "gap", 0, 60 * DAY)], ["patient"])
    return found.select("patient", *(F.col(f"s{i}_event_id").alias(f"{n}_id") for i, n in enumerate("abc")))


def _bounded(spark, d):
    """Exposures whose ends are known within days, on one of two clocks."""
    bounds = [(F.col(c) + sign * (F.col("event_id") % k) * DAY).alias(f"{c}_{x}") for c in "se" for x, sign, k in (("lo", -1, 4), ("hi", 1, 6))]
    return model.exposures(spark, d).select("patient", "event_id", "s", "e", *bounds, F.when(F.col("event_id") % 11 == 0, "local").otherwise("utc").alias("clock"))


BOUNDED = f"bnd AS (SELECT patient, event_id, s - (event_id % 4) * {DAY} AS s_lo, s + (event_id % 6) * {DAY} AS s_hi, e - (event_id % 4) * {DAY} AS e_lo, e + (event_id % 6) * {DAY} AS e_hi, CASE WHEN event_id % 11 = 0 THEN 'local' ELSE 'utc' END AS clock FROM expo)"
BOUNDED_PAIRS = "bnd a JOIN bnd b ON a.patient = b.patient AND a.event_id <> b.event_id"


@query(f""", {BOUNDED} SELECT a.patient, a.event_id AS a_id, b.event_id AS b_id, CASE WHEN a.s_hi < b.s_lo AND b.s_hi < a.e_lo AND a.e_hi < b.e_lo THEN 'CERTAIN' ELSE 'POSSIBLE' END AS status FROM {BOUNDED_PAIRS} AND a.clock = b.clock
WHERE a.s_lo < b.s_hi AND greatest(b.s_lo, a.s_lo + 1) < a.e_hi AND greatest(b.s_lo, a.s_lo + 1) <= b.s_hi AND greatest(a.e_lo, greatest(b.s_lo, a.s_lo + 1) + 1) < b.e_hi AND greatest(a.e_lo, greatest(b.s_lo, a.s_lo + 1) + 1) <= a.e_hi""")
def bounded_classify(spark, d):
    """Pairs of which the first overlaps the second for certain or possibly; all others of one clock are impossible."""
    rows = _bounded(spark, d)
    spans = rows.select("patient", "event_id", "clock", "s_lo", "s_hi", "e_lo", "e_hi", F.col("s_lo").alias("s"), F.col("e_hi").alias("e"))
    found = intervals.pairs(spans, spans, ["patient"], 0, 1200 * DAY).filter("a_clock = b_clock").select("patient", F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), intervals.bounded("overlaps").alias("status"))
    return found.filter(F.col("status").isin("CERTAIN", "POSSIBLE"))


@query(f""", {BOUNDED} SELECT patient, CASE max(CASE WHEN a_clock <> b_clock THEN 1 WHEN NOT ok THEN 0 WHEN sure THEN 3 ELSE 2 END) WHEN 3 THEN 'CERTAIN_MATCH' WHEN 2 THEN 'POSSIBLE_MATCH' WHEN 1 THEN 'INCOMPARABLE' ELSE 'NO_RECORDED_MATCH' END AS status FROM (
SELECT a.patient, a.clock AS a_clock, b.clock AS b_clock, greatest(a.e_lo, a.s_lo + 1) + 1 <= least(b.s_hi, b.e_hi - 1) AS ok, a.e_hi - b.s_lo <= -1 AS sure FROM {BOUNDED_PAIRS}) GROUP BY patient""")
def bounded_rollup(spark, d):
    return intervals.before_rolled_up(_bounded(spark, d), ["patient"])


ROBUST = [("original", 0, 0, 2 * DAY), ("ten_days", 1, 0, 10 * DAY), ("month", 2, 0, 30 * DAY), ("never", 9, 0, 300 * DAY)]


@query(f""", {BOUNDED} SELECT patient, arg_min(option, cost) AS option, min(cost)::INTEGER AS cost FROM ({" UNION ALL ".join(f"SELECT a.patient, '{n}' AS option, {c} AS cost FROM {BOUNDED_PAIRS} WHERE a.clock = b.clock AND a.e_hi - b.s_lo <= {-lo} AND b.s_hi - a.e_lo <= {hi}" for n, c, lo, hi in ROBUST[:3])}) GROUP BY patient""")
def robust_relaxation(spark, d):
    rows = _bounded(spark, d)
    return intervals.robust(intervals.pairs(rows, rows, ["patient"], 40 * DAY, 1200 * DAY), ROBUST, ["patient"], 5)  # no option within the budget reaches further


def _readings(spark, d):
    return model.events(spark, d).filter("kind IN ('view', 'click')").withColumn("unit", F.when(F.col("event_id") % 9 == 0, "g").otherwise("mg"))


def _treatments(spark, d):
    return model.events(spark, d).filter("kind = 'purchase'").select("patient", "event_id", F.col("lo").alias("s"), (F.col("lo") + 12 * HOUR).alias("e"))


@query(f""", r AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'g' ELSE 'mg' END AS unit FROM ev WHERE kind IN ('view', 'click')), base AS (SELECT x.patient, x.event_id AS x_id, x.t AS s, b.event_id AS b_event_id, b.micro AS b_micro, b.unit FROM ev x JOIN r b ON b.patient = x.patient AND b.t BETWEEN x.t - {6 * HOUR} AND x.t - 1 AND b.micro >= 50000000 WHERE x.kind = 'purchase')
SELECT b.patient, x_id, b_event_id, b_micro, f.event_id AS f_event_id, f.micro AS f_micro, f.micro - b_micro AS change FROM base b LEFT JOIN r f ON f.patient = b.patient AND f.unit = b.unit AND f.t BETWEEN s + 1 AND s + {8 * HOUR}""")
def mixed_followup(spark, d):
    return intervals.baseline_followup(_treatments(spark, d), _readings(spark, d), (1, 6 * HOUR), (1, 8 * HOUR), 50_000_000)


@query(f"SELECT DISTINCT x.event_id AS anchor_id, r.event_id FROM ev x JOIN ev r ON r.patient = x.patient AND (r.t BETWEEN x.t - {6 * HOUR} AND x.t - {HOUR} OR r.t BETWEEN x.t AND x.t + {4 * HOUR}) WHERE x.kind = 'purchase' AND r.kind IN ('view', 'click')")
def source_windows(spark, d):
    anchors = model.events(spark, d).filter("kind = 'purchase'").select(F.col("event_id").alias("anchor_id"), "patient", F.col("lo").alias("at"))
    return intervals.in_windows(anchors, _readings(spark, d), [(-6 * HOUR, -HOUR), (0, 4 * HOUR)])


@query(f"""SELECT x.patient, x.t AS "at", r.event_id, r.t, r.micro FROM (SELECT DISTINCT patient, t FROM ev WHERE kind = 'purchase') x, LATERAL (SELECT * FROM ev o WHERE o.patient = x.patient AND o.kind IN ('view', 'click') AND o.t >= x.t - {48 * HOUR} AND o.t < x.t ORDER BY o.t DESC, o.event_id LIMIT 1) r""")
def latest_before_index(spark, d):
    anchors = model.events(spark, d).filter("kind = 'purchase'").select("patient", F.col("lo").alias("at"))
    return derived.latest_before(anchors, _readings(spark, d), 48 * HOUR)


@query("SELECT patient, arg_max(micro, (t, -event_id)) AS latest, CASE WHEN max(t) > min(t) THEN arg_max(micro, (t, -event_id)) - arg_min(micro, (t, event_id)) END AS change, count(*)::BIGINT AS n, (any_value(w_end) - max(t)) // 60000000 AS recency_minutes FROM ev JOIN win USING (patient) WHERE kind = 'view' AND w_start IS NOT NULL AND t >= w_start AND t < w_end GROUP BY patient")
def features4(spark, d):
    m = Model(spark, d)
    return derived.features(m.events.filter("kind = 'view'"), m.windows)


def _bought(spark, d):
    """patient, kind (a part's type) and the catalogue: a type's own ancestors are its first words."""
    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = rows.select(F.col("o_custkey").alias("patient"), F.col("p_brand").alias("kind")).distinct()
    catalogue = read(spark, d, "part").select(F.col("p_brand").alias("concept")).distinct()
    return kinds, catalogue.select("concept", F.explode(F.array_distinct(F.array("concept", F.substring("concept", 1, 7), F.lit("Brand")))).alias("ancestor"))


BOUGHT = "bought AS (SELECT DISTINCT o_custkey AS patient, p_brand AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), cat AS (SELECT DISTINCT p_brand AS concept, unnest(list_value(p_brand, substr(p_brand, 1, 7), 'Brand')) AS ancestor FROM part), con AS (SELECT DISTINCT patient, ancestor AS concept FROM bought JOIN cat ON kind = concept), ref AS (SELECT min(patient) AS patient FROM bought), n AS (SELECT count(DISTINCT patient) AS n FROM bought), ic AS (SELECT concept, round_even(-ln((count(*) + 1) / (any_value(n) + 1)), 12) + 0.0::DOUBLE AS ic FROM con, n GROUP BY concept)"


def _concepts(spark, d):
    kinds, catalogue = _bought(spark, d)
    kinds = cut(kinds)  # a three-way join that several steps read
    concepts = kinds.join(F.broadcast(catalogue), F.col("kind") == F.col("concept")).select("patient", F.col("ancestor").alias("concept")).distinct()
    return kinds, catalogue, concepts, kinds.agg(F.min("patient")).first()[0], kinds.select("patient").distinct().count()


@query(f", {BOUGHT} SELECT c.patient, count(*) FILTER (c.concept IN (SELECT concept FROM con JOIN ref USING (patient)))::BIGINT AS both, (count(*) + (SELECT count(*) FROM con JOIN ref USING (patient)) - count(*) FILTER (c.concept IN (SELECT concept FROM con JOIN ref USING (patient))))::BIGINT AS either FROM con c WHERE c.patient <> (SELECT patient FROM ref) GROUP BY c.patient")
def jaccard(spark, d):
    _, _, concepts, reference, _ = _concepts(spark, d)
    return similarity.jaccard(concepts, reference)


@query(f", {BOUGHT} SELECT concept, ic FROM ic")
def information_content(spark, d):
    _, _, concepts, _, n = _concepts(spark, d)
    return similarity.information_content(concepts, n)


@query(f""", {BOUGHT}, s AS (SELECT patient, sum(round(ic * 1e12)::BIGINT) AS own, sum(CASE WHEN concept IN (SELECT concept FROM con JOIN ref USING (patient)) THEN round(ic * 1e12)::BIGINT ELSE 0 END) AS shared FROM con JOIN ic USING (concept) GROUP BY patient)
SELECT patient, round(CASE WHEN own + (SELECT own FROM s JOIN ref USING (patient)) - shared = 0 THEN 0 ELSE 1 - shared::DOUBLE / (own + (SELECT own FROM s JOIN ref USING (patient)) - shared)::DOUBLE END, 9) AS distance FROM s WHERE patient <> (SELECT patient FROM ref)""")
def simgic(spark, d):
    _, _, concepts, reference, n = _concepts(spark, d)
    return similarity.simgic(concepts, similarity.information_content(concepts, n), reference)


@query(f""", {BOUGHT}, x AS (SELECT patient, kind, ancestor, ic FROM bought JOIN cat ON kind = concept JOIN ic ON ic.concept = ancestor), own AS (SELECT kind AS r_kind, max(ic) AS own_ic FROM x JOIN ref USING (patient) GROUP BY kind),
best AS (SELECT x.patient, o.kind AS r_kind, max(x.ic) AS best FROM x JOIN (SELECT kind, ancestor FROM x JOIN ref USING (patient)) o USING (ancestor) GROUP BY ALL) SELECT patient, round(1 - sum(CASE WHEN own_ic > 0 THEN best / own_ic ELSE 0 END) / (SELECT count(*) FROM own), 9) AS distance FROM best JOIN own USING (r_kind) WHERE patient <> (SELECT patient FROM ref) GROUP BY patient""")
def resnik_bma(spark, d):
    kinds, catalogue, concepts, reference, n = _concepts(spark, d)
    return similarity.resnik(kinds, catalogue, similarity.information_content(concepts, n), reference)


@query("""SELECT patient, distance, coverage, rank FROM (SELECT *, row_number() OVER (ORDER BY distance, patient) AS rank FROM (SELECT c.c_custkey AS patient, CAST(((6 - (1 + CASE WHEN c.low IS NULL OR r.low IS NULL THEN 0 ELSE 2 END + 3)) + (CASE WHEN c.c_mktsegment = r.c_mktsegment THEN 0 ELSE 1 END) * 1 + coalesce(least(abs(c.low - r.low), 100000) / 100000, 0) * 2 + least(abs(c.bal - r.bal), 5000) / 5000 * 3) / 6 AS DECIMAL(18,6)) AS distance,
CAST((4 + CASE WHEN c.low IS NULL OR r.low IS NULL THEN 0 ELSE 2 END) / 6 AS DECIMAL(18,6)) AS coverage FROM (SELECT c_custkey, c_mktsegment, c_acctbal::DECIMAL(18,2) AS bal, (SELECT min(o_totalprice)::DECIMAL(18,2) FROM orders WHERE o_custkey = c_custkey) AS low FROM customer) c, (SELECT c_mktsegment, c_acctbal::DECIMAL(18,2) AS bal, (SELECT min(o_totalprice)::DECIMAL(18,2) FROM orders WHERE o_custkey = c_custkey) AS low FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)) r WHERE c.c_custkey <> (SELECT min(c_custkey) FROM customer)) WHERE coverage >= 0.5) WHERE rank <= 25""".replace("abs(c.low - r.low), 100000) / 100000", "abs(c.low - r.low), 100000)::DECIMAL(28,9) / 100000").replace("abs(c.bal - r.bal), 5000) / 5000", "abs(c.bal - r.bal), 5000)::DECIMAL(28,9) / 5000"))
def weighted_rank_topk(spark, d):
    low = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient")).agg(F.min(F.col("o_totalprice").cast("decimal(18,2)")).alias("low"))
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_mktsegment").alias("band"), F.col("c_acctbal").cast("decimal(18,2)").alias("bal")).join(low, "patient", "left")
    me = people.orderBy("patient").limit(1).select(*(F.col(c).alias(f"r_{c}") for c in people.columns))
    both = people.join(F.broadcast(me), F.col("patient") != F.col("r_patient"))  # against one row
    clipped = lambda c, scale: F.least(F.abs(F.col(c) - F.col(f"r_{c}")), F.lit(scale).cast("decimal(18,2)")) / F.lit(scale).cast("decimal(18,2)")
    distance, coverage, rankable = similarity.weighted([(F.when(F.col("band") == F.col("r_band"), 0).otherwise(1), 1), (clipped("low", 100000), 2), (clipped("bal", 5000), 3)], Decimal("0.5"))
    rows = both.filter(rankable).select("patient", distance.cast("decimal(18,6)").alias("distance"), coverage.cast("decimal(18,6)").alias("coverage"))
    return similarity.ranked(rows, "distance", "patient", 25)


@query("""SELECT coalesce(a.patient, b.patient) AS patient, CASE WHEN a.patient IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT patient FROM ev WHERE kind = 'error' GROUP BY 1 HAVING count(*) >= 12) a FULL JOIN (SELECT patient FROM ev WHERE kind = 'signup' GROUP BY 1 HAVING count(*) >= 12) b ON a.patient = b.patient WHERE a.patient IS NULL OR b.patient IS NULL""")
def revision_diff(spark, d):
    """Who joins and who leaves where a query for twelve errors is revised to twelve signups."""
    rows = model.events(spark, d)
    old, new = (rows.filter(F.col("kind") == k).groupBy("patient").agg(F.count("*").alias("n")).filter("n >= 12").select("patient") for k in ("error", "signup"))
    tag = lambda df, t: df.withColumn("change", F.lit(t))
    return tag(new.join(old, "patient", "left_anti"), "added").unionByName(tag(old.join(new, "patient", "left_anti"), "removed"))


STATE = "st AS (SELECT patient, status <> 'P' AS positive, s, e FROM expo WHERE status IN ('F', 'P')), sw AS (SELECT patient, min(s) AS w_start, max(e) AS w_end FROM expo GROUP BY patient)"
SEGMENTS = f"{STATE}, cuts AS (SELECT DISTINCT patient, t FROM (SELECT patient, s AS t FROM st UNION ALL SELECT patient, e FROM st UNION ALL SELECT patient, w_start FROM sw UNION ALL SELECT patient, w_end FROM sw)), seg AS (SELECT patient, t AS from_, lead(t) OVER (PARTITION BY patient ORDER BY t) AS to_ FROM cuts), lab AS (SELECT g.patient, from_, to_, CASE WHEN coalesce(bool_or(positive), false) AND coalesce(bool_or(NOT positive), false) THEN 'CONFLICT' WHEN bool_or(positive) THEN 'SUPPORTED' WHEN bool_or(NOT positive) THEN 'REFUTED' ELSE 'UNKNOWN' END AS status FROM seg g LEFT JOIN st ON st.patient = g.patient AND st.s <= from_ AND st.e >= to_ WHERE to_ IS NOT NULL GROUP BY ALL)"


def _states(spark, d):
    rows = model.exposures(spark, d)
    w = rows.groupBy("patient").agg(F.min("s").alias("w_start"), F.max("e").alias("w_end"))
    return states.segments(rows.filter("status IN ('F', 'P')").select("patient", (F.col("status") != "P").alias("positive"), "s", "e"), w, ["patient"])


@query(f", {SEGMENTS} SELECT patient, from_, to_, status FROM lab")
def state_segments(spark, d):
    return _states(spark, d)


@query(f", {SEGMENTS}, mark AS (SELECT *, CASE WHEN lag(status) OVER w = status AND lag(to_) OVER w = from_ THEN 0 ELSE 1 END AS fresh FROM lab WINDOW w AS (PARTITION BY patient ORDER BY from_)), isl AS (SELECT *, sum(fresh) OVER (PARTITION BY patient ORDER BY from_) AS i FROM mark) SELECT patient, status, min(from_) AS from_, max(to_) AS to_ FROM isl GROUP BY patient, i, status")
def state_coalesced(spark, d):
    return states.coalesced(_states(spark, d), ["patient"])


@query(f", {SEGMENTS}, v AS (SELECT patient, {', '.join(f'''coalesce(sum(to_ - from_) FILTER (status = '{s}'), 0)::BIGINT AS {s.lower()}''' for s in ('SUPPORTED', 'REFUTED', 'UNKNOWN', 'CONFLICT'))} FROM lab GROUP BY patient) SELECT *, CASE WHEN conflict > 0 THEN 'BLOCKED_SOURCE_CONFLICT' WHEN refuted > 0 THEN 'VIOLATED' WHEN unknown > 0 THEN 'UNKNOWN' ELSE 'HOLDS' END AS verdict FROM v")
def state_verdicts(spark, d):
    return states.verdicts(_states(spark, d), ["patient"])


@query(f", {STATE} SELECT DISTINCT p.patient, p.s AS t FROM st p JOIN st r ON p.patient = r.patient AND p.positive <> r.positive AND p.s >= r.s AND p.s < r.e")
def state_conflicts(spark, d):
    rows = model.exposures(spark, d).filter("status IN ('F', 'P')").select("patient", (F.col("status") != "P").alias("positive"), "s", "e")
    return states.point_conflicts(rows.select("patient", "positive", F.col("s").alias("t")), rows, ["patient"])


ENTRIES = "en AS (SELECT conv_id * 100 + turn AS id, role AS source, CASE WHEN turn > 0 AND turn % 5 <> 4 THEN conv_id * 100 + turn - 1 WHEN turn % 5 = 4 THEN conv_id * 100 + turn - 2 END AS supersedes, CASE WHEN length(text) % 6 = 0 THEN 'withdraw' ELSE 'assert' END AS operation, CASE WHEN length(text) % 13 <> 0 THEN turn * 10 + length(text) % 7 END AS available FROM conversations)"


def _entries(spark, d):
    n, turn = F.length("text"), F.col("turn")
    before = F.when((turn > 0) & (turn % 5 != 4), F.col("conv_id") * 100 + turn - 1).when(turn % 5 == 4, F.col("conv_id") * 100 + turn - 2)
    return read(spark, d, "conversations").select((F.col("conv_id") * 100 + turn).alias("id"), F.col("role").alias("source"), before.alias("supersedes"), F.when(n % 6 == 0, "withdraw").otherwise("assert").alias("operation"), F.when(n % 13 != 0, turn * 10 + n % 7).alias("available"))


@query(f""", {ENTRIES}, m AS (SELECT *, CASE WHEN source NOT IN ('user', 'assistant') THEN 'EXCLUDED_SOURCE' WHEN available IS NULL THEN 'UNKNOWN_AVAILABILITY' WHEN available > 45 THEN 'AFTER_CUTOFF' ELSE 'ELIGIBLE' END AS st FROM en), nx AS (SELECT supersedes AS id, count(*) AS k FROM m WHERE st = 'ELIGIBLE' AND supersedes IS NOT NULL GROUP BY 1)
SELECT m.id, CASE WHEN m.st <> 'ELIGIBLE' THEN m.st WHEN m.supersedes IS NOT NULL AND NOT coalesce(p.st = 'ELIGIBLE', false) THEN 'INELIGIBLE_REVISION_ANCESTOR' WHEN k > 1 THEN 'REVISION_FORK' WHEN k = 1 THEN 'SUPERSEDED' WHEN m.operation = 'withdraw' THEN 'WITHDRAWAL' ELSE 'ACTIVE' END AS state FROM m LEFT JOIN nx USING (id) LEFT JOIN m p ON p.id = m.supersedes""")
def revision_resolution(spark, d):
    return evidence.as_known(_entries(spark, d), F.lit(45), ["user", "assistant"]).select("id", "state")


@query("SELECT conv_id AS claim, CASE WHEN d IS NULL THEN 'pending' ELSE d END AS decision FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, arg_max(CASE WHEN length(text) % 3 = 0 THEN 'accept' WHEN length(text) % 3 = 1 THEN 'reject' ELSE 'withdraw' END, turn) AS d FROM conversations WHERE role = 'assistant' GROUP BY conv_id) USING (conv_id)")
def claim_decisions(spark, d):
    rows = read(spark, d, "conversations")
    n = F.length("text") % 3
    decisions = rows.filter("role = 'assistant'").select(F.col("conv_id").alias("claim"), F.col("turn").alias("at"), F.when(n == 0, "accept").when(n == 1, "reject").otherwise("withdraw").alias("decision"))
    return evidence.decided(rows.select(F.col("conv_id").alias("claim")).distinct(), decisions)


@query("SELECT l_orderkey * 10 + l_linenumber % 4 AS claim, count(*)::BIGINT AS copies, count(DISTINCT (l_returnflag, l_linestatus)) > 1 AS conflict FROM lineitem GROUP BY 1")
def claim_conflict(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber") % 4).alias("claim"), "l_returnflag", "l_linestatus")
    return evidence.variants(rows, "claim", ["l_returnflag", "l_linestatus"])


ADMIT = """a AS (SELECT *, list_sort(list_filter([CASE WHEN l_quantity > 48 THEN 'quantity' END, CASE WHEN l_discount >= 0.1 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS rs FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 20, len(rs) = 0 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM a)"""


@query(f", {ADMIT} SELECT CASE WHEN list_contains(rs, 'quantity') OR list_contains(rs, 'discount') THEN 'invalid' WHEN list_contains(rs, 'returned') THEN 'unsupported' WHEN nth > 1 THEN 'duplicate' ELSE 'admitted' END AS outcome, array_to_string(rs, ',') AS reasons, count(*)::BIGINT AS n FROM b GROUP BY ALL")
def admission_outcomes(spark, d):
    rows = read(spark, d, "lineitem").withColumn("who", F.col("l_suppkey") % 20)
    reasons = {"quantity": ("invalid", F.col("l_quantity") > 48), "discount": ("invalid", F.col("l_discount") >= 0.1), "returned": ("unsupported", F.col("l_returnflag") == "R")}
    return evidence.outcome_counts(evidence.admitted(rows, reasons, ["l_orderkey", "who"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]))


@query("SELECT user_id, event_type, (epoch_us(ts) // 3600000000)::BIGINT AS hour, min(event_id) AS first_id, count(*)::BIGINT AS copies FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1")
def dedup_rows(spark, d):
    hour = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    rows = read(spark, d, "events").select("user_id", "event_type", F.floor(hour / 3_600_000_000).alias("hour"), "event_id")
    return rows.groupBy("user_id", "event_type", "hour").agg(F.min("event_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")


@query(""", h AS (SELECT (('0x' || substr(sha256(patient::VARCHAR), 1, 8))::BIGINT % 8)::INTEGER AS bucket, sha256('["' || patient || '","' || event_id || '","' || kind || '","' || micro || '"]') AS x FROM ev)
SELECT bucket, n::BIGINT AS n, sha256(concat_ws(':', n, w0, w1, w2, w3)) AS digest FROM (SELECT bucket, count(*) AS n, sum(('0x' || substr(x, 1, 15))::BIGINT) AS w0, sum(('0x' || substr(x, 16, 15))::BIGINT) AS w1, sum(('0x' || substr(x, 31, 15))::BIGINT) AS w2, sum(('0x' || substr(x, 46, 15))::BIGINT) AS w3 FROM h GROUP BY bucket)""")
def content_digest(spark, d):
    return store.bucket_digests(model.events(spark, d), "patient", ["patient", "event_id", "kind", "micro"])


@query()
def merkle_root(spark, d):
    rows = model.events(spark, d).groupBy("patient").agg(F.count("*").alias("n"), F.sum("micro").alias("total"))
    return store.merkle_levels(rows.select("patient", scalars.digest(F.col("patient"), F.col("n"), F.col("total")).alias("digest")), "patient", "digest")


@query(f"""SELECT patient, count(*)::BIGINT AS plausible, count(*) FILTER (la <= a_hi AND greatest(b_lo, la, c_lo - {24 * HOUR}) <= b_hi AND greatest(c_lo, b_lo, la) <= c_hi)::BIGINT AS feasible FROM (
SELECT a.patient, greatest(a.lo, b.lo - {24 * HOUR}, c.lo - {30 * HOUR}) AS la, a.hi AS a_hi, b.lo AS b_lo, b.hi AS b_hi, c.lo AS c_lo, c.hi AS c_hi FROM ev a JOIN ev b ON a.patient = b.patient AND b.kind = 'click' AND b.hi >= a.lo AND b.lo - a.hi <= {24 * HOUR}
JOIN ev c ON c.patient = a.patient AND c.kind = 'purchase' AND c.hi >= b.lo AND c.lo - b.hi <= {24 * HOUR} AND c.hi >= a.lo AND c.lo - a.hi <= {30 * HOUR} WHERE a.kind = 'view') GROUP BY patient""")
def hof_feasibility(spark, d):
    """Joint feasibility of cyclic bindings of uncertain events, counted by patient."""
    m = Model(spark, d, True)
    found = plans.bindings(CYCLE, m.events, m.closure, m.windows, ta.plausible)
    return found.groupBy("patient").agg(F.count("*").alias("plausible"), F.sum(plans.jointly(CYCLE).cast("long")).alias("feasible"))


@query("""SELECT DISTINCT a.patient FROM ev a JOIN ev b ON a.patient = b.patient AND b.t - a.t BETWEEN 0 AND %d JOIN ev c ON c.patient = b.patient AND c.t - b.t BETWEEN 0 AND %d AND c.t - a.t BETWEEN 0 AND %d JOIN ev e ON e.patient = c.patient AND e.t - c.t BETWEEN 0 AND %d AND e.t - a.t BETWEEN %d AND %d
WHERE a.kind = 'view' AND b.kind = 'click' AND c.kind = 'purchase' AND e.kind = 'error'""" % (24 * HOUR, 24 * HOUR, 30 * HOUR, 24 * HOUR, 6 * HOUR, 48 * HOUR))
def cycle_patients(spark, d):
    """Patients with two cycles that share a view, decided for each view at once; no binding is listed."""
    m = Model(spark, d)
    more = Pattern((*CYCLE.steps, Step("e", "error")), (*CYCLE.relations, Relation("r4", "after", "c", "e", 0, 24 * HOUR), Relation("r5", "after", "a", "e", 6 * HOUR, 48 * HOUR)))
    return plans.exact_patients(more, m.events, m.closure, m.windows)


SPREAD = Pattern((Step("a", "error", at_least=100_000_000), Step("b", "signup"), Step("c", "purchase", below=10_000_000)), (Relation("r1", "after", "a", "b", 5 * DAY, 7 * DAY), Relation("r2", "after", "b", "c", 6 * DAY, 8 * DAY)), scope="within")


@query(f"""SELECT w.patient, coalesce(w_start IS NULL OR greatest(al, w_start) > least(ah, w_end) OR b_lo > b_hi OR greatest(cl, w_start, b_lo + {6 * DAY}) > least(ch, w_end, b_hi + {8 * DAY}), true) AS refuted FROM uwin w LEFT JOIN (SELECT x.*, greatest(bl, w_start, greatest(al, w_start) + {5 * DAY}) AS b_lo, least(bh, w_end, least(ah, w_end) + {7 * DAY}) AS b_hi FROM uwin JOIN
(SELECT patient, min(lo) FILTER (kind = 'error' AND micro >= 100000000) AS al, max(hi) FILTER (kind = 'error' AND micro >= 100000000) AS ah, min(lo) FILTER (kind = 'signup') AS bl, max(hi) FILTER (kind = 'signup') AS bh, min(lo) FILTER (kind = 'purchase' AND micro < 10000000) AS cl, max(hi) FILTER (kind = 'purchase' AND micro < 10000000) AS ch FROM ev GROUP BY patient) x USING (patient)
WHERE al IS NOT NULL AND bl IS NOT NULL AND cl IS NOT NULL) USING (patient)""")
def hull_refuted(spark, d):
    """Patients whose histories rule a pattern out by their steps' hulls alone."""
    m = Model(spark, d, True)
    return plans.hulls(SPREAD, m.events, m.closure, m.windows)


BEFORE_FIRST = Pattern((Step("a", "signup", occurrence="first"), Step("b", "conversion")), (Relation("r", "after", "b", "a", 1, 5 * DAY),))


@query(f""", {SCENARIOS} SELECT w.patient, CASE WHEN w_start IS NULL THEN 'excluded' WHEN s.sure THEN 'exact' WHEN s.may THEN 'possible' ELSE 'none' END AS status FROM uwin w LEFT JOIN (SELECT patient, bool_and(sure) AS sure, bool_or(may) AS may FROM (
SELECT a.patient, a.event_id, coalesce(bool_or(a.lo - b.hi >= 1 AND a.hi - b.lo <= {5 * DAY}), false) AS sure, coalesce(bool_or(a.hi - b.lo >= 1 AND a.lo - b.hi <= {5 * DAY}), false) AS may FROM first_ a LEFT JOIN ev b ON b.patient = a.patient AND b.kind = 'purchase' GROUP BY ALL) GROUP BY patient) s USING (patient)""")
def before_first(spark, d):
    """A conversion within five days before the first signup: another signup, a conversion too, can't be it, since none comes before the first."""
    m = Model(spark, d, True)
    return plans.statuses(BEFORE_FIRST, m.events, m.closure, m.windows).select("patient", "status")


@query(f""", r AS (SELECT * FROM ev WHERE kind = 'error'), near AS (SELECT e.patient, e.event_id, e.lo, e.hi, e.micro, o.lo AS o_lo, o.hi AS o_hi, o.event_id AS o_id, o.micro AS v FROM r e JOIN r o ON o.patient = e.patient AND o.event_id <> e.event_id AND o.lo <= e.hi - 1 AND o.hi >= e.lo - {2 * DAY}),
tried AS (SELECT DISTINCT patient, event_id, t FROM (SELECT patient, event_id, lo, hi, unnest([lo, o_lo + 1, o_lo + 2, o_hi + 1, o_hi + 2, o_lo + {2 * DAY} + 1, o_hi + {2 * DAY} + 1]) AS t FROM near) WHERE t BETWEEN lo AND hi),
seen AS (SELECT n.*, t, o_lo >= t - {2 * DAY} AND o_hi <= t - 1 AS forced, least(o_hi, t - 1) AS latest FROM near n JOIN tried USING (patient, event_id) WHERE o_lo <= t - 1 AND o_hi >= t - {2 * DAY}),
last_ AS (SELECT s.event_id, s.t, s.micro >= 2 * greatest(s.v, 50000000) AS rises FROM seen s WHERE NOT EXISTS (SELECT 1 FROM seen f WHERE f.event_id = s.event_id AND f.t = s.t AND f.forced AND f.o_id <> s.o_id AND (f.o_lo, f.o_id) > (s.latest, s.o_id))),
each_ AS (SELECT y.patient, y.event_id, y.t, coalesce((SELECT bool_or(rises) FROM last_ l WHERE l.event_id = y.event_id AND l.t = y.t), false) AS may, coalesce((SELECT bool_and(rises) FROM last_ l WHERE l.event_id = y.event_id AND l.t = y.t), false) AND EXISTS (SELECT 1 FROM seen f WHERE f.event_id = y.event_id AND f.t = y.t AND f.forced) AS must FROM tried y)
SELECT patient, event_id, bool_and(must) AS certain FROM each_ GROUP BY patient, event_id HAVING bool_or(may)""")
def rise_uncertain(spark, d):
    """Errors of at least twice the last one's value in the two days before, where times are known within ranges."""
    rows = model.events(spark, d, True).filter("kind = 'error'")
    return rises.uncertain(rows, 1, 2 * DAY, (2, 1), 50_000_000).select("patient", "event_id", "certain")


@query(f""", b AS (SELECT a.patient, a.event_id AS a_event_id, b.event_id AS b_event_id, c.event_id AS c_event_id, greatest(a.lo, w_start) AS al, least(a.hi, w_end) AS ah, greatest(b.lo, w_start) AS bl, least(b.hi, w_end) AS bh, greatest(c.lo, w_start) AS cl, least(c.hi, w_end) AS ch
  FROM uwin w JOIN ev a ON a.patient = w.patient AND a.kind = 'view' JOIN ev b ON b.patient = w.patient AND b.kind = 'click' AND b.hi >= a.lo AND b.lo <= a.hi + {12 * HOUR} JOIN ev c ON c.patient = w.patient AND c.kind = 'purchase' AND c.hi >= b.lo AND c.lo <= b.hi + {12 * HOUR} WHERE w_start IS NOT NULL),
t AS (SELECT *, greatest(al, bl - {12 * HOUR}, cl - {24 * HOUR}) AS a_at FROM b), u AS (SELECT *, greatest(bl, a_at, cl - {12 * HOUR}) AS b_at FROM t), v AS (SELECT *, greatest(cl, b_at) AS c_at FROM u)
SELECT patient, a_event_id, b_event_id, c_event_id, a_at, b_at, c_at, true AS replayed FROM v WHERE a_at <= ah AND b_at <= bh AND c_at <= ch QUALIFY row_number() OVER (PARTITION BY patient ORDER BY a_event_id, b_event_id, c_event_id) = 1""")
def binding_witness(spark, d):
    """A binding of each possible patient with times at which it holds."""
    m = Model(spark, d, True)
    return plans.witnesses(CHAIN, m.events, m.closure, m.windows)


FOUND = Pattern((Step("a", "error", at_least=250_000_000), Step("b", "purchase")), (Relation("r", "after", "a", "b", 0, 12 * HOUR),), scope="within")


@query(f"""SELECT w.patient, CASE WHEN w_start IS NULL THEN 'excluded' WHEN s.sure THEN 'exact' WHEN s.may THEN 'possible' WHEN u.n > 0 THEN 'not_comparable' ELSE 'none' END AS status, NOT (coalesce(s.may, false) AND NOT coalesce(s.sure, false) AND coalesce(u.n, 0) > 0) AS complete, CASE WHEN u.n > 0 THEN 'a' END AS steps FROM uwin w LEFT JOIN (
SELECT a.patient, bool_or(a.lo >= w_start AND a.hi <= w_end AND b.lo >= w_start AND b.hi <= w_end AND b.lo - a.hi >= 0 AND b.hi - a.lo <= {12 * HOUR}) AS sure, bool_or(greatest(a.lo, w_start) <= least(a.hi, w_end) AND greatest(b.lo, w_start, greatest(a.lo, w_start)) <= least(b.hi, w_end, least(a.hi, w_end) + {12 * HOUR})) AS may
FROM uwin JOIN ev a ON a.patient = uwin.patient AND a.kind = 'error' AND a.micro >= 250000000 JOIN ev b ON b.patient = a.patient AND b.kind = 'purchase' WHERE w_start IS NOT NULL GROUP BY a.patient) s USING (patient)
LEFT JOIN (SELECT patient, count(*) AS n FROM ev JOIN uwin USING (patient) WHERE kind = 'error' AND micro >= 150000000 AND micro < 250000000 AND w_start IS NOT NULL AND hi >= w_start AND lo <= w_end GROUP BY patient) u USING (patient)""")
def undetermined_findings(spark, d):
    """Errors below one value are negative, above another found, and between them undetermined: where such a one could have been the step's, no match isn't none."""
    m = Model(spark, d, True)
    finding = F.when(F.col("micro") >= 250_000_000, "found").when(F.col("micro") >= 150_000_000, "undetermined").otherwise("negative")
    findings = m.events.filter("kind = 'error'").select("patient", "kind", F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"), finding.alias("finding"))
    reach = rules.undetermined(FOUND, findings, m.closure, m.windows, ["a"])
    return rules.with_undetermined(plans.statuses(FOUND, m.events, m.closure, m.windows), reach).select("patient", "status", "complete", "steps")


REVIEW = [
    reasoning.Rule("urgent", reasoning.Is("x", "flagged"), (reasoning.Is("x", "urgent"),)),
    reasoning.Rule("followed", reasoning.Is("y", "flagged"), (reasoning.Is("x", "flagged"), reasoning.Has("x", "followed_by", "y"), reasoning.Is("y", "open"))),
    reasoning.Rule("large", reasoning.Is("x", "review"), (reasoning.Is("x", "flagged"), reasoning.Is("x", "large"))),
]


@query(f""", o AS (SELECT o_custkey AS patient, o_orderkey AS id, epoch_us(o_orderdate) + {ta.EPOCH} AS t, o_orderpriority, o_orderstatus, o_totalprice, lead(o_orderkey) OVER w AS next, lead(epoch_us(o_orderdate)) OVER w - epoch_us(o_orderdate) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
flagged AS (WITH RECURSIVE f AS (SELECT id FROM o WHERE o_orderpriority = '1-URGENT' UNION SELECT y.id FROM f JOIN o x ON x.id = f.id JOIN o y ON y.id = x.next AND x.gap <= {200 * DAY} WHERE y.o_orderstatus <> 'F') SELECT id FROM f),
review AS (SELECT * FROM o WHERE o_totalprice >= 200000 AND id IN (SELECT id FROM flagged))
SELECT DISTINCT r.patient FROM review r JOIN o u ON u.patient = r.patient AND u.o_orderpriority = '1-URGENT' AND u.t - r.t BETWEEN 1 AND {120 * DAY}""")
def rule_selection(spark, d):
    """Customers with an order that rules put under review, along chains of open orders, and an urgent one within 120 days after it."""
    from pyspark.sql import Window

    orders = read(spark, d, "orders").withColumn("t", ta.micros_of(F.col("o_orderdate").cast("timestamp_ntz")))
    classes = F.array_compact(F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "urgent"), F.when(F.col("o_orderstatus") != "F", "open"), F.when(F.col("o_totalprice") >= 200000, "large")))
    facts = orders.select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("entity"), F.explode(classes).alias("class"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    follows = orders.withColumns({"object": F.lead("o_orderkey").over(w), "gap": F.lead("t").over(w) - F.col("t")}).filter(F.col("gap") <= 200 * DAY)
    found = reasoning.derived(facts, follows.select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("subject"), F.lit("followed_by").alias("property"), "object"), REVIEW, ["patient"])
    at = orders.select(F.col("o_orderkey").alias("event_id"), F.col("t").alias("lo"), F.col("t").alias("hi"), F.col("t").alias("end_lo"), F.col("t").alias("end_hi"))
    rows = found.filter(F.col("class").isin("review", "urgent")).select("patient", F.col("entity").alias("event_id"), F.col("class").alias("kind"), F.lit(0).cast("long").alias("micro")).join(at, "event_id")
    kinds = spark.createDataFrame([(k, k) for k in ("review", "urgent")], "concept string, ancestor string")
    pattern = Pattern((Step("a", "review"), Step("b", "urgent")), (Relation("r", "after", "a", "b", 1, 120 * DAY),))
    return plans.exact_patients(pattern, rows, kinds, model.windows(rows))


NAMED = f"""named AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN lo // {HOUR} END AS v FROM ev), agreed AS (SELECT patient, v, max(lo) AS v_lo, min(hi) AS v_hi, count(*) AS n FROM named WHERE v IS NOT NULL GROUP BY ALL HAVING max(lo) <= min(hi)),
timed AS (SELECT n.patient, n.event_id, n.kind, CASE WHEN g.v IS NULL THEN -n.event_id ELSE g.v END AS name, coalesce(g.v_lo, n.lo) AS lo, coalesce(g.v_hi, n.hi) AS hi FROM named n LEFT JOIN agreed g ON g.patient = n.patient AND g.v = n.v),
sharing AS (SELECT DISTINCT patient FROM agreed WHERE n > 1)"""


@query(f""", {NAMED}, bound AS (SELECT w.patient, w_start, w_end, a.name AS an, a.lo AS al, a.hi AS ah, b.name AS bn, b.lo AS bl, b.hi AS bh, c.name AS cn, c.lo AS cl, c.hi AS ch FROM sharing JOIN uwin w USING (patient) JOIN timed a ON a.patient = w.patient AND a.kind = 'view' JOIN timed b ON b.patient = w.patient AND b.kind = 'click' JOIN timed c ON c.patient = w.patient AND c.kind = 'purchase'
  WHERE a.hi >= w_start AND a.lo <= w_end AND b.hi >= a.lo AND b.lo <= a.hi + {12 * HOUR} AND c.hi >= b.lo AND c.lo <= b.hi + {12 * HOUR}),
judged AS (SELECT patient, al >= w_start AND ah <= w_end AND bl >= w_start AND bh <= w_end AND cl >= w_start AND ch <= w_end AND (an = bn OR (bl - ah >= 0 AND bh - al <= {12 * HOUR})) AND (bn = cn OR (cl - bh >= 0 AND ch - bl <= {12 * HOUR})) AS sure,
  CASE WHEN an = cn THEN greatest(al, bl, cl, w_start) <= least(ah, bh, ch, w_end) ELSE greatest(al, w_start) <= least(ah, w_end) AND b_lo <= b_hi AND greatest(cl, w_start, b_lo) <= least(ch, w_end, CASE WHEN bn = cn THEN b_hi ELSE b_hi + {12 * HOUR} END) END AS may
  FROM (SELECT *, greatest(bl, w_start, greatest(al, w_start)) AS b_lo, least(bh, w_end, CASE WHEN an = bn THEN ah ELSE least(ah, w_end) + {12 * HOUR} END) AS b_hi FROM bound))
SELECT w.patient, CASE WHEN w_start IS NULL THEN 'excluded' WHEN bool_or(sure) THEN 'exact' WHEN bool_or(may) THEN 'possible' ELSE 'none' END AS status FROM sharing JOIN uwin w USING (patient) LEFT JOIN judged USING (patient) GROUP BY w.patient, w_start""")
def kernel_shared_vars(spark, d):
    """Statuses of patients whose events of one hour share a time variable, where their ranges agree on one."""
    m = Model(spark, d, True)
    rows = m.events.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.expr(f"string(lo div {HOUR})")))
    agreed = rows.filter("v IS NOT NULL").groupBy("patient", "v").agg(F.max("lo").alias("v_lo"), F.min("hi").alias("v_hi")).filter("v_lo <= v_hi").select("patient", "v", F.col("v").alias("start_var"))
    return shared.statuses(CHAIN, rows.join(agreed, ["patient", "v"], "left").withColumn("end_var", F.lit(None).cast("string")), m.closure, m.windows)


@query(f"""SELECT patient, CASE WHEN bool_and(sure) THEN 'exact' WHEN bool_or(may) THEN 'possible' ELSE 'none' END AS status FROM (SELECT f.patient, f.event_id, bool_or(coalesce(b.lo - f.n_hi >= 0 AND b.hi - f.lo <= {12 * HOUR}, false)) AS sure, bool_or(coalesce(b.hi - f.lo >= 0 AND b.lo - f.n_hi <= {12 * HOUR}, false)) AS may FROM (
SELECT * FROM (SELECT e.patient, e.event_id, e.lo, least(e.hi, min(o.hi)) AS n_hi FROM ev e LEFT JOIN ev o ON o.patient = e.patient AND o.kind = 'purchase' AND o.event_id <> e.event_id WHERE e.kind = 'purchase' GROUP BY e.patient, e.event_id, e.lo, e.hi) WHERE lo <= n_hi) f LEFT JOIN ev b ON b.patient = f.patient AND b.kind = 'click' GROUP BY ALL) GROUP BY patient""")
def target_split(spark, d):
    """First purchase, then a click within half a day: one scenario for each event that can be first, its start cut off where another must have begun."""
    m = Model(spark, d, True)
    return plans.split_by_first(m.events.filter("kind = 'purchase'"), m.events.filter("kind = 'click'"), 0, 12 * HOUR)


@query("""SELECT query, round(sum(relevant) FILTER (rank <= 10) / 10, 9) AS precision, round(sum(relevant) FILTER (rank <= 10) / sum(relevant), 9) AS recall, round(coalesce(1 / min(rank) FILTER (relevant = 1), 0), 9) AS reciprocal_rank, round(coalesce(sum(hits / rank) FILTER (relevant = 1) / sum(relevant), 0), 9) AS average_precision FROM (
SELECT *, sum(relevant) OVER (PARTITION BY query ORDER BY rank) AS hits FROM (SELECT q.user_id AS query, row_number() OVER (PARTITION BY q.user_id ORDER BY abs(e.value - q.v), e.event_id) AS rank, (e.event_type = 'purchase')::INTEGER AS relevant FROM (SELECT user_id, max(value) AS v FROM events GROUP BY 1) q JOIN events e ON e.user_id = q.user_id)) GROUP BY query""")
def retrieval_metrics(spark, d):
    from pyspark.sql import Window

    rows = read(spark, d, "events")
    probe = rows.groupBy("user_id").agg(F.max("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy(F.abs(F.col("value") - F.col("v")), "event_id")
    ranks = rows.join(probe, "user_id").select(F.col("user_id").alias("query"), F.row_number().over(w).alias("rank"), (F.col("event_type") == "purchase").cast("int").alias("relevant"))
    return similarity.retrieval(ranks, 10)


@query("SELECT DISTINCT patient, CASE kind WHEN 'error' THEN 'incident' ELSE kind END AS class FROM ev UNION SELECT DISTINCT patient, c FROM ev, LATERAL (SELECT unnest(CASE WHEN kind IN ('click', 'view') THEN ['interaction', 'activity'] WHEN kind IN ('purchase', 'signup') THEN ['conversion', 'activity'] ELSE ['error'] END) AS c)")
def rule_closure(spark, d):
    facts = model.events(spark, d).select(F.col("patient").alias("entity"), F.col("kind").alias("class"))
    table = spark.createDataFrame(list({**model.PARENTS}.items()), "if_class string, then_class string")
    return evidence.chained(facts, table).select(F.col("entity").alias("patient"), "class")


@query("""SELECT coalesce(a.o_orderkey, b.k) AS order_id, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'different' END AS problem FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 5 <> 0) b ON a.o_orderkey = b.k WHERE a.o_orderkey IS NULL OR b.k IS NULL OR a.o_totalprice IS DISTINCT FROM b.p""")
def fidelity_audit(spark, d):
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price"))
    copy = orders.filter("order_id % 5 <> 0").withColumn("price", F.when(F.col("order_id") % 11 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return evidence.audited(orders.filter("order_id % 7 <> 0"), copy, "order_id", ["price"])


@query("""SELECT patient, coalesce(f, 'none') AS finding, "at" FROM (SELECT DISTINCT patient FROM ev) LEFT JOIN (SELECT patient, arg_min(CASE WHEN kind = 'purchase' THEN 'found' ELSE 'undetermined' END, (t, event_id)) AS f, min(t) AS "at" FROM ev WHERE kind NOT IN ('view', 'click', 'signup') GROUP BY patient) USING (patient)""")
def first_report(spark, d):
    reports = model.events(spark, d).select("patient", F.col("lo").alias("at"), F.col("kind").alias("report"), F.col("event_id").alias("id"))
    return evidence.first_report(reports, ["view", "click", "signup"], ["purchase"])


@query("SELECT o_orderkey AS order_id, CASE WHEN o_totalprice > 0 THEN (o_totalprice::DECIMAL(18,2) * 1000000)::BIGINT END AS micro, CASE WHEN v LIKE '%.%' THEN rtrim(rtrim(v, '0'), '.') ELSE v END AS shortest FROM (SELECT *, (o_totalprice::DECIMAL(18,2))::VARCHAR AS v FROM orders)")
def exact_decimals(spark, d):
    text = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), scalars.micro_value(text).alias("micro"), scalars.shortest_decimal(text).alias("shortest"))


@query("SELECT patient, item, record_id, s, CASE WHEN nk = 'stop' THEN nt END AS e FROM (SELECT patient, item, event_id AS record_id, t AS s, k, lead(k) OVER w AS nk, lead(t) OVER w AS nt FROM (SELECT patient, (event_id % 3)::INTEGER AS item, event_id, t, CASE WHEN kind IN ('view', 'click') THEN 'start' ELSE 'stop' END AS k FROM ev) WINDOW w AS (PARTITION BY patient, item ORDER BY t, event_id)) WHERE k = 'start'")
def exposure_pairs(spark, d):
    rows = model.events(spark, d).select("patient", (F.col("event_id") % 3).cast("int").alias("item"), F.col("lo").alias("t"), F.when(F.col("kind").isin("view", "click"), "start").otherwise("stop").alias("kind"), F.col("event_id").alias("record_id"))
    return derived.exposures_paired(rows)


@query(f"SELECT status, count(*)::BIGINT AS n FROM ({STATUS_SQL}) GROUP BY status")
def status_counts(spark, d):
    """Counts and a fixed vocabulary only: nothing of a single patient leaves."""
    m = Model(spark, d)
    return plans.statuses(RELAXED, m.events, m.closure, m.windows).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS item, count(*)::BIGINT AS n, count(*) FILTER (l_returnflag = 'R')::BIGINT AS missing, count(DISTINCT l_linestatus)::BIGINT AS units, min(l_quantity) FILTER (l_returnflag <> 'R') AS least, max(l_quantity) FILTER (l_returnflag <> 'R') AS greatest FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def preflight(spark, d):
    from trailmark.sources import ingest

    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return ingest.preflight(rows.select(F.col("p_brand").alias("item"), F.col("l_linestatus").alias("unit"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("value")), "item", "unit", "value")


@query("""SELECT a.patient, count(*)::BIGINT AS pairs, count(*) FILTER (a.clock = b.clock OR a.patient % 3 = 0)::BIGINT AS comparable FROM (SELECT patient, event_id, 'c' || event_id % 2 AS clock FROM ev WHERE kind = 'signup') a JOIN (SELECT patient, event_id, 'c' || event_id % 2 AS clock FROM ev WHERE kind = 'purchase') b ON a.patient = b.patient GROUP BY a.patient""")
def clock_alignment(spark, d):
    rows = model.events(spark, d).withColumn("clock", F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")))
    side = lambda k: rows.filter(F.col("kind") == k).select("patient", "clock")
    names = F.array(*(F.struct(F.lit(a).alias("l_clock"), F.lit(b).alias("r_clock")) for a in ("c0", "c1") for b in ("c0", "c1")))
    declared = rows.select("patient").distinct().select("patient", F.inline(names)).filter("l_clock = r_clock OR patient % 3 = 0")
    return intervals.aligned_counts(side("signup"), side("purchase"), declared)


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderkey IS NULL THEN 'no_stay' WHEN p_partkey IS NULL THEN 'no_item' WHEN o_custkey % 5 = 0 THEN 'other_patient' END AS problem FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 17 <> 0) ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_partkey % 19 <> 0) ON l_partkey = p_partkey WHERE o_orderkey IS NULL OR p_partkey IS NULL OR o_custkey % 5 = 0")
def dimension_identity(spark, d):
    """Rows whose stay or item is not in its dimension, or whose stay is another patient's."""
    stays, items = read(spark, d, "orders").filter("o_orderkey % 17 <> 0"), read(spark, d, "part").filter("p_partkey % 19 <> 0")
    rows = read(spark, d, "lineitem").join(stays, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(items, F.col("l_partkey") == F.col("p_partkey"), "left")
    problem = F.when(F.col("o_orderkey").isNull(), "no_stay").when(F.col("p_partkey").isNull(), "no_item").when(F.col("o_custkey") % 5 == 0, "other_patient")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", problem.alias("problem")).filter("problem IS NOT NULL")


@query("SELECT patient, event_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY distance, event_id) AS r FROM (SELECT e.patient, e.event_id, abs(e.micro - (SELECT arg_min(micro, event_id) FROM ev)) AS distance FROM ev e WHERE kind = 'purchase')) WHERE r = 1")
def nearest_anchor(spark, d):
    """Each patient's anchor nearest to a reference value, ties by event id: one aggregation, no sort."""
    rows = model.events(spark, d)
    reference = rows.agg(F.min_by("micro", "event_id")).first()[0]
    near = rows.filter("kind = 'purchase'").select("patient", F.struct(F.abs(F.col("micro") - reference).alias("distance"), "event_id").alias("near"))
    return near.groupBy("patient").agg(F.min("near").alias("near")).select("patient", "near.event_id", "near.distance")


@query("SELECT c_custkey AS patient, CASE WHEN c_mktsegment = 'BUILDING' OR NOT coalesce(low < 50000, true) THEN 'excluded' WHEN low IS NULL THEN 'unresolved' ELSE 'eligible' END AS filter_state FROM customer LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS low FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def hard_filters(spark, d):
    low = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_totalprice").alias("low"))
    rows = read(spark, d, "customer").join(low, "c_custkey", "left")
    return similarity.eligible(rows, [F.col("c_mktsegment") != "BUILDING", F.col("low") < 50000]).select(F.col("c_custkey").alias("patient"), "filter_state")


@query("SELECT patient, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) END AS band, count(DISTINCT kind)::BIGINT AS n_bands FROM (SELECT *, rank() OVER (PARTITION BY patient ORDER BY t // 3600000000 DESC) AS r FROM ev) WHERE r = 1 GROUP BY patient")
def latest_band(spark, d):
    """The band declared in a patient's latest hour; more than one leaves it unresolved."""
    rows = model.events(spark, d).withColumn("hour", F.expr("lo div 3600000000"))
    by_hour = rows.groupBy("patient", "hour").agg(F.min("kind").alias("band"), F.count_distinct("kind").alias("n_bands"))
    last = by_hour.groupBy("patient").agg(F.max_by(F.struct("band", "n_bands"), "hour").alias("x"))
    return last.select("patient", F.when(F.col("x.n_bands") == 1, F.col("x.band")).alias("band"), "x.n_bands")


@query("SELECT kind, quantile_disc(micro, 0.5) AS p50, quantile_disc(micro, 0.95) AS p95, max(micro) AS most FROM ev GROUP BY kind")
def latency_summary(spark, d):
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY micro)").cast("long")
    return model.events(spark, d).groupBy("kind").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("micro").alias("most"))


@query(f"SELECT patient, coalesce(bool_or(n > 1), false) AS shared FROM (SELECT DISTINCT patient FROM ev) LEFT JOIN (SELECT patient, t // {DAY} AS v, count(*) AS n FROM ev WHERE kind = 'signup' GROUP BY 1, 2) USING (patient) GROUP BY patient")
def shared_variable_flag(spark, d):
    rows = model.events(spark, d)
    named = rows.withColumn("start_var", F.when(F.col("kind") == "signup", F.expr(f"string(lo div {DAY})"))).withColumn("end_var", F.lit(None).cast("string"))
    return store.shares_variables(named)


@query("SELECT a.kind AS a, b.kind AS b, count(*)::BIGINT AS n FROM (SELECT DISTINCT kind, patient FROM ev) a JOIN (SELECT DISTINCT kind, patient FROM ev) b ON a.patient = b.patient AND a.kind < b.kind GROUP BY 1, 2")
def stratum_overlap(spark, d):
    sets = model.events(spark, d).groupBy("patient").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # at most as many as kinds
    pairs = F.flatten(F.transform("kinds", lambda a: F.transform(F.filter("kinds", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS claim, string_agg(DISTINCT (l_suppkey % 4)::VARCHAR, ',' ORDER BY (l_suppkey % 4)::VARCHAR) AS batches, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def unique_claims(spark, d):
    """Each claim once, with the batches that have it."""
    batch = (F.col("l_suppkey") % 4).cast("string")
    return read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("claim")).agg(F.array_join(F.array_sort(F.collect_set(batch)), ",").alias("batches"), F.count("*").alias("n"))


@query(f"""SELECT patient, CASE WHEN p1 IN ('exact', 'excluded') THEN p1 WHEN p1 = 'none' AND p2 = 'none' THEN 'none' ELSE 'unresolved' END AS status FROM (SELECT w.patient, CASE WHEN w_start IS NULL THEN 'excluded' WHEN bool_or(certain AND lo >= w_start AND hi <= w_end) THEN 'exact' ELSE 'none' END AS p1, CASE WHEN w_start IS NULL THEN 'excluded' WHEN bool_or(lo >= w_start AND hi <= w_end) THEN 'exact' ELSE 'none' END AS p2
FROM uwin w LEFT JOIN (SELECT e.patient, e.lo, e.hi, c.certain FROM ev e JOIN (SELECT patient, event_id, min(forced) >= 2 AS certain, max(allowed) >= 2 AS possible FROM (
SELECT p.patient, p.event_id, p.tau, count(*) FILTER (o.lo >= tau - {UNCERTAIN_SPAN} AND o.hi <= tau) AS forced, count(*) FILTER (o.hi >= tau - {UNCERTAIN_SPAN} AND o.lo <= tau) AS allowed
FROM (SELECT e.patient, e.event_id, unnest(list_distinct(list_value(e.lo, e.hi) || list_filter(flatten(list(list_value(o.lo, o.lo - 1, o.lo + {UNCERTAIN_SPAN}, o.lo + {UNCERTAIN_SPAN} + 1, o.hi, o.hi - 1, o.hi + 1, o.hi + {UNCERTAIN_SPAN}, o.hi + {UNCERTAIN_SPAN} + 1))), lambda x: x BETWEEN e.lo AND e.hi))) AS tau
  FROM ev e LEFT JOIN ev o ON o.patient = e.patient AND o.kind = 'error' AND o.event_id <> e.event_id WHERE e.kind = 'error' GROUP BY e.patient, e.event_id, e.lo, e.hi) p
LEFT JOIN ev o ON o.patient = p.patient AND o.kind = 'error' AND o.event_id <> p.event_id GROUP BY ALL) GROUP BY patient, event_id) c ON c.patient = e.patient AND c.event_id = e.event_id WHERE c.possible) x ON x.patient = w.patient GROUP BY w.patient, w_start, w_end)""")
def two_pass_count(spark, d):
    """A step that needs three errors within a day, uncertain: matched with the certain ones alone, then with the possible ones too."""
    m = Model(spark, d, True)
    tags = derived.counted_uncertain(m.events.filter("kind = 'error'"), 3, UNCERTAIN_SPAN).filter("possible")
    tagged = m.events.join(tags, ["patient", "event_id"])
    step = Pattern((Step("a", "error"),), scope="within")

    def statuses(rows):
        exact = plans.exact_patients(step, rows, m.closure, m.windows).withColumn("_x", F.lit(True))
        return m.windows.join(exact, "patient", "left").select("patient", F.when(F.col("w_start").isNull(), "excluded").when(F.col("_x"), "exact").otherwise("none").alias("status"), F.lit(None).cast("string").alias("relaxations"))

    return rules.two_passes(statuses(tagged.filter("certain")), statuses(tagged))


@query(f"SELECT DISTINCT a.patient FROM ev a JOIN ev b ON a.patient = b.patient AND b.t - a.t >= {10 * DAY} WHERE a.kind = 'signup' AND b.kind = 'error'")
def unbounded_after(spark, d):
    """A relation without an upper bound: extremes of each side decide, no pairs are made."""
    m = Model(spark, d)
    first = model.of_concept(m.events, m.closure, "signup").groupBy("patient").agg(F.min("hi").alias("a"))
    last = model.of_concept(m.events, m.closure, "error").groupBy("patient").agg(F.max("lo").alias("b"))
    return first.join(last, "patient").filter(F.col("b") - F.col("a") >= 10 * DAY).select("patient")


EXEMPLAR = (48 * HOUR, 100_000_000, 6 * HOUR, 12 * HOUR)  #: baseline's reach, least rise, limit of the gap, extension


@query(f"""SELECT patient, CASE WHEN min(cost) = 0 THEN 'exact' ELSE 'relaxed' END AS status, min(cost)::DECIMAL(18,6) AS cost FROM (
SELECT f.patient, CASE WHEN x.kind = 'signup' THEN 0 ELSE 1 END + (greatest(0, f.t - x.t - {6 * HOUR})::DECIMAL(28,6) / {12 * HOUR} * 2)::DECIMAL(18,6) AS cost FROM (SELECT c.patient, c.t, c.micro, arg_min(v.micro, (v.micro, v.t, v.event_id)) AS base FROM ev c JOIN ev v ON v.patient = c.patient AND v.kind = 'view' AND v.t < c.t AND v.t >= c.t - {48 * HOUR} WHERE c.kind = 'click' GROUP BY c.patient, c.t, c.micro, c.event_id) f
JOIN ev x ON x.patient = f.patient AND x.kind IN ('signup', 'error') AND x.t < f.t AND f.t - x.t <= {18 * HOUR} WHERE f.micro - base >= 100000000) GROUP BY patient""")
def exemplar_priced(spark, d):
    """A rise of a reading over its least baseline, after an exposure: the exposure's alternative costs one, a late one up to two."""
    reach, rise, limit, extension = EXEMPLAR
    rows = model.events(spark, d)
    base = rows.filter("kind = 'view'").select("patient", F.col("event_id").alias("v_id"), F.col("lo").alias("v_t"), F.col("micro").alias("v_micro"))
    click = rows.filter("kind = 'click'").select("patient", F.col("event_id").alias("c_id"), F.col("lo").alias("c_t"), F.col("micro").alias("c_micro"))
    met = join_ranges(click, base, ["patient"], (F.col("c_t") - reach, F.col("c_t") - 1), (F.col("v_t"), F.col("v_t")), reach)
    follow = met.groupBy("patient", "c_id", "c_t", "c_micro").agg(F.min(F.struct("v_micro", "v_t", "v_id")).alias("base")).filter(F.col("c_micro") - F.col("base.v_micro") >= rise)
    exposure = rows.filter("kind IN ('signup', 'error')").select("patient", F.col("lo").alias("x_t"), "kind")
    bound = join_ranges(follow, exposure, ["patient"], (F.col("c_t") - limit - extension, F.col("c_t") - 1), (F.col("x_t"), F.col("x_t")), limit + extension)
    over = (F.greatest(F.col("c_t") - F.col("x_t") - limit, F.lit(0)).cast("decimal(28,6)") / F.lit(extension).cast("decimal(18,0)") * 2).cast("decimal(18,6)")
    cost = F.when(F.col("kind") == "signup", 0).otherwise(1) + over
    return bound.groupBy("patient").agg(F.min(cost).cast("decimal(18,6)").alias("cost")).select("patient", F.when(F.col("cost") == 0, "exact").otherwise("relaxed").alias("status"), "cost")


@query("SELECT kind, count(*)::BIGINT AS n FROM ev WHERE kind NOT IN ('view') AND NOT (kind = 'error' AND micro < 100000000) GROUP BY kind")
def coded_only(spark, d):
    """Events without the kinds that a request excludes, before any step is bound."""
    return model.events(spark, d).filter(~F.col("kind").isin("view") & ~((F.col("kind") == "error") & (F.col("micro") < 100_000_000))).groupBy("kind").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from trailmark import record_queries  # noqa: E402, F401  registers further queries
