"""Registered queries of the engine over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import scalar as S
from eventide.operators import motifs as M
from eventide.operators import relational as R
from eventide.operators import response as P
from eventide.operators import signals as G
from eventide.operators import states as T
from eventide.sources import canonical as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LIMITS = [f"{int(x * 2**64):016x}" for x in (0.5, 0.8)]
EV = f"""WITH ev AS (SELECT user_id AS e, CAST(epoch_us(ts) // {C.HOUR} AS BIGINT) AS t, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END AS p, event_id AS id, value FROM events),
src AS (SELECT e, t, p, id FROM ev WHERE p IS NOT NULL),
tg AS (SELECT e, t, count(*) AS mult FROM ev WHERE p IS NULL GROUP BY ALL),
ent AS (SELECT e, min(t) AS s, max(t) AS z, CAST(e % 2 AS INTEGER) AS stratum, CASE WHEN substr(sha256('11:' || e), 1, 16) < '{_LIMITS[0]}' THEN 0 WHEN substr(sha256('11:' || e), 1, 16) < '{_LIMITS[1]}' THEN 1 ELSE 2 END AS part FROM ev GROUP BY e)"""
#: Pair completions (0, 1): best witnesses by brute force.
PAIR = EV + """, ticks AS (SELECT DISTINCT e, t FROM src WHERE p IN (0, 1)),
pair AS (SELECT e, t, span FROM (SELECT k.e, k.t, abs(a.t - b.t) AS span, row_number() OVER (PARTITION BY k.e, k.t ORDER BY a.t + b.t DESC, abs(a.t - b.t)) AS r
 FROM ticks k JOIN src a ON a.e = k.e AND a.p = 0 AND a.t <= k.t JOIN src b ON b.e = k.e AND b.p = 1 AND b.t <= k.t AND a.id <> b.id) WHERE r = 1),
fut AS (SELECT pair.e, pair.t, span, unnest(generate_series(t + 1, least(t + 6, z))) AS row FROM pair JOIN ent USING (e) WHERE t < z)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _all(spark, d):
    return C.events(spark, d), C.targets(spark, d), C.entities(spark, d)


def _pair(spark, d):
    return M.unordered(C.events(spark, d), (0, 1))


# --- tables, splits, validation ------------------------------------------------------------------------------

@query(EV + " SELECT e, t, p, id FROM src")
def canonical_events(spark, d):
    return C.events(spark, d)


@query(EV + " SELECT * FROM tg")
def canonical_targets(spark, d):
    return C.targets(spark, d)


@query(EV + " SELECT e, s AS start, z AS \"end\", stratum, part, z - s + 1 AS n_rows FROM ent")
def entity_bounds(spark, d):
    return C.entities(spark, d).withColumn("n_rows", F.col("end") - F.col("start") + 1)


@query(EV + " SELECT part, count(*) AS n, min(e) AS least, max(e) AS most FROM ent GROUP BY part")
def hash_partition(spark, d):
    return C.entities(spark, d).groupBy("part").agg(F.count("*").alias("n"), F.min("e").alias("least"), F.max("e").alias("most"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), m AS (SELECT day, date_trunc('month', day) AS mo, count(*) OVER (PARTITION BY date_trunc('month', day)) AS n,
 row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY sha256('7:' || strftime(day, '%Y-%m-%d'))) AS i FROM d),
b AS (SELECT *, CAST(floor(round(n * 0.5, 9)) AS INTEGER) AS b0, CAST(floor(round(n * 0.3, 9)) AS INTEGER) AS b1, CAST(floor(round(n * 0.2, 9)) AS INTEGER) AS b2 FROM m),
f AS (SELECT *, n - b0 - b1 - b2 AS rest, round(round(n * 0.5, 9) - b0, 9) AS f0, round(round(n * 0.3, 9) - b1, 9) AS f1, round(round(n * 0.2, 9) - b2, 9) AS f2 FROM b),
s AS (SELECT *, b0 + CASE WHEN (CASE WHEN f1 > f0 THEN 1 ELSE 0 END + CASE WHEN f2 > f0 THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END AS s0,
 b1 + CASE WHEN (CASE WHEN f0 >= f1 THEN 1 ELSE 0 END + CASE WHEN f2 > f1 THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END AS s1 FROM f)
SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN i <= s0 THEN 0 WHEN i <= s0 + s1 THEN 1 ELSE 2 END AS part FROM s""")
def month_stratified_split(spark, d):
    days = C.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return R.month_partition(days, 7, (0.5, 0.3, 0.2)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "part")


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), r AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM d),
c AS (SELECT *, greatest(1, least(n - 2, round(n * 0.5))) AS a FROM r), c2 AS (SELECT *, greatest(a + 1, least(n - 1, round(n * 0.8))) AS b FROM c)
SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN i <= a THEN 0 WHEN i <= b THEN 1 ELSE 2 END AS part FROM c2""")
def ordered_split(spark, d):
    days = C.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return R.ordered_partition(days, ["day"], (0.5, 0.3, 0.2)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "part")


@query(EV + """ SELECT rule, CAST(n AS BIGINT) AS n FROM (
 SELECT 'entity_bounds' AS rule, count(*) FILTER (s > z) AS n FROM ent UNION ALL SELECT 'partition_code', count(*) FILTER (part NOT IN (0, 1, 2)) FROM ent UNION ALL SELECT 'entity_unique', count(*) - count(DISTINCT e) FROM ent
 UNION ALL SELECT 'event_entity', count(*) FILTER (s IS NULL) FROM src LEFT JOIN ent USING (e) UNION ALL SELECT 'event_bounds', count(*) FILTER (t < s OR t > z) FROM src LEFT JOIN ent USING (e)
 UNION ALL SELECT 'event_unique', count(*) - count(DISTINCT (e, t, p, id)) FROM src UNION ALL SELECT 'primitive_one_tick', count(*) FILTER (m > 1) FROM (SELECT count(DISTINCT t) AS m FROM src GROUP BY e, id)
 UNION ALL SELECT 'target_bounds', count(*) FILTER (s IS NULL OR t < s OR t > z) FROM tg LEFT JOIN ent USING (e) UNION ALL SELECT 'target_multiplicity', count(*) FILTER (mult < 1) FROM tg)""")
def invariant_violations(spark, d):
    e, t, n = _all(spark, d)
    return R.violations(n, e, t)


@query(EV + """, c AS (SELECT DISTINCT e FROM tg), rest AS (SELECT e, row_number() OVER (ORDER BY sha256('3:' || e)) AS i, count(*) OVER () AS n FROM ent WHERE e NOT IN (SELECT e FROM c))
 SELECT e, 1.0::DOUBLE AS weight FROM ent WHERE e IN (SELECT e FROM c) UNION ALL SELECT e, greatest(1.0, n / 5.0)::DOUBLE FROM rest WHERE i <= 5""")
def case_cohort_sample(spark, d):
    _, t, n = _all(spark, d)
    return R.case_cohort(n, t, 5, 3)


@query("""WITH a AS (SELECT 's' AS source, s_suppkey AS e, s_nationkey % 3 AS part FROM supplier UNION ALL SELECT 'c', c_custkey, c_nationkey % 3 FROM customer)
SELECT source, e, part, row_number() OVER (ORDER BY part, source, e) - 1 AS code FROM a""")
def merge_with_remap(spark, d):
    s = C.table(spark, d, "supplier").select(F.lit("s").alias("source"), F.col("s_suppkey").alias("e"), (F.col("s_nationkey") % 3).alias("part"))
    c = C.table(spark, d, "customer").select(F.lit("c").alias("source"), F.col("c_custkey").alias("e"), (F.col("c_nationkey") % 3).alias("part"))
    return R.merge_datasets([s, c], ["part", "source", "e"])


# --- history, landmarks ------------------------------------------------------------------------------------------

@query(EV + " SELECT e, t, p, id, count(*) OVER (PARTITION BY e, p ORDER BY t RANGE BETWEEN 48 PRECEDING AND 1 PRECEDING) AS n FROM src")
def history_mark_counts(spark, d):
    return M.history_counts(C.events(spark, d), 48)


@query(EV + " SELECT e, t, p, id FROM (SELECT *, count(*) OVER (PARTITION BY e, p ORDER BY t RANGE BETWEEN 48 PRECEDING AND 1 PRECEDING) AS n FROM src) WHERE n >= 2")
def history_marked_source(spark, d):
    return M.history_marked(C.events(spark, d), 48, 2)


@query(EV + " SELECT DISTINCT p, n FROM (SELECT *, count(*) OVER (PARTITION BY e, p ORDER BY t RANGE BETWEEN 48 PRECEDING AND 1 PRECEDING) AS n FROM src) WHERE n > 0")
def history_count_levels(spark, d):
    return M.history_counts(C.events(spark, d), 48).where("n > 0").select("p", "n").distinct()


@query(EV + """, h AS (SELECT p, n, row_number() OVER (PARTITION BY p ORDER BY n) AS i, count(*) OVER (PARTITION BY p) AS m FROM (SELECT *, count(*) OVER (PARTITION BY e, p ORDER BY t RANGE BETWEEN 48 PRECEDING AND 1 PRECEDING) AS n FROM src) WHERE n > 0)
 SELECT p, q, n AS value FROM h, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) v(q) WHERE i = greatest(1, ceil(round(q * m, 9)))""")
def history_count_quantiles(spark, d):
    return M.inverse_cdf(M.history_counts(C.events(spark, d), 48).where("n > 0"), ["p"], "n", (0.25, 0.5, 0.9))


_POINTS = ", pts AS (SELECT e, unnest(generate_series(s, z - 1, 12)) AS t FROM ent WHERE s < z)"


@query(EV + _POINTS + " SELECT e, t, " + ", ".join(f"(SELECT count(*) FROM src WHERE src.e = pts.e AND src.t BETWEEN pts.t - 48 AND pts.t AND p = {k}) AS f{k}" for k in range(4)) + " FROM pts")
def landmark_features(spark, d):
    e, _, n = _all(spark, d)
    return P.landmark_counts(P.landmarks(n, 12), e, range(4), 48)


@query(EV + _POINTS + " SELECT e, t, CASE WHEN EXISTS (SELECT 1 FROM tg WHERE tg.e = pts.e AND tg.t > pts.t AND tg.t <= pts.t + 24) THEN 1 ELSE 0 END AS y FROM pts")
def landmark_labels(spark, d):
    _, t, n = _all(spark, d)
    return P.forward_labels(P.landmarks(n, 12), t, 24)


@query(EV + _POINTS + ", r AS (SELECT e, unnest(generate_series(s, z, 5)) AS row FROM ent) SELECT e, t, (SELECT min(row) FROM r WHERE r.e = pts.e AND row > pts.t) AS row FROM pts")
def landmark_next_rows(spark, d):
    n = C.entities(spark, d)
    return R.next_row(P.landmarks(n, 12), n.select("e", F.explode(F.sequence("start", "end", F.lit(5))).alias("row")))


@query(EV + """, b AS (SELECT e, t, p AS kind, id FROM src UNION ALL SELECT e, t, -1, 0 FROM tg)
 SELECT e, t, kind, id, coalesce(count(*) FILTER (kind = -1) OVER (PARTITION BY e ORDER BY t, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM b""")
def merged_event_sequence(spark, d):
    e, t, _ = _all(spark, d)
    return R.merged_sequence(e, t)


@query(EV + """, r AS (SELECT e, t, id, row_number() OVER (PARTITION BY e ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY e) AS n FROM src),
 g AS (SELECT e, t, id, i, g.s AS segment FROM r JOIN (SELECT unnest(generate_series(0, 500)) AS s) g ON g.s <= greatest(0, ceil((n - 20) / 16.0)) AND i >= g.s * 16 AND i < g.s * 16 + 20)
 SELECT e, t, id, CAST(segment AS INTEGER) AS segment, t - min(t) OVER (PARTITION BY e, segment) AS "offset" FROM g""")
def sequence_segments(spark, d):
    return R.segment_sequence(C.events(spark, d).select("e", "t", "id"), 20, 4)


# --- motifs ------------------------------------------------------------------------------------------------------

@query(EV + " SELECT DISTINCT e, t, CAST(0 AS BIGINT) AS span FROM src WHERE p = 2")
def atomic_completions(spark, d):
    return M.unordered(C.events(spark, d), (2,))


@query(PAIR + " SELECT * FROM pair")
def pair_unordered(spark, d):
    return _pair(spark, d)


@query(EV + """, ticks AS (SELECT DISTINCT e, t FROM src WHERE p IN (0, 1, 2))
 SELECT e, t, span FROM (SELECT k.e, k.t, greatest(a.t, b.t, c.t) - least(a.t, b.t, c.t) AS span, row_number() OVER (PARTITION BY k.e, k.t ORDER BY a.t + b.t + c.t DESC, greatest(a.t, b.t, c.t) - least(a.t, b.t, c.t)) AS r FROM ticks k
 JOIN src a ON a.e = k.e AND a.p = 0 AND a.t <= k.t AND a.t >= k.t - 1000 JOIN src b ON b.e = k.e AND b.p = 1 AND b.t <= k.t AND a.id <> b.id JOIN src c ON c.e = k.e AND c.p = 2 AND c.t <= k.t AND c.id <> a.id AND c.id <> b.id) WHERE r = 1""")
def triplet_unordered(spark, d):
    return M.unordered(C.events(spark, d), (0, 1, 2))


@query(EV + " SELECT b.e, b.t, b.t - max(a.t) AS span FROM (SELECT DISTINCT e, t FROM src WHERE p = 1) b JOIN src a ON a.e = b.e AND a.p = 0 AND a.t < b.t GROUP BY b.e, b.t")
def pair_ordered(spark, d):
    return M.ordered(C.events(spark, d), (0, 1))


@query(EV + """, mid AS (SELECT b.e, b.t, max(a.t) AS o FROM (SELECT DISTINCT e, t FROM src WHERE p = 1) b JOIN src a ON a.e = b.e AND a.p = 0 AND a.t < b.t GROUP BY b.e, b.t)
 SELECT c.e, c.t, c.t - arg_max(mid.o, mid.t) AS span FROM (SELECT DISTINCT e, t FROM src WHERE p = 3) c JOIN mid ON mid.e = c.e AND mid.t < c.t GROUP BY c.e, c.t""")
def triplet_ordered(spark, d):
    return M.ordered(C.events(spark, d), (0, 1, 3))


@query(EV + " SELECT a.p AS pa, b.p AS pb, count(*) AS n, min(abs(a.t - b.t)) AS least_span FROM src a JOIN src b ON a.e = b.e AND a.p < b.p AND abs(a.t - b.t) <= 24 AND a.id <> b.id GROUP BY a.p, b.p")
def motif_frontier(spark, d):
    return M.frontier(C.events(spark, d), 24)


@query(PAIR + """, w AS (SELECT unnest([0, 1, 2, 6, 12, 24, 48])::BIGINT AS w), c AS (SELECT w, count(*) FILTER (span <= w) AS n FROM w, pair JOIN ent USING (e) WHERE t < z GROUP BY w)
 SELECT w, n FROM (SELECT *, lag(n, 1, 0) OVER (ORDER BY w) AS b FROM c) WHERE n > b""")
def effective_windows(spark, d):
    return M.effective_windows(_pair(spark, d), C.entities(spark, d), (0, 1, 2, 6, 12, 24, 48))


@query(PAIR + """, s AS (SELECT span, row_number() OVER (ORDER BY span) AS i, count(*) OVER () AS n FROM pair JOIN ent USING (e) WHERE t < z AND span > 0 AND span <= 72)
 SELECT q, span AS value FROM s, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) v(q) WHERE i = greatest(1, ceil(round(q * n, 9)))""")
def quantile_windows(spark, d):
    spans = M.productive(_pair(spark, d), C.entities(spark, d)).where("span > 0 and span <= 72")
    return M.inverse_cdf(spans, [], "span", (0.25, 0.5, 0.75, 0.9))


@query(PAIR + " SELECT e, t, span, CAST(CASE WHEN span <= 6 THEN 6 WHEN span <= 24 THEN 24 ELSE 72 END AS BIGINT) AS w FROM pair WHERE span <= 72")
def window_bands(spark, d):
    return M.window_band(_pair(spark, d), (6, 24, 72))


@query(PAIR + " SELECT e, min(span) AS span FROM pair GROUP BY e HAVING min(span) <= 2")
def candidate_entities(spark, d):
    return R.candidate_entities(_pair(spark, d), 2)


# --- states -------------------------------------------------------------------------------------------------------

_STATE = """, o AS (SELECT e, t, id, z, lag(t) OVER w AS pv, lag(t, 2) OVER w AS pv2, lead(t) OVER w AS nx FROM src JOIN ent USING (e) WHERE p = 0 WINDOW w AS (PARTITION BY e ORDER BY t, id)),
 c AS ({cand}), m AS (SELECT *, max(b) OVER (PARTITION BY e ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE a < b),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY e ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS g FROM m),
 st AS (SELECT e, min(a) AS start, max(b) AS "end", arg_min(id, (a, b, id)) AS id FROM i GROUP BY e, g)"""
_CAND = {
    "recent": "SELECT e, t AS a, least(z, t + 24) AS b, id FROM o",
    "recurrent": "SELECT e, t AS a, least(z, pv + 24) AS b, id FROM o WHERE t - pv <= 24",
    "accelerating": "SELECT e, t AS a, least(z, t + 24, coalesce(nx, z)) AS b, id FROM o WHERE t - pv < pv - pv2",
    "decelerating": "SELECT e, t AS a, least(z, t + 24, coalesce(nx, z)) AS b, id FROM o WHERE t - pv > pv - pv2",
}


def _state(kind: str):
    def run(spark, d):
        e, _, n = _all(spark, d)
        return T.history_states(e.where("p = 0"), n, kind, 24)

    run.__name__ = f"state_{kind}"
    return run


for _kind, _sql in _CAND.items():
    query(EV + _STATE.format(cand=_sql) + " SELECT * FROM st")(_state(_kind))

_TRANS = """, sg AS (SELECT e, t, id, 0 AS k FROM src WHERE p = 2 UNION ALL SELECT e, t, NULL, 1 FROM src WHERE p = 1),
 ch AS (SELECT * FROM (SELECT *, coalesce(lag(k) OVER (PARTITION BY e ORDER BY t, k, id NULLS FIRST), 1) AS was FROM sg) WHERE k <> was),
 tr AS (SELECT e, t AS start, coalesce(lead(t) OVER (PARTITION BY e ORDER BY t, k), z) AS "end", id, k FROM ch JOIN ent USING (e))"""


@query(EV + _TRANS + " SELECT e, start, \"end\", id FROM tr WHERE k = 0 AND start < \"end\"")
def state_transition(spark, d):
    e, _, n = _all(spark, d)
    return T.transition_states(e.where("p = 2"), e.where("p = 1"), n)


@query(EV + _STATE.format(cand=_CAND["recent"]) + _POINTS + " SELECT e, t, EXISTS (SELECT 1 FROM st WHERE st.e = pts.e AND st.start < pts.t AND pts.t <= st.\"end\") AS active FROM pts")
def state_active_at(spark, d):
    e, _, n = _all(spark, d)
    return T.active_at(T.history_states(e.where("p = 0"), n, "recent", 24), P.landmarks(n, 12))


@query(EV + _STATE.format(cand=_CAND["recent"]) + """, oc AS (SELECT b.e, b.t, b.t - max(a.t) AS span FROM (SELECT DISTINCT e, t FROM src WHERE p = 3) b JOIN src a ON a.e = b.e AND a.p = 1 AND a.t < b.t GROUP BY b.e, b.t)
 SELECT * FROM oc WHERE EXISTS (SELECT 1 FROM st WHERE st.e = oc.e AND st.start < oc.t AND oc.t <= st.\"end\")""")
def state_filtered_motif(spark, d):
    e, _, n = _all(spark, d)
    return T.state_filter(M.ordered(e, (1, 3)), T.history_states(e.where("p = 0"), n, "recent", 24))


@query(EV + """, g AS (SELECT p, t - lag(t) OVER (PARTITION BY e, p ORDER BY t, id) AS gap FROM src), r AS (SELECT p, gap, row_number() OVER (PARTITION BY p ORDER BY gap) AS i, count(*) OVER (PARTITION BY p) AS n FROM g WHERE gap > 0)
 SELECT p, greatest(1, gap) AS horizon FROM r WHERE i = ceil(round(0.9 * (n - 1), 9)) + 1""")
def gap_horizons(spark, d):
    return T.gap_horizon(C.events(spark, d))


@query(EV + ", s AS (SELECT e, t, id FROM src WHERE p = 0) SELECT e, t AS start, max(id) AS last_id, count(*) AS n FROM s GROUP BY e, t")
def state_entry_source(spark, d):
    return C.events(spark, d).where("p = 0").groupBy("e", F.col("t").alias("start")).agg(F.max("id").alias("last_id"), F.count("*").alias("n"))


# --- responses ---------------------------------------------------------------------------------------------------

_BASIS = P.triangular_basis(6, 3)


def _basis_sql(k: int) -> str:
    return "CASE row - t " + " ".join(f"WHEN {i + 1} THEN {v!r}::DOUBLE" for i, v in enumerate(_BASIS[k])) + " END"


@query(PAIR + " SELECT e, row, " + ", ".join(f"round(sum({_basis_sql(k)}), 6) AS v{k + 1}" for k in range(3)) + " FROM fut WHERE span <= 12 GROUP BY e, row")
def kernel_response(spark, d):
    r = P.kernel_response(_pair(spark, d), C.entities(spark, d), 12, 6, 3)
    return r.select("e", "row", *[F.round(f"v{k}", 6).alias(f"v{k}") for k in (1, 2, 3)])


@query(PAIR + " SELECT DISTINCT e, row FROM fut")
def footprint_rows(spark, d):
    return P.footprint(_pair(spark, d), C.entities(spark, d), 6)


@query(PAIR + " SELECT e, row, min(span) AS span FROM fut GROUP BY e, row")
def min_span_rows(spark, d):
    return P.least_span(_pair(spark, d), C.entities(spark, d), 6)


@query(PAIR + """, x AS (SELECT DISTINCT e, row FROM fut), i AS (SELECT e, row, row - row_number() OVER (PARTITION BY e ORDER BY row) AS g FROM x)
 SELECT e, min(row) AS begin, max(row) + 1 AS stop FROM i GROUP BY e, g""")
def footprint_union(spark, d):
    return P.footprint_union(_pair(spark, d), C.entities(spark, d), 6)


@query(PAIR + """, b AS (SELECT pair.e, least(t + 1 + o, z + 1) AS a FROM pair JOIN ent USING (e), (VALUES (0), (2), (6)) v(o) WHERE t < z), sb AS (SELECT DISTINCT e, a FROM b),
 sg AS (SELECT e, a AS begin, lead(a) OVER (PARTITION BY e ORDER BY a) AS stop FROM sb),
 n AS (SELECT sg.e, begin, stop, count(*) FILTER (begin >= t + 1 AND begin < least(t + 3, z + 1)) AS n0, count(*) FILTER (begin >= least(t + 3, z + 1) AND begin < least(t + 7, z + 1)) AS n1 FROM sg JOIN pair USING (e) JOIN ent USING (e) WHERE stop IS NOT NULL AND t < z GROUP BY ALL)
 SELECT e, begin, stop, n0, n1 FROM n WHERE n0 > 0 OR n1 > 0""")
def continuous_response(spark, d):
    return P.continuous_response(_pair(spark, d), C.entities(spark, d), (0, 2, 6))


@query(PAIR + """, up AS (SELECT DISTINCT c.e, unnest(generate_series(c.t + 1, least(c.t + 6, z))) AS row FROM (SELECT b.e, b.t FROM (SELECT DISTINCT e, t FROM src WHERE p = 1) b WHERE EXISTS (SELECT 1 FROM src a WHERE a.e = b.e AND a.p = 0 AND a.t < b.t)) c JOIN ent USING (e) WHERE c.t < z)
 SELECT DISTINCT e, row FROM fut WHERE (e, row) NOT IN (SELECT e, row FROM up)""")
def masked_lower_order(spark, d):
    n = C.entities(spark, d)
    return P.mask_lower_order(P.footprint(_pair(spark, d), n, 6), P.footprint(M.ordered(C.events(spark, d), (0, 1)), n, 6))


@query(PAIR + " SELECT w, e, row, count(*) AS n FROM (SELECT *, CASE WHEN span <= 6 THEN 6 WHEN span <= 24 THEN 24 END::BIGINT AS w FROM fut) WHERE w IS NOT NULL GROUP BY ALL")
def window_band_response(spark, d):
    n = C.entities(spark, d)
    return P._future(M.window_band(_pair(spark, d), (6, 24)), n, 6).groupBy("w", "e", "row").agg(F.count("*").alias("n"))


_RISK = ", risk AS (SELECT e, stratum, unnest(generate_series(s, z)) AS row FROM ent), rk AS (SELECT risk.e, stratum, row, CAST((row // 168) % 3 AS INTEGER) AS cell, coalesce(mult, 0) AS n FROM risk LEFT JOIN tg ON tg.e = risk.e AND tg.t = risk.row)"


@query(EV + _RISK + " SELECT stratum, cell, count(*) AS exposure FROM rk GROUP BY ALL")
def risk_cells(spark, d):
    return P.cell_totals(C.entities(spark, d), 3)


@query(EV + _RISK + " SELECT stratum, cell, count(*) AS exposure, CAST(sum(n) AS BIGINT) AS events FROM rk GROUP BY ALL")
def risk_rows_by_cell(spark, d):
    n = C.entities(spark, d)
    return P.with_targets(P.risk_rows(n), C.targets(spark, d)).groupBy("stratum", P.cell(3).alias("cell")).agg(F.count("*").alias("exposure"), F.sum("n").alias("events"))


@query(PAIR + _RISK + ", act AS (SELECT DISTINCT e, row FROM fut) SELECT stratum, cell, CAST(count(*) FILTER (act.row IS NULL) AS BIGINT) AS exposure, CAST(coalesce(sum(n) FILTER (act.row IS NULL), 0) AS BIGINT) AS events FROM rk LEFT JOIN act USING (e, row) GROUP BY stratum, cell")
def complement_mass(spark, d):
    e, t, n = _all(spark, d)
    return P.complement(n, t, P.footprint(_pair(spark, d), n, 6), 3)


_DESIGN = ", resp AS (SELECT e, row, round(sum(1.0::DOUBLE / 6), 9) AS v1 FROM fut WHERE span <= 12 GROUP BY e, row), des AS (SELECT stratum, cell, coalesce(v1, 0.0) AS v1, count(*) AS exposure, CAST(sum(n) AS BIGINT) AS events FROM rk LEFT JOIN resp USING (e, row) GROUP BY ALL)"


def pair_design(spark, d, window: int = 12, lag: int = 6, bins: int = 3):
    e, t, n = _all(spark, d)
    return P.design(n, t, P.kernel_response(M.unordered(e, (0, 1)), n, window, lag, 1), ["v1"], bins)


@query(PAIR + _RISK + _DESIGN + " SELECT stratum, cell, round(v1, 6) AS v1, exposure, events FROM des WHERE exposure > 0")
def design_aggregate(spark, d):
    return pair_design(spark, d).where("exposure > 0").select("stratum", "cell", F.round("v1", 6).alias("v1"), "exposure", "events")


@query(EV + ", w AS (SELECT e, s, z, unnest(generate_series(s // 168, z // 168)) AS k FROM ent) SELECT e, CAST(k % 3 AS INTEGER) AS cell, greatest(s, k * 168) AS begin, least(z + 1, (k + 1) * 168) AS stop FROM w")
def baseline_segments(spark, d):
    return P.baseline_segments(C.entities(spark, d), 3)


@query(PAIR + _RISK + """, sp AS (SELECT e, row, min(span) AS span FROM fut GROUP BY e, row)
 SELECT CAST(w AS BIGINT) AS w, stratum, cell, n > 0 AS event, count(*) AS rows FROM (SELECT *, CASE WHEN span <= 2 THEN 2 WHEN span <= 12 THEN 12 WHEN span <= 48 THEN 48 END AS w FROM sp JOIN rk USING (e, row)) WHERE w IS NOT NULL GROUP BY ALL""")
def window_shell_counts(spark, d):
    e, t, n = _all(spark, d)
    shells = M.window_band(P.least_span(M.unordered(e, (0, 1)), n, 6), (2, 12, 48))
    return P.with_targets(shells, t).join(n.select("e", "stratum"), "e").groupBy("w", "stratum", P.cell(3).alias("cell"), (F.col("n") > 0).alias("event")).agg(F.count("*").alias("rows"))


# --- likelihoods at fixed coefficients ---------------------------------------------------------------------------

_ETA = "(-3.0 + 0.4 * stratum + 0.1 * cell + 0.8 * v1)"


def _eta():
    return F.lit(-3.0) + 0.4 * F.col("stratum") + 0.1 * F.col("cell") + 0.8 * F.col("v1")


@query(PAIR + _RISK + _DESIGN + f" SELECT stratum, round(sum(exposure * exp{_ETA} - events * {_ETA}), 6) AS nll FROM des GROUP BY stratum")
def poisson_loss(spark, d):
    loss = S.loss_row(_eta(), "poisson", F.col("exposure"), F.col("exposure"), F.col("events"))
    return pair_design(spark, d).groupBy("stratum").agg(F.round(F.sum(loss), 6).alias("nll"))


@query(PAIR + _RISK + _DESIGN + f" SELECT stratum, round(sum((exposure - events) * exp{_ETA} + events * -ln(1 - exp(-exp{_ETA}))), 6) AS nll FROM des GROUP BY stratum")
def cloglog_loss(spark, d):
    loss = S.loss_row(_eta(), "cloglog", F.col("exposure"), F.col("exposure") - F.col("events"), F.col("events"))
    return pair_design(spark, d).groupBy("stratum").agg(F.round(F.sum(loss), 6).alias("nll"))


@query(PAIR + _RISK + _DESIGN + f" SELECT round(sum(exposure * exp{_ETA} - events), 6) AS g0, round(sum((exposure * exp{_ETA} - events) * v1), 6) AS g1, round(sum(exposure * exp{_ETA}), 6) AS h00, round(sum(exposure * exp{_ETA} * v1), 6) AS h01, round(sum(exposure * exp{_ETA} * v1 * v1), 6) AS h11 FROM des")
def score_moments(spark, d):
    first, second = S.loss_slopes(_eta(), "poisson", F.col("exposure"), F.col("exposure"), F.col("events"))
    v = F.col("v1")
    return pair_design(spark, d).agg(*[F.round(F.sum(x), 6).alias(n) for n, x in (("g0", first), ("g1", first * v), ("h00", second), ("h01", second * v), ("h11", second * v * v))])


_ENT_LOSS = PAIR + _RISK + ", resp AS (SELECT e, row, round(sum(1.0::DOUBLE / 6), 9) AS v1 FROM fut WHERE span <= 12 GROUP BY e, row)"


@query(_ENT_LOSS + " SELECT e, round(sum(exp(-3 + 0.8 * coalesce(v1, 0)) - n * (-3 + 0.8 * coalesce(v1, 0))), 5) AS loss FROM rk LEFT JOIN resp USING (e, row) GROUP BY e")
def entity_loss(spark, d):
    """Baseline loss in closed form from exposure and events, corrected only on active rows."""
    e, t, n = _all(spark, d)
    resp = P.kernel_response(M.unordered(e, (0, 1)), n, 12, 6, 1).withColumn("v1", F.round("v1", 9))
    eta = -3 + 0.8 * F.col("v1")
    fix = P.with_targets(resp, t).groupBy("e").agg(F.sum((F.exp(eta) - F.exp(F.lit(-3.0))) - F.col("n") * (eta + 3)).alias("fix"))
    events = t.groupBy("e").agg(F.sum("mult").alias("n"))
    base = n.join(events, "e", "left").select("e", ((F.col("end") - F.col("start") + 1) * F.exp(F.lit(-3.0)) + 3 * F.coalesce("n", F.lit(0))).alias("base"))
    return base.join(fix, "e", "left").select("e", F.round(F.col("base") + F.coalesce("fix", F.lit(0.0)), 5).alias("loss"))


@query(_ENT_LOSS + " SELECT e, row // 168 AS block, round(sum(exp(-3 + 0.8 * v1) - n * (-3 + 0.8 * v1)), 6) AS loss, count(*) AS rows FROM rk JOIN resp USING (e, row) GROUP BY ALL")
def calendar_block_loss(spark, d):
    e, t, n = _all(spark, d)
    resp = P.kernel_response(M.unordered(e, (0, 1)), n, 12, 6, 1).withColumn("v1", F.round("v1", 9))
    eta = -3 + 0.8 * F.col("v1")
    return P.with_targets(resp, t).groupBy("e", F.floor(F.col("row") / 168).alias("block")).agg(F.round(F.sum(F.exp(eta) - F.col("n") * eta), 6).alias("loss"), F.count("*").alias("rows"))


@query(_ENT_LOSS + " SELECT e, round(sum(n - exp(-3.0)), 6) AS s0, round(sum((n - exp(-3.0)) * v1), 6) AS s1 FROM rk JOIN resp USING (e, row) GROUP BY e")
def cluster_scores(spark, d):
    e, t, n = _all(spark, d)
    resp = P.kernel_response(M.unordered(e, (0, 1)), n, 12, 6, 1).withColumn("v1", F.round("v1", 9))
    r = F.col("n") - F.exp(F.lit(-3.0))
    return P.with_targets(resp, t).groupBy("e").agg(F.round(F.sum(r), 6).alias("s0"), F.round(F.sum(r * F.col("v1")), 6).alias("s1"))


@query(_ENT_LOSS + " SELECT e, round(1 - exp(-sum(exp(-3 + 0.8 * v1))), 6) AS p_full, round(1 - exp(-count(*) * exp(-3.0)), 6) AS p_null FROM resp GROUP BY e")
def probability_contribution(spark, d):
    e, _, n = _all(spark, d)
    resp = P.kernel_response(M.unordered(e, (0, 1)), n, 12, 6, 1).withColumn("v1", F.round("v1", 9))
    return resp.groupBy("e").agg(F.round(-F.expm1(-F.sum(F.exp(-3 + 0.8 * F.col("v1")))), 6).alias("p_full"), F.round(-F.expm1(-F.count("*") * F.exp(F.lit(-3.0))), 6).alias("p_null"))


@query(EV + ", m AS (SELECT s AS t, 1 AS x FROM ent UNION ALL SELECT z + 1, -1 FROM ent) SELECT t, CAST(sum(sum(x)) OVER (ORDER BY t) AS BIGINT) AS at_risk FROM m GROUP BY t")
def risk_set_sizes(spark, d):
    n = C.entities(spark, d)
    moves = n.select(F.col("start").alias("t"), F.lit(1).alias("x")).unionAll(n.select(F.col("end") + 1, F.lit(-1))).groupBy("t").agg(F.sum("x").alias("x"))
    return moves.select("t", F.sum("x").over(W.orderBy("t")).alias("at_risk"))


_RATE = "0.028881132523331052"  # ln(2) / 24
_REACH = 718


@query(EV + f" SELECT a.e, a.t, p, round(sum(exp(-{_RATE} * (a.t - b.t))), 6) AS s FROM (SELECT DISTINCT e, t FROM tg) a JOIN src b ON a.e = b.e AND b.t < a.t AND b.t >= a.t - {_REACH} GROUP BY ALL")
def hawkes_target_state(spark, d):
    e, t, _ = _all(spark, d)
    return P.hawkes_states(e, t, 24.0).withColumn("s", F.round("s", 6))


@query(EV + f" SELECT p, round(sum((1 - exp(-{_RATE} * (z - t))) / {_RATE}), 4) AS mass FROM src JOIN ent USING (e) GROUP BY p")
def hawkes_kernel_mass(spark, d):
    e, _, n = _all(spark, d)
    return P.hawkes_mass(e, n, 24.0).withColumn("mass", F.round("mass", 4))


# --- signals ------------------------------------------------------------------------------------------------------

_SIG = """WITH u AS (SELECT user_id AS k, epoch_us(ts) AS t, event_id AS id, value AS v, event_type FROM events), s AS (SELECT k, t, arg_max(v, id) AS v FROM u WHERE v IS NOT NULL GROUP BY k, t)"""
_H6 = 6 * C.HOUR


def _signal(spark, d):
    rows = C.table(spark, d, "events").select(F.col("user_id").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), F.col("value").alias("v")).where("v is not null")
    return G.last_per_tick(rows)


@query(_SIG + " SELECT k, t, v FROM s")
def last_value_per_tick(spark, d):
    return _signal(spark, d)


@query("""WITH g AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM g)
 SELECT l_returnflag, min(x) AS value FROM c WHERE c >= 0.9 * t GROUP BY l_returnflag""")
def weighted_quantile(spark, d):
    return G.weighted_quantile(C.table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), ["l_returnflag"], "l_extendedprice", "l_quantity", 0.9)


@query("""WITH g AS (SELECT l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT x, w, sum(w) OVER (ORDER BY x) AS c, sum(w) OVER () AS t FROM g), i AS (SELECT unnest(generate_series(0, 100)) AS i)
 SELECT x AS knot, max(i / 100.0::DOUBLE) AS prob FROM c, i WHERE c >= i / 100.0::DOUBLE * t AND (c - w < i / 100.0::DOUBLE * t OR (i = 0 AND c - w = 0)) GROUP BY x""")
def percentile_profile(spark, d):
    return G.percentile_profile(C.table(spark, d, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity")


@query(_SIG + ", z AS (SELECT k, max(t) + 1000 AS stop FROM s GROUP BY k) SELECT k, t, greatest(0, least(stop, coalesce(lead(t) OVER (PARTITION BY k ORDER BY t), stop)) - t) AS w FROM s JOIN z USING (k)")
def duration_weights(spark, d):
    s = _signal(spark, d)
    return G.duration_weights(s, s.groupBy("k").agg((F.max("t") + 1000).alias("stop"))).select("k", "t", "w")


_TRIG = ", g AS (SELECT *, CASE WHEN v >= {hi} THEN 1 WHEN v < {lo} THEN 0 END AS x FROM s), q AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS st, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS was FROM g)"


@query(_SIG + _TRIG.format(hi=150.0, lo=75.0) + " SELECT k, t FROM q WHERE st = 1 AND was = 0")
def hysteresis_targets(spark, d):
    return G.hysteresis_targets(_signal(spark, d), 150.0, 0.5)


@query(_SIG + _TRIG.format(hi=150.0, lo=50.0) + " SELECT k, t, st AS code FROM q WHERE st <> was")
def context_transitions(spark, d):
    return G.context_transitions(_signal(spark, d), 150.0, 50.0)


@query(_SIG + f""" SELECT k, t, v, past, CASE WHEN past > 0 AND v > 0 THEN round(ln(v / past), 6) END AS r FROM (SELECT s.k, s.t, s.v, (SELECT b.v FROM s b WHERE b.k = s.k AND b.t <= s.t - {_H6} ORDER BY b.t DESC LIMIT 1) AS past FROM s)""")
def past_horizon_return(spark, d):
    return G.past_return(_signal(spark, d), _H6).withColumn("r", F.round("r", 6))


@query(_SIG + f""", j AS (SELECT k, t, v - lag(v) OVER (PARTITION BY k ORDER BY t) AS j FROM s), q AS (SELECT k, t, CAST(round(j * j, 4) AS DECIMAL(24, 4)) AS d FROM j WHERE j <> 0), m AS (SELECT k, t, d FROM q UNION ALL SELECT k, t + {_H6}, -d FROM q)
 SELECT k, t, CAST(sum(sum(d)) OVER (PARTITION BY k ORDER BY t) AS DOUBLE) AS rv FROM m GROUP BY k, t""")
def realized_variance(spark, d):
    return G.realized_variance(_signal(spark, d), _H6)


@query(_SIG + """, g AS (SELECT *, count(*) FILTER (v >= 150 OR v <= 5) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM s),
 h AS (SELECT *, first_value(v) OVER w AS f, min(v) OVER w AS lo, max(v) OVER w AS hi FROM g WINDOW w AS (PARTITION BY k, g ORDER BY t ROWS UNBOUNDED PRECEDING))
 SELECT k, t, v, g > 0 AND f >= 150 AND lo >= 40 AS stressed, g > 0 AND f <= 5 AND hi <= 40 AS calm FROM h""")
def market_states(spark, d):
    return G.market_states(_signal(spark, d), 5.0, 40.0, 150.0)


@query(_SIG + """, g AS (SELECT k, t, coalesce(last_value(CASE WHEN v >= 150 THEN 1 WHEN v < 40 THEN 0 END IGNORE NULLS) OVER w, 0) + coalesce(last_value(CASE WHEN v >= 60 THEN 1 WHEN v < 10 THEN 0 END IGNORE NULLS) OVER w, 0) AS x FROM s WINDOW w AS (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING))
 SELECT k, t, net FROM (SELECT k, t, x - lag(x) OVER (PARTITION BY k ORDER BY t) AS net FROM g) WHERE net <> 0""")
def regime_transitions(spark, d):
    return G.regime_transitions(_signal(spark, d).withColumn("a", F.col("v")).withColumn("b", F.col("v")), {"a": (150.0, 40.0), "b": (60.0, 10.0)})


@query(_SIG + """, c AS (SELECT k, t, v - lag(v) OVER (PARTITION BY k ORDER BY t) AS d FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM c WHERE d <> 0)
 SELECT k, t, CAST(sign(d) AS INTEGER) AS sign FROM (SELECT n.*, (SELECT count(*) FROM n b WHERE b.k = n.k AND b.i < n.i AND abs(b.d) >= abs(n.d)) AS larger FROM n) WHERE 1 + larger <= 0.1 * i""")
def prequential_shocks(spark, d):
    return G.prequential_shocks(_signal(spark, d), 0.1)


@query(_SIG + f" SELECT k, t, id, " + ", ".join(f"(SELECT count(*) FROM u b WHERE b.k = u.k AND b.t >= u.t - {_H6} AND (b.t, b.id) < (u.t, u.id) AND b.event_type = '{x}') AS n_{x}" for x in ("click", "view")) + " FROM u")
def trailing_action_mix(spark, d):
    rows = C.table(spark, d, "events").select(F.col("user_id").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return G.action_mix(rows, _H6, ("click", "view")).drop("kind")


@query(EV + ", b AS (SELECT e AS k, t FROM tg UNION SELECT e, s FROM ent UNION SELECT e, z + 1 FROM ent UNION SELECT e, t + 1 FROM src) SELECT k, t, (n - t) / 24.0::DOUBLE AS exposure FROM (SELECT *, lead(t) OVER (PARTITION BY k ORDER BY t) AS n FROM b) WHERE n IS NOT NULL")
def continuous_risk_intervals(spark, d):
    e, t, n = _all(spark, d)
    b = t.select(F.col("e").alias("k"), "t").unionAll(n.select("e", "start")).unionAll(n.select("e", F.col("end") + 1)).unionAll(e.select("e", F.col("t") + 1))
    return G.risk_intervals(b, 24.0)


# --- joins, metrics ------------------------------------------------------------------------------------------------

@query("""WITH i AS (SELECT o_orderkey AS e, o_custkey % 50 AS g, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s FROM orders), x AS (SELECT l_suppkey % 50 AS g, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS t, CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS code, l_orderkey AS id FROM lineitem)
 SELECT i.e, x.t, x.code, min(x.id) AS id FROM i JOIN x ON i.g = x.g AND x.t > i.s AND x.t < i.s + 5 GROUP BY ALL""")
def interval_exposure_join(spark, d):
    i, x = _exposed(spark, d)
    return R.interval_exposure(i, x, ["g"], 5)


def _exposed(spark, d):
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    i = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("e"), (F.col("o_custkey") % 50).alias("g"), day("o_orderdate").alias("start")).withColumn("end", F.col("start") + 5)
    return i, C.table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("g"), day("l_shipdate").alias("t"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("code"), F.col("l_orderkey").alias("id"))


@query("SELECT o_orderkey, o_custkey, o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey) AS is_first FROM orders")
def first_in_group(spark, d):
    return R.first_mask(C.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate").drop("o_orderdate")


_PROB = "WITH j AS (SELECT quality AS y, toxic, round(1 / (1 + exp(-(length(text) - 1500) / 1000.0::DOUBLE)), 4) AS p FROM documents JOIN labels USING (doc_id))"


def _scores(spark, d):
    j = C.table(spark, d, "documents").select("doc_id", "text").join(C.table(spark, d, "labels"), "doc_id")
    return j.select(F.col("quality").alias("y"), "toxic", F.round(1 / (1 + F.exp(-(F.length("text") - 1500) / 1000.0)), 4).alias("p"))


@query(_PROB + """, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM j), c AS (SELECT *, greatest(1e-12, least(1 - 1e-12, p)) AS c FROM r)
 SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auroc, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-y * ln(c) - (1 - y) * ln(1 - c)), 6) AS log_loss FROM c""")
def classification_metrics(spark, d):
    m = R.classification_metrics(_scores(spark, d), "y", "p")
    return m.select("n", "positives", *[F.round(c, 6).alias(c) for c in ("auroc", "brier", "log_loss")])


@query(_PROB + " SELECT y, p, rank() OVER (PARTITION BY y ORDER BY p) + (count(*) OVER (PARTITION BY y, p) - 1) / 2.0::DOUBLE AS r FROM j")
def average_ranks(spark, d):
    return R.average_ranks(_scores(spark, d), "p", "r", ["y"]).select("y", "p", "r")


@query("SELECT o_orderpriority AS env, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(stddev_samp(o_totalprice), 2) AS deviation FROM orders GROUP BY ALL")
def environment_moments(spark, d):
    m = R.environment_moments(C.table(spark, d, "orders").select(F.col("o_orderpriority").alias("env"), "o_totalprice"), "env", "o_totalprice")
    return m.select("env", "n", F.round("mean", 2).alias("mean"), F.round(F.sqrt("variance"), 2).alias("deviation"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS deviation, count(*) AS n FROM lineitem GROUP BY ALL")
def seed_summary(spark, d):
    return R.seed_summary(C.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount"), ["l_returnflag", "l_linestatus"], "l_discount").withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


@query("""WITH s AS (SELECT DISTINCT l_returnflag || l_linestatus AS run, l_suppkey AS i FROM lineitem), n AS (SELECT run, count(*) AS n FROM s GROUP BY run), x AS (SELECT a.run AS ra, b.run AS rb, count(*) AS m FROM s a JOIN s b ON a.i = b.i AND a.run < b.run GROUP BY ALL)
 SELECT round(avg(coalesce(m, 0) / (a.n + b.n - coalesce(m, 0))), 6) AS jaccard FROM n a JOIN n b ON a.run < b.run LEFT JOIN x ON ra = a.run AND rb = b.run""")
def run_stability(spark, d):
    r = C.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("run"), F.col("l_suppkey").alias("identity")).distinct()
    return R.run_stability(r).select(F.round("jaccard", 6).alias("jaccard"))


@query(PAIR + """, a AS (SELECT e, row, count(*)::DOUBLE AS v FROM fut GROUP BY ALL), b AS (SELECT e, row, min(span)::DOUBLE AS v FROM fut GROUP BY ALL) SELECT round(sum(pow(coalesce(a.v, 0) - coalesce(b.v, 0), 2)), 4) AS d FROM a FULL JOIN b USING (e, row)""")
def profile_distance(spark, d):
    n = C.entities(spark, d)
    m = _pair(spark, d)
    count = P._future(m, n, 6).groupBy("e", "row").agg(F.count("*").cast("double").alias("v"))
    least = P.least_span(m, n, 6).select("e", "row", F.col("span").cast("double").alias("v"))
    return R.squared_distance(count, least, ["e", "row"], "v").select(F.round("d", 4).alias("d"))


_HEX = "printf('0x%064x%064x', o_custkey, o_orderkey)"


@query("""SELECT o_orderkey, lower(trim('  0X' || printf('%040x', o_custkey) || ' ')) AS address, CAST(o_custkey AS VARCHAR) AS w0, CAST(o_orderkey AS VARCHAR) AS w1, (o_custkey << 20) | (o_orderkey % 1000) AS primitive FROM orders""")
def log_word_decode(spark, d):
    o = C.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    data = F.format_string("0x%064x%064x", "o_custkey", "o_orderkey")
    return o.select("o_orderkey", S.clean_address(F.format_string("  0X%040x ", "o_custkey")).alias("address"), S.word_number(S.data_word(data, 0)).alias("w0"), S.word_number(S.data_word(data, 1)).alias("w1"), S.primitive_id(F.col("o_custkey"), F.col("o_orderkey") % 1000).alias("primitive"))
