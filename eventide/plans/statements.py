"""Queries of mechanisms, keyed tables, designs and scalar statistics, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import scalar as S
from eventide.operators import mechanisms as X
from eventide.operators import motifs as M
from eventide.operators import response as P
from eventide.operators import signals as G
from eventide.operators import tables as B
from eventide.plans import model as L
from eventide.plans.queries import _DESIGN, _ENT_LOSS, _ETA, _RISK, EV, PAIR, _all, _eta, _pair, pair_design, query
from eventide.sources import canonical as C

# --- mechanisms of position logs ---------------------------------------------------------------------------------

_KINDS = ("borrow", "repay", "supply", "withdraw", "collateral_enable", "collateral_disable", "supply")
_ACTS = f"""WITH a AS (SELECT o_custkey AS owner, list_extract({list(_KINDS)}, o_orderkey % 7 + 1) AS kind, o_orderkey AS seq, o_orderkey % 3 AS reserve, o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS actor,
  CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS rate_mode, year(o_orderdate) * 12 + month(o_orderdate) AS tx FROM orders),
b AS (SELECT a.*, coalesce((SELECT x.kind = 'collateral_enable' FROM a x WHERE x.owner = a.owner AND x.reserve = a.reserve AND x.tx < a.tx AND x.kind IN ('collateral_enable', 'collateral_disable') ORDER BY x.tx DESC, x.seq DESC LIMIT 1), false) AS held,
  EXISTS (SELECT 1 FROM a x WHERE x.owner = a.owner AND x.reserve = a.reserve AND x.tx < a.tx AND x.kind = 'borrow') AS known,
  (SELECT count(*) FROM (SELECT x.owner, x.reserve, arg_max(x.kind, x.tx * 100000000000 + x.seq) AS k FROM a x WHERE x.owner = a.owner AND x.tx < a.tx AND x.kind IN ('collateral_enable', 'collateral_disable') GROUP BY ALL) WHERE k = 'collateral_enable') AS n_held FROM a),
m AS (SELECT *, CASE kind WHEN 'borrow' THEN CASE WHEN owner = actor AND rate_mode = 1 THEN 'self_stable_borrow' ELSE CASE WHEN owner = actor THEN 'self' ELSE 'delegated' END || '_borrow_' || CASE WHEN known THEN 'known' ELSE 'new' END || '_reserve' END
  WHEN 'repay' THEN CASE WHEN owner = actor THEN 'self_repay' ELSE 'third_party_repay' END WHEN 'supply' THEN CASE WHEN held THEN CASE WHEN owner = actor THEN 'self_top_up' ELSE 'third_party_top_up' END END
  WHEN 'withdraw' THEN CASE WHEN held THEN CASE WHEN n_held > 1 THEN 'withdraw_with_rest' ELSE 'withdraw_last' END END WHEN 'collateral_enable' THEN CASE WHEN NOT held THEN 'enable' END WHEN 'collateral_disable' THEN CASE WHEN held THEN 'disable' END END AS one,
  kind = 'collateral_enable' OR (kind = 'supply' AND held) AS adds, kind = 'collateral_disable' OR (kind = 'withdraw' AND held) AS takes FROM b)"""


def _acts(spark, d):
    k = F.col("o_orderkey")
    return C.table(spark, d, "orders").select(
        F.col("o_custkey").alias("owner"), F.element_at(F.array(*map(F.lit, _KINDS)), (k % 7 + 1).cast("int")).alias("kind"), k.alias("seq"), (k % 3).alias("reserve"),
        (F.col("o_custkey") + F.when(k % 5 == 0, 1).otherwise(0)).alias("actor"), F.when(k % 4 == 0, 1).otherwise(2).alias("rate_mode"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("tx"),
    )


@query(_ACTS + " SELECT owner, seq, held, known, n_held, one AS mechanism FROM m")
def action_mechanisms(spark, d):
    return X.with_state(_acts(spark, d)).select("owner", "seq", "held", "known", "n_held", X.action_mechanism().alias("mechanism"))


@query(_ACTS + """, g AS (SELECT owner, tx, bool_or(kind = 'borrow') AS b, bool_or(kind = 'repay') AS r, count(DISTINCT reserve) FILTER (adds) AS na, count(DISTINCT reserve) FILTER (takes) AS nt, count(DISTINCT reserve) FILTER (adds OR takes) AS nr,
  bool_or(owner <> actor AND (kind = 'repay' OR adds)) AS helped FROM m GROUP BY ALL),
 c AS (SELECT *, list_filter([CASE WHEN b AND r THEN 'restructuring' END, CASE WHEN na > 0 AND nt > 0 AND nr > 1 THEN 'rotation' END, CASE WHEN b AND na > 0 THEN 'expansion' END, CASE WHEN r AND na > 0 THEN CASE WHEN helped THEN 'assisted_deleveraging' ELSE 'deleveraging' END END], lambda x: x IS NOT NULL) AS c FROM g),
 s AS (SELECT owner, tx, list_distinct(list(one)) AS s FROM m WHERE one IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a x WHERE x.owner = m.owner AND x.tx = m.tx AND x.reserve = m.reserve AND (m.kind = 'supply' AND x.kind = 'collateral_enable' OR m.kind = 'withdraw' AND x.kind = 'collateral_disable')) GROUP BY ALL)
 SELECT owner, tx, CASE WHEN len(c) = 1 THEN c[1] WHEN len(c) = 0 AND len(s) = 1 THEN s[1] END AS mechanism FROM c LEFT JOIN s USING (owner, tx)""")
def transaction_mechanisms(spark, d):
    return X.transaction_mechanism(_acts(spark, d))


@query(_ACTS + " SELECT owner, tx, 'entry_' || CASE WHEN bool_or(adds) THEN 'leveraged' WHEN bool_or(kind = 'borrow' AND owner <> actor) THEN 'delegated' WHEN bool_or(kind = 'borrow' AND rate_mode = 1) THEN 'stable_rate' WHEN arg_min(reserve, seq) FILTER (kind = 'borrow') = 0 THEN 'stable_value' ELSE 'volatile' END AS mechanism FROM m GROUP BY ALL HAVING bool_or(kind = 'borrow')")
def entry_mechanisms(spark, d):
    return X.entry_mechanism(_acts(spark, d), [0])


@query("""SELECT printf('0x%040x', o_custkey) AS reserve, o_orderkey AS block_number, o_orderkey // 7200 AS tick, (o_orderkey << 20) | (o_orderkey % 100) AS primitive, CAST(o_orderkey AS VARCHAR) AS liquidity_rate, CAST(o_custkey AS VARCHAR) AS stable_rate,
 CAST(CAST(o_orderkey AS HUGEINT) * 1152921504606846976 + o_custkey AS VARCHAR) AS variable_rate, CAST(CAST(18446744073709551616 AS HUGEINT) + o_orderkey AS VARCHAR) AS liquidity_index, CAST(NULL AS VARCHAR) AS variable_index FROM orders""")
def market_log_decode(spark, d):
    """The third word holds its number above 60 bits, the fourth one beyond 64, the fifth has no room in 38 digits."""
    word = lambda high, low: F.format_string("%049x%015x", high, low)
    b, c = F.col("b"), F.col("c")
    o = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("b"), F.col("o_custkey").alias("c"))
    data = F.concat(F.lit("0x"), word(F.lit(0), b), word(F.lit(0), c), word(b, c), word(F.lit(16), b), F.lit("f" * 64))
    logs = o.select(b.alias("block_number"), (b % 100).alias("transaction_index"), F.array(F.lit("0x0"), F.format_string("0x%064x", c)).alias("topics"), data.alias("data"))
    return B.decode_market_logs(logs).select("reserve", "block_number", "tick", "primitive", *[F.col(n).cast("string").alias(n) for n in B.RATES])


# --- keyed tables --------------------------------------------------------------------------------------------------

@query("SELECT o_orderkey, CASE WHEN n = 1 THEN CASE WHEN a THEN 'large' WHEN b THEN 'urgent' ELSE 'open' END END AS member, n <= 1 AS ok FROM (SELECT *, a::INT + b::INT + c::INT AS n FROM (SELECT o_orderkey, o_totalprice > 200000 AS a, o_orderpriority LIKE '1%' AS b, o_orderstatus = 'O' AS c FROM orders))")
def exclusive_masks(spark, d):
    o = C.table(spark, d, "orders")
    return B.exclusive_masks(o, {"large": F.col("o_totalprice") > 200000, "urgent": F.col("o_orderpriority").like("1%"), "open": F.col("o_orderstatus") == "O"}).select("o_orderkey", "member", "ok")


@query(EV + " SELECT (SELECT count(*) FROM ent) AS n_full, count(*) AS n_reference, 0 AS n_outside, count(*) < (SELECT count(*) FROM ent) AS strict FROM ent WHERE part = 0")
def cohort_check(spark, d):
    n = C.entities(spark, d)
    return B.cohort_check(n, n.where("part = 0"), "e")


_PAT = "WITH r AS (SELECT o_orderkey, list_distinct([o_orderkey % 4, o_custkey % 4, o_orderkey % 3]) AS raw, list_extract(['auto', 'ordered', 'unordered'], o_custkey % 3 + 1) AS relation, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS sign FROM orders), n AS (SELECT o_orderkey, sign, raw, CASE WHEN len(raw) = 1 THEN 'atomic' WHEN relation = 'auto' THEN 'unordered' ELSE relation END AS kind FROM r)"


def _patterns(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.array_distinct(F.array(k % 4, c % 4, k % 3))
    pattern, kind = B.normal_pattern(raw, F.element_at(F.array(*map(F.lit, ("auto", "ordered", "unordered"))), (c % 3 + 1).cast("int")))
    return C.table(spark, d, "orders").select("o_orderkey", pattern.alias("pattern"), kind.alias("relation"), F.when(k % 2 == 0, 1).otherwise(-1).alias("sign"))


@query(_PAT + " SELECT o_orderkey, kind AS relation, CASE WHEN kind = 'ordered' THEN len(raw)::VARCHAR ELSE array_to_string(list_sort(raw), ',') END AS shown FROM n")
def normal_patterns(spark, d):
    """Ordered patterns keep their order, which SQL's distinct list does not promise; they show their size."""
    p = _patterns(spark, d)
    return p.select("o_orderkey", "relation", F.when(F.col("relation") == "ordered", F.size("pattern").cast("string")).otherwise(F.array_join("pattern", ",")).alias("shown"))


@query(_PAT + " SELECT len(raw) AS \"order\", kind AS relation, sign, count(*) AS n FROM n GROUP BY ALL")
def rule_structure(spark, d):
    return B.rule_structure(_patterns(spark, d))


_BOUND = EV + ", b AS (SELECT e, s AS t FROM ent UNION SELECT e, z + 1 FROM ent UNION SELECT e, t FROM tg WHERE t % 2 = 0), nb AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY t) - 1 AS position, lead(t) OVER (PARTITION BY e ORDER BY t) IS NULL AS fin FROM b)"


@query(_BOUND + " SELECT e, t, CASE WHEN NOT fin THEN position END AS position, position IS NOT NULL AND NOT fin AS ok FROM (SELECT e, t FROM tg UNION ALL SELECT e, z + 1 FROM ent) LEFT JOIN nb USING (e, t)")
def interval_positions(spark, d):
    _, t, n = _all(spark, d)
    bounds = n.select("e", F.col("start").alias("t")).unionAll(n.select("e", F.col("end") + 1)).unionAll(t.where("t % 2 = 0").select("e", "t"))
    return B.interval_positions(t.select("e", "t").unionAll(n.select("e", F.col("end") + 1)), bounds)


_OFF = ", o AS (SELECT e, s, z, CAST(coalesce(sum(z - s + 1) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM ent)"


@query(EV + _OFF + " SELECT e, s AS start, z AS \"end\", off AS \"offset\" FROM o")
def row_offsets(spark, d):
    return B.row_offsets(C.entities(spark, d))


@query(PAIR + _OFF + " SELECT off + t - s AS id, e, t FROM pair JOIN o USING (e)")
def row_numbers(spark, d):
    """Completions as numbers of risk rows, and back."""
    offsets = B.row_offsets(C.entities(spark, d))
    return B.from_rows(B.to_rows(_pair(spark, d).select("e", "t"), offsets).select("id"), offsets)


@query(PAIR + ", n AS (SELECT e, count(*) AS n FROM pair GROUP BY e) SELECT e, n, CAST(coalesce(sum(n) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n")
def completion_offsets(spark, d):
    return B.running_total(_pair(spark, d).groupBy("e").agg(F.count("*").alias("n")), "e", "n", "offset")


@query(PAIR + " SELECT e, t, span, row_number() OVER (PARTITION BY e ORDER BY span, t) - 1 AS place FROM pair WHERE span <= 24")
def bounded_span_order(spark, d):
    return B.bounded_order(_pair(spark, d), ["e"], "span", "t", 24).select("e", "t", "span", "place")


@query("SELECT l_partkey, min(l_extendedprice) AS bound FROM lineitem GROUP BY l_partkey HAVING min(l_extendedprice) > 1000 ORDER BY bound DESC, l_partkey LIMIT 50")
def certified_queue(spark, d):
    return B.certified_queue(C.table(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("bound")), "l_partkey", "bound", 1000, 50)


@query(PAIR + ", i AS (SELECT e, t + 1 AS b, t + 6 AS z FROM pair), m AS (SELECT *, b > max(z) OVER (PARTITION BY e ORDER BY b, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM i), c AS (SELECT *, sum(coalesce(o::INT, 0)) OVER (PARTITION BY e ORDER BY b, z ROWS UNBOUNDED PRECEDING) AS c FROM m) SELECT e, min(b) AS begin, max(z) AS stop, count(*) AS n FROM c GROUP BY e, c")
def overlap_components(spark, d):
    return B.overlap_components(_pair(spark, d).select("e", (F.col("t") + 1).alias("begin"), (F.col("t") + 6).alias("stop")))


@query(PAIR + " SELECT e, t FROM pair WHERE span <= 12 UNION SELECT e, t FROM tg UNION SELECT e, s FROM ent")
def sorted_unique_union(spark, d):
    _, t, n = _all(spark, d)
    return _pair(spark, d).where("span <= 12").select("e", "t").unionAll(t.select("e", "t")).unionAll(n.select("e", F.col("start").alias("t"))).distinct()


# --- designs, moments, bounds ---------------------------------------------------------------------------------------

@query(EV + ", m AS (SELECT s AS t FROM ent UNION SELECT z + 1 FROM ent) SELECT t, round(coalesce(sum(exp(-3 + 0.4 * stratum)), 0), 6) AS first FROM m LEFT JOIN ent ON t BETWEEN s AND z GROUP BY t")
def risk_set_derivatives(spark, d):
    """For a Poisson baseline the second derivative of the risk set equals the first."""
    return B.risk_set_sums(C.entities(spark, d), F.exp(-3 + 0.4 * F.col("stratum")), "first").withColumn("first", F.round("first", 6) + 0.0)


_WIN = ", wf AS (SELECT e, row, " + ", ".join(f"round(sum(CASE WHEN span <= {w} THEN 1.0::DOUBLE / 6 ELSE 0 END), 9) AS v{w}" for w in (2, 12, 48)) + " FROM fut GROUP BY e, row)"


def _windows(spark, d):
    """One pass over the matches gives the response of every window."""
    rows = P._future(_pair(spark, d), C.entities(spark, d), 6)
    return rows.groupBy("e", "row").agg(*[F.round(F.sum(F.when(F.col("span") <= w, 1.0 / 6).otherwise(0.0)), 9).alias(f"v{w}") for w in (2, 12, 48)])


@query(PAIR + _RISK + _WIN + " SELECT " + ", ".join(f"round(sum((exp(-3.0) - n) * v{w}), 6) AS g{w}, round(sum(exp(-3.0) * v{w} * v{w}), 6) AS h{w}" for w in (2, 12, 48)) + " FROM wf JOIN rk USING (e, row)")
def sparse_moments(spark, d):
    """Gradient and curvature of each window's rule at a constant null, from active rows alone."""
    rate = math.exp(-3)
    rows = P.with_targets(_windows(spark, d), C.targets(spark, d))
    return rows.agg(*[x for w in (2, 12, 48) for x in (F.round(F.sum((rate - F.col("n")) * F.col(f"v{w}")), 6).alias(f"g{w}"), F.round(F.sum(rate * F.col(f"v{w}") * F.col(f"v{w}")), 6).alias(f"h{w}"))])


@query(PAIR + _RISK + _WIN + " SELECT stratum, cell, round(coalesce(v2, 0), 6) AS v2, round(coalesce(v12, 0), 6) AS v12, round(coalesce(v48, 0), 6) AS v48, count(*) AS exposure, CAST(sum(n) AS BIGINT) AS events FROM rk LEFT JOIN wf USING (e, row) GROUP BY ALL")
def window_family_design(spark, d):
    """One lossless design that serves all windows of a pattern."""
    _, t, n = _all(spark, d)
    return P.design(n, t, _windows(spark, d), ["v2", "v12", "v48"], 3).where("exposure > 0").select("stratum", "cell", *[F.round(v, 6).alias(v) for v in ("v2", "v12", "v48")], "exposure", "events")


_EXT = ", a1 AS (SELECT e, t AS t0, unnest(generate_series(t + 1, least(t + 6, z))) AS row FROM (SELECT DISTINCT e, t FROM src WHERE p = 2) JOIN ent USING (e) WHERE t < z), r2 AS (SELECT e, row, round(sum(1.0::DOUBLE / 6), 9) AS v2 FROM a1 GROUP BY e, row)"


@query(PAIR + _RISK + _DESIGN + _EXT + " SELECT stratum, cell, round(coalesce(resp.v1, 0), 6) AS v1, round(coalesce(r2.v2, 0), 6) AS v2, count(*) AS exposure, CAST(sum(n) AS BIGINT) AS events FROM rk LEFT JOIN resp USING (e, row) LEFT JOIN r2 USING (e, row) GROUP BY ALL")
def extended_design(spark, d):
    """A design with one more rule: a full outer join of the two rules' active rows."""
    e, t, n = _all(spark, d)
    one = P.kernel_response(_pair(spark, d), n, 12, 6, 1)
    two = P.kernel_response(M.unordered(e, (2,)), n, 12, 6, 1).withColumnRenamed("v1", "v2")
    both = one.join(two, ["e", "row"], "full_outer").fillna(0.0, ["v1", "v2"])
    return P.design(n, t, both, ["v1", "v2"], 3).where("exposure > 0").select("stratum", "cell", F.round("v1", 6).alias("v1"), F.round("v2", 6).alias("v2"), "exposure", "events")


@query(PAIR + _RISK + _DESIGN + f" SELECT e, row, round({_ETA}, 6) AS eta, round(0.8 * v1, 6) AS rule FROM (SELECT e, row, stratum, cell, v1 FROM resp JOIN rk USING (e, row))")
def linear_predictor(spark, d):
    """Predictor on the active rows, from stratum, cell and rule, and the rule's own contribution."""
    n = C.entities(spark, d)
    rows = P.kernel_response(_pair(spark, d), n, 12, 6, 1).withColumn("v1", F.round("v1", 9)).join(n.select("e", "stratum"), "e").withColumn("cell", P.cell(3))
    return rows.select("e", "row", F.round(_eta(), 6).alias("eta"), F.round(0.8 * F.col("v1"), 6).alias("rule"))


@query(PAIR + _RISK + _DESIGN + f" SELECT stratum, cell, round(sum(exposure * exp{_ETA}), 6) AS whole, round(sum(events * {_ETA}), 6) AS correction FROM des GROUP BY ALL")
def grid_derivatives(spark, d):
    """Exposure times rate over the grid, with the sparse correction of event rows apart."""
    return pair_design(spark, d).groupBy("stratum", "cell").agg(F.round(F.sum(F.col("exposure") * F.exp(_eta())), 6).alias("whole"), F.round(F.sum(F.col("events") * _eta()), 6).alias("correction"))


@query(PAIR + _RISK + _DESIGN + " SELECT stratum, round(sum(CASE WHEN events > 0 THEN 0.9 * events * (ln(0.9 * events / exposure) - 1) ELSE 0 END), 6) AS conjugate FROM des GROUP BY stratum")
def fenchel_conjugates(spark, d):
    """The Poisson conjugate at a dual of -0.1 events a row."""
    c = S.poisson_conjugate(-0.1 * F.col("events"), F.col("exposure").cast("double"), F.col("events").cast("double"))
    return pair_design(spark, d).where("exposure > 0").groupBy("stratum").agg(F.round(F.sum(c), 6).alias("conjugate"))


@query(PAIR + _RISK + _DESIGN + " SELECT stratum, round(sum(CASE WHEN events > 0 THEN events - events * ln(events / exposure) ELSE 0 END), 6) AS bound FROM des GROUP BY stratum")
def signature_bound(spark, d):
    """No rule set over the same row signatures has a smaller loss."""
    x = pair_design(spark, d).where("exposure > 0")
    return x.groupBy("stratum").agg(F.round(F.sum(B.saturated_loss(x)), 6).alias("bound"))


@query(PAIR + _RISK + _DESIGN + """, q AS (SELECT stratum, sum((events - exposure * exp(-6.0)) * v1) AS g0, sum((events - exposure * exp(-6.0)) * cell) AS g1, sum(exposure * exp(-6.0) * v1 * v1) AS h00, sum(exposure * exp(-6.0) * v1 * cell) AS h01, sum(exposure * exp(-6.0) * cell * cell) AS h11 FROM des GROUP BY stratum),
 x AS (SELECT *, h00 * h11 - h01 * h01 AS det FROM q) SELECT stratum, round(greatest(CASE WHEN g0 > 0 AND h00 > 0 THEN g0 * g0 / (2 * h00) ELSE 0 END, CASE WHEN g1 > 0 AND h11 > 0 THEN g1 * g1 / (2 * h11) ELSE 0 END,
 CASE WHEN det > 0 AND h11 * g0 - h01 * g1 > 0 AND h00 * g1 - h01 * g0 > 0 THEN (g0 * (h11 * g0 - h01 * g1) + g1 * (h00 * g1 - h01 * g0)) / det / 2 ELSE 0 END), 4) AS gain FROM x""")
def quadratic_gains(spark, d):
    """Second-order gain of two nonnegative directions, for each stratum."""
    rate = math.exp(-6)
    r, h, a, b = F.col("events") - F.col("exposure") * rate, F.col("exposure") * rate, F.col("v1"), F.col("cell")
    q = pair_design(spark, d).groupBy("stratum").agg(*[F.sum(x).alias(n) for n, x in (("g0", r * a), ("g1", r * b), ("h00", h * a * a), ("h01", h * a * b), ("h11", h * b * b))])
    return q.select("stratum", F.round(B.quadratic_gain([F.col("g0"), F.col("g1")], [[F.col("h00"), F.col("h01")], [F.col("h01"), F.col("h11")]]), 4).alias("gain"))


@query(PAIR + _RISK + _DESIGN + " SELECT round(sum(exposure * v1), 6) AS x0, round(sum(exposure * v1 * v1), 6) AS x1, round(sum(exposure * v1 * cell), 6) AS x2, round(sum(exposure * v1 * stratum), 6) AS x3 FROM des")
def design_cross(spark, d):
    """One column of the Gram matrix."""
    w = F.col("exposure") * F.col("v1")
    return pair_design(spark, d).agg(*[F.round(F.sum(w * x), 6).alias(f"x{k}") for k, x in enumerate((F.lit(1), F.col("v1"), F.col("cell"), F.col("stratum")))])


@query(PAIR + _RISK + _DESIGN + ", k AS (SELECT *, row_number() OVER (ORDER BY stratum, cell, v1) - 1 AS grp FROM (SELECT DISTINCT stratum, cell, v1 FROM des WHERE exposure > 0)) SELECT e, row, grp FROM resp JOIN rk USING (e, row) JOIN k USING (stratum, cell, v1)")
def design_groups(spark, d):
    """Which design group each active row belongs to; groups are few, rows are not ordered."""
    n = C.entities(spark, d)
    groups = pair_design(spark, d).where("exposure > 0").select("stratum", "cell", "v1", (F.row_number().over(W.orderBy("stratum", "cell", "v1")) - 1).alias("grp"))
    rows = P.kernel_response(_pair(spark, d), n, 12, 6, 1).withColumn("v1", F.round("v1", 9)).join(n.select("e", "stratum"), "e").withColumn("cell", P.cell(3))
    return rows.join(groups, ["stratum", "cell", "v1"]).select("e", "row", "grp")


@query(_ENT_LOSS + " SELECT e, row, row // 168 AS block, round(n - exp(-3.0), 6) AS s0, round((n - exp(-3.0)) * v1, 6) AS s1 FROM rk JOIN resp USING (e, row)")
def dependency_rows(spark, d):
    """Score pieces of each active row with its entity and calendar block."""
    e, t, n = _all(spark, d)
    rows = P.with_targets(P.kernel_response(M.unordered(e, (0, 1)), n, 12, 6, 1).withColumn("v1", F.round("v1", 9)), t)
    r = F.col("n") - math.exp(-3)
    return rows.select("e", "row", F.floor(F.col("row") / 168).alias("block"), F.round(r, 6).alias("s0"), F.round(r * F.col("v1"), 6).alias("s1"))


@query(_ENT_LOSS + ", c AS (SELECT e, sum((n - exp(-3.0)) * v1) AS s, sum(exp(-3.0) * v1 * v1) AS h FROM rk JOIN resp USING (e, row) GROUP BY e) SELECT round(sum(s * s) / sum(h), 4) AS dimension, count(*) AS clusters FROM c")
def godambe_dimension(spark, d):
    """Effective dimension of one rule: its clustered score variance over its information."""
    e, t, n = _all(spark, d)
    rows = P.with_targets(P.kernel_response(M.unordered(e, (0, 1)), n, 12, 6, 1).withColumn("v1", F.round("v1", 9)), t)
    rate = math.exp(-3)
    c = rows.groupBy("e").agg(F.sum((F.col("n") - rate) * F.col("v1")).alias("s"), F.sum(rate * F.col("v1") * F.col("v1")).alias("h"))
    return c.agg(F.round(F.sum(F.col("s") * F.col("s")) / F.sum("h"), 4).alias("dimension"), F.count("*").alias("clusters"))


@query(EV + " SELECT (SELECT count(*) FROM ent) AS first_event, round(sum(z - s + 1) / 6.0, 4) AS recurrent FROM ent")
def prediction_opportunities(spark, d):
    return C.entities(spark, d).agg(F.count("*").alias("first_event"), F.round(F.sum(F.col("end") - F.col("start") + 1) / 6.0, 4).alias("recurrent"))


# --- statistics of single values -----------------------------------------------------------------------------------

_KNOTS = {"l_quantity": [(1.0, 0.0), (10.0, 0.2), (25.0, 0.5), (50.0, 1.0)], "l_discount": [(0.0, 0.1), (0.05, 0.6), (0.09, 0.95)]}


def _cdf(c: str) -> str:
    k = _KNOTS[c]
    steps = " ".join(f"WHEN {c} < {b} THEN {p} + ({c} - {a}) / ({b} - {a})::DOUBLE * ({r} - {p})" for (a, p), (b, r) in zip(k, k[1:], strict=False))
    return f"CASE WHEN {c} < {k[0][0]} THEN 0 {steps} WHEN {c} = {k[-1][0]} THEN {k[-1][1]} ELSE 1 END"


@query(f"SELECT l_orderkey, l_linenumber, round(({_cdf('l_quantity')} + {_cdf('l_discount')}) / 2, 6) AS score FROM lineitem")
def stress_scores(spark, d):
    rows = C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return G.stress_score(rows, ("l_quantity", "l_discount"), _KNOTS).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


@query(EV + """, x AS (SELECT p AS k, value AS v, count(*) OVER (PARTITION BY p) AS n, count(*) OVER (PARTITION BY p ORDER BY value) AS c FROM ev JOIN ent USING (e) WHERE part = 0 AND value IS NOT NULL AND p IS NOT NULL),
 q AS (SELECT k, min(v) FILTER (c >= 0.25 * n) AS q25, min(v) FILTER (c >= 0.5 * n) AS q50, min(v) FILTER (c >= 0.75 * n) AS q75 FROM x GROUP BY k) SELECT *, q25 < q50 AND q50 < q75 AS separated FROM q""")
def fitted_thresholds(spark, d):
    """Quartiles of each channel over the entities of the fitting partition; they must differ to be thresholds."""
    kinds = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 3)
    rows = C.table(spark, d, "events").select(F.col("user_id").alias("e"), kinds.alias("k"), F.col("value").alias("v"), F.lit(1).alias("w")).where("k is not null").join(C.entities(spark, d).where("part = 0").select("e"), "e", "left_semi")
    out = None
    for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        one = G.weighted_quantile(rows, ["k"], "v", "w", q).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, "k")
    return out.withColumn("separated", (F.col("q25") < F.col("q50")) & (F.col("q50") < F.col("q75")))


@query(EV + ", n AS (SELECT count(*) AS n FROM ent), s AS (SELECT unnest(range(1, 6)) AS s) SELECT CAST(s AS BIGINT) AS rules, round(s * ln(greatest(2, n)) + 2 * (lgamma(41) - lgamma(s + 1) - lgamma(40 - s + 1)) + s * 2 * ln(8), 6) AS penalty FROM s, n")
def mdl_penalties(spark, d):
    n = C.entities(spark, d).count()
    rows = [(s, round(L.penalty(tuple(L.Rule((k,), "atomic", 6) for k in range(s)), 40, 4, n), 6)) for s in range(1, 6)]
    return spark.createDataFrame(rows, "rules bigint, penalty double")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(2 * (l_extendedprice - l_quantity / l_discount) - l_tax, 4) ELSE CAST('-inf' AS DOUBLE) END AS score, round(2 * l_discount - (l_quantity - l_tax), 6) AS delta,
 CAST(sign(l_quantity - 25) AS INTEGER) AS dominance, round(1 / (1 + exp(-(l_quantity - 25) / 5.0)), 6) AS p FROM lineitem""")
def support_scores(spark, d):
    """Score of a support (no fit gives minus infinity; a fit with an unknown term an unknown score), block delta, dominance sign and logistic value."""
    fitted = F.col("l_discount") > 0
    score = S.score_of_fit(F.col("l_extendedprice"), F.col("l_quantity") / F.when(fitted, F.col("l_discount")), F.col("l_tax"))
    return C.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(fitted, S.sql_round(score, 4)).otherwise(float("-inf")).alias("score"), S.sql_round(S.block_mdl_delta(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")), 6).alias("delta"),
        S.dominance(F.col("l_quantity"), F.lit(25)).alias("dominance"), S.sql_round(S.sigmoid((F.col("l_quantity") - 25) / 5.0), 6).alias("p"),
    )


@query("SELECT l_returnflag, l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag)) / stddev_pop(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS z FROM lineitem")
def standardised(spark, d):
    """Means and deviations are aggregated and joined; no group meets in one task."""
    rows = C.table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    m = rows.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    return rows.join(m, "l_returnflag").select("l_returnflag", "l_orderkey", "l_linenumber", F.round((F.col("l_quantity") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("SELECT o_orderkey, CAST(CAST('0x' || substr(sha256('v' || (o_orderkey % 3) || ':' || o_custkey || ':' || (o_orderkey // 7200)), 1, 15) AS BIGINT) | (1::BIGINT << 61) AS BIGINT) AS id FROM orders")
def price_primitive_ids(spark, d):
    o = C.table(spark, d, "orders")
    return o.select("o_orderkey", S.price_primitive_id(F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")), F.col("o_custkey").cast("string"), F.floor(F.col("o_orderkey") / 7200)).alias("id"))


@query(EV + ", s AS (SELECT DISTINCT p FROM src), c AS (SELECT p::VARCHAR AS k, 1 AS q FROM s UNION ALL SELECT a.p || ',' || b.p, 2 FROM s a JOIN s b ON a.p < b.p), x AS (SELECT e, p FROM src GROUP BY e, p), n AS (SELECT p::VARCHAR AS k, count(*) AS n FROM x GROUP BY p UNION ALL SELECT a.p || ',' || b.p, count(*) FROM x a JOIN x b ON a.e = b.e AND a.p < b.p GROUP BY a.p, b.p) SELECT k, q, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (k) WHERE k NOT IN ('0', '1,2') ORDER BY n DESC, k LIMIT 5")
def extension_candidates(spark, d):
    """Singletons and their one-predicate extensions, less those already selected, by the entities that have them."""
    has = C.events(spark, d).select("e", "p").distinct().groupBy("e").agg(F.sort_array(F.collect_set("p")).alias("ps"))  # a handful of predicates
    pairs = F.flatten(F.transform("ps", lambda a: F.transform(F.filter("ps", lambda b: b > a), lambda b: F.concat_ws(",", a.cast("string"), b.cast("string")))))
    counts = has.select(F.explode(F.concat(F.transform("ps", lambda a: a.cast("string")), pairs)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    ps = [r["p"] for r in C.events(spark, d).select("p").distinct().collect()]  # the predicates
    keys = [(str(a), 1) for a in ps] + [(f"{a},{b}", 2) for a in ps for b in ps if a < b]
    every = spark.createDataFrame(keys, "k string, q int").where(~F.col("k").isin("0", "1,2"))
    return every.join(counts, "k", "left").select("k", "q", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "k").limit(5)
