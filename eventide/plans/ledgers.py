"""Queries of the balance and log operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import ledger as G
from eventide.operators import response as P
from eventide.plans.queries import EV, PAIR, _pair, query
from eventide.sources import canonical as C

_ACT = "WITH a AS (SELECT o_custkey AS owner, o_orderkey % 3 AS reserve, epoch_us(o_orderdate) AS time, o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE -100 END AS delta FROM orders)"
_ZERO = """, h AS (SELECT *, sum(delta) OVER (PARTITION BY owner, reserve ORDER BY time, seq) AS held FROM a), t AS (SELECT *, CASE WHEN held > 0 THEN 1 ELSE 0 END - CASE WHEN held - delta > 0 THEN 1 ELSE 0 END AS turn FROM h),
 z AS (SELECT owner, time, seq FROM (SELECT *, sum(turn) OVER (PARTITION BY owner ORDER BY time, seq) AS positive FROM t) WHERE positive = 0)"""


def _actions(spark, d):
    o = C.table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 3).alias("reserve"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("time"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 0, 100).otherwise(-100).alias("delta"))


@query(_ACT + _ZERO + " SELECT owner, time, seq FROM z")
def zero_debt_candidates(spark, d):
    return G.zero_candidates(_actions(spark, d))


@query(_ACT + _ZERO + """, b AS (SELECT owner, time, seq, 0 AS b FROM z UNION ALL SELECT owner, time, seq, 1 FROM a WHERE delta > 0), s AS (SELECT *, sum(b) OVER (PARTITION BY owner ORDER BY time, seq, b DESC ROWS UNBOUNDED PRECEDING) AS segment FROM b)
 SELECT owner, CAST(segment AS BIGINT) AS segment, min(time) AS time FROM s WHERE b = 0 GROUP BY ALL""")
def zero_debt_points(spark, d):
    a = _actions(spark, d)
    return G.zero_points(G.zero_candidates(a), a.where("delta > 0"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey AS k, s_name, s_name IS NOT NULL AS hit FROM lineitem LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 <> 0) ON l_suppkey = s_suppkey")
def cached_dimension_lookup(spark, d):
    jobs = C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"))
    return G.cached_lookup(jobs, C.table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("k"), "s_name"), ["k"])


@query("""WITH l AS (SELECT list_extract(['borrow', 'repay', 'liquidation', 'collateral_enable'], o_orderkey % 4 + 1) AS event_type, o_orderkey AS b, o_custkey + 1 AS c FROM orders)
SELECT event_type, b AS block_number, b % 7 AS log_index, (b << 20) | (b % 100) AS primitive, b // 7200 AS tick, printf('0x%040x', CASE WHEN event_type = 'liquidation' THEN c ELSE b + 1 END) AS reserve,
 printf('0x%040x', CASE WHEN event_type = 'liquidation' THEN c + 1 ELSE c END) AS owner, CASE event_type WHEN 'borrow' THEN printf('0x%040x', c + 2) WHEN 'repay' THEN printf('0x%040x', c + 1) WHEN 'collateral_enable' THEN printf('0x%040x', c) END AS actor,
 CASE WHEN event_type = 'liquidation' THEN printf('0x%040x', b + 1) END AS collateral, CASE event_type WHEN 'borrow' THEN printf('%064x', b) WHEN 'repay' THEN printf('%064x', c + 2) WHEN 'liquidation' THEN printf('%064x', c + 2) END AS amount,
 CASE WHEN event_type = 'borrow' THEN '2' END AS rate_mode FROM l""")
def position_log_decode(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("borrow", "repay", "liquidation", "collateral_enable"))), (F.col("b") % 4 + 1).cast("int"))
    o = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("b"), (F.col("o_custkey") + 1).alias("c"))
    topic = lambda x: F.format_string("0x%064x", x)
    logs = o.select(
        kinds.alias("event_type"), F.col("b").alias("block_number"), (F.col("b") % 7).alias("log_index"), (F.col("b") % 100).alias("transaction_index"),
        F.array(F.lit("0x0"), topic(F.col("b") + 1), topic(F.col("c")), topic(F.col("c") + 1)).alias("topics"), F.format_string("0x%064x%064x%064x", F.col("c") + 2, F.col("b"), F.lit(2)).alias("data"),
    )
    return G.decode_logs(logs)


@query(PAIR + ", r AS (SELECT e, row, count(*)::DOUBLE AS v FROM fut GROUP BY ALL) SELECT e, row, v, round(avg(v) OVER (PARTITION BY row), 6) AS systemic, round(v - avg(v) OVER (PARTITION BY row), 6) AS relative FROM r")
def frequency_channels(spark, d):
    r = P._future(_pair(spark, d), C.entities(spark, d), 6).groupBy("e", "row").agg(F.count("*").cast("double").alias("v"))
    return G.channels(r, "row", "v").withColumn("systemic", F.round("systemic", 6)).withColumn("relative", F.round("relative", 6))


@query(PAIR + ", s AS (SELECT row, count(*) AS s FROM fut GROUP BY row) SELECT row, s, CAST(sum(s) OVER (ORDER BY row RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS BIGINT) AS block FROM s")
def calendar_block_sums(spark, d):
    return G.block_sums(P._future(_pair(spark, d), C.entities(spark, d), 6).select("row", F.lit(1).alias("v")), "row", "v", 12)


@query(EV + " SELECT a.p AS pa, b.p AS pb, c.p AS pc, count(*) AS n FROM src a JOIN src b ON a.e = b.e AND a.p < b.p AND abs(a.t - b.t) <= 24 AND a.id <> b.id JOIN src c ON c.e = a.e AND b.p < c.p AND abs(a.t - c.t) <= 24 AND abs(b.t - c.t) <= 24 AND c.id <> a.id AND c.id <> b.id GROUP BY ALL")
def triple_frontier(spark, d):
    return G.triple_frontier(C.events(spark, d), 24)


@query("SELECT strftime(day, '%Y-%m-%d') AS day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem) ORDER BY day LIMIT 30")
def common_days(spark, d):
    o = C.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    x = C.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return G.common_days(o, x, 30).select(F.date_format("day", "yyyy-MM-dd").alias("day"))
