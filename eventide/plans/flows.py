"""Whole analyses as queries: fit, search, certification, ensemble, Hawkes process, landmark models, folds, streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators import folds
from eventide.operators import relational as R
from eventide.operators import response as P
from eventide.plans import model as L
from eventide.plans.queries import _signal, query
from eventide.sources import canonical as C


#: Target rows that the driver fits itself; more are fitted by aggregations.
COLLECTED = 500_000


def data(spark: SparkSession, d: str, **settings) -> L.Data:
    keep = lambda df: df.persist()
    return L.Data(keep(C.events(spark, d)), keep(C.targets(spark, d)), keep(C.entities(spark, d)), **settings)


@query()
def rule_fit(spark, d) -> DataFrame:
    """Does click-then-purchase within a day raise the error rate? Null and full likelihood, effect and MDL score."""
    x = data(spark, d)
    rule = L.Rule((0, 1), "ordered", 24)
    base, full = L.fit(x, ()), L.fit(x, (rule,))
    cost = L.penalty((rule,), 40, 4, x.entities.count())
    row = (rule.key(), float(base.nll), float(full.nll), float(full.beta[0]), float(2 * (base.nll - full.nll) - cost), full.converged)
    x.close()
    return spark.createDataFrame([row], "rule string, nll0 double, nll double, beta double, score double, converged boolean")


def _searched(spark, d):
    x = data(spark, d)
    fitting = x.only(0)
    records = L.search(fitting, L.dictionary(range(len(C.PREDICATES)), (6, 24), 3), 2)
    return x, fitting, records


@query()
def rule_search(spark, d) -> DataFrame:
    _, fitting, records = _searched(spark, d)
    rows = [(L.support_key(r.support), float(r.fit.nll), float(r.penalty), float(r.score)) for r in records]
    fitting.close()
    return spark.createDataFrame(rows, "support string, nll double, penalty double, score double")


@query()
def rule_certificates(spark, d) -> DataFrame:
    x, fitting, records = _searched(spark, d)
    base = L.fit(fitting, ())
    got = L.certify(x.only(1), base, records, resamples=20_000)
    fitting.close()
    return spark.createDataFrame([(c.key, *map(float, (c.f1, c.f2, c.f3_lower, c.p_max, c.p_adjusted)), bool(c.certified)) for c in got], "support string, f1 double, f2 double, f3_lower double, p_max double, p_adjusted double, certified boolean")


@query()
def rule_ensemble(spark, d) -> DataFrame:
    x, fitting, records = _searched(spark, d)
    both = x.only(0, 1)
    base = L.fit(both, ())
    fits = [L.fit(both, r.support) for r in records[:3]]
    w = L.mixture(both, base, fits)
    names = ["empty", *[L.support_key(f.rules) for f in fits]]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, w, strict=True)], "component string, weight double")


@query()
def hawkes_fit(spark, d) -> DataFrame:
    e, t, n = C.events(spark, d), C.targets(spark, d), C.entities(spark, d)
    wide = P.hawkes_states(e, t, 24.0).groupBy("e", "t").pivot("p", [0, 1, 2, 3]).agg(F.first("s"))
    rows = t.join(wide, ["e", "t"], "left").fillna(0.0)
    mass = {r["p"]: r["mass"] for r in P.hawkes_mass(e, n, 24.0).collect()}
    mass = np.array([mass.get(p, 0.0) for p in range(4)])
    exposure = float(n.agg(F.sum(F.col("end") - F.col("start") + 1)).first()[0])
    few = rows.limit(COLLECTED + 1).collect()
    if len(few) > COLLECTED:
        mu, a, nll, converged = L.hawkes_fit_distributed(rows, ["0", "1", "2", "3"], mass, exposure)
    else:
        states = np.array([[r[str(p)] for p in range(4)] for r in few], dtype=float)
        mu, a, nll, converged = L.hawkes_fit(states, np.array([r["mult"] for r in few], dtype=float), mass, exposure)
    return spark.createDataFrame([("base", float(mu), float(nll), converged), *[(f"p{p}", float(v), float(nll), converged) for p, v in enumerate(a)]], "parameter string, value double, nll double, converged boolean")


def _landmarks(spark, d):
    e, t, n = C.events(spark, d), C.targets(spark, d), C.entities(spark, d)
    points = P.landmarks(n, 12)
    return P.landmark_counts(points, e, range(4), 48).join(P.forward_labels(points, t, 24), ["e", "t"]).join(n.select("e", "part"), "e")


@query()
def landmark_logistic(spark, d) -> DataFrame:
    """Fit on partition 0, scored once on partition 2."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=[f"f{p}" for p in range(4)], outputCol="x").transform(_landmarks(spark, d)).withColumn("y", F.col("y").cast("double"))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-3, maxIter=50).fit(rows.where("part = 0"))
    scored = model.transform(rows.where("part = 2")).select("y", vector_to_array("probability")[1].alias("p"))
    return R.classification_metrics(scored, "y", "p")


@query()
def landmark_boosted(spark, d) -> DataFrame:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=[f"f{p}" for p in range(4)], outputCol="x").transform(_landmarks(spark, d)).withColumn("y", F.col("y").cast("double"))
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(rows.where("part = 0"))
    return R.classification_metrics(model.transform(rows.where("part = 2")).select("y", vector_to_array("probability")[1].alias("p")), "y", "p")


@query()
def rule_landmark_scores(spark, d) -> DataFrame:
    """p = 1 - exp(-h * rate) at the first row after each landmark, of a rule fitted on partition 0."""
    x = data(spark, d)
    rule = (L.Rule((0, 1), "ordered", 24),)
    f = L.fit(x.only(0), rule)
    points = P.landmarks(x.entities, 12).join(x.entities.where("part = 2").select("e", "stratum"), "e")
    at = points.withColumn("row", F.col("t") + 1).join(x.active(rule), ["e", "row"], "left").fillna(0.0, ["x0"])
    base, cell = F.lit(-20.0), P.cell(x.bins)
    for (s, c), b in f.cells.items():
        base = F.when((F.col("stratum") == s) & (cell == c), b).otherwise(base)
    scored = at.select("e", "t", (-F.expm1(-24 * F.exp(base + float(f.beta[0]) * F.col("x0")))).alias("p"))
    labels = P.forward_labels(points.select("e", "t"), x.targets, 24)
    return R.classification_metrics(scored.join(labels, ["e", "t"]), "y", "p")


@query()
def order_book_events(spark, d) -> DataFrame:
    """A book rebuilt from order lines as messages: orders add, returned lines delete."""
    l = C.table(spark, d, "lineitem").select(  # noqa: E741
        F.date_format("l_shipdate", "yyyy-MM").alias("day"), F.col("l_orderkey").alias("time"), F.col("l_linenumber").cast("bigint").alias("seq"), (100 + F.col("l_suppkey") % 20).alias("price"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_quantity").cast("bigint")).alias("agg_volume"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(2).alias("side"), F.lit("2").alias("order_type"),
        F.when(F.col("l_returnflag") == "R", "D").when(F.col("l_linestatus") == "F", "M").otherwise("A").alias("action_type"),
    )
    return folds.order_book(l).groupBy("day", "code").agg(F.count("*").alias("n"))


def _actions(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("borrow", "repay", "supply", "withdraw", "collateral_enable", "liquidation"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return C.table(spark, d, "orders").select(
        F.col("o_custkey").alias("owner"), kinds.alias("kind"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("time"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3).alias("reserve"),
        F.col("o_totalprice").cast("bigint").alias("amount"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("actor"), F.date_format("o_orderdate", "yyyy-MM").alias("tx"),
    )


@query()
def debt_episodes(spark, d) -> DataFrame:
    return folds.debt_episodes(_actions(spark, d))


@query("""WITH u AS (SELECT user_id AS k, epoch_us(ts) AS t, event_id AS id, value AS v FROM events), s AS (SELECT k, t, arg_max(v, id) AS v FROM u WHERE v IS NOT NULL GROUP BY k, t), c AS (SELECT k, t, v - lag(v) OVER (PARTITION BY k ORDER BY t) AS d FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t) AS i FROM c WHERE d <> 0)
 SELECT k, t, CAST(sign(d) AS INTEGER) AS sign FROM (SELECT n.*, (SELECT count(*) FROM n b WHERE b.k = n.k AND b.i < n.i AND abs(b.d) >= abs(n.d)) AS larger FROM n) WHERE 1 + larger <= 0.1 * i""")
def prequential_fold(spark, d) -> DataFrame:
    return folds.prequential_fold(_signal(spark, d), 0.1)
