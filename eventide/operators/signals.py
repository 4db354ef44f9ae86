"""Ordered scalar signals: quantiles by weight, hysteresis, volatility, market states, prequential shocks.

Inputs have a key column k (a day, an instrument, an entity), an integer time t, and a value v.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.operators.ranks import running


def duration_weights(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """rows (k, t, v) with w, the time until the next row or until the end of the session (k, stop)."""
    return rows.join(ends, "k").withColumn("w", F.lead("t").over(W.partitionBy("k").orderBy("t"))).withColumn("w", F.greatest(F.lit(0).cast("bigint"), F.least("stop", F.coalesce("w", "stop")) - F.col("t"))).drop("stop")


def weighted_quantile(rows: DataFrame, keys: Sequence[str], value: str, weight: str, q: float) -> DataFrame:
    """keys, value: the smallest value whose cumulative weight reaches q of the total; NaN and weights <= 0 are dropped."""
    clean = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    ranked = running(clean, [value], "_w", "_b", "_t", keys)
    return ranked.where(F.col("_b") + F.col("_w") >= q * F.col("_t")).groupBy(*keys).agg(F.min(value).alias("value"))


def percentile_profile(rows: DataFrame, value: str, weight: str, knots: int = 100) -> DataFrame:
    """knot, prob: values at 0 .. knots percent of cumulative weight, each with its largest probability."""
    clean = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(value).agg(F.sum(weight).alias("_w"))
    ranked = running(clean, [value], "_w", "_b", "_t").withColumn("_c", F.col("_b") + F.col("_w"))
    steps = ranked.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(knots))))
    hit = steps.where((F.col("_c") >= F.col("i") / knots * F.col("_t")) & ((F.col("_b") < F.col("i") / knots * F.col("_t")) | ((F.col("i") == 0) & (F.col("_b") == 0))))
    return hit.groupBy(F.col(value).alias("knot")).agg((F.max("i") / knots).alias("prob"))


def stress_score(rows: DataFrame, channels: Sequence[str], profiles: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """rows with score: the mean over channels of the profile's CDF, linear between knots, 0 left and 1 right."""
    parts = []
    for c in channels:
        knots = profiles[c]
        out = F.when(F.col(c) < knots[0][0], 0.0)
        for (a, p), (b, r) in zip(knots, knots[1:], strict=False):
            out = out.when(F.col(c) < b, p + (F.col(c) - a) / (b - a) * (r - p))
        parts.append(out.when(F.col(c) == knots[-1][0], knots[-1][1]).otherwise(1.0))
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return rows.withColumn("score", total / len(parts))


def schmitt(rows: DataFrame, high: Column, low: Column, keys: Sequence[str] = ("k",), order: Sequence[str] = ("t",)) -> DataFrame:
    """rows with state 1 after a high signal until a low one, and fired where it turns to 1: a two-threshold trigger."""
    signal = F.when(high, 1).when(low, 0)
    sofar = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_s", signal)
    rows = rows.withColumn("state", F.coalesce(F.last("_s", ignorenulls=True).over(sofar), F.lit(0))).withColumn("_was", F.coalesce(F.last("_s", ignorenulls=True).over(before), F.lit(0)))
    return rows.withColumn("fired", (F.col("state") == 1) & (F.col("_was") == 0)).withColumn("released", (F.col("state") == 0) & (F.col("_was") == 1)).drop("_s", "_was")


def hysteresis_targets(rows: DataFrame, threshold: float, rearm: float, downward: bool = False) -> DataFrame:
    """k, t of crossings of the threshold while armed; armed again beyond rearm * threshold."""
    v = -F.col("v") if downward else F.col("v")
    return schmitt(rows, v >= threshold, v < rearm * threshold).where("fired").select("k", "t")


def context_transitions(rows: DataFrame, threshold: float, middle: float, upward: bool = True) -> DataFrame:
    """k, t, code: 1 when the state is entered at the threshold, 0 when it is left at the middle."""
    v = F.col("v")
    high, low = (v >= threshold, v < middle) if upward else (v <= threshold, v > middle)
    return schmitt(rows, high, low).where("fired or released").select("k", "t", F.col("fired").cast("int").alias("code"))


def regime_transitions(rows: DataFrame, channels: dict[str, tuple[float, float]]) -> DataFrame:
    """k, t, net: the sum over channels of state changes per row, where it is not 0; a first row only initialises."""
    order = W.partitionBy("k").orderBy("t")
    out = rows
    for c, (high, low) in channels.items():
        out = schmitt(out, F.col(c) >= high, F.col(c) < low).withColumnRenamed("state", f"_{c}").drop("fired", "released")
    net = F.lit(0)
    for c in channels:
        net = net + F.col(f"_{c}") - F.lag(f"_{c}").over(order)
    return out.withColumn("net", net).where("net <> 0").select("k", "t", F.col("net").cast("int").alias("net"))


def market_states(rows: DataFrame, low: float, middle: float, high: float) -> DataFrame:
    """rows with stressed and calm: entered at high or low, held until the middle is crossed, never both.

    Extreme rows open groups; inside a group the state holds while the running minimum (maximum) stays beyond.
    """
    order = W.partitionBy("k").orderBy("t")
    sofar = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_g", F.count_if((F.col("v") >= high) | (F.col("v") <= low)).over(sofar))
    inside = W.partitionBy("k", "_g").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    first = F.first("v").over(inside)
    rows = rows.withColumn("_f", first).withColumn("_lo", F.min("v").over(inside)).withColumn("_hi", F.max("v").over(inside))
    return rows.withColumn("stressed", (F.col("_g") > 0) & (F.col("_f") >= high) & (F.col("_lo") >= middle)).withColumn("calm", (F.col("_g") > 0) & (F.col("_f") <= low) & (F.col("_hi") <= middle)).drop("_g", "_f", "_lo", "_hi")


def last_per_tick(rows: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """k, t, v: the last update of each tick."""
    return rows.groupBy("k", "t").agg(F.max_by("v", F.struct(*order)).alias("v"))


def past_return(rows: DataFrame, horizon: int) -> DataFrame:
    """rows with past, the last value at or before t - horizon, and r, the log return since; null without one."""
    both = rows.select("k", "t", "v", F.lit(1).alias("q")).unionByName(rows.select("k", (F.col("t") + horizon).alias("t"), "v", F.lit(0).alias("q")))
    sofar = W.partitionBy("k").orderBy("t", "q").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("past", F.last(F.when(F.col("q") == 0, F.col("v")), ignorenulls=True).over(sofar)).where("q = 1")
    return out.select("k", "t", "v", "past", F.when((F.col("past") > 0) & (F.col("v") > 0), F.log(F.col("v") / F.col("past"))).alias("r"))


def realized_variance(rows: DataFrame, horizon: int) -> DataFrame:
    """k, t, rv: the sum of squared jumps in (t - horizon, t], where it changes: at jumps and when they leave.

    Squares are decimals, so what enters and leaves cancels exactly in any order of summation.
    """
    jumps = rows.withColumn("j", F.col("v") - F.lag("v").over(W.partitionBy("k").orderBy("t"))).where("j is not null and j <> 0").withColumn("d", F.round(F.col("j") * F.col("j"), 4).cast("decimal(24,4)"))
    moves = jumps.select("k", "t", "d").unionByName(jumps.select("k", (F.col("t") + horizon).alias("t"), (-F.col("d")).alias("d")))
    return moves.groupBy("k", "t").agg(F.sum("d").alias("d")).select("k", "t", F.sum("d").over(W.partitionBy("k").orderBy("t")).cast("double").alias("rv"))


def prequential_shocks(rows: DataFrame, level: float) -> DataFrame:
    """k, t, sign of changes as large as all but a share level of the past: p = (1 + larger before) / (1 + before).

    The rank among the past is a range join of each key's changes with its earlier ones; long histories go
    through folds.prequential_fold instead, which keeps a sorted past.
    """
    order = W.partitionBy("k").orderBy("t")
    changes = rows.withColumn("d", F.col("v") - F.lag("v").over(order)).where("d is not null and d <> 0").withColumn("i", F.row_number().over(order))
    past = changes.select(F.col("k").alias("pk"), F.col("i").alias("pi"), F.abs("d").alias("pd"))
    ranked = changes.join(past, (F.col("k") == F.col("pk")) & (F.col("pi") < F.col("i")) & (F.col("pd") >= F.abs("d")), "left").groupBy("k", "t", "i", "d").agg(F.count("pi").alias("larger"))
    return ranked.where((1 + F.col("larger")) <= level * F.col("i")).select("k", "t", F.signum("d").cast("int").alias("sign"))


def action_mix(rows: DataFrame, span: int, kinds: Sequence[str]) -> DataFrame:
    """rows (k, t, id, kind) with n_<kind>: earlier rows of each kind within span, strictly before in arrival order.

    A range frame over (t, id) would lose ties of t, so same-time rows that arrive later are taken off again.
    """
    past = W.partitionBy("k").orderBy("t").rangeBetween(-span, 0)
    tied = W.partitionBy("k", "t").orderBy("id").rowsBetween(0, W.unboundedFollowing)
    return rows.select("*", *[(F.count_if(F.col("kind") == x).over(past) - F.count_if(F.col("kind") == x).over(tied)).alias(f"n_{x}") for x in kinds])


def risk_intervals(boundaries: DataFrame, ticks_per_unit: float) -> DataFrame:
    """k, t, exposure: half-open intervals between distinct boundaries (k, t)."""
    order = W.partitionBy("k").orderBy("t")
    return boundaries.select("k", "t").distinct().withColumn("next", F.lead("t").over(order)).where("next is not null").select("k", "t", ((F.col("next") - F.col("t")) / ticks_per_unit).alias("exposure"))
