"""Predictable states: intervals (start, end] that past events open and close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_intervals(candidates: DataFrame, keys: tuple[str, ...] = ("e",)) -> DataFrame:
    """Overlapping or touching (start, end] of each key as one, with the first one's primitive id."""
    order = W.partitionBy(*keys).orderBy("start", "end", "id")
    opened = candidates.where("start < end").withColumn("reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    island = opened.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("id", F.struct("start", "end", "id")).alias("id")).drop("island")


def history_states(events: DataFrame, entities: DataFrame, transform: str, horizon: int) -> DataFrame:
    """e, start, end, id of a history state of one predicate's events (e, t, id).

    recent: after any event, for the horizon. recurrent: after a gap within the horizon. accelerating and
    decelerating: after a gap shorter or longer than the one before, until the next event at most.
    """
    order = W.partitionBy("e").orderBy("t", "id")
    rows = events.select("e", "t", "id").join(entities.select("e", F.col("end").alias("last")), "e")
    rows = rows.withColumn("prev", F.lag("t").over(order)).withColumn("prev2", F.lag("t", 2).over(order)).withColumn("next", F.lead("t").over(order))
    gap, before = F.col("t") - F.col("prev"), F.col("prev") - F.col("prev2")
    if transform == "recent":
        rows = rows.withColumn("stop", F.least("last", F.col("t") + horizon))
    elif transform == "recurrent":
        rows = rows.where(gap <= horizon).withColumn("stop", F.least("last", F.col("prev") + horizon))
    elif transform in ("accelerating", "decelerating"):
        rows = rows.where(gap < before if transform == "accelerating" else gap > before).withColumn("stop", F.least("last", F.col("t") + horizon, F.coalesce("next", "last")))
    else:
        raise ValueError(transform)
    return merge_intervals(rows.select("e", F.col("t").alias("start"), F.col("stop").alias("end"), "id"))


def transition_states(entries: DataFrame, exits: DataFrame, entities: DataFrame) -> DataFrame:
    """Entry opens if closed, exit closes if open; entries come first at a tick; what stays open ends with the entity."""
    signals = entries.select("e", "t", F.col("id"), F.lit(0).alias("kind")).unionAll(exits.select("e", "t", F.lit(None).cast("bigint").alias("id"), F.lit(1).alias("kind")))
    order = W.partitionBy("e").orderBy("t", "kind", "id")
    changes = signals.withColumn("was", F.coalesce(F.lag("kind").over(order), F.lit(1))).where("kind != was")
    paired = changes.withColumn("stop", F.lead("t").over(order)).where("kind = 0")
    closed = paired.join(entities.select("e", F.col("end").alias("last")), "e").select("e", F.col("t").alias("start"), F.coalesce("stop", "last").alias("end"), "id")
    return closed.where("start < end")


def active_at(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """points (e, t) with active: whether the last interval that starts before t reaches t (as-of, no range join)."""
    marks = intervals.select("e", F.col("start").alias("t"), F.col("end").alias("reach"), F.lit(0).alias("kind")).unionByName(points.select("e", "t", F.lit(None).cast("bigint").alias("reach"), F.lit(1).alias("kind")))
    before = W.partitionBy("e").orderBy("t").rangeBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(F.col("kind") == 0, F.struct("t", "reach"))).over(before)
    return marks.withColumn("last", last).where("kind = 1").select("e", "t", F.coalesce(F.col("last.reach") >= F.col("t"), F.lit(False)).alias("active"))


def state_filter(matches: DataFrame, intervals: DataFrame) -> DataFrame:
    """Completions at which the state is active."""
    flagged = active_at(intervals, matches.select("e", "t").distinct()).where("active").select("e", "t")
    return matches.join(flagged, ["e", "t"], "left_semi")


def gap_horizon(events: DataFrame, quantile: float = 0.9) -> DataFrame:
    """p, horizon: the upper quantile of positive gaps between events of a predicate within an entity, at least 1."""
    gaps = events.withColumn("gap", F.col("t") - F.lag("t").over(W.partitionBy("e", "p").orderBy("t", "id"))).where("gap > 0")
    counted = gaps.groupBy("p", "gap").agg(F.count("*").alias("m"))
    by = W.partitionBy("p")
    ranked = counted.withColumn("hi", F.sum("m").over(by.orderBy("gap"))).withColumn("n", F.sum("m").over(by))
    need = F.ceil(F.round(quantile * (F.col("n") - 1), 9)) + 1
    return ranked.where((F.col("hi") >= need) & (F.col("hi") - F.col("m") < need)).select("p", F.greatest(F.lit(1).cast("bigint"), "gap").alias("horizon"))
