"""Operators on keyed tables: offsets, exact interval matches, running sums by ranges, bounds, merges, risk-set sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import scalar as S
from eventide.operators.ranks import running


def running_total(rows: DataFrame, key: str, value: str, out: str, width: int = 4096) -> DataFrame:
    """rows (one per integer key) with out, the sum of value over smaller keys.

    Keys are cut into ranges of width. Only the sums of the ranges are ordered in one task; rows are ordered
    within their range.
    """
    block = F.floor(F.col(key) / width)
    sums = rows.groupBy(block.alias("_b")).agg(F.sum(value).alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_b").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_b", block).join(before, "_b").withColumn(out, (F.col("_before") + inside).cast("bigint")).drop("_b", "_before")


def row_offsets(entities: DataFrame) -> DataFrame:
    """e, start, end, offset: the number of the entity's first risk row when all entities' rows are numbered on."""
    return running_total(entities.select("e", "start", "end", (F.col("end") - F.col("start") + 1).alias("_n")), "e", "_n", "offset").drop("_n")


def to_rows(points: DataFrame, offsets: DataFrame) -> DataFrame:
    """points (e, t) with id, the number of their risk row; null outside the entity's rows."""
    return points.join(offsets, "e").withColumn("id", F.when(F.col("t").between(F.col("start"), F.col("end")), F.col("offset") + F.col("t") - F.col("start"))).drop("start", "end", "offset")


def from_rows(ids: DataFrame, offsets: DataFrame, width: int = 4096) -> DataFrame:
    """ids (id) with e and t. Numbers are cut into stretches, so the range join has an equality to go by."""
    spans = offsets.withColumn("last", F.col("offset") + F.col("end") - F.col("start"))
    spans = spans.withColumn("_s", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor(F.col("last") / width))))
    met = ids.withColumn("_s", F.floor(F.col("id") / width)).join(spans, "_s").where(F.col("id").between(F.col("offset"), F.col("last")))
    return met.select("id", "e", (F.col("start") + F.col("id") - F.col("offset")).alias("t"))


def interval_positions(times: DataFrame, boundaries: DataFrame, allow_right: bool = False) -> DataFrame:
    """times (e, t) with position, the index of the boundary (e, t) that they equal, and ok, false where there is none.

    The last boundary closes the entity; it is a position only with allow_right.
    """
    by = W.partitionBy("e").orderBy("t")
    numbered = boundaries.select("e", "t").distinct().select("e", "t", (F.row_number().over(by) - 1).cast("bigint").alias("position"), F.lead("t").over(by).isNull().alias("_last"))
    met = times.join(numbered, ["e", "t"], "left")
    if not allow_right:
        met = met.withColumn("position", F.when(~F.col("_last"), F.col("position")))
    return met.withColumn("ok", F.col("position").isNotNull()).drop("_last")


def exclusive_masks(rows: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """rows with member (the mask that holds, null for none) and ok, false where several hold."""
    held = sum((m.cast("int") for m in masks.values()), F.lit(0))
    return rows.withColumn("member", F.when(held == 1, F.coalesce(*[F.when(m, F.lit(n)) for n, m in masks.items()]))).withColumn("ok", held <= 1)


def cohort_check(full: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """One row: entities of the reference, those that full lacks, and whether the reference is a strict subset."""
    a, b = full.select(key).distinct(), reference.select(key).distinct()
    n = a.agg(F.count("*").alias("n_full")).crossJoin(b.agg(F.count("*").alias("n_reference"))).crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("n_outside")))  # one row each
    return n.withColumn("strict", (F.col("n_outside") == 0) & (F.col("n_reference") < F.col("n_full")))


def normal_pattern(pattern: Column, relation: Column) -> tuple[Column, Column]:
    """A pattern and its relation: auto is atomic or unordered, one predicate is atomic, unordered ones are sorted."""
    kind = F.when(F.size(pattern) == 1, "atomic").when(relation == "auto", "unordered").otherwise(relation)
    return F.when(kind == "unordered", F.sort_array(pattern)).otherwise(pattern), kind


def rule_structure(rules: DataFrame) -> DataFrame:
    """How many rules (pattern, relation, sign) there are of each order, relation and sign."""
    return rules.groupBy(F.size("pattern").alias("order"), "relation", "sign").agg(F.count("*").alias("n"))


def bounded_order(rows: DataFrame, keys: Sequence[str], span: str, seq: str, cap: int) -> DataFrame:
    """rows of a span up to cap with place, their index by span and then seq within the keys."""
    return rows.where(F.col(span) <= cap).withColumn("place", (F.row_number().over(W.partitionBy(*keys).orderBy(span, seq)) - 1).cast("bigint"))


def certified_queue(bounds: DataFrame, key: str, bound: str, threshold: float, first: int) -> DataFrame:
    """The keys with the largest upper bounds: each with its tightest one, those at or below the threshold gone."""
    return bounds.groupBy(key).agg(F.min(bound).alias(bound)).where(F.col(bound) > threshold).orderBy(F.desc(bound), key).limit(first)


def overlap_components(intervals: DataFrame) -> DataFrame:
    """e, begin, stop, n of each set of intervals (e, begin, stop inclusive) that overlap, transitively."""
    by = W.partitionBy("e").orderBy("begin", "stop")
    opens = (F.col("begin") > F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))).cast("int")
    marked = intervals.select("e", "begin", "stop", F.coalesce(opens, F.lit(0)).alias("_o")).withColumn("_c", F.sum("_o").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("e", "_c").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.count("*").alias("n")).drop("_c")


def risk_set_sums(entities: DataFrame, weight: Column, out: str) -> DataFrame:
    """t, out: the sum of a weight over the entities at risk, at every tick where the risk set changes.

    Entries add and exits subtract; only the ticks with a change are ordered, by ranges.
    """
    moves = entities.select(F.col("start").alias("t"), weight.alias("x")).unionAll(entities.select(F.col("end") + 1, -weight)).groupBy("t").agg(F.sum("x").alias("x"))
    return running(moves, ["t"], "x", "_b", "_n").select("t", (F.col("_b") + F.col("x")).alias(out))


#: Words of a reserve update, in order.
RATES = ("liquidity_rate", "stable_rate", "variable_rate", "liquidity_index", "variable_index")  # fixed values


def decode_market_logs(logs: DataFrame) -> DataFrame:
    """Reserve updates: reserve, tick, primitive and five rates; rates exceed 64 bits and are exact decimals where they fit 38 digits."""
    def number(word: Column) -> Column:
        """A word as a decimal, from its upper and lower 15 hex digits of the last 30; null beyond."""
        part = lambda a, n: F.conv(F.substring(word, a, n), 16, 10).cast("decimal(38,0)")
        return F.when(F.length(F.ltrim(word, F.lit("0"))) <= 30, part(35, 15) * F.lit(16**15).cast("decimal(19,0)") + part(50, 15))

    return logs.select(
        S.word_address(F.get("topics", F.lit(1))).alias("reserve"), "block_number", F.floor(F.col("block_number") / 7200).alias("tick"), S.primitive_id(F.col("block_number"), F.col("transaction_index")).alias("primitive"),
        *[number(S.data_word(F.col("data"), k)).cast("decimal(38,0)").alias(n) for k, n in enumerate(RATES)],
    )


def saturated_loss(design: DataFrame) -> Column:
    """Poisson loss of a row of an aggregated design at its own best rate: no model over the same signatures does better."""
    return F.when(F.col("events") > 0, F.col("events") - F.col("events") * F.log(F.col("events") / F.col("exposure"))).otherwise(0.0)


def quadratic_gain(g: Sequence[Column], h: Sequence[Sequence[Column]]) -> Column:
    """max over x >= 0 of g.x - x.H.x / 2 for two coordinates, by the cases of which are positive."""
    one = [F.when((g[k] > 0) & (h[k][k] > 0), g[k] * g[k] / (2 * h[k][k])).otherwise(0.0) for k in (0, 1)]
    det = h[0][0] * h[1][1] - h[0][1] * h[0][1]
    x, y = (h[1][1] * g[0] - h[0][1] * g[1]) / det, (h[0][0] * g[1] - h[0][1] * g[0]) / det
    both = F.when((det > 0) & (x > 0) & (y > 0), (g[0] * x + g[1] * y) / 2).otherwise(0.0)
    return F.greatest(*one, both)
