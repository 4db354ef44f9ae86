"""Strictly-future responses of completions, risk rows, baseline cells and lossless designs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def triangular_basis(lag: int, count: int) -> list[list[float]]:
    """count bumps over lags 1 .. lag, each summing to 1; one bump is uniform."""
    if count == 1:
        return [[1.0 / lag] * lag]
    step = (lag - 1) / (count - 1)
    raw = [[max(0.0, 1.0 - abs(x - 1 - k * step) / step) if step else 1.0 for x in range(1, lag + 1)] for k in range(count)]
    return [[v / sum(r) for v in r] for r in raw]


def _future(matches: DataFrame, entities: DataFrame, lag: int) -> DataFrame:
    """Each completion with every later row up to lag that the entity still has."""
    ended = matches.join(entities.select("e", "end"), "e").where("t < end")
    return ended.select("*", F.explode(F.sequence(F.col("t") + 1, F.least(F.col("t") + lag, "end"))).alias("row"))


def kernel_response(matches: DataFrame, entities: DataFrame, window: int, lag: int, knots: int = 1) -> DataFrame:
    """e, row, v1 .. vM: the sum over completions with span <= window of the basis at row - t."""
    basis = triangular_basis(lag, knots)
    rows = _future(matches.where(F.col("span") <= window), entities, lag)
    values = [F.sum(F.element_at(F.array(*map(F.lit, b)), (F.col("row") - F.col("t")).cast("int"))).alias(f"v{k + 1}") for k, b in enumerate(basis)]
    return rows.groupBy("e", "row").agg(*values)


def responses(matches: DataFrame, rules: DataFrame, entities: DataFrame, lag: int) -> DataFrame:
    """e, row, k, x of many rules at once: kernel_response() with one bump for each row (s, window, k) of rules.

    matches carry s, the number of their pattern; rules, one row for each rule of a dictionary, are broadcast.
    """
    admitted = matches.join(F.broadcast(rules), "s").where(F.col("span") <= F.col("window"))
    return _future(admitted, entities, lag).groupBy("e", "row", "k").agg(F.round(F.count("*") / F.lit(float(lag)), 9).alias("x"))


def footprint(matches: DataFrame, entities: DataFrame, horizon: int) -> DataFrame:
    return _future(matches, entities, horizon).select("e", "row").distinct()


def least_span(matches: DataFrame, entities: DataFrame, horizon: int) -> DataFrame:
    """e, row, span: the smallest span that covers the row; one pass answers every nested window."""
    return _future(matches, entities, horizon).groupBy("e", "row").agg(F.min("span").alias("span"))


def footprint_union(matches: DataFrame, entities: DataFrame, horizon: int) -> DataFrame:
    """Merged half-open ranges [begin, stop) of future rows, without listing rows."""
    ranges = matches.join(entities.select("e", "end"), "e").where("t < end").select("e", (F.col("t") + 1).alias("begin"), F.least(F.col("t") + horizon + 1, F.col("end") + 1).alias("stop"))
    order = W.partitionBy("e").orderBy("begin", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("reach", reach).withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("begin") > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("e", "island").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop")).drop("island")


def continuous_response(matches: DataFrame, entities: DataFrame, edges: Sequence[int]) -> DataFrame:
    """Piecewise constant knots as segments: n_k completions have [begin, stop) within their k-th lag range.

    Each completion adds one at t + 1 + edge_k and takes it back at t + 1 + edge_(k+1); running sums give counts.
    """
    ends = matches.join(entities.select("e", "end"), "e").where("t < end")
    steps = []
    for k in range(len(edges) - 1):
        for edge, sign in ((edges[k], 1), (edges[k + 1], -1)):
            steps.append(F.struct(F.least(F.col("t") + 1 + edge, F.col("end") + 1).alias("at"), *[F.lit(sign if j == k else 0).alias(f"d{j}") for j in range(len(edges) - 1)]))
    names = [f"d{j}" for j in range(len(edges) - 1)]
    moves = ends.select("e", F.explode(F.array(*steps)).alias("s")).select("e", "s.*").groupBy("e", "at").agg(*[F.sum(n).alias(n) for n in names])
    run = W.partitionBy("e").orderBy("at")
    out = moves.select("e", F.col("at").alias("begin"), F.lead("at").over(run).alias("stop"), *[F.sum(n).over(run).alias(f"n{j}") for j, n in enumerate(names)])
    active = F.lit(False)
    for j in range(len(names)):
        active = active | (F.col(f"n{j}") > 0)
    return out.where(F.col("stop").isNotNull() & active)


def mask_lower_order(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Rows of a lower-order rule that no superset covers."""
    return lower.join(upper.select("e", "row").distinct(), ["e", "row"], "left_anti")


def risk_rows(entities: DataFrame) -> DataFrame:
    """One row per entity and tick; the next tick after the first is the first at risk of a response."""
    return entities.select("e", "stratum", "start", F.explode(F.sequence("start", "end")).alias("row"))


def cell(bins: int, row: str = "row", origin: int = 0, width: int = 168) -> Column:
    """Calendar bin of a row: weeks since origin, modulo bins."""
    return F.pmod(F.floor((F.col(row) - origin) / width), F.lit(bins)).cast("int")


def cell_totals(entities: DataFrame, bins: int, width: int = 168) -> DataFrame:
    """stratum, cell, exposure over all rows by interval arithmetic: whole weeks are never listed tick by tick."""
    weeks = entities.select("stratum", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("week"))
    held = F.least(F.col("end"), (F.col("week") + 1) * width - 1) - F.greatest(F.col("start"), F.col("week") * width) + 1
    return weeks.groupBy("stratum", F.pmod("week", F.lit(bins)).cast("int").alias("cell")).agg(F.sum(held).alias("exposure"))


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (e, row) with n, their event count; 0 where there is none."""
    return rows.join(targets.select("e", F.col("t").alias("row"), F.col("mult").alias("n")), ["e", "row"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def complement(entities: DataFrame, targets: DataFrame, active: DataFrame, bins: int) -> DataFrame:
    """stratum, cell, exposure and events of the rows outside active: totals less the active, never enumerated."""
    total = cell_totals(entities, bins)
    event_rows = targets.join(entities.select("e", "stratum"), "e").groupBy("stratum", cell(bins, "t").alias("cell")).agg(F.sum("mult").alias("events"))
    inside = with_targets(active, targets).join(entities.select("e", "stratum"), "e").groupBy("stratum", cell(bins).alias("cell")).agg(F.count("*").alias("a_exposure"), F.sum("n").alias("a_events"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return total.join(event_rows, ["stratum", "cell"], "left").join(inside, ["stratum", "cell"], "left").select(
        "stratum", "cell", (F.col("exposure") - zero("a_exposure")).cast("bigint").alias("exposure"), (zero("events") - zero("a_events")).cast("bigint").alias("events")
    )


def design(entities: DataFrame, targets: DataFrame, response: DataFrame, values: Sequence[str], bins: int) -> DataFrame:
    """Lossless design: distinct (stratum, cell, values) with exposure and events; inactive rows by complement."""
    active = with_targets(response, targets).join(entities.select("e", "stratum"), "e")
    seen = active.groupBy("stratum", cell(bins).alias("cell"), *[F.round(v, 9).alias(v) for v in values]).agg(F.count("*").alias("exposure"), F.sum("n").alias("events"))
    rest = complement(entities, targets, response.select("e", "row"), bins).select("stratum", "cell", *[F.lit(0.0).alias(v) for v in values], "exposure", "events")
    return seen.unionByName(rest).groupBy("stratum", "cell", *values).agg(F.sum("exposure").alias("exposure"), F.sum("events").alias("events"))


def baseline_segments(entities: DataFrame, bins: int, width: int = 168) -> DataFrame:
    """e, cell, begin, stop: half-open runs of one cell within an entity."""
    weeks = entities.select("e", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("week"))
    return weeks.select("e", F.pmod("week", F.lit(bins)).cast("int").alias("cell"), F.greatest("start", F.col("week") * width).alias("begin"), F.least(F.col("end") + 1, (F.col("week") + 1) * width).alias("stop"))


def landmarks(entities: DataFrame, every: int) -> DataFrame:
    """Query times start, start + every ... before the end."""
    return entities.where("start < end").select("e", F.explode(F.sequence("start", F.col("end") - 1, F.lit(every))).alias("t"))


def landmark_counts(points: DataFrame, events: DataFrame, predicates: Sequence[int], history: int) -> DataFrame:
    """points with f<p>: events of each predicate in [t - history, t]."""
    both = events.select("e", "t", "p").unionByName(points.select("e", "t", F.lit(-1).alias("p")))
    past = W.partitionBy("e").orderBy("t").rangeBetween(-history, 0)
    return both.select("e", "t", "p", *[F.count_if(F.col("p") == p).over(past).alias(f"f{p}") for p in predicates]).where("p = -1").drop("p")


def forward_labels(points: DataFrame, targets: DataFrame, horizon: int) -> DataFrame:
    """points with y: 1 if a target lies in (t, t + horizon]."""
    both = targets.select("e", "t", F.lit(1).alias("k")).unionByName(points.select("e", "t", F.lit(0).alias("k")))
    ahead = W.partitionBy("e").orderBy("t").rangeBetween(1, horizon)
    return both.select("e", "t", "k", F.coalesce(F.max("k").over(ahead), F.lit(0)).alias("y")).where("k = 0").drop("k")


def hawkes_states(events: DataFrame, targets: DataFrame, half_life: float) -> DataFrame:
    """e, t, p, s: decayed mass of each predicate's earlier events at every target.

    exp(-b (t - u)) = exp(-b t) exp(b u) overflows over long histories, and a term is below 1e-9 beyond a reach. Time is
    cut into stretches of that reach: events of a stretch are summed with their decay to its end, the running sums per
    tick inside it answer every target there, and the next stretch is answered by the whole less what is out of reach.
    No target meets single events.
    """
    import math

    rate = math.log(2) / half_life
    reach = int(math.ceil(math.log(1e9) / rate))
    begin = F.col("stretch") * reach  # weights are relative to the beginning of a stretch, at most 1e9 inside it
    mass = events.groupBy("e", "p", F.col("t").alias("u")).agg(F.count("*").alias("n")).withColumn("stretch", F.floor(F.col("u") / reach))
    mass = mass.select("e", "p", "stretch", "u", (F.col("n") * F.exp(rate * (F.col("u") - begin))).alias("w"))
    # every target asks its own stretch for what came before it, and the one before for what is still in reach
    a = targets.select("e", "t").distinct().withColumn("_own", F.floor(F.col("t") / reach)).withColumn("stretch", F.explode(F.array(F.col("_own"), F.col("_own") - 1)))
    asked = a.join(mass.select("e", "p", "stretch").distinct(), ["e", "stretch"])
    at = F.when(F.col("stretch") == F.col("_own"), F.col("t") - 1).otherwise(F.col("t") - reach - 1)  # own: up to here; before: beyond here
    both = mass.select("e", "p", "stretch", "u", "w", F.lit(None).cast("bigint").alias("t"), F.lit(0).alias("own")).unionByName(
        asked.select("e", "p", "stretch", at.alias("u"), F.lit(None).cast("double").alias("w"), "t", (F.col("stretch") == F.col("_own")).cast("int").alias("own"))
    )
    keyed = W.partitionBy("e", "p", "stretch").orderBy("u")
    upto = F.sum("w").over(keyed.rangeBetween(W.unboundedPreceding, 0))
    beyond = F.sum("w").over(keyed.rangeBetween(1, W.unboundedFollowing))
    parts = both.withColumn("x", F.when(F.col("own") == 1, upto).otherwise(beyond)).where("t is not null and x is not null")
    return parts.groupBy("e", "t", "p").agg(F.sum(F.col("x") * F.exp(-rate * (F.col("t") - begin))).alias("s"))


def hawkes_mass(events: DataFrame, entities: DataFrame, half_life: float) -> DataFrame:
    """p, mass: the integral of each source's kernel to its entity's end, in closed form."""
    import math

    rate = math.log(2) / half_life
    return events.join(entities.select("e", "end"), "e").groupBy("p").agg(F.sum((1 - F.exp(-rate * (F.col("end") - F.col("t")))) / rate).alias("mass"))
