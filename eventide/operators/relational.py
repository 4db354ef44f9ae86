"""Generic joins, set operations, splits, validation and metrics of the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.operators.ranks import running


def interval_exposure(intervals: DataFrame, shocks: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """e, t, code, id: shocks (keys, t, code, id) strictly inside intervals (keys, e, start, end); the smallest id each.

    Equal keys carry the join; the open range is a residual condition on the co-located rows. With few keys, width cuts
    time into stretches that become a key too; the result is the same with any width.
    """
    on = list(keys)
    if width:
        stretch = lambda c: F.floor(F.col(c) / width)
        intervals = intervals.where("start < end").withColumn("_s", F.explode(F.sequence(stretch("start"), stretch("end"))))
        shocks, on = shocks.withColumn("_s", stretch("t")), [*on, "_s"]
    met = intervals.join(shocks, on).where((F.col("t") > F.col("start")) & (F.col("t") < F.col("end")))
    return met.groupBy("e", "t", "code").agg(F.min("id").alias("id"))


def first_mask(rows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """rows with is_first, true for all rows tied at the group's earliest time."""
    return rows.withColumn("is_first", F.col(time) == F.min(time).over(W.partitionBy(*keys)))


def next_row(points: DataFrame, rows: DataFrame) -> DataFrame:
    """points (e, t) with row, the first risk row (e, row) after t; null past the end."""
    both = points.select("e", "t", F.lit(0).alias("k")).unionByName(rows.select("e", F.col("row").alias("t"), F.lit(1).alias("k")))
    ahead = W.partitionBy("e").orderBy("t").rangeBetween(1, W.unboundedFollowing)
    return both.withColumn("row", F.min(F.when(F.col("k") == 1, F.col("t"))).over(ahead)).where("k = 0").select("e", "t", "row")


def squared_distance(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """d: the squared distance of two sparse profiles over the union of their rows."""
    a, b = left.select(*keys, F.col(value).alias("_a")), right.select(*keys, F.col(value).alias("_b"))
    return a.join(b, list(keys), "full_outer").agg(F.sum(F.pow(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)), F.lit(2))).alias("d"))


def candidate_entities(matches: DataFrame, window: int) -> DataFrame:
    """Entities whose least span is within the window."""
    return matches.groupBy("e").agg(F.min("span").alias("span")).where(F.col("span") <= window)


def ordered_partition(rows: DataFrame, order: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """rows with part by place: 0, 1, 2 at the nearest cumulative fractions of all rows, each at least one row."""
    n = F.col("_n")
    first = F.greatest(F.lit(1), F.least(n - 2, F.round(n * fractions[0])))
    second = F.greatest(first + 1, F.least(n - 1, F.round(n * (fractions[0] + fractions[1]))))
    placed = running(rows.withColumn("_one", F.lit(1)), order, "_one", "_i", "_n")
    return placed.withColumn("part", F.when(F.col("_i") < first, 0).when(F.col("_i") < second, 1).otherwise(2)).drop("_i", "_n", "_one")


def month_partition(days: DataFrame, seed: int, fractions: Sequence[float]) -> DataFrame:
    """days (day) with part: each month by largest remainders, inside it in the order of a seeded hash."""
    month = F.date_trunc("month", "day")
    by = W.partitionBy("_m")
    out = days.withColumn("_m", month).withColumn("_n", F.count("*").over(by)).withColumn("_i", F.row_number().over(by.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.date_format("day", "yyyy-MM-dd")), 256))))
    exact = [F.round(F.col("_n") * f, 9) for f in fractions]
    base = [F.floor(x).cast("int") for x in exact]
    left = F.col("_n") - base[0] - base[1] - base[2]
    part = [F.round(x - b, 9) for x, b in zip(exact, base, strict=True)]
    rank = [sum(((part[j] > part[k]) | ((part[j] == part[k]) & F.lit(j < k))).cast("int") for j in range(3) if j != k) for k in range(3)]
    size = [base[k] + F.when(rank[k] < left, 1).otherwise(0) for k in range(3)]
    return out.withColumn("part", F.when(F.col("_i") <= size[0], 0).when(F.col("_i") <= size[0] + size[1], 1).otherwise(2)).drop("_m", "_n", "_i")


def case_cohort(entities: DataFrame, targets: DataFrame, sample: int, seed: int) -> DataFrame:
    """e, weight: all entities with a target, and exactly sample others by a seeded hash, weighted by 1 / inclusion."""
    cases = entities.join(targets, "e", "left_semi").select("e", F.lit(1.0).alias("weight"))
    rest = entities.join(targets, "e", "left_anti").select("e")
    n = rest.agg(F.count("*").alias("n"))
    taken = rest.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("e").cast("string")), 256)).limit(sample)
    return cases.unionByName(taken.join(F.broadcast(n)).select("e", (F.greatest(F.lit(1.0), F.col("n") / sample)).alias("weight")))


def merge_datasets(parts: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Union of entity tables (source, part, e) with code: a dense new key in the given order, whose last column tells most rows apart."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    placed = running(out.withColumn("_one", F.lit(1)), order, "_one", "code", "_n", at=len(order) - 1)
    return placed.withColumn("code", F.col("code").cast("bigint")).drop("_one", "_n")


def segment_sequence(rows: DataFrame, longest: int, context: int) -> DataFrame:
    """rows (e, t) in overlapping segments of at most longest rows that share context rows with the one before."""
    stride = longest - context
    i = F.row_number().over(W.partitionBy("e").orderBy("t", "id")) - 1
    n = F.count("*").over(W.partitionBy("e"))
    last = F.greatest(F.lit(0), F.ceil((n - longest) / stride)).cast("int")
    placed = rows.withColumn("_i", i).withColumn("_last", last)
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - longest + 1) / stride)).cast("int")
    high = F.least(F.col("_last"), F.floor(F.col("_i") / stride).cast("int"))
    out = placed.withColumn("_low", low).withColumn("_high", high).where("_low <= _high").withColumn("segment", F.explode(F.sequence("_low", "_high")))
    return out.withColumn("offset", (F.col("t") - F.min("t").over(W.partitionBy("e", "segment"))).cast("bigint")).drop("_i", "_last", "_low", "_high")


def merged_sequence(events: DataFrame, targets: DataFrame) -> DataFrame:
    """e, t, kind, segment: sources and targets in order, targets first at a tick, a new segment after each target."""
    both = events.select("e", "t", F.col("p").alias("kind"), "id").unionByName(targets.select("e", "t", F.lit(-1).alias("kind"), F.lit(0).cast("bigint").alias("id")))
    before = W.partitionBy("e").orderBy("t", "kind", "id").rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("segment", F.coalesce(F.count_if(F.col("kind") == -1).over(before), F.lit(0)))


def violations(entities: DataFrame, events: DataFrame, targets: DataFrame) -> DataFrame:
    """rule, n: how many rows break each invariant of the canonical tables; one aggregation per table."""
    bounds = entities.select("e", "start", "end")
    ent = entities.agg(F.count_if(F.col("start") > F.col("end")).alias("entity_bounds"), F.count_if(F.col("part").isNull() | ~F.col("part").isin(0, 1, 2)).alias("partition_code"), (F.count("*") - F.count_distinct("e")).alias("entity_unique"))
    joined = events.join(bounds, "e", "left")
    evt = joined.agg(F.count_if(F.col("start").isNull()).alias("event_entity"), F.count_if((F.col("t") < F.col("start")) | (F.col("t") > F.col("end"))).alias("event_bounds"), (F.count("*") - F.count_distinct("e", "t", "p", "id")).alias("event_unique"))
    prim = events.groupBy("e", "id").agg(F.count_distinct("t").alias("m")).agg(F.count_if(F.col("m") > 1).alias("primitive_one_tick"))
    tgt = targets.join(bounds, "e", "left").agg(F.count_if(F.col("start").isNull() | (F.col("t") < F.col("start")) | (F.col("t") > F.col("end"))).alias("target_bounds"), F.count_if(F.col("mult") < 1).alias("target_multiplicity"))
    out = None
    for df in (ent, evt, prim, tgt):
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("bigint").alias("n")) for c in df.columns])).alias("x")).select("x.*")
        out = long if out is None else out.unionByName(long)
    return out


def average_ranks(rows: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """rows with out, the rank of a value within the keys with ties averaged; ranks come from counts per distinct value."""
    names = [*keys, value]
    counts = running(rows.groupBy(*names).agg(F.count("*").alias("_m")), [value], "_m", "_b", "_n", keys)
    ranks = counts.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(names)], (F.col("_b") + (F.col("_m") + 1) / 2.0).alias(out))
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{i}"))
    return rows.join(ranks, same).drop(*[f"_r{i}" for i in range(len(names))])


def classification_metrics(rows: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, positives, auroc (Mann-Whitney, ties averaged), brier, log_loss (probabilities clipped at 1e-12).

    Ranks come from counts per distinct probability, so rows are aggregated before anything is ordered.
    """
    pos = F.sum(F.col(y).cast("bigint"))
    clip = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p)))
    each = rows.groupBy(*keys, p).agg(
        F.count("*").alias("_m"), pos.alias("_pos"), F.sum(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("_b"), F.sum(-F.col(y) * F.log(clip) - (1 - F.col(y)) * F.log(1 - clip)).alias("_l")
    )
    ranked = running(each, [p], "_m", "_below", "_n", keys).withColumn("_r", F.col("_below") + (F.col("_m") + 1) / 2.0)
    out = ranked.groupBy(*keys).agg(F.sum("_m").alias("n"), F.sum("_pos").alias("positives"), F.sum(F.col("_pos") * F.col("_r")).alias("_rs"), F.sum("_b").alias("_b"), F.sum("_l").alias("_l"))
    np_, nn = F.col("positives"), F.col("n") - F.col("positives")
    return out.select(*keys, "n", "positives", F.when((np_ > 0) & (nn > 0), (F.col("_rs") - np_ * (np_ + 1) / 2.0) / (np_ * nn)).alias("auroc"), (F.col("_b") / F.col("n")).alias("brier"), (F.col("_l") / F.col("n")).alias("log_loss"))


def environment_moments(rows: DataFrame, env: str, value: str) -> DataFrame:
    return rows.groupBy(env).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def seed_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, sample deviation and number of finite values."""
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    return finite.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count("*").alias("n"))


def run_stability(runs: DataFrame) -> DataFrame:
    """Mean pairwise Jaccard of the identity sets of runs (run, identity); sets are small, one array per run."""
    sets = runs.groupBy("run").agg(F.collect_set("identity").alias("s"))
    a, b = sets.toDF("ra", "sa"), sets.toDF("rb", "sb")
    return a.join(b, F.col("ra") < F.col("rb")).agg(F.avg(F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).alias("jaccard"))
