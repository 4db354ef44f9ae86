"""Temporal motifs: unordered and strictly ordered completions of one to three predicates inside an entity.

Inputs have columns e (entity), t (integer tick), p (predicate), id (primitive event). One exchange on e serves
all windows of a motif; nothing is joined with itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.operators.ranks import running


def grammar(predicates: Sequence[int], q_max: int = 3, relations: Sequence[str] = ("unordered", "ordered")) -> list[tuple[tuple[int, ...], str]]:
    """Atomic patterns, then combinations (unordered) and permutations (ordered) up to q_max."""
    out: list[tuple[tuple[int, ...], str]] = [((p,), "atomic") for p in predicates]
    for q in range(2, q_max + 1):
        if "unordered" in relations:
            out += [(c, "unordered") for c in combinations(predicates, q)]
        if "ordered" in relations:
            out += [(c, "ordered") for c in permutations(predicates, q)]
    return out


def state_grammar(events: Sequence[int], states: Sequence[int], q_max: int = 3, relations: Sequence[str] = ("unordered", "ordered")) -> list[tuple[tuple[int, ...], str]]:
    """grammar() of the events, each state alone, and each state with one event."""
    return grammar(events, q_max, relations) + [((s,), "atomic") for s in states] + [((p, s), "unordered") for s in states for p in events]


def unordered(events: DataFrame, pattern: Sequence[int]) -> DataFrame:
    """e, t, span at every distinct tick of a member stream at which the pattern is complete.

    Witnesses are one per predicate, not after t, of distinct primitives, with the largest sum of times and then
    the smallest span. The q newest primitives of each predicate are enough to choose from.
    """
    q = len(pattern)
    rows = events.where(F.col("p").isin(*pattern)).select("e", "t", "p", "id").repartition("e")
    if q == 1:
        return rows.select("e", "t").distinct().withColumn("span", F.lit(0).cast("bigint"))
    newest = W.partitionBy("e", "p").orderBy(F.asc("t"), F.desc("id"))
    atom = F.struct("t", "id")
    rows = rows.withColumn("c", F.array_compact(F.array(atom, *[F.lag(atom, k).over(newest) for k in range(1, q)])))
    sofar = W.partitionBy("e").orderBy("t").rangeBetween(W.unboundedPreceding, 0)
    for k, p in enumerate(pattern):
        rows = rows.withColumn(f"c{k}", F.max(F.when(F.col("p") == p, F.struct(F.col("t").alias("a"), (-F.col("id")).alias("b"), "c"))).over(sofar)["c"])
    ticks = rows.select("e", "t", *[f"c{k}" for k in range(q)]).dropDuplicates(["e", "t"])

    def choose(k: int, picked: list[Column]) -> Column:
        if k == q:
            distinct = F.lit(True)
            for a, b in combinations(picked, 2):
                distinct = distinct & (a["id"] != b["id"])
            times = [x["t"] for x in picked]
            total = times[0]
            for x in times[1:]:
                total = total + x
            return F.when(distinct, F.struct(total.alias("sum"), (F.least(*times) - F.greatest(*times)).alias("nspan")))
        return F.array_max(F.transform(f"c{k}", lambda x: choose(k + 1, [*picked, x])))

    return ticks.withColumn("best", choose(0, [])).where("best is not null").select("e", "t", (-F.col("best.nspan")).alias("span"))


def ordered(events: DataFrame, pattern: Sequence[int]) -> DataFrame:
    """e, t, span for each distinct tick of the last predicate after strictly increasing witnesses.

    The latest feasible witness is taken from the last predicate backwards; span runs from the first to the last.
    """
    rows = events.where(F.col("p").isin(*pattern)).select("e", "t", "p").distinct().repartition("e")
    earlier = W.partitionBy("e").orderBy("t").rangeBetween(W.unboundedPreceding, -1)
    origin = F.when(F.col("p") == pattern[0], F.col("t"))
    for k, p in enumerate(pattern[1:]):
        # the latest tick of the chain so far, strictly before this row, with the first witness's time
        rows = rows.withColumn(f"o{k}", origin).withColumn(f"m{k}", F.max(F.when(F.col(f"o{k}").isNotNull(), F.struct(F.col("t").alias("t"), F.col(f"o{k}").alias("o")))).over(earlier))
        origin = F.when(F.col("p") == p, F.col(f"m{k}.o"))
    return rows.withColumn("o", origin).where("o is not null").select("e", "t", (F.col("t") - F.col("o")).alias("span"))


def completions(events: DataFrame, pattern: Sequence[int], relation: str) -> DataFrame:
    return ordered(events, pattern) if relation == "ordered" and len(pattern) > 1 else unordered(events, pattern)


def stretches(rows: DataFrame, time: str, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """rows with stretch, the number of the stretch of time that they are in, and copies for those before and after it."""
    own = F.floor(F.col(time) / max(1, width))
    return rows.withColumn("stretch", F.explode(F.sequence(own - before, own + after)) if before or after else own)


def frontier(events: DataFrame, horizon: int) -> DataFrame:
    """Which unordered pairs of predicates occur within the horizon on distinct primitives, and how often.

    An equality on entity and stretch of time (as long as the horizon, and the two next to it), so that a long history
    is cut into many keys and no row meets more than three stretches.
    """
    a = stretches(events.select("e", F.col("t").alias("ta"), F.col("p").alias("pa"), F.col("id").alias("ia")), "ta", horizon)
    b = stretches(events.select("e", F.col("t").alias("tb"), F.col("p").alias("pb"), F.col("id").alias("ib")), "tb", horizon, 1, 1)
    met = a.join(b, ["e", "stretch"]).where((F.col("pa") < F.col("pb")) & (F.abs(F.col("ta") - F.col("tb")) <= horizon) & (F.col("ia") != F.col("ib")))
    return met.groupBy("pa", "pb").agg(F.count("*").alias("n"), F.min(F.abs(F.col("ta") - F.col("tb"))).alias("least_span"))


def history_counts(events: DataFrame, lookback: int) -> DataFrame:
    """Each event with n, the events of its predicate in [t - lookback, t); ties at t share the same past."""
    past = W.partitionBy("e", "p").orderBy("t").rangeBetween(-lookback, -1)
    return events.withColumn("n", F.count("*").over(past))


def history_marked(events: DataFrame, lookback: int, least: int) -> DataFrame:
    return history_counts(events, lookback).where(F.col("n") >= least).drop("n")


def inverse_cdf(rows: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float]) -> DataFrame:
    """keys, q, value: the ceil(q * n)-th smallest value, exact for every n (no floating multiple is trusted)."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_m"))
    ranked = running(counted, [value], "_m", "_low", "_n", keys).withColumn("_hi", F.col("_low") + F.col("_m"))
    wanted = ranked.withColumn("q", F.explode(F.array(*map(F.lit, quantiles))))
    need = F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("_n"), 9)))
    return wanted.where((F.col("_hi") >= need) & (F.col("_low") < need)).select(*keys, "q", F.col(value).alias("value"))


def productive(matches: DataFrame, entities: DataFrame) -> DataFrame:
    """Completions that still have a risk row after them."""
    return matches.join(entities.select("e", "end"), "e").where("t < end").drop("end")


def effective_windows(matches: DataFrame, entities: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Windows that admit more productive completions than the next smaller one."""
    counts = productive(matches, entities).agg(*[F.count_if(F.col("span") <= w).alias(str(w)) for w in windows])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(w).cast("bigint").alias("w"), F.col(str(w)).alias("n")) for w in windows])).alias("x")).select("x.*")
    return long.withColumn("before", F.lag("n", 1, 0).over(W.partitionBy(F.lit(0)).orderBy("w"))).where("n > before").select("w", "n")


def window_band(matches: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Completions with w, the smallest window that admits them; others are left out."""
    band = F.lit(None).cast("bigint")
    for w in sorted(windows, reverse=True):
        band = F.when(F.col("span") <= w, F.lit(w).cast("bigint")).otherwise(band)
    return matches.withColumn("w", band).where("w is not null")
