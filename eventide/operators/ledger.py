"""Balance and log operators: running debt, zero points, cached look-ups, decoded logs, frequency channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.functions import scalar as S
from eventide.operators.motifs import stretches


def zero_candidates(actions: DataFrame) -> DataFrame:
    """owner, time, seq at which no reserve of the owner has a positive running balance, of (owner, reserve, time, seq, delta).

    Sign changes per reserve add up to the number of positive reserves, so nothing is collected per owner.
    """
    each = W.partitionBy("owner", "reserve").orderBy("time", "seq").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy("owner").orderBy("time", "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = actions.withColumn("held", F.sum("delta").over(each)).withColumn("before", F.col("held") - F.col("delta"))
    turn = (F.col("held") > 0).cast("int") - (F.col("before") > 0).cast("int")
    return rows.withColumn("positive", F.sum(turn).over(all_)).where("positive = 0").select("owner", "time", "seq")


def zero_points(candidates: DataFrame, borrows: DataFrame) -> DataFrame:
    """owner, segment, time: the first candidate after each borrow-delimited segment's start; later ones are implied."""
    both = candidates.select("owner", "time", "seq", F.lit(0).alias("b")).unionByName(borrows.select("owner", "time", "seq", F.lit(1).alias("b")))
    segment = F.sum("b").over(W.partitionBy("owner").orderBy("time", "seq", F.desc("b")).rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("segment", segment).where("b = 0").groupBy("owner", "segment").agg(F.min("time").alias("time"))


def cached_lookup(jobs: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """jobs with the cache's columns and hit, whether the cache had them."""
    return jobs.join(cache.withColumn("hit", F.lit(True)), list(keys), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


#: Where each kind of position log keeps its parts: topics by number, data by word.
LAYOUTS = {
    "borrow": {"reserve": "t1", "owner": "t2", "actor": "w0", "amount": "w1", "rate_mode": "w2"},
    "repay": {"reserve": "t1", "owner": "t2", "actor": "t3", "amount": "w0"},
    "supply": {"reserve": "t1", "owner": "t2", "actor": "w0", "amount": "w1"},
    "withdraw": {"reserve": "t1", "owner": "t2", "actor": "t3", "amount": "w0"},
    "collateral_enable": {"reserve": "t1", "owner": "t2", "actor": "t2"},
    "collateral_disable": {"reserve": "t1", "owner": "t2", "actor": "t2"},
    "liquidation": {"collateral": "t1", "reserve": "t2", "owner": "t3", "amount": "w0"},
}  # fixed values


def decode_logs(logs: DataFrame) -> DataFrame:
    """Canonical records of raw position logs; amounts stay 64 hex digits, as they exceed every integer type."""
    def part(field: str, address: bool):
        out = F.lit(None).cast("string")
        for kind, where in LAYOUTS.items():
            if field in where:
                n = int(where[field][1:])
                raw = F.get("topics", F.lit(n)) if where[field][0] == "t" else S.data_word(F.col("data"), n)
                out = F.when(F.col("event_type") == kind, S.word_address(raw) if address else raw).otherwise(out)
        return F.when(out != S.ZERO_ADDRESS, out) if address else out

    return logs.select(
        "event_type", "block_number", "log_index", S.primitive_id(F.col("block_number"), F.col("transaction_index")).alias("primitive"), F.floor(F.col("block_number") / 7200).alias("tick"),
        *[part(f, True).alias(f) for f in ("reserve", "owner", "actor", "collateral")], part("amount", False).alias("amount"), S.word_number(part("rate_mode", False)).alias("rate_mode"),
    )


def channels(rows: DataFrame, time: str, value: str) -> DataFrame:
    """rows with systemic (the mean of the value over all rows of a tick) and relative (the rest)."""
    mean = rows.groupBy(time).agg(F.avg(value).alias("systemic"))
    return rows.join(mean, time).withColumn("relative", F.col(value) - F.col("systemic"))


def block_sums(rows: DataFrame, time: str, value: str, horizon: int) -> DataFrame:
    """Per-tick sums and their overlapping sums over the next horizon ticks, for long-run variances.

    Ticks are cut into stretches; those that a block of the stretch before reaches are copied there.
    """
    width = max(horizon, 4096)
    ticks = rows.groupBy(time).agg(F.sum(value).alias("s")).withColumn("_own", F.floor(F.col(time) / width))
    copied = ticks.withColumn("_s", F.explode(F.array_distinct(F.array("_own", F.floor((F.col(time) - horizon + 1) / width)))))
    ahead = W.partitionBy("_s").orderBy(time).rangeBetween(0, horizon - 1)
    return copied.withColumn("block", F.sum("s").over(ahead)).where("_s = _own").drop("_s", "_own")


def triple_frontier(events: DataFrame, horizon: int) -> DataFrame:
    """pa < pb < pc: triples of predicates on distinct primitives that all lie within the horizon, and how many.

    The first pair bounds what the third meets; each step is an equality on the entity and the stretch of time around
    the first event.
    """
    a = stretches(events.select("e", F.col("t").alias("ta"), F.col("p").alias("pa"), F.col("id").alias("ia")), "ta", horizon)
    b = stretches(events.select("e", F.col("t").alias("tb"), F.col("p").alias("pb"), F.col("id").alias("ib")), "tb", horizon, 1, 1)
    c = stretches(events.select("e", F.col("t").alias("tc"), F.col("p").alias("pc"), F.col("id").alias("ic")), "tc", horizon, 1, 1)
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= horizon
    two = a.join(b, ["e", "stretch"]).where((F.col("pa") < F.col("pb")) & near("ta", "tb") & (F.col("ia") != F.col("ib")))
    three = two.join(c, ["e", "stretch"]).where((F.col("pb") < F.col("pc")) & near("ta", "tc") & near("tb", "tc") & (F.col("ia") != F.col("ic")) & (F.col("ib") != F.col("ic")))
    return three.groupBy("pa", "pb", "pc").agg(F.count("*").alias("n"))


def common_days(left: DataFrame, right: DataFrame, first: int) -> DataFrame:
    """The first days that both sources have."""
    both = left.select("day").distinct().intersect(right.select("day").distinct())
    return both.orderBy("day").limit(first)
