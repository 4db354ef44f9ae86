"""What position logs mean: single actions, whole transactions and entries, judged by the wallet's state before them.

Actions are rows (owner, tx, seq, kind, reserve, actor, rate_mode). All of a wallet's rows meet once, by owner; its
state is two running values, which reserves are active collateral and which were borrowed before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_state(actions: DataFrame) -> DataFrame:
    """actions with held (is the reserve active collateral), known (was it borrowed) and n_held (how many are active), all before the transaction."""
    switch = F.when(F.col("kind") == "collateral_enable", 1).when(F.col("kind") == "collateral_disable", 0)
    per = actions.groupBy("owner", "reserve", "tx").agg(F.max_by(switch, F.when(switch.isNotNull(), F.col("seq"))).alias("_turn"), F.max((F.col("kind") == "borrow").cast("int")).alias("_debt"))
    before = W.partitionBy("owner", "reserve").orderBy("tx").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_held", F.coalesce(F.last("_turn", ignorenulls=True).over(before), F.lit(0))).withColumn("known", F.coalesce(F.max("_debt").over(before), F.lit(0)) == 1)
    moves = per.groupBy("owner", "tx").agg(F.sum(F.coalesce("_turn", "_held") - F.col("_held")).alias("_move"))
    moves = moves.select("owner", "tx", F.coalesce(F.sum("_move").over(W.partitionBy("owner").orderBy("tx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n_held"))
    state = per.select("owner", "reserve", "tx", (F.col("_held") == 1).alias("held"), "known")
    return actions.join(state, ["owner", "reserve", "tx"]).join(moves, ["owner", "tx"])


def action_mechanism() -> Column:
    """The identity of one action of with_state(); null for what is no financial move of its own."""
    own = F.col("actor") == F.col("owner")
    by = lambda name: F.when(own, F.lit(f"self_{name}")).otherwise(F.lit(f"third_party_{name}"))
    borrow = F.when(own & (F.col("rate_mode") == 1), F.lit("self_stable_borrow")).otherwise(F.concat(F.when(own, F.lit("self")).otherwise(F.lit("delegated")), F.lit("_borrow_"), F.when(F.col("known"), F.lit("known")).otherwise(F.lit("new")), F.lit("_reserve")))
    return (
        F.when(F.col("kind") == "borrow", borrow).when(F.col("kind") == "repay", by("repay"))
        .when((F.col("kind") == "supply") & F.col("held"), by("top_up"))
        .when((F.col("kind") == "withdraw") & F.col("held"), F.when(F.col("n_held") > 1, F.lit("withdraw_with_rest")).otherwise(F.lit("withdraw_last")))
        .when((F.col("kind") == "collateral_enable") & ~F.col("held"), F.lit("enable")).when((F.col("kind") == "collateral_disable") & F.col("held"), F.lit("disable"))
    )


def _adds() -> Column:
    return (F.col("kind") == "collateral_enable") | (F.col("kind") == "supply") & F.col("held")


def transaction_mechanism(actions: DataFrame) -> DataFrame:
    """owner, tx, mechanism: one identity for a wallet's transaction, null where none or several compete.

    Debt restructuring, collateral rotation, leveraged expansion and deleveraging span several actions and come first.
    Supplies and withdrawals count only for active collateral; a switch of the same reserve stands for its flow.
    """
    rows = with_state(actions).withColumn("_one", action_mechanism()).withColumn("_adds", _adds()).withColumn("_takes", (F.col("kind") == "collateral_disable") | (F.col("kind") == "withdraw") & F.col("held"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    reserves = lambda c: F.collect_set(F.when(c, F.col("reserve")))
    g = rows.groupBy("owner", "tx").agg(
        some(F.col("kind") == "borrow").alias("b"), some(F.col("kind") == "repay").alias("r"), reserves(F.col("_adds")).alias("adds"), reserves(F.col("_takes")).alias("takes"),
        reserves(F.col("kind") == "collateral_enable").alias("on"), reserves(F.col("kind") == "collateral_disable").alias("off"),
        some((F.col("actor") != F.col("owner")) & ((F.col("kind") == "repay") | F.col("_adds"))).alias("helped"), F.collect_set(F.struct("kind", "reserve", F.col("_one").alias("one"))).alias("acts"),
    )
    adds, takes = F.size("adds") > 0, F.size("takes") > 0
    compound = F.array_compact(F.array(
        F.when(F.col("b") & F.col("r"), F.lit("restructuring")), F.when(adds & takes & (F.size(F.array_union("adds", "takes")) > 1), F.lit("rotation")), F.when(F.col("b") & adds, F.lit("expansion")),
        F.when(F.col("r") & adds, F.when(F.col("helped"), F.lit("assisted_deleveraging")).otherwise(F.lit("deleveraging"))),
    ))
    told = lambda a: a["one"].isNotNull() & ~((a["kind"] == "supply") & F.array_contains("on", a["reserve"])) & ~((a["kind"] == "withdraw") & F.array_contains("off", a["reserve"]))
    single = F.array_distinct(F.transform(F.filter("acts", told), lambda a: a["one"]))
    g = g.withColumn("c", compound).withColumn("s", single)
    return g.select("owner", "tx", F.when(F.size("c") == 1, F.get("c", F.lit(0))).when((F.size("c") == 0) & (F.size("s") == 1), F.get("s", F.lit(0))).alias("mechanism"))


def entry_mechanism(actions: DataFrame, stable_reserves: Sequence[int]) -> DataFrame:
    """owner, tx, mechanism of transactions that borrow: leveraged, delegated, stable rate, or by the first reserve borrowed."""
    rows = with_state(actions).withColumn("_b", F.col("kind") == "borrow")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = rows.groupBy("owner", "tx").agg(
        any_of("_b").alias("borrows"), any_of(_adds()).alias("adds"), any_of(F.col("_b") & (F.col("actor") != F.col("owner"))).alias("delegated"),
        any_of(F.col("_b") & (F.col("rate_mode") == 1)).alias("fixed"), F.min_by("reserve", F.when(F.col("_b"), F.col("seq"))).alias("first"),
    )
    name = F.when(F.col("adds"), "leveraged").when(F.col("delegated"), "delegated").when(F.col("fixed"), "stable_rate").when(F.col("first").isin(*stable_reserves), "stable_value").otherwise("volatile")
    return g.where("borrows").select("owner", "tx", F.concat(F.lit("entry_"), name).alias("mechanism"))
