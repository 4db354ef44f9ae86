"""Structured Streaming forms of the engine's tick, duplicate, counter and shock operators.

Event time is the column ts. Each function takes any streaming (or static) DataFrame; the state that each keeps
is bounded by its watermark or, for shocks, by `keep` values per key.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Events from a folder of Parquet files; new files are new data, the checkpoint knows which were read."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def ticks(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling counts per entity and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id", "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "user_id", "event_type", "n")


def trailing(events: DataFrame, width: str = "30 seconds", step: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Sliding counts per type: the trailing action mix at fixed steps."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.end").alias("at"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Merged activity intervals of a constant gap: the streaming form of the recent state."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once; what is remembered ends with the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def shocks(values: DataFrame, level: float) -> DataFrame:
    """k, t, sign of prequential shocks of a stream (k, t, v), ranked against a key's whole past.

    The state holds how often each size of a change occurred, so it grows with distinct sizes only.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, past = json.loads(state.get[0]) if state.exists else (None, [])
        ordered = [size for size, n in past for _ in range(n)]
        out = []
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        for t, v in zip(rows["t"].tolist(), rows["v"].tolist(), strict=True):
            if last is not None and v != last:
                size = abs(v - last)
                if 1 + len(ordered) - bisect_left(ordered, size) <= level * (len(ordered) + 1):
                    out.append((key[0], t, 1 if v > last else -1))
                insort(ordered, size)
            last = v
        state.update((json.dumps([last, [(size, len(list(same))) for size, same in groupby(ordered)]]),))
        yield pd.DataFrame(out, columns=["k", "t", "sign"])

    return values.groupBy("k").applyInPandasWithState(step, "k bigint, t bigint, sign int", "state string", "append", GroupStateTimeout.NoTimeout)
