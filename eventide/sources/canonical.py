"""The driver's event log as canonical tables: entities, events, targets, with an integer hour clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions.scalar import hash_split

HOUR = 3_600_000_000
#: Reported predicates by code; every other event type is a target.
PREDICATES = {"click": 0, "purchase": 1, "signup": 2, "view": 3}

ENTITIES = T.StructType([
    T.StructField("entity_id", T.StringType()), T.StructField("start_time", T.LongType()), T.StructField("end_time", T.LongType()),
    T.StructField("baseline_origin", T.LongType()), T.StructField("split_group", T.LongType()), T.StructField("baseline_stratum", T.ShortType()),
    T.StructField("partition", T.ByteType()), T.StructField("end_reason", T.StringType()), T.StructField("dependency_group", T.StringType()),
])
EVENTS = T.StructType([
    T.StructField("entity_code", T.IntegerType()), T.StructField("time", T.LongType()), T.StructField("predicate_code", T.ShortType()), T.StructField("primitive_event_id", T.LongType()),
])
TARGETS = T.StructType([T.StructField("entity_code", T.IntegerType()), T.StructField("time", T.LongType()), T.StructField("multiplicity", T.IntegerType())])
CELLS = T.StructType([T.StructField("entity_code", T.IntegerType()), T.StructField("time", T.LongType()), T.StructField("baseline_stratum", T.ShortType()), T.StructField("exposure", T.DoubleType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tick(ts: str | Column = "ts") -> Column:
    """Whole hours since the epoch, whatever zone flag the file carries."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(HOUR)).cast("bigint")


def predicate() -> Column:
    code = F.lit(None).cast("int")
    for name, k in PREDICATES.items():
        code = F.when(F.col("event_type") == name, F.lit(k)).otherwise(code)
    return code


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e, t, p (null for targets), id and value of every raw event."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("e"), tick().alias("t"), predicate().alias("p"), F.col("event_id").alias("id"), "value")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("p is not null").select("e", "t", "p", "id")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).where("p is null").groupBy("e", "t").agg(F.count("*").alias("mult"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observed history per user: inclusive bounds, stratum and partition (0 fit, 1 cert, 2 test)."""
    return (
        log(spark, sf_dir).groupBy("e").agg(F.min("t").alias("start"), F.max("t").alias("end"))
        .select("e", "start", "end", F.pmod("e", F.lit(2)).cast("int").alias("stratum"), hash_split(F.col("e").cast("string"), 11, (0.5, 0.3, 0.2)).alias("part"))
    )
