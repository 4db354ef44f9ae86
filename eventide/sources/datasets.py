"""Dataset folders: canonical tables as Parquet with a manifest of schemas, digests and provenance; raw readers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.sources.canonical import CELLS, ENTITIES, EVENTS, TARGETS

SCHEMAS = {"entities": ENTITIES, "events": EVENTS, "targets": TARGETS, "baseline_cells": CELLS}
ORDER = {"entities": ["entity_id"], "events": ["entity_code", "time", "predicate_code", "primitive_event_id"], "targets": ["entity_code", "time"], "baseline_cells": ["entity_code", "time"]}
LOGS = T.StructType([T.StructField(n, T.StringType()) for n in ("version", "address", "transaction_hash", "event_type", "data")] + [
    T.StructField("removed", T.BooleanType()), T.StructField("block_number", T.LongType()), T.StructField("transaction_index", T.LongType()), T.StructField("log_index", T.LongType()), T.StructField("topics", T.ArrayType(T.StringType())),
])


def content_digest(df: DataFrame) -> str:
    """Order-independent digest of a table's rows: sums and counts of row hashes, computed where the rows are."""
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    row = df.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256("|".join(str(v) for v in row).encode()).hexdigest()


def identity_digest(identity: dict) -> str:
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_dataset(path: str, tables: dict[str, DataFrame], identity: dict) -> str:
    """Write canonical tables under path (which must not hold one yet), then the manifest; returns its digest.

    Events without primitive ids get row numbers in the total order.
    """
    spark = next(iter(tables.values())).sparkSession
    digests = {}
    for name, df in tables.items():
        schema = SCHEMAS[name]
        if name == "events" and "primitive_event_id" not in df.columns:
            from pyspark.sql import Window

            df = df.withColumn("primitive_event_id", F.row_number().over(Window.partitionBy("entity_code").orderBy("time", "predicate_code")).cast("long") + F.col("entity_code").cast("long") * (1 << 32))
        fields = [f for f in schema.fields if f.name in df.columns]
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
        key = ORDER[name][0]
        df.repartition(key).sortWithinPartitions(*ORDER[name]).write.mode("errorifexists").parquet(f"{path}/{name}")
        digests[name] = content_digest(spark.read.parquet(f"{path}/{name}"))
    manifest = {"identity": identity, "digest": identity_digest(identity), "tables": digests}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest["digest"]


def read_dataset(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """Tables and identity; a changed table, identity or column list is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if identity_digest(manifest["identity"]) != manifest["digest"]:
        raise ValueError("the identity does not match its digest")
    out = {}
    for name, digest in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        wanted = [f.name for f in SCHEMAS[name].fields if f.name in df.columns]
        if df.columns != wanted:
            raise ValueError(f"{name} has columns {df.columns}")
        if verify and content_digest(df) != digest:
            raise ValueError(f"{name} does not match its digest")
        out[name] = df
    return out, manifest["identity"]


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Raw chain logs (JSON lines, compressed or not) without removed ones, each (block, transaction, log) once."""
    return spark.read.schema(LOGS).json(path).where(~F.coalesce("removed", F.lit(False))).dropDuplicates(["block_number", "transaction_hash", "log_index"])


def read_staging(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A headed CSV of strings, trimmed; a missing column is an error."""
    df = spark.read.csv(path, header=True)
    if missing := set(columns) - set(df.columns):
        raise ValueError(f"missing columns {sorted(missing)}")
    return df.select(*[F.trim(c).alias(c) for c in columns])


def missing_chunks(planned: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Planned chunks that are not there yet: what a resumed load still has to read."""
    return planned.join(present, keys, "left_anti")
