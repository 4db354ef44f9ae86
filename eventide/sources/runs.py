"""Run folders: configurations, checkpoints, landmark tables, reports, merged datasets and the contracts between them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.tables import running_total
from eventide.sources.datasets import identity_digest

LIKELIHOODS = ("poisson", "continuous_poisson", "cloglog")  # fixed values


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; from_file() reads them, validate() holds them against each other, digest() names them."""

    likelihood: str = "poisson"
    windows: tuple[int, ...] = (6, 24)
    max_rules: int = 2
    max_order: int = 2
    relations: tuple[str, ...] = ("unordered",)
    impact_lag: int = 6
    knots: int = 1
    fractions: tuple[float, ...] = (0.5, 0.3, 0.2)
    seed: int = 11
    alpha: float = 0.05
    resamples: int = 20_000

    @classmethod
    def from_file(cls, path: str) -> RunConfig:
        """A JSON file, or YAML where the library for it is there; unknown names are an error, lists become tuples."""
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            raw = yaml.safe_load(text) or {}
        else:
            raw = json.loads(text)
        if unknown := set(raw) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}).validate()

    def validate(self) -> RunConfig:
        wrong = [name for name, ok in {
            "likelihood": self.likelihood in LIKELIHOODS,
            "windows": bool(self.windows) and list(self.windows) == sorted(set(self.windows)) and self.windows[0] > 0,
            "max_rules": self.max_rules >= 1, "max_order": 1 <= self.max_order <= 3,
            "relations": bool(self.relations) and set(self.relations) <= {"ordered", "unordered"},
            "impact_lag": self.impact_lag >= 1, "knots": 1 <= self.knots <= self.impact_lag,
            "fractions": len(self.fractions) == 3 and min(self.fractions) > 0 and abs(sum(self.fractions) - 1) < 1e-9,
            "alpha": 0 < self.alpha < 1, "resamples": self.resamples >= 1,
        }.items() if not ok]
        if wrong:
            raise ValueError(f"settings out of range: {wrong}")
        return self

    def digest(self) -> str:
        return identity_digest(asdict(self))


def is_poisson(likelihood: str) -> bool:
    return likelihood in ("poisson", "continuous_poisson")


def file_digest(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a file, read block by block."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(block):
            h.update(data)
    return h.hexdigest()


def check_split(manifest: dict, config: RunConfig) -> None:
    """A dataset that was split beforehand must have been split as the run says."""
    if tuple(manifest.get("fractions", ())) != config.fractions or manifest.get("seed") != config.seed:
        raise ValueError(f"the dataset was split by {manifest.get('fractions')} and seed {manifest.get('seed')}")


def write_checkpoint(path: str, state: dict, config_digest: str, dataset_digest: str) -> None:
    """The file appears whole or not at all."""
    part = Path(f"{path}.part")
    part.write_text(json.dumps({"schema": 1, "config": config_digest, "dataset": dataset_digest, "state": state}, sort_keys=True))
    part.replace(path)


def load_checkpoint(path: str, config_digest: str, dataset_digest: str) -> dict | None:
    """The saved state, none if there is no file; one of another schema, configuration or dataset is an error."""
    if not Path(path).exists():
        return None
    got = json.loads(Path(path).read_text())
    if (got.get("schema"), got.get("config"), got.get("dataset")) != (1, config_digest, dataset_digest):
        raise ValueError("the checkpoint belongs to another run")
    return got["state"]


def write_landmarks(rows: DataFrame, path: str) -> None:
    """Landmark rows (part, ...) by partition, so that a reader of one split reads no other."""
    rows.repartition("part").write.partitionBy("part").parquet(path)


def read_landmarks(spark: SparkSession, path: str, part: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("part") == part).drop("part")


def write_report(metrics: DataFrame, path: str) -> None:
    """A small table of metrics as JSON lines and as CSV."""
    metrics.coalesce(1).write.json(f"{path}/json")
    metrics.coalesce(1).write.option("header", True).csv(f"{path}/csv")


def cached_prices(jobs: DataFrame, cache: DataFrame, read: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Values of jobs (keys) from a cache table, what it lacks from read; and the rows to add to the cache.

    Every cached row carries digest, the SHA-256 of its keys and value; a row that does not match is no hit.
    """
    sign = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("value").cast("string")), 256)
    good = cache.where(F.col("digest") == sign).select(*keys, "value")
    wanted = jobs.select(*keys).distinct()
    fresh = wanted.join(good, list(keys), "left_anti").join(read.select(*keys, "value"), list(keys)).withColumn("digest", sign)
    return jobs.join(good.unionByName(fresh.select(*keys, "value")), list(keys), "left"), fresh


def merge_tables(datasets: Sequence[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Entities, events and targets of several datasets as one, with new entity codes: dataset by dataset, in the old order.

    Codes are offsets plus the old dense code within a dataset, so nothing is ordered as a whole.
    """
    out: dict[str, DataFrame] = {}
    offset = 0
    for number, tables in enumerate(datasets):
        codes = running_total(tables["entities"].select("e").distinct().withColumn("_one", F.lit(1)), "e", "_one", "code").select("e", (F.col("code") + offset).alias("code"))
        for name, df in tables.items():
            new = df.join(codes, "e").withColumn("source", F.lit(number)).drop("e").withColumnRenamed("code", "e")
            out[name] = new if name not in out else out[name].unionByName(new, allowMissingColumns=True)
        offset += tables["entities"].select("e").distinct().count()
    return out
