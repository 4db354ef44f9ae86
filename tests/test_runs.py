"""Run folders, contracts, merged datasets and operators that no table query covers."""

from __future__ import annotations

import hashlib
import json
import random

import pytest

from eventide.operators import motifs, response, tables
from eventide.sources import runs


def test_config(tmp_path):
    path = tmp_path / "run.json"
    path.write_text(json.dumps({"windows": [3, 9], "seed": 4}))
    config = runs.RunConfig.from_file(str(path))
    assert config.windows == (3, 9) and config.digest() != runs.RunConfig().digest() and config.digest() == runs.RunConfig.from_file(str(path)).digest()
    for bad in ({"windows": [9, 3]}, {"knots": 9}, {"alpha": 0}, {"nothing": 1}, {"fractions": [0.5, 0.5]}, {"likelihood": "normal"}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            runs.RunConfig.from_file(str(path))
    runs.check_split({"fractions": [0.5, 0.3, 0.2], "seed": 11}, runs.RunConfig())
    with pytest.raises(ValueError):
        runs.check_split({"fractions": [0.5, 0.3, 0.2], "seed": 12}, runs.RunConfig())
    assert runs.is_poisson("poisson") and not runs.is_poisson("cloglog")


def test_checkpoints_and_digests(tmp_path):
    path = str(tmp_path / "state.json")
    assert runs.load_checkpoint(path, "a", "b") is None
    runs.write_checkpoint(path, {"step": 3}, "a", "b")
    assert runs.load_checkpoint(path, "a", "b") == {"step": 3}
    for c, d in (("x", "b"), ("a", "x")):
        with pytest.raises(ValueError):
            runs.load_checkpoint(path, c, d)
    (tmp_path / "f").write_bytes(b"z" * 3_000_000)
    assert runs.file_digest(str(tmp_path / "f"), 1000) == hashlib.sha256(b"z" * 3_000_000).hexdigest()


def test_landmarks_and_reports(spark, tmp_path):
    rows = spark.range(30).selectExpr("id e", "id % 3 part", "id * 2.0 f0")
    runs.write_landmarks(rows, str(tmp_path / "l"))
    assert runs.read_landmarks(spark, str(tmp_path / "l"), 1).count() == 10
    runs.write_report(rows.selectExpr("avg(f0) mean"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/json")).first()["mean"] == 29.0 and spark.read.option("header", True).csv(str(tmp_path / "r/csv")).count() == 1


def test_cached_prices(spark):
    read = spark.range(6).selectExpr("id k", "id * 10 value")
    jobs = spark.createDataFrame([(1,), (1,), (4,), (9,)], "k bigint")
    found, fresh = runs.cached_prices(jobs, spark.createDataFrame([], "k bigint, value bigint, digest string"), read, ["k"])
    assert sorted((r["k"], r["value"]) for r in found.collect() if r["value"] is not None) == [(1, 10), (1, 10), (4, 40)] and fresh.count() == 2
    cache = fresh.selectExpr("k", "if(k = 4, 41, value) value", "digest")  # one row was tampered with
    found, again = runs.cached_prices(jobs, cache, read, ["k"])
    assert {(r["k"], r["value"]) for r in found.collect()} == {(1, 10), (4, 40), (9, None)} and [r["k"] for r in again.collect()] == [4]


def test_merged_datasets(spark):
    def one(ids):
        return {"entities": spark.createDataFrame([(i, 0) for i in ids], "e bigint, start bigint"), "events": spark.createDataFrame([(i, i * 100) for i in ids], "e bigint, t bigint")}

    got = runs.merge_tables([one([5, 9000, 7]), one([2, 3])])
    events = {(r["source"], r["t"]): r["e"] for r in got["events"].collect()}
    assert events == {(0, 500): 0, (0, 700): 1, (0, 900_000): 2, (1, 200): 3, (1, 300): 4}
    assert sorted(r["e"] for r in got["entities"].collect()) == list(range(5))


@pytest.mark.parametrize("horizon", [1, 5, 24])
def test_frontier_equals_brute_force(spark, horizon):
    rng = random.Random(horizon)
    rows = [(rng.randrange(3), rng.randrange(-40, 80), rng.randrange(4), i % 150) for i in range(200)]
    want: dict = {}
    for e, t, p, i in rows:
        for f, u, q, j in rows:
            if e == f and p < q and i != j and abs(t - u) <= horizon:
                want.setdefault((p, q), []).append(abs(t - u))
    got = motifs.frontier(spark.createDataFrame(rows, "e int, t bigint, p int, id bigint"), horizon).collect()
    assert {(r["pa"], r["pb"]): (r["n"], r["least_span"]) for r in got} == {k: (len(v), min(v)) for k, v in want.items()}


def test_hawkes_states_equal_brute_force(spark):
    import math

    rng = random.Random(3)
    events = [(e, rng.randrange(0, 4000), rng.randrange(2)) for e in range(2) for _ in range(150)] + [(0, 720, 0), (0, 720, 0), (0, 1436, 0)]
    targets = [(e, rng.randrange(0, 4200)) for e in range(3) for _ in range(60)] + [(0, 720), (0, 721), (0, 2154)]
    rate = math.log(2) / 24
    reach = math.ceil(math.log(1e9) / rate)
    got = response.hawkes_states(spark.createDataFrame(events, "e int, t bigint, p int"), spark.createDataFrame(targets, "e int, t bigint"), 24.0).collect()
    want: dict = {}
    for e, t in set(targets):
        for f, u, p in events:
            if e == f and t - reach <= u < t:
                want[(e, t, p)] = want.get((e, t, p), 0) + math.exp(-rate * (t - u))
    assert {(r["e"], r["t"], r["p"]): r["s"] for r in got if r["s"] > 1e-8} == pytest.approx({k: v for k, v in want.items() if v > 1e-8}, rel=1e-6)


def test_quadratic_gain_is_the_best_nonnegative_step(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0.5, 2), rng.uniform(-0.4, 0.4), rng.uniform(0.5, 2)) for _ in range(40)]
    df = spark.createDataFrame(rows, "g0 double, g1 double, h00 double, h01 double, h11 double")
    c = F.col
    got = [r["x"] for r in df.select(tables.quadratic_gain([c("g0"), c("g1")], [[c("h00"), c("h01")], [c("h01"), c("h11")]]).alias("x")).collect()]
    grid = [i / 25 for i in range(150)]
    for (a, b, p, q, r), x in zip(rows, got, strict=True):
        best = max(a * u + b * v - (p * u * u + 2 * q * u * v + r * v * v) / 2 for u in grid for v in grid)
        assert best - 1e-9 <= x <= best + 0.01
