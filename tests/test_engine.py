"""Operators against literal cases and brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.functions import scalar as S
from eventide.operators import folds, motifs, relational, response, signals, states
from eventide.plans import inference as I
from eventide.plans import model as L
from eventide.plans import statements  # noqa: F401  it registers its queries
from eventide.plans.queries import ORACLES, QUERIES
from eventide.sources import datasets
from eventide.streaming import live


@pytest.fixture(scope="module")
def random_events(spark):
    """Few entities, heavy ties, primitives with several predicates."""
    rng = random.Random(173)
    rows = []
    for e in range(8):
        for k in range(rng.randint(2, 8)):
            t = rng.randint(0, 5)
            rows += [(e, t, p, 100 * e + k) for p in rng.sample(range(5), rng.randint(1, 3))]
    return rows, spark.createDataFrame(rows, "e bigint, t bigint, p int, id bigint")


def brute_unordered(rows, pattern):
    out = set()
    for e in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == e and r[2] in pattern]
        for t in {r[1] for r in own}:
            best = None
            for pick in itertools.product(*[[r for r in own if r[2] == p and r[1] <= t] for p in pattern]):
                if len({r[3] for r in pick}) == len(pattern):
                    times = [r[1] for r in pick]
                    key = (sum(times), min(times) - max(times))
                    best = key if best is None or key > best else best
            if best:
                out.add((e, t, -best[1]))
    return out


def brute_ordered(rows, pattern):
    out = set()
    for e in {r[0] for r in rows}:
        at = {p: sorted({r[1] for r in rows if r[0] == e and r[2] == p}) for p in pattern}
        for t in at[pattern[-1]]:
            now, ok = t, True
            chains = [c for c in itertools.product(*[at[p] for p in pattern[:-1]]) if all(a < b for a, b in zip((*c,), (*c[1:], t), strict=True))]
            if chains:
                best = max(chains, key=lambda c: c[::-1])
                out.add((e, t, now - best[0]))
            del ok
    return out


@pytest.mark.parametrize("pattern", [(0,), (0, 1), (2, 4), (0, 1, 2), (1, 3, 4)])
def test_unordered_motifs(random_events, pattern):
    rows, df = random_events
    assert {tuple(r) for r in motifs.unordered(df, pattern).collect()} == brute_unordered(rows, pattern)


@pytest.mark.parametrize("pattern", [(0, 1), (3, 2), (0, 1, 2), (4, 0, 3)])
def test_ordered_motifs(random_events, pattern):
    rows, df = random_events
    assert {tuple(r) for r in motifs.ordered(df, pattern).collect()} == brute_ordered(rows, pattern)


def test_grammar():
    assert len(motifs.grammar(range(3), 2)) == 3 + 3 + 6
    assert len(motifs.state_grammar(range(2), [7], 2)) == 2 + 1 + 2 + 1 + 2


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(1.0, 8), (2.0, 1), (3.0, 1), (float("nan"), 9), (5.0, 0)], "v double, w int")
    assert signals.weighted_quantile(df, [], "v", "w", 0.5).first()[0] == 1.0
    assert signals.weighted_quantile(df, [], "v", "w", 0.9).first()[0] == 2.0


def test_hysteresis(spark):
    df = spark.createDataFrame([(0, 10 * (i + 1), v) for i, v in enumerate([-0.01, -0.03, -0.04, -0.005, -0.03])], "k bigint, t bigint, v double")
    assert [r["t"] for r in signals.hysteresis_targets(df, 0.02, 0.5, downward=True).orderBy("t").collect()] == [20, 50]


def test_stress_score(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (2.0,), (9.0,)], "a double")
    assert [r["score"] for r in signals.stress_score(df, ["a"], {"a": [(1.0, 0.2), (2.0, 0.8)]}).collect()] == pytest.approx([0, 0.5, 0.8, 1])


def test_ordered_partition(spark):
    got = relational.ordered_partition(spark.range(10), ["id"], (0.5, 0.3, 0.2)).orderBy("id").collect()
    assert [r["part"] for r in got] == [0] * 5 + [1] * 3 + [2] * 2


def test_auroc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    assert relational.classification_metrics(df, "y", "p").first()["auroc"] == 0.75


def test_strict_future_labels(spark):
    points = spark.createDataFrame([(0, t) for t in range(5)], "e bigint, t bigint")
    targets = spark.createDataFrame([(0, 3)], "e bigint, t bigint")
    assert [r["y"] for r in response.forward_labels(points, targets, 2).orderBy("t").collect()] == [0, 1, 1, 0, 0]


def test_active_at_bounds(spark):
    intervals = spark.createDataFrame([(0, 2, 4, 1)], "e bigint, start bigint, end bigint, id bigint")
    points = spark.createDataFrame([(0, t) for t in range(6)], "e bigint, t bigint")
    assert [r["active"] for r in states.active_at(intervals, points).orderBy("t").collect()] == [False, False, False, True, True, False]


def test_basis_sums_to_one():
    for lag, knots in ((6, 1), (6, 3), (30, 4), (1, 2)):
        for bump in response.triangular_basis(lag, knots):
            assert math.isclose(sum(bump), 1.0)


def test_cloglog_terms(spark):
    df = spark.createDataFrame([(x,) for x in (-12.0, -3.0, 0.0, 2.0, 4.5)], "eta double")
    first, second = S.cloglog_event_slopes(F.col("eta"))
    for r in df.select("eta", S.cloglog_event(F.col("eta")).alias("v"), first.alias("d1"), second.alias("d2")).collect():
        f = lambda t: -math.log(-math.expm1(-math.exp(t)))
        assert r["v"] == pytest.approx(f(r["eta"]), rel=1e-6, abs=1e-12)
        assert r["d1"] == pytest.approx((f(r["eta"] + 1e-4) - f(r["eta"] - 1e-4)) / 2e-4, rel=1e-4, abs=1e-9)
        assert r["d2"] == pytest.approx((f(r["eta"] + 1e-3) - 2 * f(r["eta"]) + f(r["eta"] - 1e-3)) / 1e-6, rel=1e-2, abs=1e-5)


def test_address_and_words(spark):
    df = spark.createDataFrame([(" 0X" + "Ab" * 20 + " ",), ("0x12",), (None,)], "a string")
    assert [r[0] for r in df.select(S.clean_address(F.col("a"))).collect()] == ["0x" + "ab" * 20, None, None]


def test_newton_recovers_effect():
    rng = np.random.default_rng(5)
    x = rng.choice([0.0, 1.0], size=(400, 1))
    exposure = np.full(400, 50.0)
    events = rng.poisson(exposure * np.exp(-2 + 0.7 * x[:, 0])).astype(float)
    base, beta, _, ok = L.newton(x, np.zeros(400, int), exposure, events)
    assert ok and abs(base[0] + 2) < 0.1 and abs(beta[0] - 0.7) < 0.1
    assert L.newton(-x, np.zeros(400, int), exposure, events)[1][0] == 0.0  # the wrong sign stays at the bound


def test_distributed_fit_agrees(spark):
    rows = [(0.0, 1000, 40), (1.0, 300, 30), (2.0, 50, 11)]
    theta, nll = L.fit_distributed(spark.createDataFrame(rows, "x double, exposure bigint, events bigint"), ["x"])
    a = np.array(rows)
    base, beta, want, _ = L.newton(a[:, :1], np.zeros(3, int), a[:, 1], a[:, 2])
    assert theta == pytest.approx([base[0], beta[0]], abs=1e-6) and nll == pytest.approx(want)


def test_keys_round_trip():
    support = (L.Rule((0,), "atomic", 0), L.Rule((0, 1), "ordered", 6, -1), L.Rule((1, 2), "unordered", 3))
    assert L.support_of(L.support_key(support)) == tuple(sorted(support)) and L.support_of("empty") == ()
    assert L.closure(support) == [(1,), (2,)]
    assert () in L.neighbours((support[0],), support)


def test_penalty_grows():
    one, two = (L.Rule((0,), "atomic", 0),), (L.Rule((0,), "atomic", 0), L.Rule((1,), "atomic", 0))
    assert 0 == L.penalty((), 10, 2, 50) < L.penalty(one, 10, 2, 50) < L.penalty(two, 10, 2, 50)


def test_inference():
    x = np.random.default_rng(0).normal(0.3, 1, 400)
    plain, robust = I.mean_test(x), I.robust_test(x)
    assert plain.pvalue < 1e-6 and plain.pvalue < robust.pvalue < 0.01
    assert I.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert I.worst_mixture_mean(np.array([1.0, 0.0]), np.array([0.5, 0.5]), 0.4) == pytest.approx(0.3)
    assert I.environment_pvalue(np.array([1.0, 2.0]), np.array([0.5, 0.5]), 50) < 1e-6
    z = np.random.default_rng(1).normal(size=(3, 500))
    p = I.romano_wolf([5.0, 1.0, 0.0], (z - z.mean(1, keepdims=True)) / z.std(1, keepdims=True), 4000)
    assert p[0] < 0.01 and p[0] <= p[1] <= p[2]
    w = I.simplex_mixture(np.array([[1.0, 3.0], [1.0, 0.2]]), np.array([2.0, 2.0]), np.array([5.0, 5.0]))
    grid = max(np.linspace(0, 1, 1001), key=lambda a: 5 * math.log(1 - a + 3 * a) + 5 * math.log(1 - a + 0.2 * a) - 2)
    assert w.sum() == pytest.approx(1) and w[1] == pytest.approx(grid, abs=2e-3)


def test_order_book(spark):
    rows = [("d", 1, 0, 100, 5, 1, "2", "A"), ("d", 2, 1, 103, 5, 2, "2", "A"), ("d", 3, 2, 101, 9, 1, "2", "A"), ("d", 4, 3, 101, 0, 1, "2", "D"), ("d", 5, 4, 103, 2, 2, "1", "M")]
    df = spark.createDataFrame(rows, "day string, time bigint, seq bigint, price bigint, agg_volume bigint, side int, order_type string, action_type string")
    got = [(r["time"], folds.BOOK_EVENTS[r["code"]]) for r in folds.order_book(df).orderBy("time", "code").collect()]
    assert got == [(3, "buy_inside"), (3, "spread_narrows"), (3, "bid_dominance"), (4, "bid_cleared"), (4, "spread_widens"), (4, "mid_down"), (5, "ask_fill"), (5, "bid_dominance")]


def test_debt_episodes(spark):
    rows = [(1, "borrow", 1, 0, 0, 10), (1, "repay", 3, 1, 0, 10), (1, "borrow", 5, 2, 1, 7), (1, "liquidation", 9, 3, 1, 2), (2, "supply", 1, 0, 0, 1), (2, "borrow", 2, 1, 0, 5), (2, "repay", 4, 2, 0, 1)]
    df = spark.createDataFrame(rows, "owner bigint, kind string, time bigint, seq bigint, reserve bigint, amount bigint")
    assert {tuple(r) for r in folds.debt_episodes(df).collect()} == {(1, 0, 1, 3, "repaid"), (1, 1, 5, 9, "liquidated"), (2, 0, 2, 4, "open")}


def test_dataset_round_trip(spark, tmp_path):
    events = spark.createDataFrame([(0, 1, 0, 7), (0, 2, 1, 8)], "entity_code int, time long, predicate_code int, primitive_event_id long")
    targets = spark.createDataFrame([(0, 2, 1)], "entity_code int, time long, multiplicity int")
    path = str(tmp_path / "set")
    datasets.write_dataset(path, {"events": events, "targets": targets}, {"unit": "hour"})
    tables, identity = datasets.read_dataset(spark, path)
    assert identity == {"unit": "hour"} and tables["events"].count() == 2 and dict(tables["events"].dtypes)["predicate_code"] == "smallint"
    tables["targets"].union(tables["targets"]).write.mode("overwrite").parquet(f"{path}/other")
    spark.read.parquet(f"{path}/other").write.mode("overwrite").parquet(f"{path}/targets")
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, path)
    with pytest.raises(Exception):  # noqa: B017  Spark refuses an existing target
        datasets.write_dataset(path, {"events": events}, {})


def test_raw_readers(spark, tmp_path):
    (tmp_path / "logs.json").write_text('{"block_number":1,"transaction_hash":"a","log_index":0,"removed":false}\n{"block_number":1,"transaction_hash":"a","log_index":0}\n{"block_number":2,"transaction_hash":"b","log_index":0,"removed":true}\n')
    assert datasets.read_logs(spark, str(tmp_path / "logs.json")).count() == 1
    (tmp_path / "s.csv").write_text("id,type\n 1 , borrow\n")
    assert datasets.read_staging(spark, str(tmp_path / "s.csv"), ["id", "type"]).first() == ("1", "borrow")
    with pytest.raises(ValueError):
        datasets.read_staging(spark, str(tmp_path / "s.csv"), ["user"])


def test_stream_ticks_and_shocks(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(folder)
    stream = live.ticks(live.event_stream(spark, folder))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("ticks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    assert q.awaitTermination(120)
    static = spark.read.parquet(folder).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    assert spark.table("ticks").agg(F.sum("n")).first()[0] == static.count()
    values = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 99, 100, 40])], "k bigint, t bigint, v double")
    values.coalesce(1).write.parquet(str(tmp_path / "v"))
    live_rows = live.shocks(spark.readStream.schema(values.schema).parquet(str(tmp_path / "v")), 0.2)
    q = live_rows.writeStream.outputMode("append").format("memory").queryName("shocks").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    assert q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("shocks").collect()} == {tuple(r) for r in signals.prequential_shocks(values, 0.2).collect()} == {tuple(r) for r in folds.prequential_fold(values, 0.2).collect()}


def test_certified_search_on_planted_rule(spark):
    """90 entities; A then B raises the target's rate at the next tick for most of them."""
    ent, ev, tg = [], [], []
    for e in range(90):
        ent.append((e, 0, 30, 0, e * 3 // 90))
        a, b = e % 3 != 0, e % 5 != 0
        ev += ([(e, 1 + e % 7, 0, 10 * e)] if a else []) + ([(e, 3 + e % 7, 1, 10 * e + 1)] if b else [])
        if a and b and e % 7:
            tg.append((e, 4 + e % 7, 1))
        elif e % 11 == 0:
            tg.append((e, 25, 1))
    x = L.Data(spark.createDataFrame(ev, "e bigint, t bigint, p int, id bigint"), spark.createDataFrame(tg, "e bigint, t bigint, mult bigint"), spark.createDataFrame(ent, "e bigint, start bigint, end bigint, stratum int, part int"), lag=2)
    fitting = x.only(0)
    records = L.search(fitting, [r for r in L.dictionary(range(2), (4,), 2, ("ordered",)) if r.sign > 0], 1)
    assert records[0].support[0].pattern == (0, 1)
    got = L.certify(x.only(1), L.fit(fitting, ()), records[:1], resamples=500)
    assert got[0].certified and got[0].p_adjusted >= got[0].p_max
    assert isinstance(pd.DataFrame([vars(got[0])]), pd.DataFrame)


def test_effective_dimension_counts_parameters():
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(5000, 3))
    assert I.effective_dimension(scores, 5000 * np.eye(3)) == pytest.approx(3, abs=0.2)
    assert I.two_way_dimension(scores, scores, scores, 5000 * np.eye(3)) == pytest.approx(3, abs=0.2)


def test_lower_bound_meets_the_optimum():
    rng = np.random.default_rng(6)
    x, cell, exposure = rng.choice([0.0, 0.5, 1.0], size=(300, 2)), rng.integers(0, 3, 300), np.full(300, 20.0)
    events = rng.poisson(exposure * np.exp(-2 + 0.6 * x[:, 0])).astype(float)
    base, beta, nll, ok = L.newton(x, cell, exposure, events)
    bound = I.poisson_lower_bound(x, cell, exposure, events, base, beta, 1e-6)
    assert ok and nll - 1e-3 < bound <= nll + 1e-6
    assert I.poisson_lower_bound(x, cell, exposure, events, base, 0 * beta) == -math.inf


def test_unbounded_axes():
    x = np.array([[-1.0, 1.0, -1.0], [0.0, 0.0, 0.0]])
    assert I.unbounded_axes(x, np.array([0.0, 2.0])).tolist() == [True, False, True]
    assert not I.unbounded_axes(x, np.array([1.0, 2.0])).any()


@pytest.fixture(scope="module")
def every_quantity(spark, tmp_path_factory):
    """A folder of orders and lineitem whose lines carry all quantities, and their rows."""
    rng, d = random.Random(8), tmp_path_factory.mktemp("lines")
    day = lambda k: (pd.Timestamp("1995-01-01") + pd.Timedelta(days=k)).to_pydatetime()
    orders = [(k, rng.randint(0, 3), rng.randint(0, 30)) for k in range(60)]
    lines = [(rng.randint(0, 59), rng.randint(0, 3), rng.randint(0, 35), rng.choice("RAN"), rng.choice("OF"), float(rng.randint(1, 50))) for _ in range(300)]
    spark.createDataFrame([(a, b, day(c)) for a, b, c in orders], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(a, b, day(c), *r) for a, b, c, *r in lines], "l_orderkey bigint, l_suppkey bigint, l_shipdate timestamp, l_returnflag string, l_linestatus string, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return str(d), orders, lines


def test_whole_exposure_and_stability(spark, every_quantity):
    d, orders, lines = every_quantity
    want = {}
    for (e, g, s), (key, h, t, flag, _, _) in itertools.product(orders, lines):
        if g == h and s < t < s + 5:
            k = (e, t, int(flag == "R"))
            want[k] = min(want.get(k, key), key)
    origin = (pd.Timestamp("1995-01-01") - pd.Timestamp("1970-01-01")).days
    got = {(r["e"], r["t"] - origin, r["code"]): r["id"] for r in QUERIES["interval_exposure_join"](spark, d).collect()}
    assert got == want and len(want) > 100
    runs = {}
    for _, supplier, _, flag, status, _ in lines:
        runs.setdefault(flag + status, set()).add(supplier)
    pairs = [len(a & b) / len(a | b) for a, b in itertools.combinations(runs.values(), 2)]
    assert QUERIES["run_stability"](spark, d).first()["jaccard"] == pytest.approx(np.mean(pairs), abs=1e-6)


@pytest.mark.parametrize("width", [None, 1, 3, 100])
def test_interval_exposure_does_not_depend_on_width(spark, width):
    rng = random.Random(4)
    i = [(e, rng.randint(0, 1), s := rng.randint(-9, 20), s + rng.randint(-2, 9)) for e in range(25)]
    x = [(rng.randint(0, 1), rng.randint(-10, 30), rng.randint(0, 1), k) for k in range(80)]
    want = {}
    for (e, g, s, z), (h, t, code, k) in itertools.product(i, x):
        if g == h and s < t < z:
            want[(e, t, code)] = min(want.get((e, t, code), k), k)
    got = relational.interval_exposure(spark.createDataFrame(i, "e int, g int, start int, end int"), spark.createDataFrame(x, "g int, t int, code int, id int"), ["g"], width)
    assert {(r["e"], r["t"], r["code"]): r["id"] for r in got.collect()} == want and got.count() == len(want)


def test_hawkes_fits_agree(spark):
    rng = np.random.default_rng(3)
    states, counts, mass = rng.gamma(1.0, 1.0, size=(200, 2)), np.ones(200), np.array([150.0, 90.0])
    rows = spark.createDataFrame([(1, float(a), float(b)) for a, b in states], "mult bigint, a double, b double")
    here, there = L.hawkes_fit(states, counts, mass, 900.0, 40), L.hawkes_fit_distributed(rows, ["a", "b"], mass, 900.0, 40, 0.0)
    assert here[0] == pytest.approx(there[0], abs=1e-4) and here[1] == pytest.approx(there[1], rel=1e-3) and here[2] == pytest.approx(there[2], rel=1e-7)


def test_hawkes_fits_converge_alike(spark):
    """Excitations that EM takes to zero slowly: both fits end at the same optimum by themselves."""
    rng = np.random.default_rng(5)
    states, counts, mass = rng.gamma(1.0, 1.0, size=(300, 3)), rng.integers(1, 3, 300).astype(float), np.array([900.0, 460.0, 380.0])
    rows = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(counts, states, strict=True)], "mult bigint, a double, b double, c double")
    here, there = L.hawkes_fit(states, counts, mass, 400.0), L.hawkes_fit_distributed(rows, ["a", "b", "c"], mass, 400.0)
    assert here[3] and there[3]
    assert here[0] == pytest.approx(there[0], rel=1e-6) and here[1] == pytest.approx(there[1], rel=1e-6, abs=1e-9) and here[2] == pytest.approx(there[2], rel=1e-10)
    theta, scale = np.array([here[0], *here[1]]), np.array([400.0, *mass])
    z = np.column_stack([np.ones(300), states])
    grad = 1 - (counts / (z @ theta)) @ z / scale
    assert (np.abs(grad[theta > 0]) < 1e-7).all() and (grad[theta == 0] >= 0).all() and (theta == 0).any()
    assert not L.hawkes_fit(states, counts, mass, 400.0, 2)[3]


def test_search_prices_pairs_that_pay_only_jointly(monkeypatch):
    """Neither of two rules pays alone, both together do; another rule pays alone."""
    a, b, c = (L.Rule((p,), "atomic", 0) for p in range(3))
    gain = {(): 0.0, (a,): 0.5, (b,): 0.5, (c,): 12.0, (a, b): 60.0, (a, c): 12.5, (b, c): 12.5}
    monkeypatch.setattr(L, "fit", lambda data, s: L.Fit(s, {}, np.zeros(len(s)), 100.0 - gain[s], True))
    data = type("D", (), {"entities": type("E", (), {"count": lambda self: 50})(), "prepare": lambda self, *a: None, "outside": lambda self, s: False})()
    records = L.search(data, [a, b, c], 2)
    assert records[0].support == (a, b) and (c,) in [r.support for r in records] and all(r.score > 0 for r in records)


def test_fit_by_cells_agrees_with_the_driver(spark):
    rng = np.random.default_rng(7)
    rows = [(int(s), int(c), float(x), float(y), 50, int(rng.poisson(50 * np.exp(-2 + 0.3 * s - 0.2 * c + 0.5 * x)))) for s in (0, 1) for c in (0, 1, 2) for x in (0, 0.5, 1) for y in (0, -1)]
    cells, base, beta, nll, ok = L.fit_by_cells(spark.createDataFrame(rows, "stratum int, cell int, x0 double, x1 double, exposure bigint, events bigint"), ["x0", "x1"], ("stratum", "cell"))
    a = np.array(rows, dtype=float)
    want = L.newton(a[:, 2:4], (a[:, 0] * 3 + a[:, 1]).astype(int), a[:, 4], a[:, 5])
    assert ok and cells == [(s, c) for s in (0, 1) for c in (0, 1, 2)]
    assert base == pytest.approx(want[0], abs=1e-6) and beta == pytest.approx(want[1], abs=1e-6) and nll == pytest.approx(want[2])


def test_tests_by_moments_agree_with_influences():
    x = np.random.default_rng(3).gamma(2.0, size=400) - 1.2
    least, influence = I.robust_influence(x)
    got = I.robust_test(x)
    assert got.mean == pytest.approx(least) and got.statistic == pytest.approx(least / (influence.std(ddof=1) / 20))
    assert I.mean_test(x).statistic == pytest.approx(x.mean() / (x.std(ddof=1) / 20))
    assert I.mean_test(np.array([])).pvalue == I.robust_test(np.array([1.0, 1.0, 1.0])).pvalue == 1.0


def _planted(spark, entities=60):
    ent = [(e, 0, 30, 0, 1) for e in range(entities)]
    ev = [r for e in range(entities) if e % 3 for r in [(e, 1 + e % 7, 0, 10 * e), (e, 3 + e % 7, 1, 10 * e + 1)]]
    tg = [(e, 4 + e % 7, 1) for e in range(entities) if e % 3 and e % 5] + [(e, 25, 2) for e in range(entities) if e % 11 == 0]
    return L.Data(spark.createDataFrame(ev, "e bigint, t bigint, p int, id bigint"), spark.createDataFrame(tg, "e bigint, t bigint, mult bigint"), spark.createDataFrame(ent, "e bigint, start bigint, end bigint, stratum int, part int"), lag=2)


def test_certificates_and_mixture_against_whole_vectors(spark, monkeypatch):
    """Moments and passes in Spark give what the entities' gains and the target rows give on the driver."""
    x = _planted(spark)
    base = L.fit(x, ())
    fits = [L.fit(x, (r,)) for r in (L.Rule((0, 1), "ordered", 4), L.Rule((0,), "atomic", 0))]
    got = L.certify(x, base, [L.Record(f.rules, f, 0.0, 0.0) for f in fits], resamples=500)
    for f, c in zip(fits, got, strict=True):
        rows = L.entity_gains(x, base, f).collect()
        gain, score = (np.array([r[n] for r in rows]) for n in ("gain", "score"))
        assert len(rows) == 60
        assert (c.f1, c.f2, c.f3_lower) == pytest.approx((I.mean_test(score).pvalue, I.mean_test(gain).pvalue, I.robust_test(gain).lower))
    assert L.certify(x, base, []) == []
    near = L.mixture(x, base, fits)
    hit = {f.rules: {(r["e"], r["row"]): r["x0"] for r in x.active(f.rules).collect()} for f in fits}
    targets = [(r["e"], r["t"], r["mult"]) for r in x.targets.collect()]
    columns = np.array([[np.exp(base.cells[0, 0]), *[np.exp(f.cells[0, 0] + f.beta[0] * hit[f.rules].get((e, t), 0.0)) for f in fits]] for e, t, _ in targets])
    linear = [60 * 31 * np.exp(base.cells[0, 0])] + [np.exp(f.cells[0, 0]) * (60 * 31 + sum(np.expm1(f.beta[0] * v) for v in hit[f.rules].values())) for f in fits]
    assert near == pytest.approx(I.simplex_mixture(columns, np.array(linear), np.array([m for _, _, m in targets], dtype=float)), abs=1e-6)
    monkeypatch.setattr(L, "COLLECTED", 1)
    ascent = I.simplex_ascent
    monkeypatch.setattr(I, "simplex_ascent", lambda sums, linear, rounds=500: ascent(sums, linear, 3))
    few = L.mixture(x, base, fits)
    assert few == pytest.approx(I.simplex_mixture(columns, np.array(linear), np.array([m for _, _, m in targets], dtype=float), 3), abs=1e-6)


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "date"])
def test_running_sums_by_ranges(spark, kind):
    """Any order type, null keys and values, a hot key; and an empty table."""
    from eventide.operators.ranks import running

    values = [None, *range(-20, 60)]
    text = {"bigint": str, "double": lambda v: str(v / 7), "string": lambda v: f"k{v + 100}", "date": lambda v: f"2020-{1 + (v + 20) // 28:02d}-{1 + (v + 20) % 28:02d}"}[kind]
    rows = [(k, None if v is None else text(v), 1 + i % 4) for k in ("hot", "b", None) for i, v in enumerate(values) if k == "hot" or i % 9 == 0]
    df = spark.createDataFrame(rows, "k string, v string, w bigint").withColumn("v", F.col("v").cast(kind))
    got = Counter((r["k"], str(r["v"]), r["w"], r["before"], r["whole"]) for r in running(df, ["v"], "w", "before", "whole", ["k"]).collect())
    held = df.collect()
    least = lambda r: (r["v"] is not None, r["v"] if r["v"] is not None else 0)
    same = lambda r: [x for x in held if x["k"] == r["k"]]
    want = Counter((r["k"], str(r["v"]), r["w"], sum(x["w"] for x in same(r) if least(x) < least(r)), sum(x["w"] for x in same(r))) for r in held)
    assert got == want
    assert running(df.where("1 = 0"), ["v"], "w", "before", "whole").count() == 0


def test_prepared_designs_equal_designs_of_their_own(spark):
    """Every single and pair from one pass, against the design that each makes alone."""
    rng = np.random.default_rng(12)
    ev = [(e, int(t), int(p), 1000 * e + i) for e in range(8) for i, (t, p) in enumerate(zip(rng.integers(0, 40, 25), rng.integers(0, 3, 25), strict=True))]
    tg = [(e, t, 1 + t % 2) for e in range(8) for t in range(3 + e % 4, 40, 7)]
    ent = [(e, e % 3, 41 - e, e % 2, 0) for e in range(8)]
    x = L.Data(spark.createDataFrame(ev, "e bigint, t bigint, p int, id bigint"), spark.createDataFrame(tg, "e bigint, t bigint, mult bigint").where("t >= 3"), spark.createDataFrame(ent, "e bigint, start bigint, end bigint, stratum int, part int"), lag=3)
    rules = [L.Rule((2,), "atomic", 0), L.Rule((0, 1), "unordered", 4), L.Rule((0, 1), "ordered", 9), L.Rule((1, 0, 2), "ordered", 12), L.Rule((0, 1), "unordered", 9)]
    x.prepare(rules)
    table = lambda a: sorted((*map(float, v), a[1][c], float(n), float(m)) for v, c, n, m in zip(a[0], a[2], a[3], a[4], strict=True))
    assert len(x.arrays) == 5 + 7
    for plain, got in x.arrays.items():
        assert table(got) == table(L._arrays(x.design(plain), len(plain))), plain


def test_search_without_fits_outside_finds_the_same(spark, monkeypatch):
    """Supports whose optimum has other signs are skipped; what is found equals a search that fits them all."""
    rng = np.random.default_rng(5)
    ev, tg = [], {}
    for e in range(40):
        ticks = [[int(t) for t in np.unique(rng.integers(0, 60, 12))] for _ in range(3)]
        ev += [(e, t, p, 1000 * e + 100 * p + t) for p in range(3) for t in ticks[p]]
        for t in range(2, 60):
            if rng.random() < 0.04 + 0.5 * (t - 1 in ticks[0] and t - 1 not in ticks[1]):
                tg[e, t] = 1
    ent = [(e, 0, 60, e % 2, 0) for e in range(40)]
    x = L.Data(spark.createDataFrame(ev, "e bigint, t bigint, p int, id bigint"), spark.createDataFrame([(*k, v) for k, v in tg.items()], "e bigint, t bigint, mult bigint"), spark.createDataFrame(ent, "e bigint, start bigint, end bigint, stratum int, part int"), lag=1)
    rules = L.dictionary(range(3), (0, 5), 2)
    seen = lambda records: [(L.support_key(r.support), round(r.score, 6)) for r in records]
    quick = seen(L.search(x, rules, 2))
    monkeypatch.setattr(L.Data, "outside", lambda self, support: False)
    assert quick == seen(L.search(x, rules, 2)) and len(quick[0][0].split(";")) == 2 and "0|W0|exc" in quick[0][0]


def test_support_scores_equal_their_sql_to_the_sign_of_zero(spark, tmp_path):
    """Scores that cancel to less than nothing, unknown and infinite terms; values compare as they are written."""
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 0.02, 0.02, 50.01), (1.0, 0.08, 0.02, 12.51), (3.0, 0.1, 0.0, 30.0), (7.0, 0.07, 0.04, 100.02), (25.0, 0.0, 0.0, 5.0), (0.04, 0.02, 0.0, 2.00000625), (-0.04, 0.02, 0.0, -2.00000625)]
    odd = [None, nan, inf, -inf, 0.0, -0.0, -2.0, 1e-300, 1e18, 25.0]
    rows += [tuple(v if i == j else 0.5 for i in range(4)) for j in range(4) for v in odd] + [(None,) * 4]
    lines = [(k, 1, *r) for k, r in enumerate(rows)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    columns = ["l_orderkey", "l_linenumber", "score", "delta", "dominance", "p"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['support_scores']})").fetchall())
    got = sorted(map(tuple, QUERIES["support_scores"](spark, str(tmp_path)).select(*columns).collect()))
    assert list(map(repr, got)) == list(map(repr, want))
    assert repr(want[0][2]) == "-0.0"
