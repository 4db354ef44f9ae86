"""Rules, event models and their selection: designs are aggregated by Spark, small convex fits run on the driver."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators import motifs as M
from eventide.operators import response as P
from eventide.plans import inference as I


@dataclass(frozen=True, order=True)
class Rule:
    """Pattern, relation, window and sign (+1 excites, -1 inhibits)."""

    pattern: tuple[int, ...]
    relation: str
    window: int
    sign: int = 1

    def key(self) -> str:
        tag = {"ordered": "|RO", "unordered": "|RU"}.get(self.relation, "")
        return ",".join(map(str, self.pattern)) + f"{tag}|W{self.window}|{'exc' if self.sign > 0 else 'inh'}"

    @staticmethod
    def of(key: str) -> Rule:
        atoms, *tags = key.split("|")
        pattern = tuple(map(int, atoms.split(",")))
        relation = "ordered" if "RO" in tags else "unordered" if len(pattern) > 1 else "atomic"
        return Rule(pattern, relation, int(next(t for t in tags if t[0] == "W")[1:]), -1 if "inh" in tags else 1)


Support = tuple[Rule, ...]
#: Rows of sufficient statistics that the driver takes; more are summed by passes.
COLLECTED = 500_000


def support_key(support: Sequence[Rule]) -> str:
    return ";".join(r.key() for r in sorted(support)) or "empty"


def support_of(key: str) -> Support:
    return () if key == "empty" else tuple(Rule.of(k) for k in key.split(";"))


def closure(support: Sequence[Rule]) -> list[tuple[int, ...]]:
    """Strict subsets of reported patterns that are not reported themselves."""
    have = {r.pattern for r in support}
    return sorted({c for r in support for q in range(1, len(r.pattern)) for c in combinations(r.pattern, q)} - have)


def neighbours(support: Support, dictionary: Sequence[Rule]) -> list[Support]:
    """One-exchange moves: add, drop, replace; one rule per pattern."""
    out = set()
    for r in dictionary:
        if r.pattern not in {s.pattern for s in support}:
            out.add(tuple(sorted((*support, r))))
        for s in support:
            rest = [x for x in support if x != s]
            if r != s and r.pattern not in {x.pattern for x in rest}:
                out.add(tuple(sorted((*rest, r))))
    for s in support:
        out.add(tuple(x for x in support if x != s))
    return sorted(out - {support})


def penalty(support: Sequence[Rule], skeletons: int, windows: int, entities: int, knots: int = 1, kernels: int = 1, dimension: float | None = None) -> float:
    """Code length: parameters, the choice of the support among all patterns, each rule's window, sign and kernel."""
    s = len(support)
    if not s:
        return 0.0
    d = max(s * knots, dimension or 0)
    choice = math.lgamma(skeletons + 1) - math.lgamma(s + 1) - math.lgamma(skeletons - s + 1)
    return d * math.log(max(2, entities)) + 2 * choice + s * 2 * math.log(2 * windows * kernels)


@dataclass
class Data:
    """Canonical tables of one partition of entities, with the settings that designs share."""

    events: DataFrame
    targets: DataFrame
    entities: DataFrame
    lag: int = 6
    bins: int = 1
    responses: dict = field(default_factory=dict)
    arrays: dict = field(default_factory=dict)
    optima: dict = field(default_factory=dict)

    def only(self, *parts: int) -> Data:
        keep = self.entities.where(F.col("part").isin(*parts))
        ids = F.broadcast(keep.select("e")) if keep.limit(100_001).count() <= 100_000 else keep.select("e")  # a checked size
        return Data(self.events.join(ids, "e", "left_semi"), self.targets.join(ids, "e", "left_semi"), keep, self.lag, self.bins)

    def matches(self, pattern: tuple[int, ...], relation: str) -> DataFrame:
        key = (pattern, relation)
        if key not in self.responses:
            self.responses[key] = M.completions(self.events, pattern, relation).persist()
        return self.responses[key]

    def close(self) -> None:
        for df in self.responses.values():
            df.unpersist()
        self.responses.clear()

    def prepare(self, rules: Sequence[Rule], pairs: bool = True) -> None:
        """Designs of all rules, and of all pairs of different patterns, from one pass over the rows that any rule reaches.

        Counted are each rule's rows by value, and the rows that two rules reach together by both values; what only one
        of them reaches, and what neither does, are differences. Where there are more counts than the driver takes,
        fit() makes the designs one by one.
        """
        base = _arrays(self.design(()), 0)
        if base is None:
            return
        shapes = list(dict.fromkeys((r.pattern, r.relation) for r in rules))
        listed = self.entities.sparkSession.createDataFrame([(shapes.index((r.pattern, r.relation)), r.window, k) for k, r in enumerate(rules)], "s int, window int, k int")
        found = reduce(DataFrame.unionByName, [M.completions(self.events, *shape).select("e", "t", "span", F.lit(i).alias("s")) for i, shape in enumerate(shapes)])
        rows = P.responses(found, listed, self.entities, self.lag).groupBy("e", "row").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("by"))  # at most one entry a rule
        rows = P.with_targets(rows, self.targets).join(self.entities.select("e", "stratum"), "e").withColumn("cell", P.cell(self.bins)).persist()
        counted = lambda df, *by: df.groupBy(*by, "stratum", "cell").agg(F.count("*").alias("exposure"), F.sum("n").alias("events")).limit(COLLECTED + 1).collect()
        single = counted(rows.select("stratum", "cell", "n", F.inline("by")), "k", "x")
        joint = "flatten(transform(by, (a, i) -> transform(slice(by, i + 2, size(by)), b -> struct(a.k AS k, a.x AS x, b.k AS l, b.x AS y))))"
        double = counted(rows.select("stratum", "cell", "n", F.inline(F.expr(joint))), "k", "l", "x", "y") if pairs else []
        rows.unpersist()
        if max(len(single), len(double)) > COLLECTED:
            return
        _, cells, cell, exposure, events = base
        at = {c: i for i, c in enumerate(cells)}
        whole = {(i, ()): np.array([exposure[cell == i].sum(), events[cell == i].sum()]) for i in range(len(cells))}
        alone, both = defaultdict(dict), defaultdict(dict)
        for r in single:
            alone[r["k"]][at[(r["stratum"], r["cell"])], r["x"]] = np.array([r["exposure"], r["events"]], dtype=float)
        for r in double:
            both[r["k"], r["l"]][at[(r["stratum"], r["cell"])], r["x"], r["y"]] = np.array([r["exposure"], r["events"]], dtype=float)

        def stored(plain: Support, counts: dict) -> None:
            left = {(c, *[0.0] * len(plain)): v.copy() for (c, _), v in whole.items()}
            for key, v in counts.items():
                left[(key[0], *[0.0] * len(plain))] -= v
            kept = [(key, v) for key, v in (*counts.items(), *left.items()) if v[0] > 0]
            keys, sums = np.array([key for key, _ in kept], dtype=float), np.array([v for _, v in kept])
            self.arrays[plain] = (keys[:, 1:], cells, keys[:, 0].astype(int), sums[:, 0], sums[:, 1])

        for k, r in enumerate(rules):
            stored((r,), alone[k])
        for k, l in combinations(range(len(rules)), 2) if pairs else ():
            if rules[k].pattern != rules[l].pattern:
                counts = dict(both[k, l])
                first, second = ({(c, x): v.copy() for (c, x), v in alone[i].items()} for i in (k, l))
                for (c, x, y), v in counts.items():
                    first[c, x] -= v
                    second[c, y] -= v
                counts |= {(c, x, 0.0): v for (c, x), v in first.items()} | {(c, 0.0, y): v for (c, y), v in second.items()}
                plain = (rules[k], rules[l])
                if rules[k] > rules[l]:
                    plain, counts = plain[::-1], {(c, y, x): v for (c, x, y), v in counts.items()}
                stored(plain, counts)

    def outside(self, support: Support) -> bool:
        """Whether the best coefficients free in sign have other signs than the support's.

        The loss is convex, so the support's own optimum then has a coefficient at 0, and this one need not be fitted. False where the design is not on the driver.
        """
        plain = tuple(Rule(r.pattern, r.relation, r.window) for r in support)
        if plain not in self.optima:
            known = self.arrays.get(plain)
            got = newton(*known[:1], *known[2:], signed=False) if known else None
            self.optima[plain] = got[1] if got and got[3] else None
        best = self.optima[plain]
        return best is not None and any(b * r.sign < 0 for b, r in zip(best, support, strict=True))

    def active(self, rules: Sequence[Rule]) -> DataFrame:
        """e, row and one signed column per rule; rows that no rule reaches are not listed."""
        out = None
        for k, r in enumerate(rules):
            block = P.kernel_response(self.matches(r.pattern, r.relation), self.entities, r.window, self.lag).select("e", "row", F.round(r.sign * F.col("v1"), 9).alias(f"x{k}"))
            out = block if out is None else out.join(block, ["e", "row"], "full_outer")
        return out.select("e", "row", *[F.coalesce(f"x{k}", F.lit(0.0)).alias(f"x{k}") for k in range(len(rules))])

    def design(self, rules: Sequence[Rule]) -> DataFrame:
        names = [f"x{k}" for k in range(len(rules))]
        if not rules:
            return P.complement(self.entities, self.targets, self.entities.where("1 = 0").select("e", F.col("start").alias("row")), self.bins)
        return P.design(self.entities, self.targets, self.active(rules), names, self.bins)


@dataclass
class Fit:
    rules: Support
    cells: dict[tuple[int, int], float]
    beta: np.ndarray
    nll: float
    converged: bool


def _arrays(design: DataFrame, k: int, limit: int = COLLECTED) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray] | None:
    """The design on the driver; None where it has more than limit distinct rows."""
    rows = design.where("exposure > 0").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    cells = sorted({(r["stratum"], r["cell"]) for r in rows})
    at = {c: i for i, c in enumerate(cells)}
    x = np.array([[r[f"x{j}"] for j in range(k)] for r in rows], dtype=float).reshape(len(rows), k)
    return x, cells, np.array([at[(r["stratum"], r["cell"])] for r in rows]), np.array([r["exposure"] for r in rows], dtype=float), np.array([r["events"] for r in rows], dtype=float)


def _projected(at: Callable, theta: np.ndarray, free: np.ndarray, total: float, rounds: int) -> tuple[np.ndarray, float, bool]:
    """Projected Newton with halving, coefficients that are not free at least 0; at(theta) gives loss, gradient and Hessian."""
    now, grad, h = at(theta)
    for _ in range(rounds):
        work = free | (theta > 0) | (grad < 0)
        if np.abs(grad[work]).max(initial=0) < 1e-8 * max(1.0, total):
            return theta, now, True
        step = np.zeros_like(theta)
        step[work] = -np.linalg.lstsq(h[np.ix_(work, work)] + 1e-10 * np.eye(work.sum()), grad[work], rcond=None)[0]
        size = 1.0
        for _ in range(60):
            new = theta + size * step
            new[~free] = np.maximum(new[~free], 0)
            after = at(new)
            if after[0] <= now + 1e-4 * grad @ (new - theta):
                break
            size /= 2
        done = now - after[0] < 1e-11 * max(1.0, abs(now))
        theta, now, grad, h = new, min(now, after[0]), *after[1:]
        if done:
            return theta, now, True
    return theta, now, False


def _start(events: np.ndarray, exposure: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Baselines from each cell's events and exposure, coefficients 0; and which parameters are free in sign."""
    m = len(events)
    return np.concatenate([np.log((events + 0.5) / (exposure + 1.0)), np.zeros(k)]), np.concatenate([np.ones(m, bool), np.zeros(k, bool)])


def newton(x: np.ndarray, cell: np.ndarray, exposure: np.ndarray, events: np.ndarray, rounds: int = 100, signed: bool = True) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """Poisson likelihood, free baselines per cell, rule coefficients at least 0 (or, where signed is False, of any sign)."""
    m, k = int(cell.max()) + 1, x.shape[1]
    theta, free = _start(np.bincount(cell, events, m), np.bincount(cell, exposure, m), k)
    d = np.column_stack([np.eye(m)[cell], x])

    def at(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = np.clip(d @ t, -745, 700)
        rate = exposure * np.exp(eta)
        return float(rate.sum() - events @ eta), d.T @ (rate - events), (d * rate[:, None]).T @ d

    theta, loss, ok = _projected(at, theta, free | (not signed), events.sum(), rounds)
    return theta[:m], theta[m:], loss, ok


def fit(data: Data, rules: Support) -> Fit:
    """Both signs of a rule share one design, which is aggregated once; designs too large to collect are fitted by passes."""
    plain = tuple(Rule(r.pattern, r.relation, r.window) for r in rules)
    if plain not in data.arrays:
        data.arrays[plain] = _arrays(data.design(plain), len(plain))
    if data.arrays[plain] is None:
        signed = [(r.sign * F.col(f"x{k}")).alias(f"x{k}") for k, r in enumerate(rules)]
        cells, base, beta, nll, ok = fit_by_cells(data.design(plain).select("stratum", "cell", *signed, "exposure", "events"), [f"x{k}" for k in range(len(rules))], ("stratum", "cell"))
        return Fit(rules, dict(zip(cells, base.tolist(), strict=True)), beta, nll, ok)
    x, cells, cell, exposure, events = data.arrays[plain]
    x = x * np.array([r.sign for r in rules], dtype=float)
    base, beta, nll, ok = newton(x, cell, exposure, events)
    return Fit(rules, dict(zip(cells, base.tolist(), strict=True)), beta, nll, ok)


def fit_by_cells(design: DataFrame, values: Sequence[str], cells: Sequence[str] = (), rounds: int = 100) -> tuple[list[tuple], np.ndarray, np.ndarray, float, bool]:
    """newton() with one aggregation per evaluation; what comes back is one row of sums for each cell."""
    rows, k = design.where("exposure > 0").select(*cells, *values, "exposure", "events").persist(), len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.col(v) for v in values]
    fixed = rows.groupBy(*cells).agg(F.sum("exposure").alias("_x"), F.sum("events").alias("_n"), *[F.sum(F.col("events") * c).alias(f"_s{j}") for j, c in enumerate(x)]).collect()
    fixed.sort(key=lambda r: tuple(r[c] for c in cells))
    known = [tuple(r[c] for c in cells) for r in fixed]
    place, m = {c: i for i, c in enumerate(known)}, len(known)
    seen = np.array([float(r["_n"]) for r in fixed] + [sum(float(r[f"_s{j}"]) for r in fixed) for j in range(k)])
    theta, free = _start(seen[:m], np.array([float(r["_x"]) for r in fixed]), k)

    def at(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        based = rows.withColumn("_b", F.lit(float(t[0])))
        if cells:  # one row for each cell
            table = rows.sparkSession.createDataFrame([(*c, float(b)) for c, b in zip(known, t, strict=False)], ", ".join(f"{c} {design.schema[c].dataType.simpleString()}" for c in cells) + ", _b double")
            based = rows.join(F.broadcast(table), list(cells))
        eta = sum((float(w) * c for w, c in zip(t[m:], x, strict=True)), F.col("_b"))
        rated = based.withColumn("_r", F.col("exposure") * F.exp(F.greatest(F.lit(-745.0), F.least(F.lit(700.0), eta))))
        sums = [F.sum("_r"), *[F.sum(F.col("_r") * c) for c in x], *[F.sum(F.col("_r") * x[i] * x[j]) for i, j in pairs]]
        grad, h = -seen, np.zeros((m + k, m + k))
        for r in rated.groupBy(*cells).agg(*[v.alias(f"_s{i}") for i, v in enumerate(sums)]).collect():
            c, got = place[tuple(r[n] for n in cells)], [r[f"_s{i}"] for i in range(len(sums))]
            grad[c] += got[0]
            grad[m:] += got[1 : k + 1]
            h[c, c] = got[0]
            h[c, m:] = h[m:, c] = got[1 : k + 1]
            for v, (i, j) in zip(got[k + 1 :], pairs, strict=True):
                h[m + i, m + j] += v
                h[m + j, m + i] = h[m + i, m + j]
        return float((grad + seen)[:m].sum() - seen @ t), grad, h

    theta, loss, ok = _projected(at, theta, free, seen[:m].sum(), rounds)
    rows.unpersist()
    return known, theta[:m], theta[m:], loss, ok


def fit_distributed(design: DataFrame, values: Sequence[str], rounds: int = 100) -> tuple[np.ndarray, float]:
    """fit_by_cells() with one baseline for all rows: parameters and loss."""
    _, base, beta, nll, _ = fit_by_cells(design, values, (), rounds)
    return np.concatenate([base, beta]), nll


@dataclass
class Record:
    support: Support
    fit: Fit
    penalty: float
    score: float


def dictionary(predicates: Sequence[int], windows: Sequence[int], q_max: int = 2, relations: Sequence[str] = ("unordered", "ordered")) -> list[Rule]:
    """All identities: singletons have window 0 only, ordered patterns no window 0, each with both signs."""
    out = []
    for pattern, relation in M.grammar(predicates, q_max, relations):
        for w in [0] if relation == "atomic" else [w for w in windows if w > 0 or relation != "ordered"]:
            out += [Rule(pattern, relation, w, s) for s in (1, -1)]
    return out


def search(data: Data, rules: Sequence[Rule], max_rules: int = 2, tolerance: float = 1e-6) -> list[Record]:
    """Forward additions of any identity with drops, from every identity, so a pair may pay only jointly; refitted exactly.

    The designs of all identities and pairs come from one pass (Data.prepare); larger supports have one of their own.
    Supports that do not pay are left out; where none pays, the best start's stays.
    """
    skeletons = len({(r.pattern, r.relation) for r in rules})
    windows = max(1, len({r.window for r in rules}))
    n = data.entities.count()
    base = fit(data, ())
    known: dict[Support, Record] = {(): Record((), base, 0.0, 0.0)}

    def price(s: Support) -> Record:
        if s not in known:
            c = penalty(s, skeletons, windows, n)
            if data.outside(s):  # one coefficient is 0, so the best support with one rule less has this one's loss
                less = min((price(tuple(r for r in s if r != d)) for d in s), key=lambda x: x.fit.nll)
                beta = np.array([dict(zip(less.support, less.fit.beta.tolist(), strict=True)).get(r, 0.0) for r in s])
                f = Fit(s, less.fit.cells, beta, less.fit.nll, less.fit.converged)
            else:
                f = fit(data, s)
            known[s] = Record(s, f, c, 2 * (base.nll - f.nll) - c if f.converged else -math.inf)
        return known[s]

    data.prepare(list(dict.fromkeys(Rule(r.pattern, r.relation, r.window) for r in rules)), max_rules > 1)
    singles = sorted((price((r,)) for r in rules), key=lambda x: (-x.score, x.support))
    best: dict[Support, Record] = {}
    for start in singles:
        now = start
        while len(now.support) < max_rules:
            more = [price(tuple(sorted((*now.support, x)))) for x in rules if x.pattern not in {r.pattern for r in now.support}]
            top = max(more, key=lambda x: (x.score, [-ord(c) for c in support_key(x.support)]), default=None)
            if top is None or top.score <= now.score + tolerance:
                break
            now = top
            drops = [price(tuple(r for r in now.support if r != d)) for d in now.support]
            now = max([now, *[x for x in drops if x.support]], key=lambda x: x.score)
        best[now.support] = now
    found = sorted(best.values(), key=lambda x: (-x.score, x.support))
    return [x for x in found if x.score > tolerance] or found[:1]


def entity_gains(data: Data, base: Fit, full: Fit) -> DataFrame:
    """e, gain (null less full loss) and score (direction of the full predictor at the null) over all rows of e.

    What both baselines differ by is summed in closed form from exposure and events per entity and cell; only rows
    that a rule reaches are listed, for the rest of the difference.
    """
    cells = sorted({*base.cells, *full.cells})
    table = data.entities.sparkSession.createDataFrame([(s, c, base.cells.get((s, c), -20.0), full.cells.get((s, c), -20.0)) for s, c in cells], "stratum int, cell int, b0 double, b1 double")
    table = F.broadcast(table)  # one row per cell
    stratum = data.entities.select("e", "stratum")
    held = P.baseline_segments(data.entities, data.bins).groupBy("e", "cell").agg(F.sum(F.col("stop") - F.col("begin")).alias("exposure"))
    seen = data.targets.groupBy("e", P.cell(data.bins, "t").alias("cell")).agg(F.sum("mult").alias("n"))
    whole = held.join(seen, ["e", "cell"], "left").join(stratum, "e").join(table, ["stratum", "cell"]).withColumn("n", F.coalesce("n", F.lit(0)))
    shift = F.col("b1") - F.col("b0")
    parts = whole.select("e", (F.col("exposure") * (F.exp("b0") - F.exp("b1")) + F.col("n") * shift).alias("gain"), ((F.col("n") - F.col("exposure") * F.exp("b0")) * shift).alias("score"))
    if full.rules:
        extra = sum((float(w) * F.col(f"x{k}") for k, w in enumerate(full.beta)), F.lit(0.0))
        rows = P.with_targets(data.active(full.rules), data.targets).join(stratum, "e").withColumn("cell", P.cell(data.bins)).join(table, ["stratum", "cell"])
        parts = parts.unionByName(rows.select("e", (F.exp("b1") - F.exp(F.col("b1") + extra) + F.col("n") * extra).alias("gain"), ((F.col("n") - F.exp("b0")) * extra).alias("score")))
    return parts.groupBy("e").agg(F.sum("gain").alias("gain"), F.sum("score").alias("score"))


@dataclass
class Certificate:
    key: str
    f1: float
    f2: float
    f3_lower: float
    p_max: float
    p_adjusted: float
    certified: bool


def certify(data: Data, base: Fit, records: Sequence[Record], alpha: float = 0.05, resamples: int = 20_000) -> list[Certificate]:
    """Frozen predictors on held-out entities: score direction, mean gain and robust gain must all be positive.

    The largest of the three p-values stands for a support; step-down max-T over all supports adjusts them, and
    an adjusted p-value is never below its raw one. Nothing is refitted. Gains of entities stay in Spark: the driver
    gets their moments and the products of the supports' influences.
    """
    if not records:
        return []
    parts = data.entities.select("e", F.lit(-1).alias("k"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("score"))
    for k, record in enumerate(records):
        parts = parts.unionByName(entity_gains(data, base, record.fit).select("e", F.lit(k).alias("k"), "gain", "score"))
    names = [(f"g{k}", f"s{k}") for k in range(len(records))]
    held = [F.sum(F.when(F.col("k") == k, F.col(c)).otherwise(0.0)).alias(n) for k, pair in enumerate(names) for c, n in zip(("gain", "score"), pair, strict=True)]
    wide = parts.groupBy("e").agg(*held).persist()
    means = wide.agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for pair in names for n in pair]).first()
    n = means["n"]
    if not n:
        wide.unpersist()
        return [Certificate(support_key(r.support), 1.0, 1.0, -math.inf, 1.0, 1.0, False) for r in records]
    centred = wide.select(*[(F.col(c) - means[c]).alias(c) for pair in names for c in pair])
    power = lambda c, p: F.avg(F.pow(c, F.lit(float(p))))
    moments = centred.agg(*[power(c, p).alias(f"{c}_{p}") for pair in names for c in pair for p in (2, 3, 4)]).first()
    tests, influences = [], []
    for g, s in names:
        m2, m3, m4 = (moments[f"{g}_{p}"] for p in (2, 3, 4))
        f1, f2, f3 = I.mean_test_of(n, means[s], moments[f"{s}_2"], alpha=alpha), I.mean_test_of(n, means[g], m2, alpha=alpha), I.robust_test_of(n, means[g], m2, m3, m4, alpha=alpha)
        weakest, column = min((f1, s), (f2, g), key=lambda t: t[0].statistic)
        worst, x = (f3, F.col(g) - I.robust_scale(n, alpha) * (F.col(g) * F.col(g) - m2) / (2 * math.sqrt(m2))) if f3.statistic < weakest.statistic and m2 > 0 else (f3 if f3.statistic < weakest.statistic else weakest, F.col(column))
        influences.append(x)
        tests.append((f1, f2, f3, worst))
    products = np.zeros((len(tests), len(tests)))
    shown = centred.select(*[x.alias(f"x{k}") for k, x in enumerate(influences)])
    for i in range(len(tests)):  # a row of products at a time, so that no aggregation grows with the square
        got = shown.agg(*[F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{j}") for j in range(i, len(tests))]).first()
        products[i, i:] = products[i:, i] = got
    wide.unpersist()
    size = np.sqrt(np.diag(products))
    unit = np.where(size > 0, 1 / np.where(size > 0, size, 1.0), 0.0)
    adjusted = I.romano_wolf_of([t[3].statistic for t in tests], products * np.outer(unit, unit), resamples)
    out = []
    for record, (f1, f2, f3, worst), p in zip(records, tests, adjusted, strict=True):
        p = max(p, worst.pvalue)
        out.append(Certificate(support_key(record.support), f1.pvalue, f2.pvalue, f3.lower, worst.pvalue, p, p <= alpha and f3.lower > 0))
    return out


def compact(certificates: Sequence[Certificate], scores: dict[str, float]) -> list[Certificate]:
    """Of nested certified supports the better scored one stays."""
    sets = {c.key: frozenset(c.key.split(";")) for c in certificates if c.certified}
    return [c for c in certificates if c.key in sets and not any((sets[o] < sets[c.key] or sets[o] > sets[c.key]) and (scores[o], o) > (scores[c.key], c.key) for o in sets)]


def mixture(data: Data, base: Fit, fits: Sequence[Fit]) -> np.ndarray:
    """Convex weights of frozen models (the baseline first), from sufficient statistics.

    These are each model's total over its design, and how many targets there are for each distinct vector of rates. A
    vector stands for a cell and the values of the rules, so there are as many as rows of a common design; up to
    500,000 are brought to the driver, more are summed by one pass a round, by the same steps.
    """
    cells = sorted({c for f in (base, *fits) for c in f.cells})
    schema = ["stratum int", "cell int", *[f"b{k} double" for k in range(len(fits) + 1)]]
    table = F.broadcast(data.entities.sparkSession.createDataFrame([(*c, *[f.cells.get(c, -20.0) for f in (base, *fits)]) for c in cells], ", ".join(schema)))  # one row per cell
    rows = data.targets.withColumnRenamed("t", "row").join(data.entities.select("e", "stratum"), "e").withColumn("cell", P.cell(data.bins)).join(table, ["stratum", "cell"])
    linear = []
    for k, f in enumerate((base, *fits)):
        names = [f"x{j}" for j in range(len(f.rules))]
        eta = sum((float(w) * F.col(c) for w, c in zip(f.beta, names, strict=True)), F.col(f"b{k}"))
        linear.append(float(data.design(f.rules).join(table, ["stratum", "cell"]).agg(F.sum(F.col("exposure") * F.exp(eta))).first()[0] or 0.0))
        if f.rules:
            rows = rows.join(data.active(f.rules), ["e", "row"], "left").fillna(0.0, names)
        rows = rows.withColumn(f"r{k}", F.exp(eta)).drop(*names)
    rates = [f"r{k}" for k in range(len(linear))]
    seen = rows.groupBy(*rates).agg(F.sum("mult").alias("n")).persist()
    got = seen.limit(COLLECTED + 1).collect()
    if len(got) <= COLLECTED:
        seen.unpersist()
        columns, counts = np.array([[r[c] for c in rates] for r in got], dtype=float).reshape(len(got), len(rates)), np.array([r["n"] for r in got], dtype=float)
        return I.simplex_mixture(columns, np.array(linear), counts)

    def sums(w: np.ndarray) -> tuple[float, np.ndarray]:
        rate = F.greatest(F.lit(1e-300), sum((float(v) * F.col(c) for v, c in zip(w, rates, strict=True)), F.lit(0.0)))
        out = seen.agg(F.sum(F.col("n") * F.log(rate)).alias("l"), *[F.sum(F.col("n") * F.col(c) / rate).alias(c) for c in rates]).first()
        return out["l"], np.array([out[c] for c in rates])

    weights = I.simplex_ascent(sums, np.array(linear))
    seen.unpersist()
    return weights


#: When Hawkes fits stop, whichever way the rows are held: rounds at most, and the largest relative gradient.
HAWKES_ROUNDS, HAWKES_TOLERANCE = 2000, 1e-8


def _hawkes(sums: Callable, total: float, mass: np.ndarray, exposure: float, rounds: int, tolerance: float) -> tuple[float, np.ndarray, float, bool]:
    """Projected Newton on the convex likelihood of (base, excitations) >= 0; a step of EM where halving finds no descent.

    sums(theta) gives, over all target rows with count c, columns z = (1, states) and rate r: c log r, c z / r and
    c z z' / r^2. Each call is one pass, and counts as a round.
    """
    scale = np.maximum(np.concatenate(([exposure], mass)), 1e-300)
    theta = np.concatenate(([max(1e-9, total / exposure / 2)], np.where(mass > 0, 0.01, 0.0)))
    passes = 0

    def at(t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        nonlocal passes
        passes += 1
        logs, first, second = sums(t)
        return float(scale @ t - logs), first, second

    now, first, second = at(theta)
    while True:
        grad = 1 - first / scale  # by theta * scale
        work = ((theta > 0) | (grad < 0)) & (np.concatenate(([exposure], mass)) > 0)
        if np.abs(grad[work]).max(initial=0) <= tolerance or passes >= rounds:
            return float(theta[0]), theta[1:], now, bool(np.abs(grad[work]).max(initial=0) <= tolerance)
        h = second[np.ix_(work, work)] / np.outer(scale[work], scale[work])
        step = np.zeros_like(theta)
        step[work] = -np.linalg.lstsq(h + 1e-12 * max(1e-300, np.trace(h)) * np.eye(work.sum()), grad[work], rcond=None)[0] / scale[work]
        for size in 0.5 ** np.arange(12):
            new = np.maximum(theta + size * step, 0)
            after = at(new)
            if after[0] <= now + 1e-4 * float((grad * scale) @ (new - theta)) + 1e-13 * abs(now) or passes >= rounds:
                break
        else:
            new = theta * first / scale
            after = at(new)
        if after[0] > now + 1e-12 * abs(now):
            return float(theta[0]), theta[1:], now, False
        theta, (now, first, second) = new, after


def hawkes_fit(states: np.ndarray, counts: np.ndarray, mass: np.ndarray, exposure: float, rounds: int = HAWKES_ROUNDS, tolerance: float = HAWKES_TOLERANCE) -> tuple[float, np.ndarray, float, bool]:
    """Base rate and nonnegative excitations of an exponential Hawkes process, the loss, and whether they converged."""
    z = np.column_stack([np.ones(len(states)), states])

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        rate = np.maximum(z @ theta, 1e-300)
        d = z / rate[:, None]
        return float(counts @ np.log(rate)), counts @ d, (d * counts[:, None]).T @ d

    return _hawkes(sums, float(counts.sum()), mass, exposure, rounds, tolerance)


def hawkes_fit_distributed(rows: DataFrame, names: Sequence[str], mass: np.ndarray, exposure: float, rounds: int = HAWKES_ROUNDS, tolerance: float = HAWKES_TOLERANCE) -> tuple[float, np.ndarray, float, bool]:
    """hawkes_fit() with one aggregation per round, of rows (mult, names) too many to collect."""
    rows = rows.select("mult", *names).persist()
    n = len(names) + 1
    upper = [(i, j) for i in range(n) for j in range(i, n)]

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = [F.lit(1.0), *map(F.col, names)]
        rate = F.greatest(F.lit(1e-300), sum((float(w) * c for w, c in zip(theta, z, strict=True)), F.lit(0.0)))
        d = rows.select("mult", F.log(rate).alias("l"), *[(c / rate).alias(f"d{k}") for k, c in enumerate(z)])
        parts = [F.sum(F.col("mult") * F.col("l")), *[F.sum(F.col("mult") * F.col(f"d{k}")) for k in range(n)], *[F.sum(F.col("mult") * F.col(f"d{i}") * F.col(f"d{j}")) for i, j in upper]]
        got = [float(v or 0) for v in d.agg(*[p.alias(f"s{k}") for k, p in enumerate(parts)]).first()]
        h = np.zeros((n, n))
        for v, (i, j) in zip(got[n + 1 :], upper, strict=True):
            h[i, j] = h[j, i] = v
        return got[0], np.array(got[1 : n + 1]), h

    out = _hawkes(sums, float(rows.agg(F.sum("mult")).first()[0] or 0), mass, exposure, rounds, tolerance)
    rows.unpersist()
    return out
