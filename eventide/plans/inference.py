"""Driver-side statistics of small vectors: tests, bounds and multiplicity; rows come aggregated from Spark."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np


@dataclass(frozen=True)
class MeanTest:
    n: int
    mean: float
    statistic: float
    pvalue: float
    lower: float


def _tail(z: float) -> float:
    return min(1.0, max(0.0, 0.5 * math.erfc(z / math.sqrt(2.0))))


def mean_test(values: np.ndarray, threshold: float = 0.0, alpha: float = 0.05) -> MeanTest:
    """One-sided normal test that the mean of independent values exceeds the threshold."""
    x = np.asarray(values, dtype=float)
    x = x[np.isfinite(x)]
    return mean_test_of(len(x), float(x.mean()), float(x.var()), threshold, alpha) if len(x) else mean_test_of(0, math.nan, 0.0)


def mean_test_of(n: int, mean: float, m2: float, threshold: float = 0.0, alpha: float = 0.05) -> MeanTest:
    """mean_test() of n values by their mean and second central moment."""
    sd = math.sqrt(m2 * n / (n - 1)) if n > 1 else 0.0
    if n < 2 or sd <= np.finfo(float).eps:
        return MeanTest(n, mean, -math.inf, 1.0, -math.inf)
    error = sd / math.sqrt(n)
    z = (mean - threshold) / error
    return MeanTest(n, mean, z, _tail(z), mean - NormalDist().inv_cdf(1 - alpha) * error)


def robust_scale(n: int, alpha: float = 0.05) -> float:
    """The radius of the density-ratio ball, in standard deviations of the values."""
    return NormalDist().inv_cdf(1 - alpha) / math.sqrt(n)


def robust_influence(values: np.ndarray, alpha: float = 0.05) -> tuple[float, np.ndarray]:
    """The least mean within a density-ratio ball of radius z**2 / n, and each value's influence on it."""
    x = np.asarray(values, dtype=float)
    sd = x.std()
    scale = robust_scale(len(x), alpha)
    c = x - x.mean()
    return float(x.mean() - scale * sd), c - scale * (c * c - sd * sd) / (2 * sd)


def robust_test(values: np.ndarray, threshold: float = 0.0, alpha: float = 0.05) -> MeanTest:
    """One-sided test of the least mean under local shifts of the distribution of entities."""
    x = np.asarray(values, dtype=float)
    x = x[np.isfinite(x)]
    c = x - x.mean() if len(x) else x
    return robust_test_of(len(x), float(x.mean()), *(float((c**p).mean()) for p in (2, 3, 4)), threshold, alpha) if len(x) else robust_test_of(0, math.nan, 0.0, 0.0, 0.0)


def robust_test_of(n: int, mean: float, m2: float, m3: float, m4: float, threshold: float = 0.0, alpha: float = 0.05) -> MeanTest:
    """robust_test() of n values by their mean and central moments; the influences' variance follows from them."""
    sd = math.sqrt(m2)
    if n < 3 or sd <= np.finfo(float).eps:
        return MeanTest(n, mean, -math.inf, 1.0, -math.inf)
    scale = robust_scale(n, alpha)
    variance = max(0.0, m2 - scale / sd * m3 + scale * scale / (4 * m2) * (m4 - m2 * m2))
    error = math.sqrt(variance / (n - 1))
    if error <= np.finfo(float).eps:
        return MeanTest(n, mean, -math.inf, 1.0, -math.inf)
    least = mean - scale * sd
    z = (least - threshold) / error
    return MeanTest(n, least, z, _tail(z), least - NormalDist().inv_cdf(1 - alpha) * error)


def l1_radius(n: int, environments: int, alpha: float) -> float:
    """Confidence radius of multinomial shares in L1."""
    return 0.0 if environments <= 1 else min(2.0, math.sqrt(2 * (environments * math.log(2) - math.log(alpha)) / n))


def worst_mixture_mean(values: np.ndarray, shares: np.ndarray, radius: float) -> float:
    """The least mean over shares within an L1 radius: mass moves from the largest values to the smallest one."""
    v, w = np.asarray(values, dtype=float), np.asarray(shares, dtype=float).copy()
    low, left = int(np.argmin(v)), min(radius / 2, 1.0)
    for high in np.argsort(-v, kind="stable"):
        move = min(left, w[high]) if v[high] > v[low] else 0.0
        w[high] -= move
        w[low] += move
        left -= move
    return float(w @ v)


def environment_pvalue(values: np.ndarray, shares: np.ndarray, n: int, threshold: float = 0.0) -> float:
    """The smallest alpha at which the worst mixture still exceeds the threshold, by bisection."""
    low, high = 1e-12, 1.0
    if worst_mixture_mean(values, shares, l1_radius(n, len(values), high)) <= threshold:
        return 1.0
    for _ in range(80):
        mid = math.sqrt(low * high)
        if worst_mixture_mean(values, shares, l1_radius(n, len(values), mid)) > threshold:
            high = mid
        else:
            low = mid
    return high


def holm(pvalues: list[float]) -> list[float]:
    order = np.argsort(pvalues, kind="stable")
    out, most = np.ones(len(pvalues)), 0.0
    for i, k in enumerate(order):
        most = max(most, min(1.0, (len(pvalues) - i) * pvalues[k]))
        out[k] = most
    return out.tolist()


def romano_wolf(statistics: list[float], influences: np.ndarray, resamples: int = 20_000, seed: int = 1) -> list[float]:
    """Step-down max-T: all hypotheses share Gaussian multipliers of the entities (rows of influences are standardised).

    The multipliers enter through the covariance of the influences, so nothing of the size entities x resamples
    is ever made.
    """
    if not len(statistics):
        return []
    z = np.asarray(influences, dtype=float)
    return romano_wolf_of(statistics, z @ z.T / z.shape[1], resamples, seed)


def romano_wolf_of(statistics: list[float], cov: np.ndarray, resamples: int = 20_000, seed: int = 1) -> list[float]:
    """romano_wolf() by the covariance of the standardised influences."""
    k = len(statistics)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    draws = np.random.default_rng(seed).standard_normal((resamples, k)) @ (vectors * np.sqrt(np.maximum(values, 0))).T
    order = np.argsort(-np.asarray(statistics), kind="stable")
    out, most = np.ones(k), 0.0
    for i, h in enumerate(order):
        top = draws[:, order[i:]].max(1)
        most = max(most, (1 + int((top >= statistics[h]).sum())) / (resamples + 1))
        out[h] = most
    return out.tolist()


def simplex_mixture(columns: np.ndarray, linear: np.ndarray, counts: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Convex weights of frozen intensities that maximise sum counts * log(columns @ w) - linear @ w.

    columns: target rows by components; linear: each component's total intensity. Exponentiated gradient with
    backtracking; the objective is concave, so the limit is the optimum.
    """
    def sums(u: np.ndarray) -> tuple[float, np.ndarray]:
        rate = np.maximum(columns @ u, 1e-300)
        return float(counts @ np.log(rate)), columns.T @ (counts / rate)

    return simplex_ascent(sums, linear, rounds)


def simplex_ascent(sums: Callable, linear: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The steps of simplex_mixture(); sums(w) gives sum counts * log(rate) and, by component, sum counts * column / rate."""
    k = len(linear)
    w, step = np.full(k, 1.0 / k), 1.0
    logs, first = sums(w)
    now = logs - float(linear @ w)
    for _ in range(rounds):
        grad = first - linear
        scale = max(1e-12, np.abs(grad).max())
        while step > 1e-10:
            new = w * np.exp(np.clip(step * grad / scale, -30, 30))
            new /= new.sum()
            logs, ahead = sums(new)
            after = logs - float(linear @ new)
            if after >= now:
                break
            step /= 2
        if step <= 1e-10 or after - now < 1e-12 * max(1.0, abs(now)):
            break
        w, now, first, step = new, after, ahead, min(step * 2, 8.0)
    return w


def effective_dimension(scores: np.ndarray, hessian: np.ndarray, columns: slice = slice(None)) -> float:
    """trace(H^-1 M) over some columns, with M the sum over clusters of outer products of their scores.

    scores: clusters by parameters, as Spark sums them; dependent rows of a cluster count as one.
    """
    meat = scores.T @ scores
    return float(np.trace(np.linalg.solve(hessian, meat)[columns, columns]))


def two_way_dimension(by_entity: np.ndarray, by_tick: np.ndarray, by_both: np.ndarray, hessian: np.ndarray) -> float:
    """Clusters that cross: entities and ticks, less what is in both."""
    return sum(sign * effective_dimension(s, hessian) for s, sign in ((by_entity, 1), (by_tick, 1), (by_both, -1)))


def poisson_lower_bound(x: np.ndarray, cell: np.ndarray, exposure: np.ndarray, events: np.ndarray, base: np.ndarray, beta: np.ndarray, slack: float = 1e-9) -> float:
    """A lower bound on the Poisson loss over all baselines and coefficients >= 0, from a near-optimal point.

    The point's rates, scaled per cell to the cell's events, are dual feasible when no coefficient could still gain
    by growing; then sum(rate - rate * log(rate / exposure)) bounds the loss. Otherwise the bound is -inf.
    """
    rate = exposure * np.exp(base[cell] + x @ beta)
    have, want = np.bincount(cell, rate, len(base)), np.bincount(cell, events, len(base))
    rate = rate * (want / np.maximum(have, 1e-300))[cell]
    if x.shape[1] and (x.T @ (rate - events)).min() < -slack * max(1.0, events.sum()):
        return -math.inf
    live = rate > 0
    return float((rate[live] - rate[live] * np.log(rate[live] / exposure[live])).sum())


def unbounded_axes(x: np.ndarray, events: np.ndarray) -> np.ndarray:
    """Columns whose coefficient could grow without end: they only lower rates, and never where events are."""
    return np.array([(c <= 0).all() and (c < 0).any() and not events[c < 0].any() for c in x.T])
