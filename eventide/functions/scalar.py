"""Scalar column functions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_ADDRESS = "0x" + "0" * 40


def hash_split(key: Column, seed: int, fractions: Sequence[float]) -> Column:
    """Partition code by the first 8 bytes of SHA-256("seed:key") against cumulative shares of 2**64.

    Hex strings of one length compare as the unsigned numbers they stand for, so no 64-bit overflow occurs.
    """
    prefix = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256), 1, 16)
    total, out = 0.0, None
    for code, share in enumerate(fractions[:-1]):
        total += share
        limit = F.lit(f"{min(int(total * 2**64), 2**64 - 1):016x}")
        out = F.when(prefix < limit, F.lit(code)) if out is None else out.when(prefix < limit, F.lit(code))
    return F.lit(len(fractions) - 1) if out is None else out.otherwise(F.lit(len(fractions) - 1))


def clean_address(c: Column) -> Column:
    """Trimmed lower-case 0x + 40 hex digits, else null."""
    low = F.lower(F.trim(c))
    return F.when(low.rlike("^0x[0-9a-f]{40}$"), low)


def data_word(data: Column, k: int) -> Column:
    """The k-th 32-byte word of 0x-prefixed hex data, as 64 hex digits."""
    return F.substring(data, 3 + 64 * k, 64)


def word_address(word: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.substring(word, -40, 40)))


def word_number(word: Column) -> Column:
    """A word as a decimal string; exact up to 64 bits, null beyond (256-bit amounts stay hex)."""
    return F.when(F.length(F.ltrim(word, F.lit("0"))) <= 16, F.conv(F.substring(word, -16, 16), 16, 10))


def primitive_id(block: Column, index: Column) -> Column:
    """block << 20 | index."""
    return F.shiftleft(block.cast("bigint"), 20).bitwiseOR(index.cast("bigint"))


def price_primitive_id(version: Column, reserve: Column, tick: Column) -> Column:
    """A tag bit above 60 bits of a hash of the key."""
    digest = F.substring(F.sha2(F.concat_ws(":", version, reserve, tick.cast("string")), 256), 1, 15)
    return F.conv(digest, 16, 10).cast("bigint").bitwiseOR(F.lit(1 << 61))


def dominance(bid: Column, ask: Column) -> Column:
    return F.signum(F.nanvl(bid - ask, F.lit(0.0))).cast("int")


def sigmoid(x: Column) -> Column:
    """Stable for large arguments of either sign."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def cloglog_event(eta: Column) -> Column:
    """-log(1 - exp(-exp(eta))), by a series for small rates and a tail for large ones."""
    x = F.exp(eta)
    series = x / 2 - x * x / 24 - F.log(x)
    return F.when(x < 1e-4, series).when(x > 40, F.exp(-x)).otherwise(-F.log(-F.expm1(-x)))


def cloglog_event_slopes(eta: Column) -> tuple[Column, Column]:
    """First and second derivative of cloglog_event by eta."""
    x = F.exp(eta)
    ratio = F.when(x < 1e-4, 1 - x / 2 + x * x / 12).when(x > 40, x * F.exp(-x)).otherwise(x / F.expm1(x))
    return -ratio, -ratio * (1 - x - ratio)


def loss_row(eta: Column, likelihood: str, exposure: Column, no_event: Column, event: Column) -> Column:
    """Negative log-likelihood of a row: Poisson exposure * exp(eta) - n * eta, or complementary log-log."""
    if likelihood in ("poisson", "continuous_poisson"):
        return exposure * F.exp(eta) - event * eta
    eta = F.greatest(F.lit(-745.0), F.least(F.lit(700.0), eta))
    return no_event * F.exp(eta) + event * cloglog_event(eta)


def loss_slopes(eta: Column, likelihood: str, exposure: Column, no_event: Column, event: Column) -> tuple[Column, Column]:
    """First and second derivative of loss_row by eta."""
    if likelihood in ("poisson", "continuous_poisson"):
        return exposure * F.exp(eta) - event, exposure * F.exp(eta)
    eta = F.greatest(F.lit(-745.0), F.least(F.lit(700.0), eta))
    first, second = cloglog_event_slopes(eta)
    return no_event * F.exp(eta) + event * first, no_event * F.exp(eta) + event * second


def poisson_conjugate(dual: Column, exposure: Column, event: Column) -> Column:
    """sup over eta of dual * eta - loss: (u)(log(u / exposure) - 1) with u = dual + event."""
    u = dual + event
    return F.when(u > 0, u * (F.log(u / exposure) - 1)).when(u == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))


def sql_round(x: Column, places: int) -> Column:
    """round() of doubles as DuckDB has it: half away from zero in scaled arithmetic; zeros keep the sign of x."""
    scaled = x * 10.0**places
    near = F.rint(scaled)
    out = F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / 10.0**places
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def score_of_fit(baseline_nll: Column, fit_nll: Column, penalty: Column) -> Column:
    return 2 * (baseline_nll - fit_nll) - penalty


def support_score(baseline_nll: Column, fit_nll: Column, penalty: Column) -> Column:
    score = score_of_fit(baseline_nll, fit_nll, penalty)
    return F.when(F.isnan(score) | F.isnull(score), F.lit(float("-inf"))).otherwise(score)


def block_mdl_delta(gain: Column, parent_penalty: Column, child_penalty: Column) -> Column:
    return 2 * gain - (child_penalty - parent_penalty)
