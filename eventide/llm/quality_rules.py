"""Quality rules as a learned decision list, in DataFrame functions only.

Every text is described by a few numbers that built-in functions compute in one pass; these make a small staged
table. Sequential covering over the labelled rows of that table (a bounded sample, per_class of each label)
grows conjunctions of thresholds by information gain, prunes each on rows that did not grow it, and removes what
it covers before the next. The list becomes one ordered Spark conditional expression, and stays readable:
describe() prints it.

Null and empty texts: no words; they fail the base rule. Without labels of both kinds the list is empty and the
base rule decides alone. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import labelled, staged

WORDS = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Labelled rows to learn from, of each label at most.
PER_CLASS = 8_000
NUMBERS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "marks", "digits", "line_words")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the four base numbers, and what FEATURES needs, of docs(doc_id, text)."""
    none = F.array().cast("array<bigint>")
    d = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
        .withColumn("words", F.regexp_extract_all("t", F.lit(WORDS), F.lit(0)))
        .withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .select(
            "doc_id", "words", F.size("words").alias("n"), F.char_length(F.array_join("words", "")).alias("word_chars"),
            F.regexp_count("t", F.lit(SYMBOLS)).alias("n_symbols"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
            F.regexp_count("t", F.lit("[A-Z]")).alias("n_capitals"), F.regexp_count("t", F.lit(r"[!?]")).alias("n_marks"), F.regexp_count("t", F.lit("[0-9]")).alias("n_digits"),
            F.size(F.array_distinct("words")).alias("n_distinct"),
        )
        .withColumn("h", F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - WINDOW)), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))).otherwise(none))
        .drop("words")
        # only texts that repeat a window sort their windows; their places come back in order
        .withColumn("sorted", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
        .drop("h")
        .withColumn("at", F.sort_array(F.transform(F.filter(F.transform("sorted", lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(F.get("sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("sorted", k + 1)["h"] == x["h"], F.lit(False))).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"])))
        .drop("sorted")
        # each place covers WINDOW words, or as many as there are up to the next place
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b), F.lit(0)))
    )
    return d.select("doc_id", *[F.col(c).cast("bigint").alias("n_words" if c == "n" else c) for c in ("n", *NUMBERS, "n_lines", "n_capitals", "n_marks", "n_digits", "n_distinct")])


def features() -> list[Column]:
    words = F.greatest(F.lit(1.0), F.col("n_words").cast("double"))
    chars = F.greatest(F.lit(1.0), F.col("word_chars").cast("double"))
    made = {
        "log_words": F.log1p(F.col("n_words").cast("double")), "word_length": chars / words, "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.lit(1.0), F.col("n_lines").cast("double")), "repeats": F.col("n_repeat_words") / words, "distinct": F.col("n_distinct") / words,
        "capitals": F.col("n_capitals") / chars, "marks": F.col("n_marks") / words, "digits": F.col("n_digits") / chars, "line_words": words / F.greatest(F.lit(1.0), F.col("n_lines").cast("double")),
    }
    return [made[f].alias(f) for f in FEATURES]


@dataclass(frozen=True)
class Rule:
    """Rows that meet all conditions (feature, above or not, threshold) are bad."""

    conditions: tuple[tuple[str, bool, float], ...]
    covered: int
    wrong: int

    def mask(self, x: np.ndarray) -> np.ndarray:
        m = np.ones(len(x), dtype=bool)
        for f, above, t in self.conditions:
            m &= (x[:, FEATURES.index(f)] >= t) if above else (x[:, FEATURES.index(f)] < t)
        return m

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.conditions:
            out = out & ((F.col(f) >= t) if above else (F.col(f) < t))
        return out


def _best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, tuple[str, bool, float] | None]:
    """The threshold with the largest FOIL gain over the rows given."""
    p, n = bad.sum(), len(bad) - bad.sum()
    if p == 0 or n == 0:
        return 0.0, None
    start, best = math.log2(p / (p + n)), (1e-6, None)
    for j, name in enumerate(FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, y = x[order, j], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        below = np.cumsum(y)[cut - 1]
        for above, pos, size in ((False, below, cut), (True, p - below, len(v) - cut)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / size) - start), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (name, above, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
    return best


def learn(x: np.ndarray, bad: np.ndarray, max_rules: int = 16, min_cover: int = 5, min_precision: float = 0.8) -> list[Rule]:
    """Sequential covering. Two rows of three grow each rule, the third prunes it; rows come in a fixed order."""
    out: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    third = np.arange(len(x)) % 3 == 2
    for _ in range(max_rules):
        grow, prune = left & ~third, left & third
        if bad[grow].sum() < min_cover:
            break
        conditions: list[tuple[str, bool, float]] = []
        rows = grow.copy()
        while len(conditions) < 4 and (~bad[rows]).any():
            _, condition = _best_condition(x[rows], bad[rows])
            if condition is None:
                break
            conditions.append(condition)
            rows &= Rule((condition,), 0, 0).mask(x)
        if not conditions:
            break

        def worth(c: tuple, prune: np.ndarray = prune) -> float:
            m = Rule(c, 0, 0).mask(x) & prune
            return (bad[m].sum() - (~bad[m]).sum() + 1) / (m.sum() + 2)

        kept = max((tuple(conditions[: k + 1]) for k in range(len(conditions))), key=lambda c: (round(worth(c), 6), -len(c)))
        m = Rule(kept, 0, 0).mask(x) & left
        if m.sum() < min_cover or bad[m].mean() < min_precision:
            break
        out.append(Rule(kept, int(m.sum()), int((~bad[m]).sum())))
        left &= ~m
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: true keeps."""
    if not rules:
        return F.lit(True)
    case = F.when(rules[0].column(), F.lit(False))
    for rule in rules[1:]:
        case = case.when(rule.column(), F.lit(False))
    return case.otherwise(F.lit(True))


def describe(rules: list[Rule]) -> str:
    return "\n".join("drop if " + " and ".join(f"{f} {'>=' if above else '<'} {t:.6g}" for f, above, t in r.conditions) + f"  ({r.covered} labelled rows, {r.wrong} wrong)" for r in rules)


def learn_rules(measured: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Rule]:
    known = F.broadcast(labelled(labels, "quality", per_class))  # at most 2 * per_class rows
    rows = measured.join(known, "doc_id").select("doc_id", "label", *features()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * per_class).collect()
    if len({r["label"] for r in rows}) < 2:
        return []
    x = np.array([[r[f] for f in FEATURES] for r in rows], dtype=float)
    return learn(x, np.array([r["label"] == 0 for r in rows]))


def apply_quality_rules(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    measured = staged(measure(docs), "quality_numbers")
    rules = learn_rules(measured, labels, per_class)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.select("*", *features()).select("doc_id", "n_words", *NUMBERS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
