"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged per document.

Features of a text are its white-space separated words, pairs of neighbouring words, and all runs of three and
four bytes; each is hashed into one of BUCKETS vectors. A document is the mean vector of all its features, a
softmax layer gives the two classes, and vectors and layer are trained together by stochastic gradient descent
in numpy, on a bounded sample of labelled rows (per_class of each label, outside the held-out fold).

A trained model scores by a table look-up: the mean of vectors times the layer is the mean of one number per
bucket. Whole texts are scored, in pieces of bounded size, and only the table (BUCKETS numbers) is sent out.

A pair of neighbouring words is hashed by the difference of their hashes, so that a word followed by itself is
one feature whatever the word: repetition can be learned from any language.

Null and empty texts have no features; their score is the model's for a zero vector. Without labels of both
kinds every score is the share of label 1 (0.5 without any). Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import class_counts, fold_of, labelled, pieces
from eventide.llm.textscan import _BASE, _BYTES, _U, _UNBASE, flat, mix, powers

BITS = 15
BUCKETS = 1 << BITS
#: Labelled rows to learn from, of each label at most.
PER_CLASS = 1_000
THRESHOLD = 0.7
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per family of features: the bucket of each, in order of rows, and where each row begins."""
    raw, off = flat(column)
    n, out = len(raw), []
    wide = raw.astype(np.uint32)
    packed = wide[:-1] | wide[1:] << np.uint32(8) if n > 1 else np.zeros(0, np.uint32)
    for k, salt in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        if n >= k:
            gram = packed[: n - k + 1] | (wide[2:] << np.uint32(16) if k == 3 else packed[2:] << np.uint32(16))
            gram = (gram * np.uint32(salt) ^ (gram >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
            bucket = (gram >> np.uint32(32 - BITS)).astype(np.int32)
            inside = np.ones(n - k + 1, dtype=bool)  # runs that cross into the next row do not count
            for j in range(1, k):
                at = off[1:-1] - j
                inside[at[(at >= 0) & (at < len(inside))]] = False
            begin = np.concatenate(([0], np.cumsum(inside)))[np.minimum(off, n - k + 1)]
            out.append((bucket[inside], begin))
    blank = _BLANK[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    start = np.flatnonzero(~blank & (np.concatenate(([True], blank[:-1]))[:n] | cut[:-1]))
    end = np.flatnonzero(~blank & (np.concatenate((blank[1:], [True]))[:n] | cut[1:])) + 1
    at = np.zeros(n + 1, dtype=_U)
    np.cumsum(_BYTES[raw] * powers(_BASE, n), out=at[1:])
    h = mix((at[end] - at[start]) * powers(_UNBASE, n + 1)[start])
    first = np.searchsorted(start, off)
    out.append(((h >> _U(64 - BITS)).astype(np.int32), first))
    if len(h) > 1:
        pair = mix(h[1:] - h[:-1] + _U(0x5851F42D4C957F2D))
        inside = np.ones(len(pair), dtype=bool)
        edge = first[1:-1] - 1
        inside[edge[(edge >= 0) & (edge < len(pair))]] = False
        begin = np.concatenate(([0], np.cumsum(inside)))[np.minimum(first, len(pair))]
        out.append(((pair >> _U(64 - BITS)).astype(np.int32)[inside], begin))
    return out


def _bags(docs: DataFrame) -> DataFrame:
    """Distinct buckets and their shares of each labelled document: two packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            made = features(piece.column("text"))
            ids, shares = [], []
            for r in range(piece.num_rows):
                all_ids = np.concatenate([b[s[r] : s[r + 1]] for b, s in made] or [np.zeros(0, np.int32)])
                count = np.bincount(all_ids, minlength=BUCKETS)
                there = np.flatnonzero(count)
                ids.append(there.astype("<u2").tobytes())
                shares.append((count[there] / max(1, len(all_ids))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "label", "ids", "shares"])

    return docs.mapInArrow(run, "doc_id bigint, label int, ids binary, shares binary")


@dataclass
class Model:
    table: np.ndarray  #: per bucket, its vector times the difference of the two output rows
    bias: float

    def logits(self, column: pa.Array) -> np.ndarray:
        rows = len(column)
        total, count = np.zeros(rows), np.zeros(rows)
        for bucket, begin in features(column):
            run = np.concatenate(([0.0], np.cumsum(self.table[bucket], dtype=np.float64)))
            total += run[begin[1:]] - run[begin[:-1]]
            count += np.diff(begin)
        return total / np.maximum(1, count) + self.bias


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], counts: tuple[int, int], dim: int = 12, epochs: int = 12, rate: float = 4.0, seed: int = 7) -> Model:
    """Stochastic gradient descent over (ids, shares, label); counts are the true numbers of both labels."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.3, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    layer[:, 0], layer[:, 1] = (side := rng.normal(0, 0.3, dim)), -side
    have = [sum(y == k for _, _, y in bags) for k in (0, 1)]
    if not min(have):
        p = min(max((counts[1] + 0.5) / (sum(counts) + 1), 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(p / (1 - p))))
    weight = [sum(have) / (2 * h) for h in have]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.05
        for i in rng.permutation(len(bags)):
            ids, shares, y = bags[i]
            mean = shares @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= weight[y]
            back = layer @ p
            layer -= 0.1 * step * np.outer(mean, p)
            bias -= 0.1 * step * p
            vectors[ids] -= (8 * step) * shares[:, None] * back
    prior = np.log((counts[1] + 1) / (counts[0] + 1))
    side = layer[:, 1] - layer[:, 0]
    return Model((vectors @ side).astype(np.float32), float(bias[1] - bias[0] + prior))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: int = PER_CLASS) -> Model:
    known = F.broadcast(labelled(labels, target, per_class))  # at most 2 * per_class rows
    rows = _bags(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id").select("doc_id", "text", "label"))
    got = sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["shares"]), r["label"]) for r in rows.toLocalIterator()), key=lambda r: (r[0], r[1]))
    return train([(np.frombuffer(i, "<u2").astype(np.int32), np.frombuffer(s, "<f4"), y) for _, i, s, y in got], class_counts(labels, target))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    table, bias = model.table, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(table, bias)
        for piece in pieces(batches, "text"):
            s = 1 / (1 + np.exp(-np.clip(m.logits(piece.column("text")), -30, 30)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold_of("doc_id") == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    return score(docs, fit(docs, labels, "quality", per_class))
