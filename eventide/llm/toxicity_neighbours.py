"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Terms are the words of a text and the beginnings of its longer words (STEMS bytes long), as 64-bit hashes, so
inflected and invented forms of one stem share terms. A bounded sample of labelled rows outside the held-out fold
(per_class rows of each label and MAX_POSTINGS postings at most) gives the examples. Every term of every example
is indexed; a term that no example holds can match none and is left out of the query's vector. Document
frequencies of all indexed terms are counted over all documents.

The examples are placed so that alike ones are neighbours, and cut into blocks of BLOCK. Every term has a posting
list (example, weight). A query adds up its short lists first. Its upper bound for a block is the most that these
give to an example there, plus the sum of its weights times the block maxima of its wide lists; blocks are visited
from the highest bound down, the wide lists complete the exact cosines of a block, and blocks whose bound cannot
beat the K-th best cosine are skipped. The result is the exact K nearest examples.

Neighbours vote with their cosine, among the nearest of several numbers (DEPTHS); a constant weight PULL stands
for no evidence. A logistic curve, fitted to the votes that each example gets from the others (without the terms
that it alone holds) and weighted to the true share of labels, turns votes into calibrated scores. The nearest
examples are given as evidence.

Null and empty texts, and texts without any indexed term, have no neighbours and get the curve's value for no
evidence. Very long texts are scored whole; memory follows one text. Without labels of both kinds every score is
the share of label 1 (0 without any). Ties between neighbours go to the smaller id. Repeated rows give repeated
results; of a sampled id on several rows the smallest text is the example. Empty tables give empty results; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import class_counts, fold_of, labelled, pieces
from eventide.llm.textscan import _BASE, _BYTES, _U, _UNBASE, mix, powers, words

#: Labelled rows to index, of each label at most, and (term, example) pairs of all of them at most.
PER_CLASS, MAX_POSTINGS = 1_500, 8_000_000
#: Bytes of the beginnings of words that are terms beside the words themselves.
STEMS = (4, 6, 8)
#: Votes are taken among so many nearest examples; K is the largest number.
DEPTHS = (10, 40, 80)
K, BLOCK, PULL, RIDGE, PIVOTS = max(DEPTHS), 64, 0.35, 1e-4, 16
#: Lists with this share of all examples are stored as matrix rows, the longest so many at most; others stay lists.
WIDE, WIDE_MOST = 1 / 16, 2_048
#: Queries and postings that are held at once.
QUERIES, POSTINGS = 256, 1 << 21
THRESHOLD = 0.3
SHOWN = 3
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:float,toxic:int>>"


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All terms of a column's texts as 64-bit numbers, and the row of each; repeated as often as they stand."""
    w = words(column)
    length = w.end - w.start
    sums = np.zeros(len(w.low) + 1, dtype=_U)
    np.cumsum(_BYTES[w.low] * powers(_BASE, len(w.low)), out=sums[1:])
    back = powers(_UNBASE, len(w.low) + 1)
    values, rows = [mix((sums[w.end] - sums[w.start]) * back[w.start])], [w.row]
    for k in STEMS:
        long = np.flatnonzero(length > k)
        begin = w.start[long]
        values.append(mix((sums[begin + k] - sums[begin]) * back[begin] + _U(k)) | _U(1 << 63))
        rows.append(w.row[long])
    values[0] &= _U((1 << 63) - 1)
    return np.concatenate(values), np.concatenate(rows)


class Vocabulary:
    """Exact look-up of terms, behind a table of hashes that turns most of them away."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = np.sort(known.astype(_U))
        self.hint = np.zeros(1 << 21, dtype=bool)
        self.hint[self._hash(self.known)] = True

    @staticmethod
    def _hash(x: np.ndarray) -> np.ndarray:
        return (x * _U(0x9E3779B97F4A7C15)) >> _U(43)

    def sparse(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the known terms of each text, by row and term."""
        value, row = term_counts(column)
        maybe = np.flatnonzero(self.hint[self._hash(value)])
        value, row = value[maybe], row[maybe]
        if not len(value) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, value), len(self.known) - 1)
        hit = self.known[at] == value
        key, count = np.unique(row[hit].astype(np.int64) * len(self.known) + at[hit], return_counts=True)
        return key // len(self.known), key % len(self.known), count


def weigh(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Weights of unit TF-IDF vectors given as (row, term, count)."""
    w = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(row, w * w, minlength=rows))
    return (w / np.where(norm > 0, norm, 1)[row]).astype(np.float32)


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then the same of begin[1] and so on."""
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


def arrange(row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """An order of n vectors in which alike ones are close: by the nearest of PIVOTS vectors far from each other."""
    best, home, pivot = np.full(n, -1.0), np.zeros(n, dtype=np.int64), 0
    for p in range(min(PIVOTS, n)):
        dense = np.zeros(size, dtype=np.float32)
        own = row == pivot
        dense[term[own]] = weight[own]
        cosine = np.bincount(row, weight * dense[term], minlength=n)
        home[cosine > best] = p
        best = np.maximum(best, cosine)
        pivot = int(best.argmin())
    return np.lexsort((-best, home))


@dataclass
class BlockMaxIndex:
    """Exact K nearest vectors by cosine. Vectors are given as (row, term, weight) with rows 0 .. len(labels) - 1.

    Posting lists that hold WIDE or more of all examples are stored as rows of a matrix, with their block maxima.
    """

    row: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    size: int  #: number of terms
    visited: int = 0
    blocks: int = 0
    _tables: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None, "visited": 0}

    def __post_init__(self) -> None:
        n = len(self.labels)
        order = arrange(self.row, self.term, self.weight, n, self.size)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        row = place[self.row]
        by = np.lexsort((row, self.term))
        self.row, self.term, self.weight = row[by].astype(np.int32), self.term[by].astype(np.int32), self.weight[by].astype(np.float32)
        self.labels, self.ids, self.blocks = self.labels[order], self.ids[order], -(-n // BLOCK)

    def tables(self) -> tuple:
        """Where each list begins, which lists are wide, their matrix and their block maxima; made once a worker."""
        if self._tables is None:
            begin = np.searchsorted(self.term, np.arange(self.size + 1))
            n = np.diff(begin)
            wide = np.argsort(-n, kind="stable")[:WIDE_MOST]
            wide = np.sort(wide[n[wide] >= max(2, WIDE * len(self.labels))])
            slot = np.full(self.size, -1, dtype=np.int64)
            slot[wide] = np.arange(len(wide))
            matrix = np.zeros((len(wide), self.blocks * BLOCK), dtype=np.float32)
            own = slot[self.term] >= 0
            matrix[slot[self.term[own]], self.row[own]] = self.weight[own]
            self._tables = begin, n, slot, matrix, matrix.reshape(len(wide), self.blocks, BLOCK).max(2)
        return self._tables

    def search(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, k: int = K, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest of each query, best first (0 and -1 where there are fewer).

        Queries are (row, term, weight), by row. leave: a place that each query must not find.
        """
        best, place = np.zeros((rows, k), dtype=np.float32), np.full((rows, k), -1, dtype=np.int64)
        if self.blocks and len(row):
            for a in range(0, rows, QUERIES):
                b = min(a + QUERIES, rows)
                i, j = np.searchsorted(row, [a, b])
                best[a:b], place[a:b] = self._search(row[i:j] - a, term[i:j], weight[i:j], b - a, k, None if leave is None else leave[a:b])
        return best, place

    def _search(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, k: int, leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        begin, n, slot, matrix, maxima = self.tables()
        wide = self.blocks * BLOCK
        best, place = np.zeros((rows, k), dtype=np.float32), np.full((rows, k), -1, dtype=np.int64)
        # short lists, a bounded number of postings at once
        some = np.flatnonzero((slot[term] < 0) & (n[term] > 0))
        m = n[term[some]]
        short = np.zeros(rows * wide)
        for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(m) // POSTINGS)) + 1):
            e, mm = some[part], m[part]
            posting = spread(begin[term[e]], mm)
            short += np.bincount(np.repeat(row[e] * wide, mm) + self.row[posting], np.repeat(weight[e], mm) * self.weight[posting], minlength=len(short))
        short = short.reshape(rows, wide).astype(np.float32)
        if leave is not None:
            short[np.arange(rows), leave] = -2.0
        # bounds: what the short lists give at most in a block, and the block maxima of the wide ones
        query = np.zeros((rows, len(matrix)), dtype=np.float32)
        own = slot[term] >= 0
        query[row[own], slot[term[own]]] = weight[own]
        bound = short.reshape(rows, self.blocks, BLOCK).max(2) + query @ maxima
        visit = np.argsort(-bound, axis=1, kind="stable")
        cosines = np.zeros((rows, wide), dtype=np.float32)
        live = np.arange(rows)
        for turn in range(self.blocks):
            block = visit[live, turn]
            go = (bound[live, block] > 0) & (bound[live, block] + 1e-5 >= best[live, -1])
            live, block = live[go], block[go]
            if not len(live):
                break
            self.visited += len(live)
            for b in np.unique(block).tolist():
                q = live[block == b]
                at = slice(b * BLOCK, (b + 1) * BLOCK)
                got = np.maximum(short[q, at] + query[q] @ matrix[:, at], 0)
                cosines[q, at] = got
                best[q] = -np.sort(np.partition(-np.concatenate((best[q], got), 1), k - 1, axis=1)[:, :k], axis=1)
        q, at = np.nonzero((cosines > 0) & (cosines >= best[:, -1:]))
        by = np.lexsort((self.ids[at], -cosines[q, at], q))
        q, at = q[by], at[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        place[q[keep], rank[keep]] = at[keep]
        return best, place


def vote(cosines: np.ndarray, places: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """What the curve is fitted to: for each depth the vote weighted by cosines, and the same times the best cosine."""
    yes = np.where(places >= 0, labels[places], 0) if len(labels) else np.zeros_like(cosines)
    out = []
    for k in DEPTHS:
        share = (cosines * yes)[:, :k].sum(1) / (cosines[:, :k].sum(1) + PULL)
        out += [share, share * cosines[:, 0]]
    return np.column_stack(out)


@dataclass
class Model:
    terms: np.ndarray
    idf: np.ndarray
    index: BlockMaxIndex
    slopes: np.ndarray
    bias: float
    _vocabulary: Vocabulary | None = None

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._vocabulary is None:
            self._vocabulary = Vocabulary(self.terms)
        row, term, count = self._vocabulary.sparse(column)
        cosines, places = self.index.search(row, term, weigh(row, term, count, self.idf, len(column)), len(column))
        z = vote(cosines, places, self.index.labels) @ self.slopes + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), cosines, places


def calibrate(votes: np.ndarray, labels: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """A logistic curve of the votes, by Newton steps with a ridge and halving; both labels weigh as they truly occur."""
    weight = np.where(labels == 1, share / max(1, labels.sum()), (1 - share) / max(1, (1 - labels).sum()))
    x = np.column_stack([votes, np.ones(len(votes))])
    ridge = np.append(np.full(votes.shape[1], RIDGE), 1e-9)
    beta = np.append(np.zeros(votes.shape[1]), np.log(share / (1 - share)))
    loss = lambda b: (weight * (np.logaddexp(0, x @ b) - labels * (x @ b))).sum() + (ridge * b * b).sum() / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (labels - p)) - ridge * beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step /= 2
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta[:-1], float(beta[-1])


def examples(sample: DataFrame, limit: int = MAX_POSTINGS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of all terms of docs(doc_id, text, label), the terms as numbers, labels and ids.

    Rows come in the order of a hash of the id and end before limit pairs would be passed; sample holds one row an id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            value, row = term_counts(piece.column("text"))
            found = [np.unique(value[row == r], return_counts=True) for r in range(piece.num_rows)]
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), piece.column("label"), pa.array([v.astype("<u8").tobytes() for v, _ in found], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary()),
            ], ["doc_id", "label", "terms", "counts"])

    got, held = [], 0
    for r in sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, label int, terms binary, counts binary").orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        held += len(r["terms"]) // 8
        if held > limit:
            break
        got.append((r["doc_id"], r["label"], np.frombuffer(bytes(r["terms"]), "<u8"), np.frombuffer(bytes(r["counts"]), "<i4")))
    got.sort(key=lambda r: r[0])
    values = np.concatenate([np.zeros(0, "<u8"), *(v for _, _, v, _ in got)])
    known, term = np.unique(values, return_inverse=True)
    row = np.repeat(np.arange(len(got)), [len(v) for _, _, v, _ in got])
    by = np.lexsort((term, row))
    count = np.concatenate([np.zeros(0, "<i4"), *(n for _, _, _, n in got)])
    return row[by], term[by], count[by], known, np.array([y for _, y, _, _ in got], dtype=np.int64), np.array([i for i, _, _, _ in got], dtype=np.int64)


def document_frequencies(texts: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all texts each known term stands, and how many texts there are; pre-summed in each task."""
    sent = texts.sparkSession.sparkContext.broadcast(known)  # terms of the examples, MAX_POSTINGS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen, total = Vocabulary(sent.value), np.zeros(len(sent.value), dtype=np.int64), 0
        for piece in pieces(batches, "text"):
            seen += np.bincount(vocabulary.sparse(piece.column("text"))[1], minlength=len(seen))
            total += piece.num_rows
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], some))), pa.array(np.concatenate(([total], seen[some])))], ["k", "n"])

    got = texts.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = (np.asarray(got.column(c).to_numpy(), dtype=np.int64) for c in ("k", "n"))
    out = np.zeros(len(known))
    out[k[k >= 0]] = n[k >= 0]
    return out, int(n[k < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = PER_CLASS) -> Model:
    sizes = class_counts(labels, target)
    share = min(max(sizes[1] / max(1, sum(sizes)), 1e-6), 1 - 1e-6)
    none = np.zeros(0, np.int64)
    nothing = Model(np.zeros(0, _U), np.zeros(0), BlockMaxIndex(none, none, np.zeros(0, np.float32), none, none, 0), np.zeros(2 * len(DEPTHS)), float(np.log(share / (1 - share))))
    if not min(sizes):
        return nothing
    chosen = F.broadcast(labelled(labels, target, per_class))  # at most 2 * per_class rows
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    row, term, count, known, y, ids = examples(texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")))
    if len(set(y.tolist())) < 2 or not len(known):
        return nothing
    df, total = document_frequencies(texts.select("text"), known)
    idf = np.log((total + 1) / (df + 1)) + 1e-3
    index = BlockMaxIndex(row, term, weigh(row, term, count, idf, len(y)), y, ids, len(known))
    place = np.empty(len(y), dtype=np.int64)
    place[np.searchsorted(ids, index.ids)] = np.arange(len(y))  # ids are sorted in the sample
    shared = np.bincount(term, minlength=len(known))[term] > 1  # what only one example holds could not match a query's
    row, term, count = row[shared], term[shared], count[shared]
    weight, votes = weigh(row, term, count, idf, len(y)), []
    for a in range(0, len(y), 256):
        b = min(a + 256, len(y))
        i, j = np.searchsorted(row, [a, b])
        votes.append(vote(*index.search(row[i:j] - a, term[i:j], weight[i:j], b - a, leave=place[a:b]), index.labels))
    return Model(known, idf, index, *calibrate(np.concatenate(votes), y, share))


def _scored(spark: SparkSession, model: Model):
    sent = spark.sparkContext.broadcast(model)  # MAX_POSTINGS postings at most

    def run(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, Model]:
        return *sent.value.score(piece.column("text")), sent.value

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    scored = _scored(docs.sparkSession, fit(docs, labels, "toxic", per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            s, cosines, places, m = scored(piece)
            evidence = [
                [{"doc_id": int(m.index.ids[p]), "cosine": float(c), "toxic": int(m.index.labels[p])} for c, p in zip(cs, ps, strict=True) if p >= 0]
                for cs, ps in zip(cosines[:, :SHOWN].tolist(), places[:, :SHOWN].tolist(), strict=True)
            ]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float32()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(evidence, kind)], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold_of("doc_id") == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, columns: list[str], per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns as they are."""
    scored = _scored(docs.sparkSession, fit(docs, labels, "toxic", per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            s, *_ = scored(piece)
            yield piece.filter(pa.array(s < threshold))

    return docs.select(*columns).mapInArrow(run, docs.select(*columns).schema)
