"""Benchmark decontamination by a prefix-filtered set join with exact verification.

The windows of the benchmark (WINDOW consecutive words of an item; a shorter item is one window) are joined with
the documents. As a window counts only when all its words stand there, its necessary prefix is one word: the
rarest by the counts of benchmark words over all documents. Where that word stands in a document, its place in
a window says where the window would begin: one beginning for each of the few places and lengths that windows of
that word have. Beginnings outside the document fail the bounds; the hash of the words at the rest is looked up
among the windows, and what agrees is verified byte by byte.

The benchmark is taken in blocks of BLOCK_BYTES of text, so what is broadcast is bounded whatever its size. With
more than one block, the documents pass through GROUP blocks in one task, one index at a time for each, and are then
written to the shared folder; words are counted once for each group.

Null and empty texts, and texts without words, have no words, hits or items. Items without words have no windows.
Items that share an id count once; items without an id count as one item whose id is the empty string. Repeated
rows give repeated results. Very long texts are read whole; an empty table gives an empty one. Columns that are not
read may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import drop, free, pieces, staged
from eventide.llm.textscan import _U, Words, mix, windows, words

WINDOW = 13
BLOCK_BYTES = 4 << 20
#: Blocks whose indexes may be alive in one task.
GROUP = 4
#: Beginnings that are tried at once.
AT_ONCE = 1 << 20


class Lookup:
    """Places of 64-bit values in a sorted array, behind a table that turns most of them away."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known
        self.hint = np.zeros(1 << 18, dtype=bool)
        self.hint[known >> _U(46)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the values that are known, and their places among the known."""
        maybe = np.flatnonzero(self.hint[values >> _U(46)])
        if not len(self.known) or not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.known, values[maybe]), len(self.known) - 1)
        hit = self.known[k] == values[maybe]
        return maybe[hit], k[hit]


@dataclass
class Index:
    """Windows, sorted by the hash of their words, and the shapes that windows have around their rarest word."""

    lookup: Lookup
    first: np.ndarray  #: anchor a has shapes first[a] .. first[a + 1]
    offset: np.ndarray  #: place of the anchor in a window of each shape
    size: np.ndarray  #: and the words of such a window
    value: np.ndarray  #: hash of each window's words, sorted
    length: np.ndarray  #: words of each window
    text: list[bytes]
    items: list[tuple[str, ...]]


def item_windows(w: Words, window: int) -> list[tuple[int, int]]:
    """(first word, words) of each window of each row, in order."""
    out = []
    for begin, end in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        size = min(window, end - begin)
        if size:
            out += [(i, size) for i in range(begin, end - size + 1)]
    return out


def _value(h: np.ndarray) -> np.ndarray:
    return windows(h, len(h)) if len(h) else np.zeros(0, _U)


def build_index(ids: list[str], texts: list[str | None], counts: dict[int, int], window: int) -> Index:
    w = words(pa.array(texts, pa.string()))
    h = w.hashes()
    many = np.array([counts.get(int(x), 0) for x in h.view(np.int64)], dtype=np.int64)
    found: dict[bytes, tuple[int, int, int, int, set[str]]] = {}
    for i, size in item_windows(w, window):
        text = b" ".join(w.text(k) for k in range(i, i + size))
        row = found.get(text)
        if row is None:
            at = min(range(size), key=lambda k: (many[i + k], int(h[i + k]), k))
            found[text] = row = (int(h[i + at]), at, size, int(_value(h[i : i + size])[0]), set())
        row[4].add(ids[w.row[i]])
    order = sorted(found, key=lambda t: (found[t][3], t))
    shapes = sorted({(found[t][0], found[t][1], found[t][2]) for t in order})
    known, first = np.unique(np.array([x[0] for x in shapes], dtype=_U), return_index=True)
    return Index(
        Lookup(known), np.append(first, len(shapes)), np.array([x[1] for x in shapes], dtype=np.int64), np.array([x[2] for x in shapes], dtype=np.int64),
        np.array([found[t][3] for t in order], dtype=_U), np.array([found[t][2] for t in order], dtype=np.int64), order, [tuple(sorted(found[t][4])) for t in order],
    )


def find_windows(w: Words, h: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of every verified occurrence; work and memory follow words times shapes."""
    where, anchor = index.lookup.find(h)
    most = int(np.diff(index.first).max()) if len(index.value) else 1
    begins, windows_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(where), max(1, AT_ONCE // most)):
        at, a = where[k : k + max(1, AT_ONCE // most)], anchor[k : k + max(1, AT_ONCE // most)]
        n = index.first[a + 1] - index.first[a]
        at = np.repeat(at, n)
        shape = np.repeat(index.first[a], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin, size = at - index.offset[shape], index.size[shape]
        row = w.row[at]
        fits = (begin >= w.first[row]) & (begin + size <= w.first[row + 1])  # positional and length bounds
        begin, size = begin[fits], size[fits]
        for m in np.unique(size).tolist():
            b = begin[size == m]
            value = np.zeros(len(b), dtype=_U)
            for j in range(m):
                value = value * _U(0xD1342543DE82EF95) + h[b + j]
            value = mix(value)
            low, high = np.searchsorted(index.value, value), np.searchsorted(index.value, value, side="right")
            some = np.flatnonzero(high > low)
            b, low, n = b[some], low[some], (high - low)[some]
            b, which = np.repeat(b, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            same = [index.length[x] == m and index.text[x] == b" ".join([w.low[w.start[i] : w.end[i]].tobytes() for i in range(c, c + m)]) for c, x in zip(b.tolist(), which.tolist(), strict=True)]
            same = np.array(same, dtype=bool)
            begins.append(b[same])
            windows_.append(which[same])
    return np.concatenate(begins), np.concatenate(windows_)


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of the vocabulary (sorted hashes) stands in all texts; pre-summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = Lookup(vocabulary), np.zeros(len(vocabulary), dtype=np.int64)
        for piece in pieces(batches, "text"):
            total += np.bincount(lookup.find(words(piece.column("text")).hashes())[1], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total)], ["word", "n"])

    if not len(vocabulary):
        return {}
    return {r["word"]: r["n"] for r in docs.select("text").mapInArrow(run, "word bigint, n bigint").where("n > 0").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[str], list[str | None]]]:
    """Items in blocks of about block_bytes of text."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted((r["item_id"], r["text"]) for r in some.distinct().collect())
        yield [r[0] for r in rows], [r[1] for r in rows]


def mark_documents(docs: DataFrame, benchmark: DataFrame, columns: list[str], names: tuple[str, str, str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES, group: int = GROUP) -> DataFrame:
    """columns of docs (text among them) with three more under names: words, spans (merged, as pairs) and items of all occurrences."""
    many, spans_, items_ = names
    spark, made = docs.sparkSession, []
    out = docs.select(*columns, F.lit(0).cast("bigint").alias(many), F.array().cast("array<bigint>").alias(spans_), F.array().cast("array<string>").alias(items_))
    schema = out.schema
    texts = docs.select(F.col("text").cast("string").alias("text"))
    blocks, first = _blocks(benchmark, block_bytes), True
    while some := list(islice(blocks, group)):
        if not first:  # no more than one group's indexes in a task
            old = list(made)
            made.clear()
            out = staged(out, "marked", made=made)
            drop(spark, old)
        first = False
        counts = word_counts(texts, np.unique(np.concatenate([words(pa.array(t, pa.string())).hashes() for _, t in some])))
        for ids, items in some:
            index = build_index(ids, items, counts, window)
            sent = spark.sparkContext.broadcast(index)  # windows of one block

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                index = sent.value
                for piece in pieces(batches, "text"):
                    w = words(piece.column("text"))
                    begin, which = find_windows(w, w.hashes(), index)
                    marks = np.zeros(len(w.start) + 1, dtype=np.int64)
                    np.add.at(marks, begin, 1)
                    np.add.at(marks, begin + index.length[which], -1)
                    for r, old in enumerate(piece.column(spans_).to_pylist()):
                        for a, b in zip(old[::2], old[1::2], strict=True):
                            marks[w.first[r] + a] += 1
                            marks[w.first[r] + b] -= 1
                    hit = np.concatenate(([False], np.cumsum(marks[:-1]) > 0, [False]))
                    # spans of hit words, cut where rows meet
                    edge = np.zeros(len(w.start) + 1, dtype=bool)
                    edge[w.first] = True
                    starts = np.flatnonzero(hit[1:-1] & (~hit[:-2] | edge[:-1]))
                    ends = np.flatnonzero(hit[1:-1] & (~hit[2:] | edge[1:])) + 1
                    found = [set(x) for x in piece.column(items_).to_pylist()]
                    for r, x in set(zip(w.row[begin].tolist(), which.tolist(), strict=True)):
                        found[r].update(index.items[x])
                    row = w.row[starts] if len(starts) else starts
                    spans: list[list[int]] = [[] for _ in range(piece.num_rows)]
                    for r, a, b in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True):
                        spans[r] += [a - int(w.first[r]), b - int(w.first[r])]
                    got = {many: pa.array(np.diff(w.first).astype(np.int64)), spans_: pa.array(spans, pa.list_(pa.int64())), items_: pa.array([sorted(x) for x in found], pa.list_(pa.string()))}
                    yield pa.RecordBatch.from_arrays([got[n] if n in got else piece.column(n) for n in schema.names], schema.names)

            out = out.mapInArrow(run, schema)
    return out


def contaminated(n_words: F.Column, n_hit: F.Column) -> F.Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def hits(spans: str) -> F.Column:
    """Words in the spans."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, b: a + b)


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, group: int = GROUP) -> DataFrame:
    small = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = mark_documents(small, benchmark, ["doc_id", "text"], ("n_words", "spans", "items"), block_bytes=block_bytes, group=group).select("doc_id", "n_words", hits("spans").alias("n_hit"), "items")
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    names = tuple(free(n, columns) for n in ("n_words", "spans", "items"))
    return mark_documents(docs, benchmark, columns, names).where(~contaminated(F.col(names[0]), hits(names[1]))).select(*columns)
