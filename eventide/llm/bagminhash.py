"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its runs of SHINGLE words (a shorter text is one run of all its words). The weight
of a shingle is how often it stands there, and similarity is weighted Jaccard: the sum of the smaller weights
over the sum of the larger ones; 0.8 or more links two texts.

Signature: every shingle drives a Poisson process over its weights, cut at the powers of two into blocks that
double in size. Points of a block come in order of time; each has a weight within the block (it counts for the
texts whose weight of that shingle reaches it) and one of SLOTS slots, whose earliest point is kept. Two texts
agree in a slot with a probability equal to their weighted Jaccard, without bias, and each process is followed
only until its next point is later than all of the text's slots. The processes of all texts of a piece advance
together, one point per round.

Candidates: BANDS bands of ROWS slots; at 0.8 a pair misses all bands with a probability of 5e-8. Exact copies of
a text are one representative from the beginning. Pairs whose signatures agree in fewer than MIN_AGREE slots are
not candidates (at 0.8, four and a half standard deviations below). Every text is paired with the leader of each
of its buckets. The best of these pairs are verified and contracted into classes; all of them, verified or not,
make clusters. Then nothing is left out:

* inside a cluster, each text outside the cluster's largest class meets all texts of other classes. Texts meet in
  blocks of bounded size within a task, which compares signatures, then whole multisets, and returns one link for
  each text and class, so no pairs are written out;
* a bucket's texts outside its commonest cluster meet all texts of the bucket, in blocks too, but by signature alone,
  and the few pairs that pass are verified.

So no link between different texts is lost and no group of copies is expanded into pairs. Classes are connected
components of verified links, found by alternating large and small stars.

Null is an empty text; texts without words have no shingles and link to nothing but exact copies. Repeated rows
are copies. Rows without an id take part; a class is named by the smallest id in it (null if there is none). Very
long texts are compared whole. An empty table gives an empty one. Columns that are not read may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.llm.common import drop, free, pieces, staged
from eventide.llm.textscan import _U, mix, windows, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
MIN_AGREE = 82
#: Pairs with leaders that are verified first, for each text.
LEADERS = 2
#: Texts of a bucket that meet in one group: at most about so many members and so many visitors.
BUCKET_BLOCK = 512
#: Texts of a cluster meet in blocks of about so many bytes of multisets and so many texts.
CLUSTER_BYTES, CLUSTER_TEXTS = 8 << 20, 1024
PIECE_ROWS = 1024
#: Staged tables of numbers have a file for about so many texts or edges, however many partitions made them: files are launches.
FILE_TEXTS, FILE_EDGES = 50_000, 250_000
_LOW54 = _U((1 << 54) - 1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 54-bit hash of every shingle of at most PIECE_ROWS texts, sorted by both."""
    w = words(column)
    h = w.hashes()
    n = np.diff(w.first)
    runs = windows(h, SHINGLE)
    at = np.arange(len(runs))
    row = w.row[: len(runs)]
    whole = at + SHINGLE <= w.first[row + 1] if len(runs) else at.astype(bool)
    value, rows = [runs[whole]], [row[whole]]
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        some = h[w.first[r] : w.first[r + 1]]
        value.append(windows(some, len(some)) + _U(len(some)))
        rows.append(np.array([r]))
    key = np.concatenate(rows).astype(_U) << _U(54) | np.concatenate(value) >> _U(10)
    key.sort()
    return (key >> _U(54)).astype(np.int64), key & _LOW54


def signatures(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Earliest point of each slot of each row's multiset (infinite for rows without shingles)."""
    out = np.full(rows * SLOTS, np.inf)
    if not len(row):
        return out.reshape(rows, SLOTS)
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(row)))
    row, value = row[first], value[first]
    # blocks [0, 1), [1, 2), [2, 4), [4, 8) ... that the weight reaches
    blocks = np.frexp(np.maximum(weight - 1, 0).astype(float))[1] + 1
    which = np.repeat(np.arange(len(row)), blocks)
    block = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    size = np.maximum(low, 1)
    reach = weight[which] - low
    row, size = row[which], size.astype(float)
    state = mix(value[which] * _U(0x9E3779B97F4A7C15) + block.astype(_U))
    time = np.zeros(len(row))
    while len(row):
        state = mix(state + _U(0x9E3779B97F4A7C15))
        more = mix(state ^ _U(0xD6E8FEB86659FD93))
        time = time - np.log(((state >> _U(11)).astype(float) + 0.5) * 2.0**-53) / size
        slot = (more >> _U(32)).astype(np.int64) % SLOTS
        counts = (more & _U(0xFFFFFFFF)).astype(float) * 2.0**-32 * size < reach
        np.minimum.at(out, row[counts] * SLOTS + slot[counts], time[counts])
        last = out.reshape(rows, SLOTS).max(1)
        live = np.flatnonzero(time < last[row])
        row, size, reach, state, time = row[live], size[live], reach[live], state[live], time[live]
    return out.reshape(rows, SLOTS)


def elements(row: np.ndarray, value: np.ndarray, rows: int) -> list[bytes]:
    """Each row's multiset as a sorted set of numbers: the k-th copy of a shingle is an element of its own."""
    begin = np.searchsorted(row, np.arange(rows + 1))
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        v = value[a:b]
        new = np.concatenate(([True], v[1:] != v[:-1])) if len(v) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        copy = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
        out.append(np.sort(mix(v * _U(0x9E3779B97F4A7C15) + copy.astype(_U))).astype("<u8").tobytes())
    return out


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two multisets given by elements()."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def _limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        for k in range(0, piece.num_rows, PIECE_ROWS):
            yield piece.slice(k, PIECE_ROWS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _limited(batches):
        row, value = shingles(piece.column("text"))
        times = signatures(row, value, piece.num_rows)
        n = np.bincount(row, minlength=piece.num_rows)
        bits = mix(times.view(_U))
        band = np.zeros((piece.num_rows, BANDS), dtype=_U)
        for k in range(ROWS):
            band = mix(band * _U(0xD1342543DE82EF95) + bits[:, k::ROWS] + np.arange(BANDS, dtype=_U))
        slots = (bits >> _U(48)).astype("<u2")
        yield pa.RecordBatch.from_arrays([
            piece.column("doc_id"), piece.column("key"), pa.array(n.astype(np.int64)),
            pa.array([b if k else [] for b, k in zip(band.view(np.int64), n, strict=True)], pa.list_(pa.int64())), pa.array([s.tobytes() for s in slots], pa.binary()),
        ], ["doc_id", "key", "n", "bands", "slots"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in _limited(batches):
        yield pa.RecordBatch.from_arrays([piece.column("rid"), pa.array(elements(*shingles(piece.column("text")), piece.num_rows), pa.binary())], ["rid", "elements"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in at least MIN_AGREE slots, and in how many."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, SLOTS) for c in ("slots_x", "slots_y"))
        agree = (x == y).sum(1)
        ok = pa.array(agree >= MIN_AGREE)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(ok) for c in ("rid", "leader")), pa.array(agree.astype(np.int32)).filter(ok)], ["rid", "leader", "agree"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [similarity(x.as_py(), y.as_py()) >= THRESHOLD for x, y in zip(batch.column("ea"), batch.column("eb"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["a", "b"])


def _links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _unpack(table: pa.Table, *columns: str) -> list[np.ndarray]:
    slots = np.frombuffer(b"".join(table.column("slots").to_pylist()), "<u2").reshape(-1, SLOTS)
    return [*(np.array(table.column(c).to_pylist(), dtype=np.int64) for c in columns), slots]


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links of the visitors of a cluster's block to other classes there: one for each visitor and class."""
    rid, cls, n, visits, slots = _unpack(table, "rid", "cls", "n", "visits")
    elements = table.column("elements")
    members, out = np.flatnonzero(visits == 0), []
    for v in np.flatnonzero(visits == 1).tolist():
        near = members[(cls[members] != cls[v]) & (np.minimum(n[members], n[v]) >= THRESHOLD * np.maximum(n[members], n[v]))]
        agree = (slots[near] == slots[v]).sum(1)
        near = near[agree >= MIN_AGREE][np.argsort(-agree[agree >= MIN_AGREE], kind="stable")]
        own, linked = elements[v].as_py() if len(near) else b"", set()
        for m in near.tolist():
            if cls[m] not in linked and similarity(own, elements[m].as_py()) >= THRESHOLD:
                linked.add(cls[m])
                out.append((min(rid[v], rid[m]), max(rid[v], rid[m])))
    return _links(out)


def _cross(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs of different clusters and classes that signatures let through: visitors of a bucket's block with members there."""
    rid, cls, cluster, minor, visits, slots = _unpack(table, "rid", "cls", "cluster", "minor", "visits")
    members, out = np.flatnonzero(visits == 0), []
    for v in np.flatnonzero(visits == 1).tolist():
        # two visitors of one bucket also meet the other way round
        other = members[(cluster[members] != cluster[v]) & (cls[members] != cls[v]) & ((minor[members] == 0) | (rid[members] > rid[v]))]
        out += [(min(rid[v], r), max(rid[v], r)) for r in rid[other[(slots[other] == slots[v]).sum(1) >= MIN_AGREE]].tolist()]
    return _links(out)


def components(edges: DataFrame) -> DataFrame:
    """rid and cls (the smallest rid of its component) of every end of edges(a, b).

    Alternating stars: the large star links a node's larger neighbours to its smallest one, the small star its
    smaller neighbours and itself. Both keep components; they go on until a round changes nothing, which is when all
    that is left are stars (a number of rounds that grows with the square of the logarithm of the nodes).
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        linked = both.join(low, "u")
        linked = linked.where(F.col("v") > F.col("u")).select("v", "m") if large else linked.select("v", "m").unionAll(low.select(F.col("u").alias("v"), "m"))
        return linked.where(F.col("v") != F.col("m")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    spark, made, before = edges.sparkSession, [], None
    few = edges.count() // FILE_EDGES + 1
    e = staged(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(few), "edges", made=made)
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if before == now:
            break
        before, old = now, list(made)
        made.clear()
        e = staged(star(star(e, True), False).coalesce(now[0] // FILE_EDGES + 1), "edges", made=made)
        drop(spark, old)
    low = e.groupBy("b").agg(F.min("a").alias("a"))
    return low.select(F.col("b").alias("rid"), F.col("a").alias("cls")).unionAll(low.select("a").distinct().select(F.col("a").alias("rid"), F.col("a").alias("cls")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, class_key of each row of docs(doc_id, text); a key is a text's MD5, a class is named by its first text."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    signed = staged(texts.select("doc_id", "key", "text").mapInArrow(_sign, "doc_id bigint, key binary, n bigint, bands array<bigint>, slots binary"), "signed")
    few = signed.count() // FILE_TEXTS + 1
    reps = staged(
        signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("slots").alias("slots"))
        .coalesce(2 * few).select(F.monotonically_increasing_id().alias("rid"), "*"), "representatives",
    )
    placed = reps.select("rid", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rid").alias("l1"), F.min(F.struct(F.xxhash64("rid"), "rid"))["rid"].alias("l2")).where("size > 1")
    shared = staged(placed.join(shared, "bucket").repartition(2 * few), "buckets")

    sized = reps.select("rid", "n", "slots")
    stars = shared.select("rid", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("leader")).where("rid != leader").distinct()
    fits = F.least("n_x", "n_y") >= THRESHOLD * F.greatest("n_x", "n_y")
    near = (
        stars.join(sized.toDF("rid", "n_x", "slots_x"), "rid").join(sized.toDF("leader", "n_y", "slots_y"), "leader")
        .where(fits).select("rid", "leader", "slots_x", "slots_y").mapInArrow(_agree, "rid bigint, leader bigint, agree int")
    )
    near = staged(near.repartition(few), "star_pairs")

    def multisets(wanted: DataFrame, name: str) -> DataFrame:
        keyed = wanted.join(reps.select("rid", "key", F.col("doc_id").alias("own")), "rid")
        found = texts.join(keyed, (F.col("doc_id").eqNullSafe(F.col("own"))) & (texts["key"] == keyed["key"])).select("rid", "text")
        return staged(found.mapInArrow(_expand, "rid bigint, elements binary").dropDuplicates(["rid"]).coalesce(8 * few), name, "uncompressed")

    def verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        both = pairs.join(sets.toDF("b", "eb"), "b").join(sets.toDF("a", "ea"), "a")
        return staged(both.select("a", "b", "ea", "eb").mapInArrow(_overlap, "a bigint, b bigint").repartition(few), name)

    ends = lambda df, a, b: df.select(F.col(a).alias("rid")).unionAll(df.select(F.col(b).alias("rid"))).distinct()
    sets = multisets(ends(near, "rid", "leader"), "elements")
    best = near.withColumn("k", F.row_number().over(W.partitionBy("rid").orderBy(F.desc("agree"), "leader"))).where(F.col("k") <= LEADERS)
    links = verified(best.select(F.least("rid", "leader").alias("a"), F.greatest("rid", "leader").alias("b")).distinct(), sets, "star_links")
    clusters = components(near.select(F.col("rid").alias("a"), F.col("leader").alias("b"))).withColumnRenamed("cls", "cluster")
    placed = clusters.join(components(links), "rid", "left").withColumn("cls", F.coalesce("cls", "rid"))
    placed = staged(placed.join(sized, "rid").repartition(few), "placed")

    # inside clusters of several classes: all texts by blocks, and the texts outside the largest class as visitors
    by_class = placed.groupBy("cluster", "cls").agg(F.count("*").alias("m"), F.sum("n").alias("words"))
    plan = by_class.groupBy("cluster").agg(F.count("*").alias("classes"), F.max_by("cls", F.struct("m", "cls")).alias("largest"), F.sum("words").alias("words"), F.sum("m").alias("texts"), F.max(F.struct("m", "cls", "words")).alias("most")).where("classes > 1")
    size = lambda words, texts: F.greatest(F.lit(1), F.ceil(words * 8 / CLUSTER_BYTES), F.ceil(texts / CLUSTER_TEXTS)).cast("int")
    plan = plan.select("cluster", "largest", size(F.col("words"), F.col("texts")).alias("blocks"), size(F.col("words") - F.col("most.words"), F.col("texts") - F.col("most.m")).alias("rooms"))
    there = placed.join(plan, "cluster").join(sets, "rid")
    of = lambda c: F.pmod(F.xxhash64("rid"), F.col(c)).cast("int")

    def seated(df: DataFrame, visitor: Column) -> DataFrame:
        """Each row once for every room of its block, and visitors once more for every block of their room."""
        here = F.expr("transform(sequence(0, rooms - 1), x -> struct(block, x AS room, 0 AS visits))")
        there = F.expr("transform(sequence(0, blocks - 1), x -> struct(x AS block, room, 1 AS visits))")
        placed = df.withColumn("block", of("blocks")).withColumn("room", of("rooms")).withColumn("seat", F.explode(F.when(visitor, F.concat(here, there)).otherwise(here)))
        return placed.drop("block", "room", "blocks", "rooms").select("*", "seat.*").drop("seat")

    inside = staged(seated(there, F.col("cls") != F.col("largest")).drop("largest").groupBy("cluster", "block", "room").applyInArrow(_meet, "a bigint, b bigint").repartition(few), "inside_links")

    # texts of different clusters that share a bucket: those outside its commonest cluster visit all of its texts
    seen = shared.select("bucket", "rid").join(placed.select("rid", "cluster", "cls"), "rid", "left").withColumn("cluster", F.coalesce("cluster", "rid")).withColumn("cls", F.coalesce("cls", "rid"))
    parts = lambda c: F.ceil(F.col(c) / BUCKET_BLOCK).cast("int")
    mixed = (
        seen.groupBy("bucket", "cluster").agg(F.count("*").alias("m")).groupBy("bucket")
        .agg(F.sum("m").alias("size"), F.max(F.struct("m", "cluster")).alias("most")).where("size > most.m")
        .withColumn("rest", F.col("size") - F.col("most.m")).select("bucket", F.col("most.cluster").alias("common"), parts("size").alias("blocks"), parts("rest").alias("rooms"))
    )
    met = seen.join(mixed, "bucket").join(sized.select("rid", "slots"), "rid").withColumn("minor", (F.col("cluster") != F.col("common")).cast("int"))
    cross = seated(met.drop("common"), F.col("minor") == 1).groupBy("bucket", "block", "room").applyInArrow(_cross, "a bigint, b bigint").distinct()
    cross = staged(cross.coalesce(few), "cross_pairs")
    if cross.head(1):
        links = links.unionAll(verified(cross, multisets(ends(cross, "a", "b"), "cross_elements"), "cross_links"))
    classes = components(links.unionAll(inside))
    named = reps.select("rid", "key", "doc_id").join(classes, "rid", "left").withColumn("cls", F.coalesce("cls", "rid"))
    names = named.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first"))
    named = named.select("key", "cls").join(names, "cls").select("key", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("class_key"))
    return signed.select("doc_id", "key").join(named, "key").select("doc_id", "key", "class_id", "class_key")


def find_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and the id of its class, which is its smallest doc_id."""
    return near_duplicates(docs).select("doc_id", "class_id")


def drop_near_duplicates(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id; of its repeated rows, one."""
    own, key, name = (free(n, columns) for n in ("own_key", "class_key", "class_id"))
    kept = near_duplicates(docs).select(F.col("class_id").alias(name), F.col("class_key").alias(key)).distinct().coalesce(docs.count() // FILE_TEXTS + 1)
    keyed = docs.select(*columns, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias(own))
    there = keyed.join(staged(kept, "kept"), (F.col(own) == F.col(key)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(name)), "left_semi")
    return there.dropDuplicates([own, "doc_id"]).select(*columns)
