"""Shared plumbing of the corpus operators: tables, staged tables, labels, row batches.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A piece of a batch holds about so many bytes of text, unless one row alone is longer.
PIECE_BYTES = 1 << 20


#: Rows in an Arrow batch at most: texts are a few KB each, and a batch is held on both sides of the pipe.
BATCH_ROWS = 1_000
# Python workers live on between stages; the system allocator gives freed batches back to the machine.
pa.set_memory_pool(pa.system_memory_pool())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at BATCH_ROWS rows or fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session sets none (tests, local mode) a temporary folder of this machine is made; a cluster
    must set it.
    """
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        own = tempfile.mkdtemp(prefix="eventide-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


#: For every file in a local folder Hadoop launches chmod three times: for the file, for its checksum and for the folder of the attempt.
#: A process that is just being launched shares the memory of the executor, which is then seen at twice its size, and each
#: launch takes time. Staged tables do without checksums and success markers: two launches a file are left.
PLAIN_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}


def staged(df: DataFrame, name: str, codec: str = "zstd", made: list[str] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here.

    A lost executor costs at most the tasks that still read this table, never what came before. The path is
    added to made, so that a caller can drop() the table when nothing reads it any more.
    """
    small_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES).option("compression", codec).parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, made: list[str]) -> None:
    """Delete tables that staged() wrote."""
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    made.clear()


def fold_of(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 4; labels of fold 2 are never learned from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 4


def labelled(labels: DataFrame, target: str, per_class: int) -> DataFrame:
    """A bounded sample of labelled ids outside fold 2: at most per_class of each label.

    Rows come in the order of a hash of the id, so the sample does not depend on the partitioning.
    Null ids and null labels are left out; a doc labelled twice counts once, with its larger label.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (fold_of("doc_id") != 2))
        .groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    )
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionAll(parts[1])


def class_counts(labels: DataFrame, target: str) -> tuple[int, int]:
    """How many distinct labelled ids outside fold 2 carry 0 and 1, over all of labels."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (fold_of("doc_id") != 2))
        .groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    )
    got = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return got.get(0, 0), got.get(1, 0)


def free(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column of taken has it (whatever its case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about size bytes of column; memory then follows one piece."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i, n in enumerate(lengths.tolist()):
            if held and held + n > size:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def texts_of(piece: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in piece.column(column).to_pylist()]
