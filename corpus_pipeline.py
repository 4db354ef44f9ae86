"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns the documents it keeps.

Toxic documents go, one document of each group of near-duplicates stays, documents contaminated with benchmark
passages go, personal data are replaced by their kind, and what is left is encoded. Every stage works on all that
the one before it kept. The last one returns the digests of encode_documents instead of documents.

Defined cases: null and empty texts are copies of each other, so one of them stays, and it has no tokens. Of repeated
rows and of near-duplicates the smallest doc_id stays. Without labels of both kinds no document is toxic. Very long
texts are handled whole. Empty tables give an empty result. Extra columns, whatever their names, stay until the last
stage; n_chars keeps its type. Documents of a group that are equal in every respect leave one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.bagminhash import drop_near_duplicates
from eventide.llm.bpe_chunks import encode_documents
from eventide.llm.common import small_batches, staged, table
from eventide.llm.decontamination import drop_contaminated
from eventide.llm.pii_labelers import redact
from eventide.llm.toxicity_neighbours import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"), docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encode_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("encoding", encoded),
]

#: No stage but the exact joins can be told in SQL; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
