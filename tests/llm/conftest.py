from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("label", T.StringType()),
])

ODD = [None, "", " ", "\n\n", "x", "Word", "ÀÉ été naïve", "a\x00b\x1fc d", "😀 emoji 😀 emoji", "\t tab\r\nline\n", "!!!", "<|endoftext|> inside", "a@b.c 1.2.3.4 +1 555 123 4567"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents-like table with extra columns whose names clash with results'; ids may repeat or be null."""
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in zip(ids, texts, strict=True)], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empties, odd characters, a very long text, repeated rows and a null id."""
    texts = [*ODD, "long words go on " * 40_000, "z" * 300_000, *ODD[:4]]
    ids = [*range(len(texts) - 4), 0, 1, 2, None]
    return make_docs(texts, ids)


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
