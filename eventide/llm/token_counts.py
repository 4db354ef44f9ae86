"""Token counts by a separator scan of flat, unindexed token files.

A token file is a row of little-endian token ids, document after document, each closed by a separator id; no
index says where documents begin. Files are read in fixed-size blocks, wherever those happen to cut. Each block
is searched for the separator in one vectorised comparison; what crosses blocks is stitched by an exclusive
prefix scan over the blocks of a file: tokens before the block, documents before it, and where the last
separator before it stood.

Results: one row per document: file_id, ordinal (from 0 in its file), first_token (position in the file) and
n_tokens without the separator. Two separators in a row enclose a document of 0 tokens. Tokens after the last
separator are a last document of their own, marked closed = false; a file that ends with a separator has none.
An empty table has no files and no rows; null and empty texts are documents of 0 tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventide.llm.common import pieces, staged

BLOCK_TOKENS = 1 << 18
PIECES_KEPT = 100_000
BLOCKS = "file_id string, block_no bigint, data binary"


class ByteBpe(dict):
    """Pattern piece -> its token ids as little-endian uint16; two generations bound the memory."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.findall = regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = np.array(self.coding.encode_ordinary(piece), dtype="<u2").tobytes()
        if len(self) >= PIECES_KEPT:
            self.older = dict(self)
            self.clear()
        self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join([self[p] for p in self.findall(text)])


_coders: dict[str, ByteBpe] = {}


def vocabulary() -> tuple[str, str, int]:
    """Path, pattern and a free id for the separator of the byte-level vocabulary."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN, 50256


def write_token_files(docs: DataFrame, path: str, pattern: str, separator: int, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Tokenise docs(doc_id, text) into flat token files, one per partition: (blocks, manifest).

    blocks has the files' bytes in fixed-size blocks; manifest says which document has which place in which
    file, and serves only to label results. Both are one staged table, so a lost task cannot mix two orders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _coders:
            _coders[path] = ByteBpe(path, pattern)
        code = _coders[path]
        file_id = f"part-{TaskContext.get().partitionId():06d}"
        end = np.array([separator], dtype="<u2").tobytes()
        block_bytes, open_block, block_no, ordinal = 2 * block_tokens, bytearray(), 0, 0

        def rows(numbers: list[int], blocks: list[bytes], ids: list) -> pa.RecordBatch:
            n = len(numbers) + len(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([file_id] * n), pa.array([*numbers, *[None] * len(ids)], pa.int64()), pa.array([*blocks, *[None] * len(ids)], pa.binary()),
                pa.array([None] * len(numbers) + [ordinal - len(ids) + k for k in range(len(ids))], pa.int64()), pa.array([None] * len(numbers) + ids, pa.int64()),
            ], ["file_id", "block_no", "data", "ordinal", "doc_id"])

        for batch in pieces(batches, "text"):
            numbers, blocks, ids = [], [], batch.column("doc_id").to_pylist()
            for text in batch.column("text"):
                open_block += code.encode(text.as_py() or "")
                open_block += end
                while len(open_block) >= block_bytes:
                    numbers.append(block_no)
                    blocks.append(bytes(open_block[:block_bytes]))
                    del open_block[:block_bytes]
                    block_no += 1
            ordinal += len(ids)
            yield rows(numbers, blocks, ids)
        if open_block:
            yield rows([block_no], [bytes(open_block)], [])

    out = staged(
        docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, f"{BLOCKS}, ordinal bigint, doc_id bigint"),
        "token_files",
    )
    return out.where(F.col("block_no").isNotNull()).select("file_id", "block_no", "data"), out.where(F.col("ordinal").isNotNull()).select("file_id", "ordinal", "doc_id")


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """Blocks of raw token files in a folder that Spark can read (each file below 2 GB)."""
    size = block_tokens * width
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.length("content") > 0).select(
        F.col("path").alias("file_id"), F.explode(F.sequence(F.lit(0), F.expr(f"(length(content) - 1) div {size}"))).alias("k"), "content"
    ).select("file_id", F.col("k").cast("bigint").alias("block_no"), F.expr(f"substring(content, int(k * {size} + 1), {size})").alias("data"))


def count_tokens(blocks: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """Documents of the token files in blocks(file_id, block_no, data)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer(), dtype=dtype)
                sizes.append(len(ids))
                found.append(np.flatnonzero(ids == separator).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("block_no"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["file_id", "block_no", "n", "ends"])

    seen = blocks.mapInArrow(scan, "file_id string, block_no bigint, n bigint, ends array<int>")
    order = W.partitionBy("file_id").orderBy("block_no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    stitched = (
        seen.withColumn("tokens_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("docs_before", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .withColumn("last_end", F.when(F.size("ends") > 0, F.col("tokens_before") + F.element_at("ends", -1)))
        .withColumn("open_from", F.coalesce(F.max("last_end").over(before) + 1, F.lit(0)))
        .withColumn("is_last", F.lead("block_no").over(order).isNull())
    )
    closed = (
        stitched.select("file_id", "tokens_before", "docs_before", "open_from", "ends", F.posexplode("ends").alias("k", "end"))
        .select(
            "file_id", (F.col("docs_before") + F.col("k")).cast("bigint").alias("ordinal"),
            F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.col("tokens_before") + F.expr("ends[k - 1]") + 1).cast("bigint").alias("first_token"),
            (F.col("tokens_before") + F.col("end")).alias("after"), F.lit(True).alias("closed"),
        )
    )
    rest = (
        stitched.where("is_last").withColumn("after", F.col("tokens_before") + F.col("n"))
        .withColumn("first_token", F.coalesce(F.col("last_end") + 1, F.col("open_from"))).where("after > first_token")
        .select("file_id", (F.col("docs_before") + F.size("ends")).cast("bigint").alias("ordinal"), F.col("first_token").cast("bigint").alias("first_token"), "after", F.lit(False).alias("closed"))
    )
    return closed.unionAll(rest).select("file_id", "ordinal", "first_token", (F.col("after") - F.col("first_token")).cast("bigint").alias("n_tokens"), "closed")


def count_document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of every document, by writing token files and scanning them."""
    path, pattern, separator = vocabulary()
    blocks, manifest = write_token_files(docs, path, pattern, separator)
    return count_tokens(blocks, separator).join(manifest, ["file_id", "ordinal"]).select("doc_id", "n_tokens", "file_id", "ordinal", "first_token")
