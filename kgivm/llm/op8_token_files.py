"""Token ids in Parquet list columns.

Documents are range-partitioned and sorted by id, encoded, and written by
Spark's own Parquet writer: one row per document with its ids as a list column
(dictionary encoded, or delta encoded with ``encoding='delta'``), row groups and
pages of a stated size, and the writer's page indexes. Metadata columns
(``part``, ``local_start``, ``n_tokens``) can be read without touching tokens, and
a filter on ``doc_id`` skips pages.

Null and empty texts hold the end id alone. Rows with equal (or null) ids are
ordered by a fingerprint of their text; nulls come first. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgivm.llm import scratch
from kgivm.llm.kernels import list_of
from kgivm.llm.pretokens import encoder

FILE_SCHEMA = "part int, local_start long, n_tokens long, ids array<int>"


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, style: str = "word", end_id: int = 2, key: str = "doc_id", text: str = "text",
    encoding: str = "dictionary", row_group_bytes: int = 64 << 20, page_bytes: int = 256 << 10,
) -> None:
    """Encode ``docs`` in ascending ``key`` order and write the token files to ``path``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding: {encoding}")
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    # the driver samples range keys, so texts are not among them
    tie = F.xxhash64("text")
    ordered = src.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)

    def encode(batches):
        enc, part, start = encoder(tokenizer, style), TaskContext.get().partitionId(), 0
        for batch in batches:
            column, key_column = batch.column(1), batch.column(0)
            for lo, hi, ids, bounds in enc.batches(column):
                n = hi - lo
                ends = bounds + np.arange(n + 1)
                out = np.full(ends[-1], end_id, np.int32)
                inner = np.ones(ends[-1], bool)
                inner[ends[1:] - 1] = False
                out[inner] = ids
                sizes = np.diff(ends)
                yield pa.RecordBatch.from_arrays(
                    [key_column.slice(lo, n), pa.array(np.full(n, part, np.int32)), pa.array(start + ends[:-1]), pa.array(sizes), list_of(out, ends, pa.int32())],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    options = {
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "PARQUET_2_0" if encoding == "delta" else "PARQUET_1_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "compression": "zstd",
    }
    ordered.mapInArrow(encode, f"doc_id {kind}, {FILE_SCHEMA}").write.options(**{k: str(v) for k, v in options.items()}).parquet(path)
    scratch.drop_shuffles(docs.sparkSession)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, local_start, start, n_tokens: metadata pages only."""
    rows = spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per file written
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sums.select("part", before.alias("before")), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def read_tokens(spark: SparkSession, path: str, *, where=None) -> DataFrame:
    """doc_id and ids; a filter on doc_id reaches the page index."""
    rows = spark.read.parquet(path)
    return (rows if where is None else rows.where(where)).select("doc_id", "ids")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files."""
    rows = spark.read.parquet(path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=True)).cast("B")
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])), np.int64, len(lists))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc)], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    got = rows.select("doc_id", "part", "local_start", "ids").mapInArrow(digest, f"doc_id {kind}, part int, local_start long, n_tokens long, ids_crc32 long")
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("part", before.alias("before"))
    return got.join(starts, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch.folder(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_digest(spark, path)
