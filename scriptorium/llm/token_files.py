"""Token-ID output: Parquet files of token lists, dictionary-encoded ids, delta-encoded metadata columns,
bounded row groups and pages with page indexes, so that a reader fetches only the documents it asks for.

Nulls: a null text counts as empty, so it has the end id alone; a null doc_id sorts first. Rows of one doc_id stand in
order of a hash of their texts, and starts follow the files' own order of rows. Repeated rows each get their own entry. A very
long text is one row, whole. An empty table gives files without rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, parts
from scriptorium.llm.tokens import chunk_memo, tokenizer_path

#: One row per document: its ids (the end id included) and their number.
SCHEMA = "doc_id long, tokens array<int>, n_tokens long"

#: Parquet settings: ids in a dictionary of at most 1 MB a row group, integers else as deltas (format 2),
#: row groups of 8 MB, pages of 64 kB or 2,000 rows; parquet writes column and offset indexes of pages.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(8 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
}


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Rows of SCHEMA in the input's order and partitions; ``tokenizer`` is a file's path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, end = chunk_memo(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in parts(batches):
            found = [x + end for x in memo.encode([t or "" for t in batch.column("text").to_pylist()])]
            lengths = np.array([len(x) // 4 for x in found], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), ids), pa.array(lengths)],
                names=["doc_id", "tokens", "n_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Write the documents' ids as files of ascending doc_id: file n holds smaller ids than file n + 1."""
    # Rows of one doc_id, all the null ones for example, are dealt to several files by a hash of their texts.
    order = (F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    encode_documents(ordered, tokenizer, end_id).write.options(**LAYOUT).mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The token lists with the number of their file and row; columns and row filters reach the scan."""
    number = F.regexp_extract(F.input_file_name(), r"part-(\d+)-[^/]*$", 1).cast("int")
    return spark.read.schema(SCHEMA).parquet(path).withColumns({"file_no": number, "row_no": F.col("_metadata.row_index")})


def token_positions(files: DataFrame, end_id: int = 1) -> DataFrame:
    """From files as read: per document its number of ids, their checksum, and where they start in the whole
    sequence of files. Sums are taken in each file and then over files, never over all rows in one task.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            offsets = column.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file_no"), batch.column("row_no"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "file_no", "row_no", "n_tokens", "ids_crc32"],
            )

    found = files.select("doc_id", "file_no", "row_no", "tokens").mapInArrow(digest, "doc_id long, file_no int, row_no long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file only
    bases = totals.select("file_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        found.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "file_no")
        .select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files of the word-end BPE, read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = Scratch(spark).folder()
    write_token_files(docs, path, tokenizer_path("word_bpe_49k.json"))
    return token_positions(read_token_files(spark, path))
