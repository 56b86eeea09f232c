"""Token ids in ORC files: ascending ids, integer run-length encoding, row indexes and Bloom filters.

ORC stores integer columns as runs (run-length encoding, version 2), each stripe with an index entry of minimum and maximum for
every ``row_stride`` rows, and a Bloom filter on the document id. Stripes are read in parallel, and a
look-up by id reads only those row groups that its Bloom filter and range admit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.bpe import encode_decode
from netloom.llm.common import shuffle_partitions


def write_token_orc(
    df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0,
    files: int | None = None, stripe_bytes: int = 8 << 20, row_stride: int = 1000, compression: str = "none",
) -> None:
    """Encodes every whole text and writes ``doc_id``, ``text_hash``, ``n_tokens``, ``ids`` to ORC files at ``path``.

    Rows are ascending by id over all files and inside each: texts are dealt by ranges of (id, hash of the text), so that an
    id with many rows is spread as well; nulls come first, ties by the text's hash. ``end_id``, if any, is put after each
    document's ids, also those of an empty or null text. An empty table gives files without rows. Other columns
    are not read."""
    spark = df.sparkSession
    keys = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    dealt = keys.repartitionByRange(files or shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    keyed = dealt.select(F.struct("doc_id", tie.alias("text_hash")).alias("key"), "text")
    ids = encode_decode(keyed, tokenizer, "key", "text", decode=False)
    if end_id is not None:
        ids = ids.withColumn("ids", F.array_append("ids", F.lit(end_id)))
    out = ids.select("key.doc_id", "key.text_hash", F.size("ids").cast("long").alias("n_tokens"), "ids")
    out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option(
        "orc.row.index.stride", str(row_stride)
    ).option("orc.stripe.size", str(stripe_bytes)).option("orc.compress", compression.upper()).orc(path)


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text_hash, n_tokens, ids and the file that holds them; filters on doc_id reach the files' indexes."""
    return spark.read.orc(path).select("*", F.col("_metadata.file_path").alias("file"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        flat, bounds = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].data) for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(np.diff(bounds).astype(np.int64)), batch.column(1), pa.array(crc, pa.int64())], names=["doc_id", "text_hash", "n_tokens", "file", "ids_crc32"])


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """For each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Null ids come first, rows that share an id in the order of their texts' hashes, each with a row of its own; files without rows give none. Files are ranges of ids, so a document's start is its file's start plus the running sum inside its file. The
    files' starts come from a table with one row a file, read from the column ``n_tokens`` alone."""
    rows = read_token_orc(spark, path)
    # One row a file; Spark numbers the files in the order of the ranges, and their names begin with that number.
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("int"), "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    digests = rows.select("doc_id", "file", "ids", "text_hash").mapInArrow(_crc, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, n_tokens long, file string, ids_crc32 long")
    before = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    inside = digests.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return inside.join(starts, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
