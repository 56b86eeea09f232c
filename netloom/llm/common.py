"""Shared helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by local sessions that name no shared folder (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/netloom"

#: Bits of a filter for documents: 1 MB.
DOC_BITS = 23

#: Text handed to one vectorised step at a time; bounds a Python worker's memory.
STEP_CHARS = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a cluster must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = LOCAL_CHECKPOINTS
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, what: str) -> str:
    """An unused path in the shared folder. What is left there when the driver ends is deleted."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to reliable storage and returns it with its lineage cut.

    Spark deletes the files once the returned frame is garbage if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; they are small."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod))


def spans_of(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Slices (start, end) whose sizes add up to about ``most``; none is empty."""
    start = size = i = 0
    for i, n in enumerate(sizes, 1):
        size += n
        if size >= most:
            yield start, i
            start, size = i, 0
    if start < i:
        yield start, i


def steps(texts: list, chars: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Slices (start, end) of a list of texts holding about ``chars`` characters each; no text is cut."""
    yield from spans_of(map(len, texts), chars)


def text_steps(column: pa.Array, chars: int = STEP_CHARS, raw: bool = True) -> Iterator[tuple[int, int, list]]:
    """(start, end, texts in UTF-8, or as text; nulls as empty) of a column: whatever the size of a batch, Python holds about ``chars`` bytes of texts at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    kind, empty = (pa.binary(), b"") if raw else (pa.string(), "")
    for a, b in spans_of(sizes, chars):
        yield a, b, [t or empty for t in column.slice(a, b - a).cast(kind).to_pylist()]
    trim()


def trim() -> None:
    """Gives freed memory back to the system: a worker goes on to other stages, and what it once held would count against the executor for good."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give_back(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of unsigned 64-bit integers."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-white-space-separated words of several texts.

    Returns (hash of each word, bounds): text i has words ``bounds[i]:bounds[i+1]``. A word's hash is a
    polynomial of its bytes, taken from prefix sums so that no Python loop runs over words, then mixed."""
    joined = b" ".join(texts) + b" "
    b = np.frombuffer(joined, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], space.astype(np.int8), [1]))))
    start, end = edge[0::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)), dtype=np.uint64)))
    h = (sums[end] - sums[start]) * powers(BASE_INV, len(b))[start]
    h = mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    bounds = np.concatenate(([0], np.searchsorted(start, ends, side="left")))
    return h, bounds


_power_cache: dict[int, np.ndarray] = {}


def cached_powers(base: int, n: int) -> np.ndarray:
    """A view of the first ``n`` powers; a worker computes them once."""
    if len(_power_cache.get(base, ())) < n:
        _power_cache[base] = powers(base, max(n, 1 << 20))
    return _power_cache[base][:n]


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Sums s with which ``(s[j] - s[i]) * BASE_INV**i`` is a polynomial hash of bytes i to j."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * cached_powers(BASE, len(b)), dtype=np.uint64, out=out[1:])
    return out


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as Parquet to the shared folder, which is smaller than a checkpoint; the frame that reads it, and its path."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class BitFilter:
    """A set of longs as bits of a table of fixed size (``1 << bits`` bits): may claim too many members, never too few.

    It is built by aggregation, has 2**bits / 8 bytes whatever the input's size, and only spares rows a shuffle: an exact
    join must follow. When it is full it passes everything."""

    def __init__(self, keys: DataFrame, bits: int) -> None:
        column = keys.columns[0]
        at = F.pmod(F.col(column), F.lit(1 << bits))
        rows = keys.select(at.alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("m")).collect()
        table = np.zeros((1 << bits) // 8, np.uint8)
        for r in rows:
            table[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)
        self.mask = np.uint64((1 << bits) - 1)
        self.shared = keys.sparkSession.sparkContext.broadcast(table)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.uint64) & self.mask
        return (self.shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def passing(self, batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        """The rows whose key, the first column, may be (or isn't) in it."""
        for batch in batches:
            yield batch.filter(pa.array(self.has(batch.column(0).to_numpy()) == wanted))

    def free(self) -> None:
        """Lets all workers forget it. Only when what used it is written, so that no task can run again."""
        self.shared.destroy()


def passed(rows: DataFrame, known: BitFilter, wanted: bool) -> DataFrame:
    """The rows whose key, the first column, may be (or isn't) in the filter."""
    return rows.mapInArrow(lambda batches: known.passing(batches, wanted), rows.schema)


#: Low bits of a value that hold its index in ``first_smallest``: more than a step has values.
INDEX_BITS = 22


def first_smallest(v: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the index of the smallest by its high bits, the leftmost of equal ones.

    Hash and index share one number, so that a minimum finds both; minima of 1, 2, 4, ... neighbours make up any width."""
    if len(v) >> INDEX_BITS:
        raise ValueError("too many values at a time")
    low = np.uint64((1 << INDEX_BITS) - 1)
    best = (v & ~low) | np.arange(len(v), dtype=np.uint64)
    n, span = len(v) - width + 1, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    return (np.minimum(best[:n], best[width - span : width - span + n]) & low).astype(np.int64)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is finished and written: it does so when the driver collects its garbage, which
    it may not do for long, and until then they fill the executors' disks."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Lets executors and idle workers return the memory that finished work has left them: a heap otherwise stays as large as it ever was, and adds to what
    the next work's workers hold. A few small tasks for each core, so that no executor is likely to be left out; one that is only keeps its memory."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from batches

    release(spark)
    n = 2 * spark.sparkContext.defaultParallelism
    tasks = spark.range(0, n, 1, n).mapInArrow(trimmed, "id long")
    tasks.select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()
