"""Helpers shared by the corpus operators: Arrow word splitting, stable hashing, folds, written tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of every operator here: a run of characters that aren't ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal id, modulo folds; null ids count as fold 0 of the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (only where that is unset and there is one machine, as in tests) a new local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a folder that all executors share is needed")
        where = tempfile.mkdtemp(prefix="graphlode-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/graphlode/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application wrote. Results that aren't saved yet can't be read any more."""
    remove(spark, own_dir(spark))


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives any executor. clear() removes them all."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more, and lets go of the shuffle files of jobs that ended."""
    spark = tables[0].sparkSession
    for t in tables:
        remove(spark, t.written_to)
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of a batch that a worker's function gets at once: its arrays take a multiple of them.
SLICE_BYTES = 6 << 20


def slices(b: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most so many bytes of strings; a longer row is a run of its own."""
    size = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns if pa.types.is_string(c.type)), np.zeros(b.num_rows, np.int64))
    at, total = 0, np.cumsum(size)
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, end - at)
        at = end


def give_back() -> None:
    """Unused memory goes back to the machine: workers live on after their task, and other tables' tasks follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, after: Callable[[], None] | None = None, most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow of a function from one batch to one batch, of at most so many bytes; after: called when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, most):
                yield fn(part)
                pa.default_memory_pool().release_unused()
        if after:
            after()
        give_back()

    return df.mapInArrow(run, schema)


def plain(a: pa.Array | pa.ChunkedArray) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def texts_of(col: pa.Array) -> pa.Array:
    """Strings without nulls (null: empty)."""
    return pc.fill_null(plain(col).cast(pa.string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of all texts in order, and for each word the index of its text."""
    lists = pc.ascii_split_whitespace(texts)
    flat, parents = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return parents.filter(full).to_numpy(zero_copy_only=False), flat.filter(full)


def encode(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index into the distinct values for each value, and the distinct values."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def hash64(values: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string: words of eight bytes are mixed in turn, so strings up to eight bytes of one length never meet; long ones go by xxh3."""
    n, (_, ends, data) = len(values), values.buffers()
    if not n:
        return np.zeros(0, np.uint64)
    at = np.frombuffer(ends, np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    begin, size = at[:-1], np.diff(at)
    raw = np.concatenate([np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    word = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix((size.astype(np.uint64) + np.uint64(1)) * GOLDEN)
        for j in range(0, 24, 8):
            some = np.flatnonzero((size > j) & (size <= 24))
            left = np.minimum(size[some] - j, 8)
            out[some] = mix(out[some] ^ (word[begin[some] - at[0] + j] & TAILS[left]))
    long = np.flatnonzero(size > 24)
    if len(long):
        out[long] = np.fromiter(map(xxhash.xxh3_64_intdigest, values.take(pa.array(long)).to_pylist()), np.uint64, len(long))
    return out


#: Masks of the first bytes of a word.
TAILS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; wraps silently."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def starts_of(parents: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of the runs of the sorted parents."""
    return np.searchsorted(parents, np.arange(n + 1))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets; empty segments are 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
