"""Helpers shared by the text operators: shared scratch tables, ranges of ids, words and hashes."""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources.scratch import shared_dir

#: Wraps at 2**64; odd, so multiplication is a bijection.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
MAX_ID = 2**63 - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _released_shuffles(spark: SparkSession):
    """Within it, Spark deletes a query's shuffle files once the query has ended; its result is in a table by then."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _released_shuffles(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() made and that nothing needs any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty), and the further columns named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def range_buckets(df: DataFrame, id_col: str, out: str, rows_each: int = 4096, most: int = 20_000) -> DataFrame:
    """df with a column that numbers ranges of a non-null id column from 0 in ascending order.

    The bounds are approximate quantiles, at most `most` of them: beyond that the ranges only get larger.
    """
    from pyspark.ml.feature import Bucketizer

    n = min(most, -(-df.count() // rows_each))
    bounds = df.select(F.percentile_approx(id_col, [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] if n > 1 else []
    splits = sorted({float(b) for b in bounds})
    if not splits:
        return df.withColumn(out, F.lit(0))
    as_double = df.withColumn("__range_of", F.col(id_col).cast("double"))
    cut = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="__range_of", outputCol="__range")
    return cut.transform(as_double).withColumn(out, F.col("__range").cast("int")).drop("__range_of", "__range")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, for arrays."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * MIX_1
        h = (h ^ (h >> np.uint64(27))) * MIX_2
        return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered for the words seen of late."""

    def __init__(self, keep: int = 100_000):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.keep:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of GOLDEN and of its inverse, for hashes of runs by prefix sums."""
    inverse = np.uint64(pow(int(GOLDEN), -1, 2**64))
    one = np.ones(1, np.uint64)
    return tuple(np.multiply.accumulate(np.concatenate([one, np.full(n, b)])) for b in (GOLDEN, inverse))


def run_hashes(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of code points or bytes from lo to hi."""
    up, down = powers(1 << max(10, len(points).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points + GOLDEN) * up[: len(points)], dtype=np.uint64)])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


#: The white space between words.
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = mix(np.arange(256, dtype=np.uint64) + GOLDEN)


def word_hashes(some: list[str], most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, by their UTF-8 bytes between ASCII white space, and each word's text by number.

    Hashed in stretches of about `most` bytes that end at white space.
    """
    encoded = [t.encode() for t in some]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in encoded), np.int64, len(encoded)))
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    edge = np.diff((~SPACES[data]).astype(np.int8), prepend=np.int8(0))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = np.empty(len(lo), np.uint64), 0
    while at < len(lo):
        end = max(at + 1, int(np.searchsorted(hi, lo[at] + most)))
        a, b = lo[at], hi[end - 1]
        up, down = powers(1 << max(10, int(b - a).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data[a:b]] * up[: b - a], dtype=np.uint64)])
        first, last = lo[at:end] - a, hi[at:end] - a
        out[at:end] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        at = end
    return out, np.searchsorted(ends, lo, "right")


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive values: one uint64 for each start."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, b = values[:n].copy(), np.uint64(base)
    with np.errstate(over="ignore"):
        for j in range(1, width):
            out *= b
            out += values[j : j + n]
    return mix(out)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def slices(batch, column: str, most_bytes: int = 1 << 20, most_rows: int = 512) -> Iterator:
    """An Arrow batch in slices of so many bytes in a column, or of one row, and so many rows."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, min(at + most_rows, int(np.searchsorted(sizes, before + most_bytes, "right"))))
        yield batch.slice(at, end - at)
        at = end


def rows(batches: Iterator) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)
