"""What several operators share: shared storage, table reading and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, the bytes of [\x20\x09-\x0D].
SPACES = (9, 10, 11, 12, 13, 32)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
#: Text bytes that are hashed at a time; it bounds a worker's memory (a longer document is a slice of its own).
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the storage that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent a local master (tests, one machine) gets a temporary folder; others are an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: df as a Parquet table in shared storage, which outlives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, through the file system that its path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Give memory that a worker has freed back to the machine: workers live on, and others need it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """A function over Arrow batches that gives freed memory back after each batch and at its end."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            for b in run(batches):
                yield b
                del b
                give_back()
        finally:
            give_back()

    return tidied


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words (runs of bytes other than ASCII white space) of some texts, hashed together.

    hash: 64 bits of each word; bounds: the words of text i are bounds[i]:bounds[i + 1].
    """

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts) + b" " * 9
        raw = np.frombuffer(joined, np.uint8)
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([np.zeros(1, edge.dtype), edge])
        self.joined, self.starts, self.ends = joined, edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.bounds = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.bounds[-1] = len(self.starts)
        self.hash = self._hash(joined, self.starts, self.ends - self.starts)

    @staticmethod
    def _hash(joined: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        loads = np.ndarray((len(joined) - 7,), np.dtype("<u8"), joined, strides=(1,))
        out = mix(loads[starts] & _MASKS[np.minimum(lengths, 8)])
        live, at = np.flatnonzero(lengths > 8), 8
        while len(live):
            part = loads[starts[live] + at] & _MASKS[np.minimum(lengths[live] - at, 8)]
            out[live] = mix(out[live] * np.uint64(0x9E3779B97F4A7C15) + part)
            at += 8
            live = live[lengths[live] > at]
        return mix(out + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Rolling:
    """Hashes of runs of consecutive words: polynomial prefix sums modulo 2**64, then mixed."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes) + 1
        one = np.ones(1, np.uint64)
        self._back = np.multiply.accumulate(np.concatenate([one, np.full(n - 1, pow(base, -1, 2**64), np.uint64)]))
        power = np.multiply.accumulate(np.concatenate([one, np.full(n - 1, base, np.uint64)]))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)])

    def runs(self, length: int) -> np.ndarray:
        """One hash for each start of `length` words (across texts too; the caller knows the bounds)."""
        if len(self._sums) <= length:
            return np.zeros(0, np.uint64)
        return mix((self._sums[length:] - self._sums[:-length]) * self._back[: len(self._sums) - length])


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list[bytes]:
    """The strings of an Arrow column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
