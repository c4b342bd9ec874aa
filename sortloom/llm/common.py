"""Pieces shared by the training-data operators.

Words are maximal runs of bytes other than ``\\x20\\x09-\\x0D``; in UTF-8 that is
exactly what ``bytes.split()`` gives, as no other byte is ASCII white space.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Entries that a worker's word cache may hold; beyond, words are hashed anew.
WORD_CACHE = 400_000


# ---------------------------------------------------------------- staging
def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or one under /tmp where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        path = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        root = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return root.rstrip("/")


#: Paths that open scopes have to remove, innermost last.
_SCOPES: list[list[str]] = []


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a
    lost executor costs no recomputation. The innermost open scope removes the table,
    or, if it is to be kept, the scope around that one."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    around = _SCOPES[: len(_SCOPES) - keep]
    if around:
        around[-1].append(path)
    return out


def unstage(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more: all that came of them is
    written."""
    for df in tables:
        _remove(df.sparkSession, df.staged_path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def staging(spark: SparkSession):
    """Tables staged in here are removed at its end; what came of them has to be written
    by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def buckets_for(df: DataFrame) -> int:
    """A number of buckets that grows with the input."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * df.rdd.getNumPartitions())


# ---------------------------------------------------------------- hashing
class WordHashes(dict):
    """word bytes -> 64-bit hash, cached up to WORD_CACHE entries."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def multipliers(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the len(words)-k+1 windows of k words (none if fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, m in enumerate(multipliers(k)):
        total += words[i : i + n] * m
    return mix(total)


# ---------------------------------------------------------------- packing
def _planes(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def squeeze(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes: high bytes that are alike cost little."""
    return _planes(np.ascontiguousarray(a))


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = np.dtype(dtype).itemsize
    n = len(raw) // size
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """A sorted uint64 array, as differences."""
    return _planes(np.diff(a, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a 64-bit hash, rising with it."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, with the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def runs_of(batches: Iterator, key: str) -> Iterator[tuple[object, Iterator]]:
    """Groups of record batches sorted by key: (key, rows of that key as batches),
    each to be used up before the next."""
    queue: list[pa.RecordBatch] = []
    source = iter(batches)

    def pull() -> bool:
        while not queue:
            batch = next(source, None)
            if batch is None:
                return False
            if batch.num_rows:
                queue.append(batch)
        return True

    while pull():
        value = queue[0].column(key)[0].as_py()

        def rows(value=value):
            while pull():
                batch = queue.pop(0)
                # in Arrow: NumPy would compare byte strings without their last zero bytes
                differs = pc.not_equal(batch.column(key), pa.scalar(value, batch.column(key).type))
                other = np.flatnonzero(differs.to_numpy(zero_copy_only=False))
                if len(other):
                    queue.append(batch.slice(int(other[0])))
                    if other[0]:
                        yield batch.slice(0, int(other[0]))
                    return
                yield batch

        rest = rows()
        yield value, rest
        for _ in rest:
            pass


@lru_cache(1)
def _trim():
    """The allocator's call that gives free memory back to the system, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def tidy(run):
    """run for mapInArrow, by a worker that other tasks use after it: Python's cycle search
    runs less often meanwhile (large caches of plain values make it costly), and at the end
    what was freed goes back to the system instead of staying with the worker."""

    def wrapped(batches):
        before = gc.get_threshold()
        gc.set_threshold(200_000, 50, 100)
        try:
            yield from run(batches)
        finally:
            gc.set_threshold(*before)
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return wrapped


# ---------------------------------------------------------------- bitmaps
#: Bits of a map of values that a join wants: a fixed 1 MB, whatever the input. What it
#: lets pass beside them, the join drops.
BITMAP_BITS, BITMAP_SLICES = 23, 128


def cell_of(value: Column | str, name: str = "cell") -> Column:
    """The bit of a value."""
    return F.pmod(F.xxhash64(value), F.lit(1 << BITMAP_BITS)).cast("int").alias(name)


def _mark(batches: Iterator) -> Iterator:
    seen = np.zeros(1 << BITMAP_BITS, bool)
    for batch in batches:
        seen[batch.column(0).to_numpy()] = True
    for i, part in enumerate(np.packbits(seen).reshape(BITMAP_SLICES, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "bits"])


def _unite(batches: Iterator) -> Iterator:
    for number, parts in runs_of(batches, "slice"):
        total = np.zeros((1 << BITMAP_BITS) // 8 // BITMAP_SLICES, np.uint8)
        for part in parts:
            for data in part.column("bits").to_pylist():
                total |= np.frombuffer(data, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "bits"])


def bitmap(cells: DataFrame) -> bytes:
    """The bits of a column of cells, united in tasks; BITMAP_SLICES rows at the driver."""
    out = np.zeros((BITMAP_SLICES, (1 << BITMAP_BITS) // 8 // BITMAP_SLICES), np.uint8)
    for r in cells.mapInArrow(tidy(_mark), "slice int, bits binary").repartition(F.col("slice")).sortWithinPartitions("slice").mapInArrow(tidy(_unite), "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def sift(shared, hits: bool, cells: int = 1):
    """Rows without their last columns, the cells: those with a cell in the broadcast
    bitmap, or the others."""

    def run(batches: Iterator) -> Iterator:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            hit, k = np.zeros(batch.num_rows, bool), batch.num_columns - cells
            for column in batch.columns[k:]:
                cell = column.to_numpy()
                hit |= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays(batch.columns[:k], names=batch.schema.names[:k]).filter(pa.array(hit == hits))

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(column) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8, nulls as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator, column: int = 1, most: int = 1 << 20) -> Iterator:
    """Batches cut to about so many bytes of a text column, a row at least."""
    for batch in batches:
        upto = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(column)).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
