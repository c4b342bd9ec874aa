"""The binary record format as a Spark data source, and a generator.

A file is records one after another: key (8 bytes), payload length (4 bytes), both
little-endian, then the payload. A record belongs to the split in whose range of bytes it
begins. The driver only looks at file sizes and at small index files: this writer notes
beside each part where a record begins in every ``MARK_BYTES``, and a task walks headers
from the last such mark before its range. Files from elsewhere have no index; there each
task walks from the file's start. A short header, a short payload or a length out of bounds
fails the read.

Paths are local, or of any file system that Arrow opens by URI (hdfs://, s3://, ...).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.records import HEADER_BYTES, PAYLOAD_MAX, PAYLOAD_MIN, RECORD_SCHEMA, check_payload_bounds, sort_key

_LENGTH = struct.Struct("<I")
BATCH_BYTES = 8 << 20
#: Bytes between marks of a part's index.
MARK_BYTES = 1 << 20
#: Bytes read at once while headers are walked.
WALK_BYTES = 256 << 10


def _opened(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path.removeprefix("file:")
    return fs.LocalFileSystem(), path


def _joined(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _check(length: int, at: int, most: int) -> None:
    if not PAYLOAD_MIN <= length <= most:
        raise ValueError(f"record at {at}: length {length} is not between {PAYLOAD_MIN} and {most}")


def _starts(block, at: int, base: int, most: int) -> tuple[list[int], int]:
    """Places in a block of bytes, from at on, of records whose headers are in it whole, and
    where the next one begins. base: the block's offset in the file."""
    out, n, unpack = [], len(block), _LENGTH.unpack_from
    while at + HEADER_BYTES <= n:
        length = unpack(block, at + 8)[0]
        if not PAYLOAD_MIN <= length <= most:
            _check(length, base + at, most)
        out.append(at)
        at += HEADER_BYTES + length
    return out, at


def walk(path: str, most: int, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records that begin in [begin, end), payloads not kept."""
    system, inner = _opened(path)
    size = system.get_file_info(inner).size
    end = size if end is None else min(end, size)
    with system.open_input_file(inner) as f:
        at = begin
        while at < end:
            f.seek(at)
            block = f.read(WALK_BYTES)
            if len(block) < HEADER_BYTES:
                raise ValueError(f"record at {at}: its header is cut short")
            starts, upto = _starts(block, 0, at, most)
            for s in starts:
                if at + s >= end:
                    return
                length = _LENGTH.unpack_from(block, s + 8)[0]
                if at + s + HEADER_BYTES + length > size:
                    raise ValueError(f"record at {at + s}: its payload is cut short")
                yield at + s, length
            at += upto


def boundaries(path: str, parts: int, most: int = PAYLOAD_MAX) -> list[int]:
    """parts + 1 offsets: part r begins at the first record at or after total * r / parts.
    Splits of a read begin there, too, but find it in their tasks."""
    system, inner = _opened(path)
    total = system.get_file_info(inner).size
    if parts <= 1:
        return [0, total]
    out, r = [0], 1
    for at, _ in walk(path, most):
        while r < parts and at >= total * r // parts:
            out.append(at)
            r += 1
        if r == parts:
            break
    return out + [total] * (parts + 1 - len(out))


@dataclass
class Split(InputPartition):
    path: str
    mark: int  # a record begins here, at or before begin
    begin: int
    end: int


class KvrecReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.parts = int(options.get("partitions", "8"))
        self.most = int(options.get("payloadmax", PAYLOAD_MAX))
        self.with_payload = options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """By file sizes and index files alone."""
        from pyarrow import fs

        system, inner = _opened(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda x: x.path)
        sizes = {x.path: x.size for x in found if x.type == fs.FileType.File}
        out = []
        for path, size in sizes.items():
            folder, _, name = path.rpartition("/")
            if path != inner and name.startswith((".", "_")):
                continue
            marks = np.zeros(1, np.int64)
            if (index := f"{folder}/_{name}.idx") in sizes and sizes[index]:
                with system.open_input_file(index) as f:
                    marks = np.frombuffer(f.read(), "<i8")
            edges = [size * r // self.parts for r in range(self.parts + 1)]
            where = path if "://" not in self.path else self.path if path == inner else _joined(self.path, name)
            out += [Split(where, int(marks[max(0, int(np.searchsorted(marks, a, side="right")) - 1)]), a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        return out or [Split(self.path, 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.end <= split.begin:
            return
        system, inner = _opened(split.path)
        size = system.get_file_info(inner).size
        # the first record at or after the range's begin
        at = split.begin if split.mark == split.begin else next((o for o, _ in walk(split.path, self.most, split.mark) if o >= split.begin), size)
        with system.open_input_file(inner) as f:
            while at < min(split.end, size):
                f.seek(at)
                block = f.read(min(BATCH_BYTES, size - at))
                if len(block) < HEADER_BYTES:
                    raise ValueError(f"record at {at}: its header is cut short")
                starts, upto = _starts(block, 0, at, self.most)
                if upto > len(block):  # the last one's payload reaches beyond the block
                    if at + upto > size:
                        raise ValueError(f"record at {at + starts[-1]}: its payload is cut short")
                    if len(starts) == 1:
                        block += f.read(upto - len(block))
                    else:
                        upto = starts.pop()
                elif upto < len(block) and at + len(block) == size:
                    raise ValueError(f"record at {at + upto}: its header is cut short")
                mine = np.array(starts, np.int64)
                mine = mine[at + mine < split.end]
                if len(mine):
                    yield self._batch(np.frombuffer(block, np.uint8), mine, at)
                at += upto

    def _batch(self, data: np.ndarray, starts: np.ndarray, base: int) -> pa.RecordBatch:
        head = data[starts[:, None] + np.arange(HEADER_BYTES)]
        keys = np.ascontiguousarray(head[:, 7::-1])
        lengths = np.ascontiguousarray(head[:, 8:]).view("<u4").reshape(-1).astype(np.int64)
        order = (keys.view(">u8").reshape(-1).astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
        n = len(starts)
        key_array = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 8 * n + 1, 8, dtype=np.int32)), pa.py_buffer(keys)])
        if self.with_payload:
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            place = np.repeat(starts + HEADER_BYTES - offsets[:-1], lengths) + np.arange(offsets[-1])
            payload = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[place])])
        else:
            payload = pa.array([b""] * n, pa.binary())
        return pa.RecordBatch.from_arrays([key_array, pa.array(order), pa.array(lengths.astype(np.int32)), payload, pa.array(base + starts)], RECORD_SCHEMA.names)


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    if column.null_count:
        raise ValueError("a record has neither a null key nor a null payload")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return o, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def encoded(keys: pa.Array, payloads: pa.Array, at: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Records as bytes, and where each begins. keys: 8 bytes each, big-endian."""
    ko, kb = _values(keys)
    po, pb = _values(payloads)
    lengths = np.diff(po)
    if len(bad := np.flatnonzero((lengths < PAYLOAD_MIN) | (lengths > most))):
        _check(int(lengths[bad[0]]), at, most)
    if (np.diff(ko) != 8).any():
        raise ValueError("a key has 8 bytes")
    upto = np.concatenate(([0], np.cumsum(lengths + HEADER_BYTES)))
    out, starts = np.empty(upto[-1], np.uint8), upto[:-1]
    out[starts[:, None] + np.arange(8)] = kb[ko[0] : ko[-1]].reshape(-1, 8)[:, ::-1]
    out[starts[:, None] + np.arange(8, HEADER_BYTES)] = lengths.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[np.repeat(starts + HEADER_BYTES - (po[:-1] - po[0]), lengths) + np.arange(po[-1] - po[0])] = pb[po[0] : po[-1]]
    return out, starts


class KvrecWriter(DataSourceArrowWriter):
    """Partitions become parts, each with an index of record starts; a single file, if asked
    for, is the parts in order of partition. That needs a file system that driver and
    executors share, and the driver copies every byte: keep parts on a cluster."""

    def __init__(self, options: dict, overwrite: bool):
        from pyarrow import fs

        self.path = options["path"]
        self.single = options.get("singlefile", "false").lower() == "true"
        self.most = int(options.get("payloadmax", PAYLOAD_MAX))
        self.keep = options.get("keepruns", "false").lower() == "true"
        self.parts = f"{self.path}.parts" if self.single else self.path
        for p in dict.fromkeys((self.path, self.parts)):
            system, inner = _opened(p)
            kind = system.get_file_info(inner).type
            if kind != fs.FileType.NotFound and not overwrite:
                raise FileExistsError(p)
            if kind == fs.FileType.Directory:
                system.delete_dir(inner)
            elif kind == fs.FileType.File:
                system.delete_file(inner)
        system, inner = _opened(self.parts)
        system.create_dir(inner, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        number = context.partitionId()
        name = f"part-{number:05d}-{context.taskAttemptId()}.bin"
        system, folder = _opened(self.parts)
        at, marks = 0, [0]
        with system.open_output_stream(_joined(folder, name)) as f:
            for batch in batches:
                if not batch.num_rows:
                    continue
                data, starts = encoded(batch.column("key"), batch.column("payload"), at, self.most)
                f.write(pa.py_buffer(data))
                starts = starts + at
                while len(k := np.flatnonzero(starts >= marks[-1] + MARK_BYTES)):
                    marks.append(int(starts[k[0]]))
                at += len(data)
        with system.open_output_stream(_joined(folder, f"_{name}.idx")) as f:
            f.write(np.array(marks, "<i8").tobytes())
        return Part(number, name)

    def commit(self, messages) -> None:
        from pyarrow import fs

        kept = sorted((m for m in messages if m), key=lambda m: m.number)
        good = {m.name for m in kept} | {f"_{m.name}.idx" for m in kept}
        system, folder = _opened(self.parts)
        for x in system.get_file_info(fs.FileSelector(folder)):
            if x.base_name not in good:  # of failed attempts
                system.delete_file(x.path)
        if self.single:
            target, inner = _opened(self.path)
            with target.open_output_stream(inner) as out:
                for m in kept:
                    with system.open_input_stream(_joined(folder, m.name)) as f:
                        while block := f.read(4 << 20):
                            out.write(block)
            if not self.keep:
                system.delete_dir(folder)

    def abort(self, messages) -> None:
        system, folder = _opened(self.parts)
        system.delete_dir(folder)


class KvrecSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvrec"

    def schema(self):
        return RECORD_SCHEMA

    def reader(self, schema):
        return KvrecReader(self.options)

    def writer(self, schema, overwrite):
        return KvrecWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KvrecSource)


def to_records(df: DataFrame) -> DataFrame:
    """key (bits in a long), payload as records for the sink."""
    bits = F.unhex(F.lpad(F.hex("key"), 16, "0"))
    return df.select(bits.alias("key"), sort_key("key").alias("sort_key"), F.octet_length("payload").alias("len"), F.col("payload").cast("binary").alias("payload"), F.lit(0).cast("long").alias("file_offset"))


def generate(spark: SparkSession, n: int, payload_min: int = PAYLOAD_MIN, payload_max: int = 64, seed: int = 42, order: str = "random", partitions: int | None = None) -> DataFrame:
    """seq, key (64 bits in a long), payload: random keys, or rising ('sorted'), or
    falling ('reverse'); lengths uniform within the bounds. A row depends on seq and seed
    alone."""
    check_payload_bounds(payload_min, payload_max)
    df = spark.range(n) if partitions is None else spark.range(0, n, 1, partitions)
    key = {"random": F.xxhash64(F.lit(seed), "id"), "sorted": F.col("id"), "reverse": F.lit(n - 1) - F.col("id")}[order]
    length = (F.lit(payload_min) + F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(payload_max - payload_min + 1))).cast("int")
    filler = F.repeat(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), payload_max // 64 + 1)
    return df.select(F.col("id").alias("seq"), key.alias("key"), F.substring(filler, F.lit(1), length).cast("binary").alias("payload")).withColumn("len", F.octet_length("payload"))
