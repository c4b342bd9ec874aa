"""Media columns: content-defined chunks, a deduplicated chunk store, verified media.

A payload is stored as 8-bit PCM samples in a WAV container. The container is cut by
a rolling gear hash. A first pass counts chunk digests; a bitmap of fixed size marks those
that occur more than once. A second pass writes the store: a row for each medium with the
ordered list of its chunks' digests and the bytes of the chunks that no other medium has,
and a table of the shared chunks, each once. Every medium is rebuilt from what was written:
straight from its row if it shares no chunk, else where its row meets the shared chunks
that its list names. A chunk's digest and the medium's digest are both checked; a mismatch
raises. Copies of a medium are rebuilt once and joined back to all rows.

Edge cases: a null text is an empty payload (64 zero bytes); repeated rows give
repeated rows; very long texts give many chunks, never one large row beyond the text
itself.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, runs_of, stage, tidy

BLOCK = 64
#: Chunks of about 1,000 bytes, below the usual text's length.
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 9, 8_192
#: Bits of the map of shared chunks: a fixed 4 MB. A chunk marked by chance is stored as a shared one.
MAP_BITS, MAP_SLICES = 25, 64
SAMPLE_RATE = 8_000
GEAR = mix(np.arange(1000, 1256, dtype=np.uint64))


def payload_of(text: bytes) -> bytes:
    """The text, with zero bytes up to a positive multiple of BLOCK."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def to_media(payload: bytes) -> bytes:
    """A WAV file, one channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, SAMPLE_RATE, len(payload), "NONE", "not compressed"))
        w.writeframes(payload)
    return out.getvalue()


def from_media(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1 or w.getnchannels() != 1:
            raise ValueError("not one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + GEAR[data[i]] modulo 2**64, by doubling: a byte's share has
    left the hash after 64 steps."""
    h = GEAR[data]
    step = 1
    while step < 64:
        shifted = h[:-step] << np.uint64(step)
        h = h.copy()
        h[step:] += shifted
        step *= 2
    return h


def cut(data: bytes, least: int = MIN_CHUNK, bits: int = MASK_BITS, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks: where the hash's upper bits are 0, at least ``least`` and at
    most ``most`` bytes after the last cut."""
    n = len(data)
    if n <= least:
        return [n]
    hits = np.flatnonzero(gear_hashes(np.frombuffer(data, np.uint8)) >> np.uint64(64 - bits) == 0) + 1
    ends, at = [], 0
    while n - at > least:
        k = np.searchsorted(hits, at + least)
        end = min(int(hits[k]) if k < len(hits) else n, at + most, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def features(payload: bytes) -> str:
    """Least, greatest and summed sample, crossings of the middle, and energy."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"min={x.min()};max={x.max()};sum={x.sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};energy={int((x * x).sum())}"


#: The store as it is written: media (kind 0: digests, lengths and bytes of their own chunks,
#: length 0 for shared ones) and shared chunks (kind 1: digest and bytes).
_STORE = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("media_sha", T.BinaryType()), T.StructField("n_shared", T.IntegerType()),
    T.StructField("digests", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("data", T.BinaryType()),
])
_CHUNKS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("data", T.BinaryType())])
MEDIA = T.StructType([
    T.StructField("media_sha", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("n_chunks", T.IntegerType()), T.StructField("feature", T.StringType()),
])


def _medium(text: str | None) -> bytes:
    return to_media(payload_of((text or "").encode()))


def _digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def _new_media(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, list[bytes]]]]:
    """(digest, chunks) of each medium that is new in this task, by batch."""
    seen: set[bytes] = set()
    for batch in batches:
        out = []
        for text in batch.column(0):
            data = _medium(text.as_py())
            sha = hashlib.sha256(data).digest()
            if sha not in seen:
                seen.add(sha)
                ends = cut(data)
                out.append((sha, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]))
        yield out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first 8 bytes of chunk digests, with their number in a batch."""
    for media in _new_media(batches):
        found = np.frombuffer(b"".join(_digest(c)[:8] for _, parts in media for c in parts), np.int64)
        h, n = np.unique(found, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["h", "n"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << MAP_BITS, bool)
    for batch in batches:
        bits[batch.column(0).to_numpy() & ((1 << MAP_BITS) - 1)] = True
    for i, part in enumerate(np.packbits(bits).reshape(MAP_SLICES, -1)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "bits"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, parts in runs_of(batches, "slice"):
        total = np.zeros((1 << MAP_BITS) // 8 // MAP_SLICES, np.uint8)
        for part in parts:
            for data in part.column("bits").to_pylist():
                total |= np.frombuffer(zlib.decompress(data), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "bits"])


def shared_map(docs: DataFrame) -> bytes:
    """A bitmap of the chunks that occur more than once, by the low bits of their digests."""
    often = docs.select("text").mapInArrow(tidy(_counted), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    out = np.zeros((MAP_SLICES, (1 << MAP_BITS) // 8 // MAP_SLICES), np.uint8)
    for r in often.mapInArrow(tidy(_marked), "slice int, bits binary").repartition(F.col("slice")).sortWithinPartitions("slice").mapInArrow(tidy(_united), "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _stored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        sent: set[bytes] = set()
        for media in _new_media(batches):
            rows: list[tuple] = []
            for sha, parts in media:
                digests = [_digest(c) for c in parts]
                cell = np.frombuffer(b"".join(d[:8] for d in digests), np.int64) & ((1 << MAP_BITS) - 1)
                others = ((bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1).tolist()
                lengths = np.array([0 if o else len(c) for c, o in zip(parts, others, strict=True)], "<i4")
                rows.append((0, sha, sum(others), b"".join(digests), lengths.tobytes(), b"".join(c for c, o in zip(parts, others, strict=True) if not o)))
                for d, c, o in zip(digests, parts, others, strict=True):
                    if o and d not in sent:
                        sent.add(d)
                        rows.append((1, None, None, d, None, c))
            if rows:
                yield _batch(rows, _STORE)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared chunks sorted by digest: each once."""
    last = None
    for batch in batches:
        rows = []
        for d, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if d != last:
                rows.append((d, data))
                last = d
        if rows:
            yield _batch(rows, _CHUNKS)


def chunk_store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is written: the media (media_sha, n_shared, digests in order, lengths, data),
    and the shared chunks (digest, data). A medium all of whose chunks are shared has a row
    for each task that met it; every chunk's bytes are there once."""
    texts = docs.selectExpr("cast(text as string) text")
    shared = docs.sparkSession.sparkContext.broadcast(shared_map(texts))
    cut_ = stage(texts.mapInArrow(tidy(_stored(shared)), _STORE), "media")
    chunks = cut_.where("kind = 1").select(F.col("digests").alias("digest"), "data").repartition(F.col("digest")).sortWithinPartitions("digest").mapInArrow(tidy(_once), _CHUNKS)
    return cut_.where("kind = 0").drop("kind"), stage(chunks, "chunks")


def _described(sha: bytes, media: bytes, n_chunks: int) -> tuple:
    if hashlib.sha256(media).digest() != sha:
        raise ValueError("rebuilt media differ from what was stored")
    payload = from_media(media)
    return sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), sha.hex(), n_chunks, features(payload)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.BinaryType: pa.binary(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string()}
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[type(f.dataType)]) for c, f in zip(cols, schema, strict=True)], schema.names)


def _joined(sha: bytes, digests: bytes, lengths: bytes, data: bytes, others: dict[bytes, bytes]) -> tuple:
    """A medium from its row of the store and the shared chunks that its list names."""
    parts, at = [], 0
    for i, n in enumerate(np.frombuffer(lengths, "<i4").tolist()):
        d = digests[16 * i : 16 * i + 16]
        if n:
            part = data[at : at + n]
            at += n
        elif (part := others.get(d)) is None:
            raise ValueError("a chunk list names a chunk that isn't stored")
        if _digest(part) != d:
            raise ValueError("a stored chunk differs from its digest")
        parts.append(part)
    return _described(sha, b"".join(parts), len(parts))


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_joined(*row, {}) for row in zip(*(batch.column(c).to_pylist() for c in ("media_sha", "digests", "lengths", "data")), strict=True)], MEDIA)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared chunks that media name: digest and medium, each pair once a row."""
    for batch in batches:
        rows = []
        for sha, digests, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            wanted = {digests[16 * int(i) : 16 * int(i) + 16] for i in np.flatnonzero(np.frombuffer(lengths, "<i4") == 0)}
            rows += [(d, sha) for d in sorted(wanted)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], ["digest", "media_sha"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by medium and kind, media before their shared chunks: the media."""
    rows: list[tuple] = []
    for sha, parts in runs_of(batches, "media_sha"):
        own, others = None, {}
        for part in parts:
            for kind, digests, lengths, data in zip(*(part.column(c).to_pylist() for c in ("kind", "digests", "lengths", "data")), strict=True):
                if kind == 0:
                    own = own or (digests, lengths, data)
                else:
                    others[digests] = data
        if own is None:
            raise ValueError("a medium lacks its chunk list")
        rows.append(_joined(sha, *own, others))
        if len(rows) >= 1000:
            yield _batch(rows, MEDIA)
            rows = []
    if rows:
        yield _batch(rows, MEDIA)


def media_of(docs: DataFrame) -> DataFrame:
    """One row for each different medium: digests and features of what was read back."""
    media, chunks = chunk_store(docs)
    some = media.where("n_shared > 0").select("media_sha", F.lit(0).alias("kind"), "digests", "lengths", "data")
    # Media that several tasks met name their chunks once.
    names = some.select("media_sha", "digests", "lengths").dropDuplicates(["media_sha"]).mapInArrow(tidy(_named), "digest binary, media_sha binary")
    brought = names.join(chunks, "digest").select("media_sha", F.lit(1).alias("kind"), F.col("digest").alias("digests"), F.lit(None).cast("binary").alias("lengths"), "data")
    met = some.unionByName(brought).repartition(F.col("media_sha")).sortWithinPartitions("media_sha", "kind").mapInArrow(tidy(_rebuild), MEDIA)
    return media.where("n_shared = 0").mapInArrow(tidy(_alone), MEDIA).unionByName(met)


_ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media_sha", T.BinaryType())])


def _row_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([hashlib.sha256(_medium(t)).digest() for t in texts], pa.binary())], _ROWS.names)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the medium's columns for each row of docs (doc_id, text)."""
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(_row_keys), _ROWS)
    return rows.join(media_of(docs), "media_sha").drop("media_sha")
