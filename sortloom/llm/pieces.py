"""SentencePiece encoding and decoding that keeps source offsets.

The text is normalised by longest-prefix match through the model's compiled
character map (a double-array trie and a table of replacements), noting for every
normalised byte the source byte it came from; white space is escaped and the dummy
prefix added as the model says. The normalised text is then encoded, and each piece
is projected through that alignment to a span of the original UTF-8.

The ids are the library's own, of the whole text.

Edge cases: a null or empty text has no pieces but the end id; repeated rows give
repeated rows; spans of the dummy prefix are empty at offset 0.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, tidy

MARK = "▁"
_MARK_B = MARK.encode()


# ---------------------------------------------------------------- the model file
def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: ints, or bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class CharMap:
    """A compiled character map: 4 bytes with the trie's size, the double-array trie,
    then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.empty = len(blob) <= 4
        if self.empty:
            return
        (size,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.replacements = blob[4 + size :]
        root = self._offset(self.units[0])
        self.firsts = {c for c in range(1, 256) if (root ^ c) < len(self.units) and self.units[root ^ c] & 0x800000FF == c}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched at this place and what stands for them."""
        units, node, best, i = self.units, 0, None, at
        node ^= self._offset(units[0])
        while i < len(text):
            c = text[i]
            node ^= c
            if node >= len(units) or units[node] & 0x800000FF != c:
                break
            i += 1
            unit = units[node]
            node ^= self._offset(unit)
            if unit & 0x100:
                best = (i - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        start = best[1]
        return best[0], self.replacements[start : self.replacements.index(b"\0", start)]

    def apply(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The mapped text, and for each of its bytes (and its end) the source byte."""
        if self.empty or not any(c in self.firsts for c in set(text)):
            return text, np.arange(len(text) + 1)
        out, align, at = bytearray(), [], 0
        while at < len(text):
            hit = self.longest(text, at) if text[at] in self.firsts else None
            if hit:
                n, new = hit
            else:
                c = text[at]
                n = 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                new = text[at : at + n]
            out += new
            align += range(at, at + n) if not hit else [at] * len(new)
            at += n
        return bytes(out), np.array([*align, len(text)])


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does, with source spans."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        with open(path, "rb") as f:
            model = f.read()
        spec = {k: v for n, m in _fields(model) if n == 3 for k, v in _fields(m)}
        self.charmap = CharMap(spec.get(2, b""))
        self.dummy_prefix = bool(spec.get(3, 1))
        self.squash_spaces = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))
        n = lib.get_piece_size()
        self.eos = lib.eos_id()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.surface = [b"" if lib.is_control(i) else bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.encode() for i, p in enumerate(names)]
        self.width = np.array([len(s) for s in self.surface])
        self.text_of = [str(i).encode() for i in range(n)]
        self.unknown = lib.unk_id()

    # ------------------------------------------------ normalising
    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the source byte of each and of the end."""
        mapped, align = self.charmap.apply(text)
        if self.squash_spaces:
            keep = np.ones(len(mapped), bool)
            data = np.frombuffer(mapped, np.uint8)
            space = data == 0x20
            keep[1:] &= ~(space[1:] & space[:-1])
            inner = np.flatnonzero(~space)
            if len(inner):
                keep[: inner[0]] = False
                keep[inner[-1] + 1 :] = False
            else:
                keep[:] = False
            end = align[inner[-1] + 1] if len(inner) else align[0]
            mapped, align = data[keep].tobytes(), np.append(align[:-1][keep], end)
        if not mapped:
            return b"", align[-1:]
        if self.escape:
            repeat = np.where(np.frombuffer(mapped, np.uint8) == 0x20, 3, 1)
            align = np.append(np.repeat(align[:-1], repeat), align[-1])
            mapped = mapped.replace(b" ", _MARK_B)
        if self.dummy_prefix:
            head = _MARK_B if self.escape else b" "
            mapped, align = head + mapped, np.concatenate((np.full(len(head), align[0]), align))
        return mapped, align

    # ------------------------------------------------ encoding
    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without the end id."""
        return self.library.encode(texts, num_threads=1)

    def spans(self, ids: list[int], normalized: bytes, align: np.ndarray) -> np.ndarray:
        """(begin, end) in the source for each id."""
        if not ids:
            return np.zeros((0, 2), np.int64)
        ends = np.cumsum(self.width[ids]) if self.unknown not in ids else None
        if ends is None or ends[-1] != len(normalized):
            return self._spans_by_library(normalized, align, ids)
        return np.column_stack((align[np.concatenate(([0], ends[:-1]))], align[ends]))

    def _spans_by_library(self, normalized: bytes, align: np.ndarray, ids: list[int]) -> np.ndarray:
        """With unknown pieces, whose length the id doesn't tell: matched in turn, an
        unknown reaching to the next known piece, or to the end if that isn't found."""
        at, ends = 0, []
        for k, i in enumerate(ids):
            if i == self.unknown:
                follow = next((self.surface[j] for j in ids[k + 1 :] if j != self.unknown), None)
                found = -1 if follow is None else normalized.find(follow, at + 1)
                at = len(normalized) if found < 0 else found
            else:
                at += len(self.surface[i])
            ends.append(min(at, len(normalized)))
        e = np.array(ends)
        return np.column_stack((align[np.concatenate(([0], e[:-1]))], align[e]))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("span_begin", T.ArrayType(T.IntegerType())), T.StructField("span_end", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
])
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("spans_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())])


def _encoded(batches, path: str):
    codec = PieceCodec(path)
    for batch in slices(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows = []
        for text, ids in zip(texts, codec.encode(texts), strict=True):
            data = text.encode()
            rows.append((data, ids, codec.spans(ids, *codec.normalize(data))))
        yield codec, batch.column(0), rows


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Number arrays as one list array, without a Python object for each number."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *parts]).astype(np.int32)))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Ids (with the end id), source byte spans and the decoded text of each row of
    docs (doc_id, text). The end id's span is empty, at the end of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codec, doc_ids, rows in _encoded(batches, model_path):
            ids = [[*r[1], codec.eos] for r in rows]
            yield pa.RecordBatch.from_arrays([
                doc_ids, pa.array([len(i) for i in ids], pa.int64()), _lists([np.array(i, np.int32) for i in ids]),
                _lists([np.append(r[2][:, 0], len(r[0])) for r in rows]), _lists([np.append(r[2][:, 1], len(r[0])) for r in rows]),
                pa.array([codec.decode(i) for i in ids], pa.string()),
            ], [f.name for f in SCHEMA])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), SCHEMA)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """As encode, with digests in place of the arrays and the decoded text; lossless:
    the decoded text is the source, and the spans tile it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for codec, doc_ids, rows in _encoded(batches, model_path):
            out = []
            for data, ids, spans in rows:
                ids = [*ids, codec.eos]
                decoded = codec.decode(ids).encode()
                tiled = not len(spans) or bool((spans[1:, 0] == spans[:-1, 1]).all() and spans[-1, 1] == len(data))
                out.append((len(ids), sha(b" ".join(map(codec.text_of.__getitem__, ids))).hexdigest(), sha(decoded).hexdigest(), sha(spans.astype("<i8").tobytes()).hexdigest(), decoded == data and tiled))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:4]), pa.array(cols[4], pa.bool_())], [f.name for f in DIGESTS])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), DIGESTS)
