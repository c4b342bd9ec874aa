"""Substring dedup by de Bruijn compaction.

Every window of ``k`` words is an edge of the token de Bruijn graph (its nodes are runs
of k - 1 words). Edges are dealt by hash; where an edge starts in several documents, its
source is its first start in the least doc_id, and the starts in all other documents are
sent back to them with the source's coordinates. There, in the join of documents and
their repeated edges, edges that follow one another both in the document and in the
source compact to one path: a span with its source coordinates. All words that edges
with a source in another document cover are removed.

Windows meet by 64-bit hashes, but no removal rests on one: each path goes to its source's
coordinates, in a join of paths and sources, and 128 bits of its words are compared with those
of the source's words. Where a path differs from its source, as hashes collided, the windows
of that path are compared word by word with all windows of equal hash.

Edges travel packed, sorted by hash, as differences; no table of all edges with a row
each ever exists. Before they travel, each task settles what it can: of an edge that
starts in several of its documents, only the starts in the least doc_id go to the edge's
hash range; the others have a source already, and go on to their documents. So an edge
that a third of all documents hold brings a hash range one document for each block of
``BLOCK_EDGES`` edges, not one for each document.

A document's removed words depend on the input alone, not on what is left of other
documents nor on how rows are dealt. Which of several sources a span names, and so
n_spans and longest_span, may depend on how rows are dealt to tasks.

Edge cases: a null text has no words; texts shorter than a window lose nothing; rows
that repeat a doc_id, with any texts, are never smaller than each other; rows without a
doc_id lose nothing and are no source. Of equal starts in the least document the first is
the source. A very long text is split into words as a whole, its edges packed with those of
few others. An empty table gives an empty result; other columns are not read, so names that
clash with the result's do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BITMAP_BITS, WordHashes, bitmap, bucket_of, cell_of, cuts, gram_hashes, runs_of, sift, squeeze, squeeze_sorted, stage, tidy, unsqueeze, unsqueeze_sorted, utf8

WINDOW = 13
#: Edges that a task holds before it packs them.
BLOCK_EDGES = 3_000_000
_EDGES = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("hashes", "owner", "place", "ids", "crcs", "homes"))])
#: A start of an edge in a document, and the edge's source.
_START = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("source", "<i8"), ("source_crc", "<u4"), ("source_at", "<u4")])
#: A path of a document's edges, and where its source's begins; with the digest of its words.
_SPAN = np.dtype([("at", "<u4"), ("edges", "<u4"), ("source", "<i8"), ("source_crc", "<u4"), ("source_at", "<u4"), ("d1", "<i8"), ("d2", "<i8")])


def _by_home(home: np.ndarray, **columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Starts packed by home, in order of document and place."""
    starts = np.empty(len(home), _START)
    for name, values in columns.items():
        starts[name] = values
    order = np.lexsort((starts["at"], starts["doc"], home))
    starts, home = starts[order], home[order]
    edges = cuts(home)
    return [(int(home[a]), squeeze(starts[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def settle(h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges in order of hash: the places of starts whose edge also starts in a lesser
    document here, and for each the place of its source, the edge's first start in the least
    such document."""
    edges = cuts(h)
    lengths = np.diff(edges)
    some = np.flatnonzero(np.repeat(lengths > 1, lengths))
    group = np.repeat(np.arange(len(lengths)), lengths)[some]
    some = some[np.lexsort((at[some], doc[some], group))]
    edges = cuts(group)
    first = some[np.repeat(edges[:-1], np.diff(edges))] if len(some) else some
    gone = doc[some] > doc[first]
    return some[gone], first[gone]


def _mask(bits: int) -> np.uint64:
    """What is kept of a hash: all 64 bits, fewer in tests of hashes that collide."""
    return np.uint64((1 << 64) - (1 << (64 - bits)))


def _edges(k: int, buckets: int, block: int, bits: int):
    """Packed edges of documents (doc_id, text, home), by hash range; and packed starts
    that this task has a source for, under their home (owner null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mask = WordHashes(), _mask(bits)
        held: list[tuple] = []
        size = 0

        def out():
            lengths = [len(x[3]) for x in held]
            h = np.concatenate([x[3] for x in held])
            owner, place = np.repeat(np.arange(len(held), dtype=np.int32), lengths), np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            ids, crcs, homes = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.uint32), np.array([x[2] for x in held], np.int32)
            order = np.argsort(h)
            h, owner, place = h[order], owner[order], place[order]
            doc = ids[owner]
            gone, source = settle(h, doc, place)
            rows = [(home, data, *[None] * 5) for home, data in _by_home(homes[owner[gone]], doc=doc[gone], crc=crcs[owner[gone]], at=place[gone], source=doc[source], source_crc=crcs[owner[source]], source_at=place[source])] if len(gone) else []
            stay = np.ones(len(h), bool)
            stay[gone] = False
            h, owner, place = h[stay], owner[stay], place[stay]
            edges = cuts(bucket_of(h, buckets))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                used, local = np.unique(owner[a:b], return_inverse=True)
                rows.append((int(bucket_of(h[a : a + 1], buckets)[0]), squeeze_sorted(h[a:b]), squeeze(local.astype(np.uint32)), squeeze(place[a:b].astype(np.uint32)), squeeze(ids[used]), squeeze(crcs[used]), squeeze(homes[used])))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], _EDGES.names)

        for batch in batches:
            for doc, text, home in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                if doc is None or len(words) < k:
                    continue
                h = gram_hashes(hashes.of(words), k) & mask
                held.append((doc, zlib.crc32(text), home, h))
                size += len(h)
                if size > block:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


#: Rows of the last step: a home's repeated edges (kind 0), then its documents (kind 1).
_HOME = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("data", T.BinaryType())])


def _home_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * n, pa.int32()), pa.nulls(n).cast(pa.int64()), pa.array([r[1] for r in rows], pa.binary())], _HOME.names)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each hash range, the starts of edges that have a source in another document;
    starts that are settled already pass through."""
    for _, parts in runs_of(batches, "bucket"):
        cols: list[list] = [[], [], [], [], []]
        for part in parts:
            settled = []
            for bucket, *row in zip(*(part.column(c).to_pylist() for c in _EDGES.names), strict=True):
                if row[1] is None:
                    settled.append((bucket, row[0]))
                    continue
                owner = unsqueeze(row[1], np.uint32)
                cols[0].append(unsqueeze_sorted(row[0]))
                cols[1].append(unsqueeze(row[3], np.int64)[owner])
                cols[2].append(unsqueeze(row[2], np.uint32))
                cols[3].append(unsqueeze(row[4], np.uint32)[owner])
                cols[4].append(unsqueeze(row[5], np.int32)[owner])
            if settled:
                yield _home_rows(settled)
        if not cols[0]:
            continue
        h, doc, at, crc, home = (np.concatenate(x) for x in cols)
        del cols
        order = np.argsort(h, kind="stable")  # merges sorted stretches
        edges = cuts(h[order])
        lengths = np.diff(edges)
        keep = order[np.repeat(lengths > 1, lengths)]
        h, doc, at, crc, home = h[keep], doc[keep], at[keep], crc[keep], home[keep]
        gone, source = settle(h, doc, at)
        if len(gone):
            yield _home_rows(_by_home(home[gone], doc=doc[gone], crc=crc[gone], at=at[gone], source=doc[source], source_crc=crc[source], source_at=at[source]))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents on their way home, texts compressed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([1] * n, pa.int32()), batch.column(0), pa.array([pack(t) for t in utf8(batch.column(1))], pa.binary())], _HOME.names)


def paths(starts: np.ndarray) -> np.ndarray:
    """Starts of one document, in order, compacted: edges that follow one another in the
    document and in the source are one path. It ends where the source's text goes another
    way, at a node where the graph branches."""
    if not len(starts):
        return np.empty(0, _SPAN)
    at, source_at = starts["at"].astype(np.int64), starts["source_at"].astype(np.int64)
    broken = (at[1:] != at[:-1] + 1) | (starts["source"][1:] != starts["source"][:-1]) | (starts["source_crc"][1:] != starts["source_crc"][:-1]) | (source_at[1:] != source_at[:-1] + 1)
    first = np.concatenate(([0], np.flatnonzero(broken) + 1))
    out = np.zeros(len(first), _SPAN)
    for name in ("at", "source", "source_crc", "source_at"):
        out[name] = starts[name][first]
    out["edges"] = np.diff(np.append(first, len(at)))
    return out


def span_digest(words: list[bytes], at: int, edges: int, k: int) -> tuple[int, int]:
    """128 bits of the words that a path of edges from ``at`` on covers."""
    return struct.unpack("<qq", hashlib.blake2b(b" ".join(words[at : at + edges + k - 1]), digest_size=16).digest())


def _home(describe):
    """Groups of a home: calls describe(doc_id, text, starts of the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for _, parts in runs_of(batches, "home"):
            starts = np.empty(0, _START)
            pieces: list[np.ndarray] = []
            for part in parts:
                kinds = part.column("kind").to_numpy()
                n = int((kinds == 0).sum())
                pieces += [unsqueeze(x, _START) for x in part.column("data").slice(0, n).to_pylist()]
                if n == len(kinds):
                    continue
                if pieces:
                    starts = np.concatenate(pieces)
                    starts = starts[np.lexsort((starts["at"], starts["crc"], starts["doc"]))]
                    pieces = []
                rows = []
                for doc, data in zip(part.column("doc_id").slice(n).to_pylist(), part.column("data").slice(n).to_pylist(), strict=True):
                    text = unpack(data)
                    mine = starts[:0]
                    if doc is not None and len(starts):
                        a, b = np.searchsorted(starts["doc"], (doc, doc + 1)) if doc < 2**63 - 1 else (int(np.searchsorted(starts["doc"], doc)), len(starts))
                        mine = starts[a:b]
                        if len(mine):
                            mine = mine[mine["crc"] == zlib.crc32(text)]
                    rows.append(describe(doc, text, mine))
                yield from rows_out(rows)

    def rows_out(rows):
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.string()), pa.array(cols[7], pa.binary())], _HOMED.names)

    return run


#: A document's result, as far as hashes tell, and the spans that it rests on.
_HOMED = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "crc", "n_words", "n_removed", "n_spans", "longest_span")), T.StructField("kept", T.StringType()), T.StructField("spans", T.BinaryType())])
RESULT = ["doc_id", "n_words", "n_removed", "n_spans", "longest_span", "kept"]


def covered(n: int, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words lie in spans of so many words from these places on."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at.astype(np.int64), 1)
    np.subtract.at(edge, at.astype(np.int64) + lengths, 1)
    return np.cumsum(edge[:n]) > 0


def _described(doc, crc: int, text: bytes, spans: np.ndarray, k: int, digest: bool) -> tuple:
    """A document's row of _HOMED: the words that spans cover are removed."""
    words = text.split()
    mask = covered(len(words), spans["at"], spans["edges"].astype(np.int64) + k - 1) if len(spans) else None
    kept = b" ".join(words if mask is None else [w for w, m in zip(words, mask.tolist(), strict=True) if not m])
    gone = 0 if mask is None else int(mask.sum())
    longest = int(spans["edges"].max()) + k - 1 if len(spans) else 0
    return doc, crc, len(words), gone, len(spans), longest, hashlib.sha256(kept).hexdigest() if digest else kept.decode(), spans.tobytes() if len(spans) else None


# ---------------------------------------------------------------- verification at the source
_ASKED = "source long, source_crc long, source_at int, edges int, d1 long, d2 long"
_ASKED_NAMES = ("source", "source_crc", "source_at", "edges", "d1", "d2")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What spans say of their sources, each once a batch."""
    for batch in batches:
        spans = np.frombuffer(b"".join(batch.column(0).to_pylist()), _SPAN)
        once = np.unique(spans[list(_ASKED_NAMES)])
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(once[n].astype(t)) for n, t in zip(_ASKED_NAMES, kinds, strict=True)], list(_ASKED_NAMES))


def _unlike(k: int):
    """Rows of sources, by source: a text (kind 0), then what spans say of it (kind 1). Those
    whose words are not the source's at these coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in runs_of(batches, "source"):
            words, crc = None, None
            for part in parts:
                wrong = []
                for *row, kind, text in zip(*(part.column(c).to_pylist() for c in (*_ASKED_NAMES, "kind", "text")), strict=True):
                    if kind == 0:
                        words, crc = text.encode().split(), row[1]
                    elif crc != row[1] or span_digest(words, row[2], row[3], k) != (row[4], row[5]):
                        wrong.append(row)
                if wrong:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*wrong, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], list(_ASKED_NAMES))

    return run


def _by_id(docs: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """doc_id, crc, text of the documents whose ids are wanted, each once. Only those that a
    fixed-size bitmap marks travel."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(cell_of(column))))
    rows = docs.where("doc_id is not null").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), "text", cell_of("doc_id"))
    return rows.mapInArrow(tidy(sift(shared, True)), "doc_id long, crc long, text string").groupBy("doc_id", "crc").agg(F.min("text").alias("text"))


def wrong_spans(docs: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """The spans whose words are not their source's: each path is compared, by 128 bits of
    its words, in the join of paths and sources by the source's coordinates."""
    asked = spans.mapInArrow(tidy(_asked), _ASKED).distinct()
    sources = _by_id(docs, asked, "source").select(F.col("doc_id").alias("source"), F.col("crc").alias("source_crc"), *(F.lit(0).cast(t).alias(c) for c, t in (("source_at", "int"), ("edges", "int"), ("d1", "long"), ("d2", "long"))), F.lit(0).alias("kind"), "text")
    both = sources.unionByName(asked.withColumns({"kind": F.lit(1), "text": F.lit(None).cast("string")}))
    return both.repartition(F.col("source")).sortWithinPartitions("source", "source_crc", "kind").mapInArrow(tidy(_unlike(k)), _ASKED)


def _windows(k: int, bits: int, shared=None):
    """Windows as words. Of rows (doc_id, crc, text, spans): those of the spans; of rows
    (doc_id, text): those whose hash the broadcast bitmap marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mask = WordHashes(), _mask(bits)
        for batch in batches:
            out = []
            crcs = batch.column("crc").to_pylist() if shared is None else [None] * batch.num_rows
            spans = batch.column("spans").to_pylist() if shared is None else [None] * batch.num_rows
            for doc, crc, text, mine in zip(batch.column("doc_id").to_pylist(), crcs, utf8(batch.column("text")), spans, strict=True):
                words = text.split()
                if doc is None or len(words) < k:
                    continue
                h = (gram_hashes(hashes.of(words), k) & mask).view(np.int64)
                if shared is None:
                    at = np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(*(np.frombuffer(mine, _SPAN)[c].tolist() for c in ("at", "edges")), strict=True)]))
                else:
                    cell = h.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
                    bit = np.frombuffer(shared.value, np.uint8)[(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7))).astype(np.uint8)
                    at = np.flatnonzero(bit & 1)
                out += [(doc, crc, int(i), int(h[i]), b" ".join(words[i : i + k])) for i in at.tolist()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "crc", "at", "h", "words"])

    return run


_WINDOWS = "doc_id long, crc long, at int, h long, words binary"


def _mended(homed: DataFrame, docs: DataFrame, wrong: DataFrame, k: int, digest: bool, bits: int) -> DataFrame:
    """homed, where spans are not their source's: the windows of such spans are compared with
    all windows of equal hash word by word, and stay where none of a lesser document equals
    them."""
    spark = docs.sparkSession

    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, crc, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc, crc, *(int(x) for x in s)) for s in np.unique(np.frombuffer(spans, _SPAN))]
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "crc", *_SPAN.names])

    each = homed.where("spans is not null").select("doc_id", "crc", "spans").distinct().mapInArrow(tidy(bad), "doc_id long, crc long, at int, edges int, source long, source_crc long, source_at int, d1 long, d2 long")
    doubted = stage(each.join(wrong, list(_ASKED_NAMES), "left_semi").groupBy("doc_id", "crc").agg(F.collect_set("at").alias("at")), "doubted")
    rows = homed.where("spans is not null").select("doc_id", "crc", "spans").distinct().join(doubted.select("doc_id", "crc"), ["doc_id", "crc"], "left_semi")
    texts = stage(_by_id(docs, doubted, "doc_id").join(rows, ["doc_id", "crc"]).join(doubted, ["doc_id", "crc"]), "doubted-texts")

    def split(batches: Iterator[pa.RecordBatch], doubt: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for data, at in zip(batch.column("spans").to_pylist(), batch.column("at").to_pylist(), strict=True):
                s = np.frombuffer(data, _SPAN)
                spans.append(s[np.isin(s["at"], at) == doubt].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("crc"), batch.column("text"), pa.array(spans, pa.binary())], ["doc_id", "crc", "text", "spans"])

    schema = "doc_id long, crc long, text string, spans binary"
    asked = stage(texts.mapInArrow(tidy(lambda b: split(b, True)), schema).mapInArrow(tidy(_windows(k, bits)), _WINDOWS), "doubted-windows")
    shared = spark.sparkContext.broadcast(bitmap(asked.select(F.shiftrightunsigned("h", 64 - BITMAP_BITS).cast("int").alias("cell"))))
    least = docs.mapInArrow(tidy(_windows(k, bits, shared)), _WINDOWS).groupBy("words").agg(F.min("doc_id").alias("least"))
    gone = asked.join(least, "words").where("least < doc_id").groupBy("doc_id", "crc").agg(F.collect_set("at").alias("gone"))
    sure = texts.mapInArrow(tidy(lambda b: split(b, False)), schema).join(gone, ["doc_id", "crc"], "left")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, crc, text, spans, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "crc", "text", "spans", "gone")), strict=True):
                more = np.zeros(len(at or ()), _SPAN)
                more["at"], more["edges"] = sorted(at or ()), 1
                out.append(_described(doc, crc, text.encode(), np.concatenate((np.frombuffer(spans, _SPAN), more)), k, digest))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.string()), pa.array(cols[7], pa.binary())], _HOMED.names)

    mended = stage(sure.mapInArrow(tidy(describe), _HOMED), "mended")
    key = ["doc_id", "crc"]
    rest = homed.join(doubted.select(*key), key, "left_anti").select(*RESULT)
    # a row for each row that repeats a document
    return rest.unionByName(homed.select(*key).join(mended, key).select(*RESULT))


def remove_repeats(docs: DataFrame, k: int = WINDOW, digest: bool = False, block: int = BLOCK_EDGES, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, longest_span (words) and kept of each row of
    docs (doc_id, text): the kept words joined by one space, or their sha256. bits: of the
    hashes by which windows meet; the result is the same with any number."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), docs.rdd.getNumPartitions())
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    dealt = docs.selectExpr("doc_id", "text", f"cast(pmod(xxhash64(doc_id, crc32(cast(text as binary))), {buckets}) as int) home")

    def describe(doc, text: bytes, starts: np.ndarray) -> tuple:
        spans = paths(starts)
        if len(spans):
            words = text.split()
            digests = [span_digest(words, a, n, k) for a, n in zip(spans["at"].tolist(), spans["edges"].tolist(), strict=True)]
            spans["d1"], spans["d2"] = zip(*digests, strict=True)
        return _described(doc, zlib.crc32(text), text, spans, k, digest)

    edges = dealt.mapInArrow(tidy(_edges(k, buckets, block, bits)), _EDGES).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    home = edges.mapInArrow(tidy(_repeated), _HOME).unionByName(dealt.mapInArrow(tidy(_documents), _HOME))
    homed = stage(home.repartition(buckets, "home").sortWithinPartitions("home", "kind").mapInArrow(tidy(_home(describe)), _HOMED), "homed")
    wrong = stage(wrong_spans(docs, homed.where("spans is not null").select("spans"), k), "wrong")
    if wrong.isEmpty():
        return homed.select(*RESULT)
    return _mended(homed, docs, wrong, k, digest, bits)
