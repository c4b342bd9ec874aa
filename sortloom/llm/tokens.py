"""Token counts with overlap resynchronisation.

A text of up to ``chunk_chars`` is encoded whole. A longer one is cut into chunks
that overlap; each chunk is encoded with offsets, and two neighbours are spliced at
a boundary that both encodings have in the overlap and that is *stable*: a white
space character (space or line feed) after a character that is no white space. The
pre-tokeniser's pattern has no token with white space after anything else and looks
behind nowhere, so the tokens on both sides of such a boundary do not depend on
each other. Where an overlap has none, it is doubled, up to the whole text.

Within a chunk the same boundaries cut it into segments, whose counts are cached:
most words occur again and again.

Edge cases: a null or empty text has 0 tokens; special strings within a text become
special tokens, the library's default; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, tidy

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
SEGMENT_CACHE = 500_000
#: White space besides space and line feed; a chunk with any is encoded in one piece.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_SEGMENT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_STABLE = re.compile(r"(?<=\S)(?=[ \n])")


class SpliceFailed(Exception):
    """Neighbouring chunks share no stable boundary."""


class TokenCounter:
    """Counts tokens as the tokenizers library does, by chunks and segments."""

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk_chars, self.overlap_chars = max(1, chunk_chars), max(1, overlap_chars)
        self.cache: dict[str, int] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: A special string with white space in it could cross a segment's edge.
        self.by_segment = not any(re.search(r"\s", s) for s in self.special) and self.tokenizer.normalizer is None

    # ------------------------------------------------ one chunk
    def segments(self, text: str) -> list[str] | None:
        """The text cut at its stable boundaries; None if it has to stay in one piece."""
        if not self.by_segment or any(c in text for c in _OTHER_SPACE):
            return None
        return _SEGMENT.findall(text)

    def learn(self, cut: list[list[str] | None]) -> None:
        """Puts every segment of these texts into the cache."""
        new: set[str] = set()
        for segments in cut:
            new.update(segments or ())
        fresh = new.difference(self.cache)
        if len(self.cache) + len(fresh) > SEGMENT_CACHE:
            self.cache.clear()
            fresh = new
        # Segments that begin with white space and end without are joined: the edges are stable boundaries.
        inner = [s for s in fresh if s[0] in " \n" and s[-1] not in " \n"]
        for i in range(0, len(inner), 256):
            part = inner[i : i + 256]
            edges = np.cumsum([0, *map(len, part)])
            starts = np.array([a for a, _ in self.tokenizer.encode("".join(part), add_special_tokens=False).offsets])
            counts = np.bincount(np.searchsorted(edges, starts, side="right") - 1, minlength=len(part))
            self.cache.update(zip(part, counts.tolist(), strict=True))
        outer = [s for s in fresh if not (s[0] in " \n" and s[-1] not in " \n")]
        self.cache.update(zip(outer, map(len, self.tokenizer.encode_batch_fast(outer, add_special_tokens=False)), strict=True))

    def plain(self, texts: list[str]) -> list[int]:
        """Tokens of each chunk."""
        out = []
        for i in range(0, len(texts), 256):
            cut = [self.segments(t) for t in texts[i : i + 256]]
            self.learn(cut)
            get = self.cache.__getitem__
            out += [len(self.tokenizer.encode(t, add_special_tokens=False)) if c is None else sum(map(get, c)) for t, c in zip(texts[i : i + 256], cut, strict=True)]
        return out

    # ------------------------------------------------ huge texts
    def _starts(self, text: str, begin: int, end: int, low: int, high: int) -> set[int]:
        """Token starts in [low, high] of the encoding of text[begin:end]. Only the
        overlap and what its first stable boundary depends on has to be encoded."""
        e = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return {begin + a for a, _ in e.offsets if low <= begin + a <= high}

    def splice(self, text: str, begin: int, edge: int, overlap: int) -> int:
        """Where the chunk from begin, reaching to edge + overlap, hands over to the
        next one, which begins at edge: a stable boundary that both encodings have."""
        end = min(len(text), edge + overlap)
        left = self._starts(text, max(begin, edge - overlap), end, edge, end - 1)
        right = self._starts(text, edge, min(len(text), end + overlap), edge, end - 1)
        both = left & right
        for m in _STABLE.finditer(text, edge, end):
            if m.start() > edge and m.start() in both:
                return m.start()
        raise SpliceFailed

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans whose token counts add up to the text's."""
        begin = 0
        while len(text) - begin > self.chunk_chars:
            overlap = self.overlap_chars
            edge = begin + self.chunk_chars
            while True:
                if edge + overlap >= len(text) and overlap > self.overlap_chars:
                    yield begin, len(text)
                    return
                try:
                    cut = self.splice(text, begin, edge, overlap)
                    break
                except SpliceFailed:
                    overlap *= 2
            yield begin, cut
            begin = cut
        yield begin, len(text)

    def count(self, texts: list[str]) -> list[int]:
        chunks, owners = [], []
        for k, text in enumerate(texts):
            parts = [text] if len(text) <= self.chunk_chars else [text[a:b] for a, b in self.spans(text)]
            chunks += parts
            owners += [k] * len(parts)
        total = [0] * len(texts)
        for k, n in zip(owners, self.plain(chunks), strict=True):
            total[k] += n
        return total


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
_COUNTERS: dict[tuple, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs (doc_id, text)."""
    key = (tokenizer_path, chunk_chars, overlap_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(key) or _COUNTERS.setdefault(key, TokenCounter(*key))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), SCHEMA)
