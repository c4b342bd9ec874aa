"""Quality rules on repetition, by suffix arrays.

Each text becomes a sequence of word ids. A suffix array (prefix doubling, stopped as
soon as all ranks differ) puts suffixes with long common prefixes side by side; the
intervals of longest common prefixes give the maximal repeated substrings. Those of
at least ``min_words`` words cover spans; their union is the covered part. A text is
kept if the covered fraction is at most ``max_covered`` and the longest repeat at
most ``max_longest`` of its words.

The verdict decides where the base rules pass: a long text that says a third of its words
twice, or one long passage again, has too few words in repeated three-word windows to fail.

Edge cases: null and empty texts have no words and fail the base rules. Very long texts are
judged whole; a text of one repeated passage needs eight bytes a word for each doubling of
the passage's length. Equal texts have equal rows, repeated rows give repeated rows; rows
without a doc_id are judged like others. An empty table gives an empty result; other columns
are not read, so names that clash with the result's do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy

MIN_WORDS, MAX_COVERED, MAX_LONGEST = 8, 0.30, 0.25
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def word_ids(words: list) -> np.ndarray:
    index: dict = {}
    return np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and the ranks of prefixes of 1, 2, 4, ... words (the last
    doubling beyond which nothing repeats left out)."""
    n = len(ids)
    levels = [ids]
    rank, step = ids, 1
    while True:
        nxt = np.full(n, -1, np.int64)
        if step < n:
            nxt[: n - step] = rank[step:]
        key = rank * (n + 1) + (nxt + 1)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        if n == 0 or new[order[-1]] == n - 1:
            return order, levels
        levels.append(new)
        rank, step = new, step * 2


def neighbours_lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix and the one before it in order, by
    descending powers of two."""
    n = len(order)
    if n < 2:
        return np.zeros(0, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    total = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        ok = (a + width <= n) & (b + width <= n)
        hit = np.zeros(n - 1, bool)
        hit[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        a[hit] += width
        b[hit] += width
        total[hit] += width
    return total


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the suffix array whose suffixes share a
    prefix of that length, least or more, and no longer one together."""
    out: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int]] = []
    at = np.flatnonzero(lcp >= least)
    last = -2
    for i, length in zip(at.tolist(), lcp[at].tolist(), strict=True):
        if i != last + 1:
            out += [(n, first, last + 1) for n, first in reversed(open_)]
            open_.clear()
        first = i
        while open_ and open_[-1][0] > length:
            n, first = open_.pop()
            out.append((n, first, i))
        if not open_ or open_[-1][0] < length:
            open_.append((length, first))
        last = i
    return out + [(n, first, last + 1) for n, first in reversed(open_)]


def maximal_repeats(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The suffix array, the longest common prefixes of neighbours, and the intervals that
    no word on the left extends: maximal repeats, which occur at order[first..last]."""
    order, levels = suffix_array(ids)
    lcp = neighbours_lcp(order, levels)
    before = np.where(order > 0, ids[order - 1], -1)
    # a text's first word has nothing before it, which differs from everything
    differs = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))))
    return order, lcp, [x for x in lcp_intervals(lcp, least) if differs[x[2]] > differs[x[1]]]


def repeats(ids: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, int, int]:
    """Which words maximal repeats of min_words or more cover, how many such repeats there
    are, and the length of the longest repeat of any size."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, bool), 0, 0
    order, lcp, found = maximal_repeats(ids, min_words)
    if not found:
        return np.zeros(n, bool), 0, int(lcp.max())
    # Of nested intervals the deepest covers most at a suffix: the union of all spans is
    # that of each suffix with its deepest interval, so it takes a step a suffix. Intervals
    # that a word on the left extends lie within the span of the extended one.
    deepest = np.maximum(np.append(lcp, 0), np.insert(lcp, 0, 0))
    deepest[deepest < min_words] = 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, order, 1)
    np.add.at(edge, order + deepest, -1)
    return np.cumsum(edge[:-1]) > 0, len(found), max(x[0] for x in found)


def trigram_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    size = int(ids.max()) + 1
    if size < 2_000_000:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:] if size**3 < 2**63 else None
    else:
        key = None
    if key is None:
        _, pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
        key = pair[:-1] * size + ids[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k : n - 2 + k] |= twice
    return int(mark.sum())


def judge(text: str, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_repeats, n_covered, longest_repeat, kept."""
    data = text.encode()
    words = data.split()
    n = len(words)
    ids = word_ids(words)
    joined = b"".join(words)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if _WORD.search(line):
            if line in seen:
                dup += 1
            seen.add(line)
    again = trigram_words(ids)
    failed = n < 50 or 100 * again > 50 * n
    covered, n_repeats, longest = repeats(ids, min_words)
    n_covered = int(covered.sum())
    kept = not failed and n_covered <= max_covered * n and longest <= max_longest * n
    return n, len(joined.decode()), len(_SYMBOLS.findall(text)), dup, again, failed, n_repeats, n_covered, longest, kept


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), *(T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_repeats", T.LongType()), T.StructField("n_covered_words", T.LongType()), T.StructField("longest_repeat", T.LongType()), T.StructField("kept", T.BooleanType()),
])


def repetition_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """The counts and the verdict for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t or "", min_words, max_covered, max_longest) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], SCHEMA.names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), SCHEMA)
