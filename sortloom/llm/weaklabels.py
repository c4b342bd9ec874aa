"""Quality classifier: weak labels and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on each text. Texts are counted by their
pattern of votes (at most 3 ** labellers patterns, whatever the corpus), and on these
counts expectation-maximisation estimates each labeller's accuracy in either class and
the share of good texts. The posteriors of a bounded sample's patterns then train a
linear scorer on hashed features, and the scorer judges every text.

The label model covers all texts. The scorer is fitted on ``TRAIN_ROWS`` rows, those of
least hash of id and text, so reruns agree and no order of rows matters.

The scorer judges texts of every length; a feature counts by the share of evidence that a
text of its length gives, characters / (characters + ``DOUBT``), so short texts stay near
the middle, where nothing speaks against them.

Edge cases: a null text, or one without words, is rejected. Very long texts are measured
and scored whole. With no rows at all nothing is trained and the result is empty. Repeated
rows get equal scores; of rows that tie at the end of the sample, equal in id and text, one
is taken. Rows without a doc_id are judged like others. Of other columns none is read;
keep_good gives them back unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, mix, stage, tidy

TRAIN_ROWS, DIMENSIONS, THRESHOLD = 4_000, 1 << 15, 0.5
#: Characters at which a text's features count half.
DOUBT = 60
#: What a labeller says good of, of good texts, before anything is seen; and how many corpora
#: that counts as.
PRIOR_GOOD, PRIOR_WEIGHT = 0.998, 5.0
SYMBOLS = "#*$%&|<>"


# ---------------------------------------------------------------- labellers
def measures(text: str) -> dict[str, float]:
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    letters = max(1, sum(map(str.isalpha, text)) if not text.isascii() else len(text.encode().translate(None, _NOT_LETTERS)))
    upper = len(text.encode().translate(None, _NOT_UPPER))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return {
        "words": len(words),
        "symbols": sum(map(text.count, SYMBOLS)) / chars,
        "upper": upper / letters,
        "shouts": text.count("!") / n,
        "cells": words.count("|") / n,
        "variety": len(set(words)) / n ** 0.9,
        "echo": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "copied": 1 - len(set(lines)) / max(1, len(lines)),
    }


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_NOT_LETTERS = bytes(b for b in range(256) if b not in _LETTERS)
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)

#: Measure, bad from (or up to) here, good up to (or from) here, fewest words to vote.
LABELLERS = (
    ("symbols", 0.03, 0.010, 1),
    ("upper", 0.40, 0.150, 8),
    ("shouts", 0.25, 0.050, 5),
    ("cells", 0.08, 0.020, 8),
    ("variety", -0.45, -0.70, 40),
    ("echo", 0.20, 0.050, 10),
    ("copied", 0.60, 0.350, 20),
)


def votes(text: str) -> tuple[int, ...]:
    """1 good, 0 bad, -1 nothing, of each labeller."""
    m = measures(text)
    out = []
    for name, bad, good, least in LABELLERS:
        x = -m[name] if bad < 0 else m[name]
        out.append(-1 if m["words"] < least else 0 if x >= bad else 1 if x <= good else -1)
    return tuple(out)


def pattern_of(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def votes_of(pattern: int) -> np.ndarray:
    return np.array([pattern // 3**i % 3 - 1 for i in range(len(LABELLERS))])


class LabelModel:
    """Class shares, and each labeller's chance of voting good in each class, by
    expectation-maximisation; labellers are independent given the class, and no vote
    says nothing. A labeller looks for one fault and misses others, but seldom blames a
    good text: it starts from calling 0.85 of bad and PRIOR_GOOD of good texts good, and the
    latter is a prior that weighs PRIOR_WEIGHT times the corpus. That keeps the classes'
    meaning; without it the likelihood has other maxima, such as one class for each kind of
    fault."""

    def __init__(self, counts: dict[int, int], rounds: int = 200):
        table = np.array([votes_of(p) for p in counts] or np.zeros((0, len(LABELLERS)), int)).reshape(-1, len(LABELLERS))
        weight = np.array(list(counts.values()), float)
        self.good = 0.8
        self.says_good = np.tile([[0.85], [PRIOR_GOOD]], (1, len(LABELLERS)))  # by class: bad, good
        prior = PRIOR_WEIGHT * weight.sum()
        for _ in range(rounds if len(weight) else 0):
            p = self._posterior(table)
            old = self.says_good.copy()
            self.good = float(np.clip((weight @ p + 4) / (weight.sum() + 5), 0.01, 0.99))
            for c, q in ((0, 1 - p), (1, p)):
                w = (weight * q)[:, None]
                up, any_ = (w * (table == 1)).sum(0), (w * (table >= 0)).sum(0)
                self.says_good[c] = (up + 1) / (any_ + 2) if c == 0 else (up + PRIOR_GOOD * prior) / (any_ + prior)
            if np.abs(old - self.says_good).max() < 1e-9:
                break

    def _posterior(self, table: np.ndarray) -> np.ndarray:
        logit = np.full(len(table), np.log(self.good / (1 - self.good)))
        logit += ((table == 1) * np.log(self.says_good[1] / self.says_good[0]) + (table == 0) * np.log((1 - self.says_good[1]) / (1 - self.says_good[0]))).sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def table(self) -> np.ndarray:
        """The posterior of each possible pattern."""
        return self._posterior(np.array([votes_of(p) for p in range(3 ** len(LABELLERS))]))


# ---------------------------------------------------------------- scorer
_CLASSES = np.full(256, 11, np.int64)
for _bytes, _c in ((range(65, 91), 0), (range(97, 123), 1), (range(128, 256), 2), (range(48, 58), 3), (b" \t", 4), (b"\n\r", 5), (b".", 6), (b",", 7), (b"!?", 8), (b"|", 9), (b"#*$%&<>", 10)):
    for _b in _bytes:
        _CLASSES[_b] = _c


class Hasher:
    """Hashed features: words; runs of three byte classes; and per word whether it was seen
    before in the text, whether it repeats its neighbour, and its length."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.words = dimensions, WordHashes()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        data = text.encode()
        if not data:
            return np.empty(0, np.int64), np.empty(0)
        c = _CLASSES[np.frombuffer(data, np.uint8)]
        codes = [np.bincount(c[:-2] * 144 + c[1:-1] * 12 + c[2:], minlength=1728) if len(c) > 2 else np.zeros(1728, np.int64)]
        words = data.split()
        h = self.words.of(words)
        if len(h):
            different, first, often = np.unique(h, return_index=True, return_counts=True)
            again = np.ones(len(h), np.int64)
            again[first] = 0
            echo = np.concatenate(([0], (h[1:] == h[:-1]).astype(np.int64)))
            size = np.minimum(np.fromiter(map(len, words), np.int64, len(words)) // 2, 7)
            codes.append(np.bincount(again * 16 + echo * 8 + size, minlength=32))
        else:
            codes.append(np.zeros(32, np.int64))
        shares = np.concatenate([x / max(1, x.sum()) for x in codes])
        at = np.flatnonzero(shares)
        keys, values = at.astype(np.uint64) + np.uint64(77), shares[at]
        if len(h):
            keys, values = np.concatenate((keys, different)), np.concatenate((values, often / len(h)))
        return (mix(keys) % np.uint64(self.dimensions)).astype(np.int64), np.sqrt(values) * (len(data) / (len(data) + DOUBT))


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, dimensions: int = DIMENSIONS, rounds: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, both classes weighing alike, by gradient
    steps with momentum."""
    weights, bias = np.zeros(dimensions), 0.0
    if not rows:
        return weights, bias
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    balance = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    balance /= balance.sum()
    speed, bias_speed = np.zeros(dimensions), 0.0
    for _ in range(rounds):
        score = np.bincount(row, value * weights[at], len(rows)) + bias
        error = (1 / (1 + np.exp(-score)) - target) * balance
        speed = 0.9 * speed - 2.0 * (np.bincount(at, value * error[row], dimensions) + decay * weights)
        bias_speed = 0.9 * bias_speed - 2.0 * error.sum()
        weights, bias = weights + speed, bias + bias_speed
    return weights, float(bias)


# ---------------------------------------------------------------- operator
def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors by pattern, and the scorer's weights and intercept."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([pattern_of(votes(t or "")) for t in batch.column(0).to_pylist()], pa.int32())], ["h", "pattern"])

    hashed = _texts(docs).select("text", F.xxhash64("doc_id", "text").alias("h"))
    voted = stage(hashed.mapInArrow(tidy(vote), "h long, pattern int"), "votes")
    # At most 3 ** labellers rows.
    posterior = LabelModel({r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()}).table()
    least = [r.h for r in voted.select("h").orderBy("h").limit(train_rows).collect()]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            found = [hasher(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([pattern_of(votes(t)) for t in texts], pa.int32()), pa.array([f[0].astype("<i8").tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], ["h", "pattern", "at", "value"])

    if not least:
        return posterior, *train([], np.zeros(0))
    sample = hashed.where(F.col("h") <= least[-1]).mapInArrow(tidy(describe), "h long, pattern int, at binary, value binary").dropDuplicates(["h"]).orderBy("h").limit(train_rows).collect()
    rows = [(np.frombuffer(r["at"], "<i8"), np.frombuffer(r["value"], float)) for r in sample]
    return posterior, *train(rows, posterior[[r.pattern for r in sample]])


SCHEMA = T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def _judge(batches, posterior: np.ndarray, weights: np.ndarray, bias: float, threshold: float):
    hasher = Hasher()
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        patterns = [pattern_of(votes(t)) for t in texts]
        scores = []
        for t in texts:
            at, value = hasher(t)
            scores.append(round(float(1 / (1 + np.exp(-np.clip(weights[at] @ value + bias, -30, 30)))), 9))
        sizes = [len(t.split()) for t in texts]
        kept = [n > 0 and s >= threshold for n, s in zip(sizes, scores, strict=True)]
        yield batch, patterns, [float(posterior[p]) for p in patterns], scores, kept


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, vote pattern, posterior, score and verdict of each row of docs."""
    model = fit(docs, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, *cols in _judge(batches, *model, threshold):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64(), pa.bool_()), strict=True))], ["doc_id", *SCHEMA.names])

    return _texts(docs).mapInArrow(tidy(run), T.StructType([T.StructField("doc_id", T.LongType()), *SCHEMA.fields]))


def keep_good(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the scorer keeps, all columns as they are."""
    model = fit(docs, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, *_, kept in _judge(batches, *model, threshold):
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
