"""Mixing sources to target weights by Sainte-Laguë apportionment.

All tokens (words) of the corpus are dealt in equal blocks. Each source's target share
decides how many blocks it gives, by highest quotients of target over odd numbers; a
source whose target is ``MAX_REPEAT`` times its size gives just that. A source gives whole
passes first, and the blocks of what is left are dealt to its shards in the same way,
weighted by the shards' sizes. The last block of a source or shard may be short, and what
finds no room in one shard goes to others, so no words are lost to rounding. Within a
shard, documents stand on a line in a seeded order, blocks of the line's words stand on a
ring, and the chosen ones are neighbours, from a seeded first block on: documents are a
random choice of the shard, and only those at the ends of a shard's arc are cut. What a
document gives is what its words have in common with chosen blocks. No block is chosen twice in a pass and no source gives more
than ``MAX_REPEAT`` passes, so no document exceeds ``MAX_REPEAT`` times its size.

Only two small tables meet at the driver: one row per source, and per source and shard
their sizes (``SHARD_UNIT``; 18,000 rows for a source of 1.6e12 words). Everything
on documents is plain DataFrame code; a source holding a third of all rows is split over
its shards.

Edge cases: a null or empty text has size 0 and gives 0; a null source is a source of
its own, the last; a source without words has target 0. A very long text spans many blocks
and may be cut once. Repeated rows, and rows without a doc_id, are one after another in
their shard's order; equal quotients go to the source or shard that stands first. An empty
table gives an empty result. mixed_documents gives all columns back as they are, whatever
their names; only __cut is its own.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, tidy

SEED, BLOCK_WORDS, MAX_REPEAT = 17, 64, 3
#: A source of n words has sqrt(n / SHARD_UNIT) shards: both their number, which meets at the
#: driver, and what one task orders at once grow with the root of the source's size.
SHARD_UNIT = 5_000
WEIGHTS = (5, 2, 1)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def waterfill(sizes: Sequence[int], weights: Sequence[int], cap: int = MAX_REPEAT) -> list[Fraction]:
    """Targets that share sum(sizes) by weight, none above cap times its size: sources
    above it stop there and the rest share what is left, until none is above."""
    left, open_ = Fraction(sum(sizes)), [i for i, s in enumerate(sizes)]
    targets = [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = Fraction(cap * sizes[i])
        left -= sum(targets[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return targets


def sainte_lague(votes: Sequence[Fraction | int], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), ties to the first, none above its
    limit. Most seats come at once from a divisor just above the last quotient; the
    remaining few are dealt one by one."""
    n = len(votes)
    limits = list(limits) if limits is not None else [seats] * n
    seats = min(seats, sum(m for v, m in zip(votes, limits, strict=True) if v > 0))
    total = sum(votes)
    if not seats or total <= 0:
        return [0] * n

    def dealt(divisor: Fraction) -> list[int]:
        # seats whose quotient v / (2 k + 1) is above the divisor
        out = []
        for v, m in zip(votes, limits, strict=True):
            q = Fraction(v) / divisor
            k = -((-(q - 1)) // 2) if q > 1 else 0
            out.append(min(m, int(k)))
        return out

    high = Fraction(total) / 2 + 1
    low = high
    while sum(dealt(low)) < seats:
        low /= 4
    for _ in range(64):
        mid = (low + high) / 2
        mid = Fraction(mid).limit_denominator(10**12) or mid
        if not low < mid < high:
            break
        if sum(dealt(mid)) <= seats:
            high = mid
        else:
            low = mid
    given = dealt(high)
    queue = [(-Fraction(v) / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes, given, limits, strict=True)) if v > 0 and k < m]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < limits[i]:
            heapq.heappush(queue, (-Fraction(votes[i]) / (2 * given[i] + 1), i))
    return given


def word_count(text: str = "text"):
    """Words of a text column, with JVM code only."""
    return F.coalesce(F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("bigint")


def deal(votes: Sequence[Fraction | int], words: int, block: int, room: Sequence[int]) -> list[int]:
    """Words by Sainte-Laguë seats of a block each, none above its room in words. The last
    block may be short; what finds no room is dealt again to those that have some."""
    given = [0] * len(votes)
    words = min(words, sum(r for v, r in zip(votes, room, strict=True) if v > 0))
    while words > 0:
        left = [r - g if v > 0 else 0 for v, r, g in zip(votes, room, given, strict=True)]
        seats = sainte_lague(votes, -(-words // block), [-(-r // block) for r in left])
        for i, k in enumerate(seats):
            more = min(k * block, left[i], words)
            given[i] += more
            words -= more
    return given


def shards_of(size: int, unit: int) -> int:
    """Shards of a source, by its own size."""
    return max(1, math.isqrt(size // unit))


def block_of(total: int, block_words: int) -> int:
    return max(1, min(block_words, total // 10_000))


def quotas(sized: DataFrame, block: int) -> DataFrame:
    """One row per source and shard: source, shard, shard_size, source_size, target, words."""
    spark = sized.sparkSession
    rows = sized.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect()
    by: dict[str | None, dict[int, int]] = {}
    for r in rows:
        by.setdefault(r.source, {})[r.shard] = r.n
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in by)
    sizes = [sum(by[s].values()) for s in names]
    targets = waterfill(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))])
    # a source at its limit gives all of it; the others share the rest, in blocks that are small beside each target
    most = [MAX_REPEAT * s for s in sizes]
    votes = [t if t < m else 0 for t, m in zip(targets, most, strict=True)]
    full = [0 if v else m for v, m in zip(votes, most, strict=True)]
    fine = max(1, min([block, *(int(v) // 100 for v in votes if v)]))
    shared = deal(votes, sum(sizes) - sum(full), fine, most)
    out = []
    for s, size, target, a, b in zip(names, sizes, targets, full, shared, strict=True):
        shards = sorted(by[s])
        held = [by[s][x] for x in shards]
        passes, rest = divmod(a + b, size) if size else (0, 0)
        dealt = deal(held, rest, block, held)
        out += [(s, x, n, size, float(target), passes * n + w) for x, n, w in zip(shards, held, dealt, strict=True)]
    return spark.createDataFrame(out, "source string, shard int, shard_size long, source_size long, target double, words long")


def _sized(docs: DataFrame, row, seed: int) -> DataFrame:
    """row (a struct), source, size and the seeded order h of each row of docs."""
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))


def _taken(docs: DataFrame, row, seed: int, block_words: int, shard_unit: int) -> DataFrame:
    """row, source, size, source_size, target, taken of each row of docs."""
    small = stage(_sized(docs, F.struct(F.lit(0).alias("none")), seed).drop("row", "doc_id"), "sizes")
    sizes = small.groupBy("source").agg(F.sum("size").alias("n")).collect()
    block = block_of(sum(r.n for r in sizes), block_words)
    # Sources of several shards, one row each.
    several = [("null" if r.source is None else "=" + r.source, k) for r in sizes if (k := shards_of(r.n, shard_unit)) > 1]
    several = F.broadcast(docs.sparkSession.createDataFrame(several, "key string, shards int"))

    def sharded(d: DataFrame) -> DataFrame:
        # Null sources get a key of their own, so that joins and window share one partitioning.
        d = d.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).join(several, "key", "left")
        return d.withColumn("shard", F.pmod(F.shiftright("h", 20), F.coalesce("shards", F.lit(1))).cast("int")).drop("shards")

    plan = quotas(sharded(small), block)
    # One row per source and shard: what each of them gives.
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("key")
    d = sharded(_sized(docs, row, seed)).join(plan.select(key, "shard", "shard_size", "source_size", "target", "words"), ["key", "shard"])
    line = Window.partitionBy("key", "shard").orderBy("h", "doc_id", "size")
    d = d.withColumn("upto", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # The words to take are whole passes over the shard's line, then an arc of it from a seeded block on.
    # Documents stand in a seeded order on the line, so neighbouring blocks are a random choice of the shard.
    d = d.withColumn("passes", F.expr("coalesce(words div nullif(shard_size, 0), 0)"))
    d = d.withColumn("rest", F.when(F.col("shard_size") > 0, F.col("words") - F.col("passes") * F.col("shard_size")).otherwise(0))
    first = F.coalesce(F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.expr(f"nullif((shard_size + {block - 1}) div {block}, 0)")), F.lit(0))
    a, whole = first * block, F.col("shard_size")
    b = a + F.col("rest")

    def common(lo, hi):
        return F.greatest(F.lit(0), F.least(F.col("upto"), hi) - F.greatest(F.col("upto") - F.col("size"), lo))

    taken = F.col("passes") * F.col("size") + common(a, F.least(b, whole)) + F.when(b > whole, common(F.lit(0), b - whole)).otherwise(0)
    return d.select("row", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_unit: int = SHARD_UNIT) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs
    (doc_id, text, source)."""
    taken = _taken(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id")), seed, block_words, shard_unit)
    return taken.select("row.doc_id", "source", "size", "source_size", "target", "taken")


def first_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    end = 0
    for _, m in zip(range(n), _WORD.finditer(text), strict=False):
        end = m.end()
    return text[:end]


def mixed_documents(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_unit: int = SHARD_UNIT) -> DataFrame:
    """The mix itself, with the columns of docs: each row as often as it is taken whole,
    and once more, cut after the words that are left to take, where it is taken in part."""
    taken = _taken(docs, F.struct("*"), seed, block_words, shard_unit).where("taken > 0")
    copies = taken.select("row", F.explode(F.expr("transform(sequence(0, (taken - 1) div size), i -> least(size, taken - i * size))")).alias("words"), "size")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    names, at = docs.columns, docs.columns.index("text")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            words = cols.pop().to_pylist()
            texts = [first_words(t, int(n)) if n else t for t, n in zip(cols[at].to_pylist(), words, strict=True)]
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([len(t) if n else old for t, n, old in zip(texts, words, cols[k].to_pylist(), strict=True)], cols[k].type)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return copies.select(*columns, F.when(F.col("words") < F.col("size"), F.col("words")).alias("__cut")).mapInArrow(tidy(shorten), docs.schema)
