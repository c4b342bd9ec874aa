"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document's set is its distinct word shingles, as 64-bit hashes. Two sets link when
100 |A & B| >= 80 |A | B|; a set of n shingles then shares at least T = ceil(0.8 n)
shingles with any partner. DivideSkip orders a query's inverted lists by length,
merges the short ones with a heap and probes the long ones by binary search, only for
documents that the short lists have brought to T minus the number of long lists.

On a cluster the lists are split over the short and the long side as follows.

1. One pass over all texts gives each set's size and digest, and a fixed-size sketch
   of how many documents hold each shingle. Equal sets are one class from here on.
2. Shingles are ordered by the sketch's level, then by hash: an order of all shingles
   by the length of their lists. A query's long lists are its last T - 1 shingles, so
   any partner occurs at least once in its short lists. Only short lists are ever
   built: each class is posted under its n - T + 1 first shingles. (Order affects
   speed alone: any order gives the same links, as partners share T shingles.)
3. A task takes a range of hashes, so it has whole short lists. It first links each
   member of a list to the list's hub and to the member before it, by size: a star and
   a chain, never all pairs. Pairs have to pass exact bounds: a length filter, a
   positional filter and one on the parities of the rests of the sets. Candidates are
   searched exactly (4.); connected
   components of the links collapse large groups of near copies.
4. A candidate search takes a query class with its candidates' texts: their sets make
   inverted lists over the query's shingles; the short lists are merged with a heap,
   those that reach T - L probe the L long lists by binary search, and those that
   reach the required overlap are links.
5. Lists are taken a second time: now all pairs of a list between *different*
   components that pass the length filter and the positional filter are candidates, so
   no link between different components is lost. Their exact links are joined to the
   first ones, and components of all links are the result.

Two documents of one component need no link of their own: the result is the component
of each document. Every set is searched, and no list, partner or candidate is capped.

A doc_id names a document: rows that share an id but not a text are one node, which links
where any of its sets does.

Edge cases: an empty table gives an empty result. Very long texts are whole sets, their
candidates searched in blocks; equal sizes and places are ordered by class, which changes no
link. Of other columns none is read, so names that clash with the result's do no harm.
Further: a null text, or one without words, has an empty set and is linked with
nothing; its component is its own doc_id. A text of fewer words than a shingle has one
shingle, all its words. Repeated rows are one class. A row with a null doc_id counts
like others, but a class of such rows only has a null component.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WordHashes, bitmap, bucket_of, buckets_for, cell_of, cuts, gram_hashes, mix, multipliers, runs_of, sift, slices, squeeze, squeeze_sorted, stage, tidy, unsqueeze, unsqueeze_sorted, unstage, utf8

WORDS, PERCENT = 5, 80
#: Counters of the sketch of list lengths: a fixed 8 MB, whatever the corpus.
SKETCH_BITS, SKETCH_SLICES = 23, 128
#: Classes of at least one in so many rows are joined by broadcast, for the last join.
HOT_CLASSES = 1_000
#: Candidates of a query that a task gets at once, about.
CANDIDATES = 256
#: Long lists that are probed before sets that can't reach the overlap are dropped.
PROBED = 64


def shingle_set(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < k:
        return mix(np.array([(words * multipliers(n)).sum() + np.uint64(n)], np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.unique(gram_hashes(words, k))


def needed(n, percent: int = PERCENT):
    """Least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def overlap_needed(a, b, percent: int = PERCENT):
    """Least overlap of sets of a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


# ---------------------------------------------------------------- 1. sets and sketch
_FIRST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])


def _sets(texts: list[bytes], hashes: WordHashes, k: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(hashes.of(text.translate(LOWER).split()), k)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _first_pass(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint8)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            ns, digests = [], []
            for s in _sets(utf8(batch.column(1)), hashes, k):
                ns.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                cells = (s & mask).astype(np.int64)
                # a cell twice in one document counts once: lengths are only compared
                counts[cells] += counts[cells] < 255
            none = pa.nulls(len(ns))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), pa.array(digests, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], _FIRST.names)
        width = len(counts) // SKETCH_SLICES
        if counts.any():
            parts = [zlib.compress(counts[i * width : (i + 1) * width].tobytes(), 1) for i in range(SKETCH_SLICES)]
            none = pa.nulls(SKETCH_SLICES)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(parts, pa.binary())], _FIRST.names)

    return run


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums counters as they stream by: one slice in memory."""
    for number, parts in runs_of(batches, "slice"):
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_SLICES, np.int64)
        for part in parts:
            for data in part.column("counts").to_pylist():
                total += np.frombuffer(zlib.decompress(data), np.uint8)
        # levels of about a fifth of a doubling
        levels = np.minimum(255, np.round(5 * np.log2(1 + total))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["slice", "counts"])


def levels_of(first: DataFrame) -> np.ndarray:
    """The order's levels, summed in tasks; SKETCH_SLICES rows, 8 MB, at the driver."""
    sliced = first.where("slice is not null").select("slice", "counts").repartition(F.col("slice")).sortWithinPartitions("slice")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    width = len(out) // SKETCH_SLICES
    for r in sliced.mapInArrow(tidy(_add_slices), "slice int, counts binary").collect():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.uint8)
    return out


# ---------------------------------------------------------------- 2. short sides
def bit_of(h: np.ndarray) -> np.ndarray:
    """One of 64 bits for each hash; a set's parity is the exclusive or of its bits.
    The parities of two sets differ in at most as many bits as the sets do in members."""
    return np.uint64(1) << (h >> np.uint64(58))


def rest_parity(parity: int, short: np.ndarray) -> np.ndarray:
    """For each place of a short side, the parity of what comes after it in the whole set."""
    return np.int64(parity).view(np.uint64) ^ np.bitwise_xor.accumulate(bit_of(short))


_SHORT = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("parity", T.LongType()), T.StructField("short", T.BinaryType())])


def _short_sides(levels, k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mask = WordHashes(), np.uint64((1 << SKETCH_BITS) - 1)
        level = np.frombuffer(levels.value, np.uint8)
        done: set[bytes] = set()
        for batch in batches:
            rows = []
            for s in _sets(utf8(batch.column(0)), hashes, k):
                if not len(s):
                    continue
                digest = _digest(s)
                if digest in done:
                    continue
                done.add(digest)
                if len(done) > 500_000:
                    done.clear()
                order = np.argsort(level[(s & mask).astype(np.int64)], kind="stable")
                rows.append((digest, len(s), int(np.bitwise_xor.reduce(bit_of(s)).view(np.int64)), s[order[: len(s) - needed(len(s), percent) + 1]].tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int64(), pa.binary()), strict=True)], _SHORT.names)

    return run


# ---------------------------------------------------------------- 3. and 5. lists
_POSTED = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("hashes", "owner", "place", "classes", "sizes", "groups", "rests"))])


def _post(buckets: int):
    """Short sides (class, n, grp, parity, short) as packed postings by hash range, each
    with the parity of the rest of its set."""

    def pack(h, owner, place, classes, sizes, groups, rests):
        order = np.argsort(h)
        h, owner, place = h[order], owner[order], place[order]
        edges = cuts(bucket_of(h, buckets))
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            used, local = np.unique(owner[a:b], return_inverse=True)
            rows.append((int(bucket_of(h[a : a + 1], buckets)[0]), squeeze_sorted(h[a:b]), squeeze(local.astype(np.uint32)), squeeze(place[a:b].astype(np.uint32)), squeeze(classes[used]), squeeze(sizes[used]), squeeze(groups[used]), squeeze(rests[order[a:b]])))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], _POSTED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out():
            lengths = [len(x[3]) for x in held]
            h = np.concatenate([x[3] for x in held])
            rests = np.concatenate([rest_parity(x[4], x[3]) for x in held])
            return pack(h, np.repeat(np.arange(len(held)), lengths), np.concatenate([np.arange(n) for n in lengths]), np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int32), np.array([x[2] for x in held], np.int64), rests)

        for batch in batches:
            for c, n, g, parity, short in zip(*(batch.column(x).to_pylist() for x in ("class", "n", "grp", "parity", "short")), strict=True):
                s = np.frombuffer(short, np.uint64)
                held.append((c, n, g, s, parity))
                size += len(s)
                if size > 3_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _lists(parts: Iterator[pa.RecordBatch]):
    """A bucket's postings, sorted by hash, then size, then class, and the lists' edges."""
    cols: list[list] = [[], [], [], [], [], []]
    for part in parts:
        for row in zip(*(part.column(c).to_pylist() for c in _POSTED.names[1:]), strict=True):
            owner = unsqueeze(row[1], np.uint32)
            cols[0].append(unsqueeze_sorted(row[0]))
            cols[1].append(unsqueeze(row[3], np.int64)[owner])
            cols[2].append(unsqueeze(row[4], np.int32)[owner])
            cols[3].append(unsqueeze(row[5], np.int64)[owner])
            cols[4].append(unsqueeze(row[2], np.uint32))
            cols[5].append(unsqueeze(row[6], np.uint64))
    h, c, n, g, p, r = (np.concatenate(x) for x in cols)
    # lists of one document have no candidates
    order = np.argsort(h, kind="stable")
    edges = cuts(h[order])
    keep = order[np.repeat(np.diff(edges) > 1, np.diff(edges))]
    h, c, n, g, p, r = h[keep], c[keep], n[keep], g[keep], p[keep], r[keep]
    order = np.lexsort((c, n, h))
    h, c, n, g, p, r = h[order], c[order], n[order], g[order], p[order], r[order]
    return cuts(h), c, n.astype(np.int64), g, p.astype(np.int64), r


_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.minimum(a, b), np.maximum(a, b)
    both = np.unique(np.column_stack((low, high)), axis=0) if len(low) else np.empty((0, 2), np.int64)
    return both[both[:, 0] != both[:, 1]]


def _emit(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(pairs), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 50_000, 0]), pa.array(pairs[i : i + 50_000, 1])], _PAIRS.names)


def _may_link(na, nb, pa_, pb, percent: int):
    """Length filter (nb >= na) and positional filter: both short sides are in one
    order, so after this common shingle at most the shorter rest is in common."""
    least = overlap_needed(na, nb, percent)
    return (100 * na >= percent * nb) & (np.minimum(pa_, pb) + 1 + np.minimum(na - pa_ - 1, nb - pb - 1) >= least)


def _rests_may_link(na, nb, pa_, pb, ra, rb, percent: int):
    """If this is the first common shingle, what comes after it in both sets differs in
    at least as many members as the parities do in bits."""
    rest = (na - pa_ - 1) + (nb - pb - 1) - np.bitwise_count(ra ^ rb).astype(np.int64)
    return 1 + rest // 2 >= overlap_needed(na, nb, percent)


def _chain_and_star(percent: int):
    """Each member of a list with the one before it, by size, and with the list's hub:
    the member that has the shingle at the least place of its short side. The fewer rare
    shingles a document has of its own, the lower its places; in a group of copies that
    were each changed a little the hub is the text nearest to the original."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in runs_of(batches, "bucket"):
            edges, c, n, _, p, r = _lists(parts)
            if len(edges) < 2:
                continue
            lengths = np.diff(edges)
            number = np.repeat(np.arange(len(lengths)), lengths)
            hub = np.repeat(np.lexsort((c, p, number))[edges[:-1]], lengths)
            at = np.arange(len(c))
            later = at > edges[:-1][number]
            x = np.concatenate((at[later] - 1, hub))
            y = np.concatenate((at[later], at))
            less, more = np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x)
            ok = _may_link(n[less], n[more], p[less], p[more], percent) & (c[less] != c[more])
            ok[ok] = _rests_may_link(n[less[ok]], n[more[ok]], p[less[ok]], p[more[ok]], r[less[ok]], r[more[ok]], percent)
            yield from _emit(_pairs(c[less[ok]], c[more[ok]]))

    return run


def _across(percent: int):
    """All pairs of a list between different groups that may link, by rows of the list
    so that memory follows the list's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in runs_of(batches, "bucket"):
            edges, c, n, g, p, r = _lists(parts)
            found: list[np.ndarray] = []
            held = 0
            if len(edges) > 1:
                lengths = np.diff(edges)
                mixed = np.minimum.reduceat(g, edges[:-1]) != np.maximum.reduceat(g, edges[:-1])
                # step d pairs each posting with the d-th after it in its list
                left = np.repeat(edges[1:], lengths)
                at = np.flatnonzero(np.repeat(mixed, lengths))
                step = 1
                while len(at):
                    at = at[at + step < left[at]]
                    # sizes rise along a list: too large here is too large further on
                    at = at[100 * n[at] >= percent * n[np.minimum(at + step, len(n) - 1)]]
                    y = at + step
                    ok = (g[at] != g[y]) & _may_link(n[at], n[y], p[at], p[y], percent)
                    ok[ok] = _rests_may_link(n[at[ok]], n[y[ok]], p[at[ok]], p[y[ok]], r[at[ok]], r[y[ok]], percent)
                    if ok.any():
                        found.append(_pairs(c[at[ok]], c[y[ok]]))
                        held += len(found[-1])
                        if held > 2_000_000:
                            found = [np.unique(np.concatenate(found), axis=0)]
                            if len(found[0]) > 1_000_000:
                                yield from _emit(found.pop())
                            held = sum(map(len, found))
                    step += 1
            if found:
                yield from _emit(np.unique(np.concatenate(found), axis=0))

    return run


# ---------------------------------------------------------------- 4. exact search
def divide_skip(query: np.ndarray, sets: list[np.ndarray], least: np.ndarray, long_share: float = 1.0) -> np.ndarray:
    """Which of the sets share at least ``least`` (one each) values with the query.

    Inverted lists over the query's values hold the places of the sets. The longest,
    at most long_share of the least required overlap less one, are long: the others are
    merged with a heap, and the long ones are probed by binary search, PROBED lists at a
    time, only for sets that the lists before brought close enough."""
    m = len(sets)
    if not m:
        return np.empty(0, bool)
    values, owners = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    at = np.searchsorted(query, values)
    hit = at < len(query)
    hit[hit] = query[at[hit]] == values[hit]
    at, owners = at[hit], owners[hit]
    order = np.lexsort((owners, at))
    at, owners = at[order], owners[order]
    edges = cuts(at)
    lengths = np.diff(edges)
    by_length = np.argsort(lengths, kind="stable")
    n_long = min(len(by_length), int(long_share * max(0, int(least.min()) - 1)))
    short, long = by_length[: len(by_length) - n_long], by_length[len(by_length) - n_long :]
    merged = [0] * m
    for place in heapq.merge(*(owners[edges[i] : edges[i + 1]].tolist() for i in short.tolist())):
        merged[place] += 1
    counts = np.array(merged)
    alive = np.flatnonzero(counts >= least - n_long)
    for first in range(0, n_long, PROBED):
        if not len(alive):
            break
        probed = long[first : first + PROBED]
        # the lists one after another, each place raised by m for every list before it
        raised = np.concatenate([owners[edges[i] : edges[i + 1]] + k * m for k, i in enumerate(probed.tolist())])
        wanted = (np.arange(len(probed))[:, None] * m + alive).reshape(-1)
        k = np.minimum(np.searchsorted(raised, wanted), len(raised) - 1)
        counts[alive] += (raised[k] == wanted).reshape(len(probed), -1).sum(0)
        alive = alive[counts[alive] >= least[alive] - (n_long - first - len(probed))]
    out = np.zeros(m, bool)
    out[alive] = True
    return out


def _search(percent: int, words: int):
    """Rows (query class, part, kind, class, text): the query's own texts (kind 0; more than
    one if rows share its doc_id but not a text), then its candidates'. Candidates are
    searched in blocks, so memory has a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for a, parts in runs_of(slices(batches, 4, 4 << 20), "a"):
            queries: list[np.ndarray] = []
            links: set[int] = set()
            asked = False
            for part in parts:
                kinds, others = part.column("kind").to_pylist(), part.column("b").to_pylist()
                sets = list(_sets(utf8(part.column("text")), hashes, words))
                i = 0
                while i < len(sets):
                    if kinds[i] == 0:
                        if asked:  # the next part of the same query
                            queries, asked = [], False
                        queries.append(sets[i])
                        i += 1
                        continue
                    if not queries:
                        raise ValueError("a query lacks its text")
                    asked = True
                    end = next((j for j in range(i, min(i + 256, len(sets))) if kinds[j] == 0), min(i + 256, len(sets)))
                    for query in queries:
                        least = overlap_needed(len(query), np.array([len(s) for s in sets[i:end]]), percent)
                        links.update(b for b, ok in zip(others[i:end], divide_skip(query, sets[i:end], least), strict=True) if ok)
                    i = end
                if len(links) > 100_000:
                    yield _linked(a, links)
                    links.clear()
            if links:
                yield _linked(a, links)

    return run


def _linked(a: int, links: set[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a] * len(links), pa.int64()), pa.array(sorted(links), pa.int64())], _PAIRS.names)


def _once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, text) that a task has not seen just before: of a row that a third of all
    rows repeat, one a task travels."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for c, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            key = hashlib.blake2b(text, digest_size=16, key=c.to_bytes(8, "little", signed=True)).digest()
            keep.append(key not in seen)
            seen.add(key)
        if len(seen) > 500_000:
            seen.clear()
        yield batch.filter(pa.array(keep, pa.bool_()))


def exact_links(pairs: DataFrame, docs: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that link. A query's candidates are dealt over tasks in parts of
    about CANDIDATES, each with the query's own text: the hub of a large group of near copies
    is the query of many. Texts travel, not sets: words compress, hashes don't. A bitmap of
    fixed size keeps most texts that no pair names out of the join."""
    spark = pairs.sparkSession
    pairs = stage(pairs.distinct(), f"{name}-pairs")
    parts = pairs.groupBy("a").agg((F.expr(f"count(*) div {CANDIDATES}") + 1).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    own = dealt.select(F.col("a").alias("class"), "a", "part", F.lit(0).alias("kind")).distinct()
    ways = own.unionByName(dealt.select(F.col("b").alias("class"), "a", "part", F.lit(1).alias("kind")))
    shared = spark.sparkContext.broadcast(bitmap(pairs.select(cell_of("a")).unionByName(pairs.select(cell_of("b")))))
    rows = docs.select(F.col("doc_id").alias("class"), "text", cell_of("doc_id")).where("class is not null")
    wanted = sift(shared, True)
    # of rows that share an id, each different text has its set; one function for both steps,
    # as each mapInArrow of a task takes a worker of its own, which then stays
    texts = rows.mapInArrow(tidy(lambda batches: _once_a_task(wanted(batches))), "class long, text string")
    texts = texts.repartition(F.col("class")).dropDuplicates(["class", "text"])
    asked = texts.join(ways, "class").select("a", "part", "kind", F.col("class").alias("b"), "text").repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "kind", "b")
    links = stage(asked.mapInArrow(tidy(_search(percent, words)), _PAIRS).distinct(), f"{name}-links")
    unstage(pairs)
    return links


# ---------------------------------------------------------------- components
def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, component (least node) of each node of links (a, b): large-star and
    small-star rounds (Kiveris et al. 2014), each of joins and aggregates on the links."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, edges = edges, stage(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        unstage(last)
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        before = now


# ---------------------------------------------------------------- the operator
def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    first = stage(docs.mapInArrow(tidy(_first_pass(words)), _FIRST), "sets")
    rows = first.where("slice is null").select("doc_id", "n", "digest")
    levels = spark.sparkContext.broadcast(levels_of(first).tobytes())

    # classes of equal sets, named by their least doc_id
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class"), F.count("*").alias("copies"))
    short = docs.select("text").mapInArrow(tidy(_short_sides(levels, words, percent)), _SHORT).groupBy("digest").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("short").alias("short"))
    short = stage(short.join(classes.where("class is not null"), "digest").select("class", "n", "parity", "short"), "short")

    buckets = buckets_for(docs)

    def lists(sides: DataFrame) -> DataFrame:
        return sides.mapInArrow(tidy(_post(buckets)), _POSTED).repartition(buckets, "bucket").sortWithinPartitions("bucket")

    near = exact_links(lists(short.withColumn("grp", F.col("class"))).mapInArrow(tidy(_chain_and_star(percent)), _PAIRS), docs, words, percent, "near")
    groups = stage(components(spark, near), "groups")
    grouped = short.join(groups.withColumnRenamed("node", "class"), "class", "left").select("class", "n", "parity", "short", F.coalesce("component", "class").alias("grp"))
    far = exact_links(lists(grouped).mapInArrow(tidy(_across(percent)), _PAIRS), docs, words, percent, "far")
    joined = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(far)
    final = components(spark, joined).withColumnRenamed("node", "class")

    named = stage(classes.join(final, "class", "left").select("digest", "copies", F.coalesce("component", "class").alias("component_id")), "named")
    unstage(short, near, groups, far)
    # a digest of at least 1 / HOT_CLASSES of the rows does not go through a shuffle:
    # there are at most HOT_CLASSES such digests, whatever the corpus
    often = F.col("copies") * HOT_CLASSES >= rows.count()
    hot = F.broadcast(named.where(often).select("digest", "component_id"))
    filled = rows.where("n > 0")
    found = filled.join(hot, "digest").unionByName(filled.join(hot.select("digest"), "digest", "left_anti").join(named.where(~often).select("digest", "component_id"), "digest"))
    empty = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return found.unionByName(empty).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stand for their component: those whose doc_id is its least
    (rows without a doc_id, or without words, stay). Rows that repeat both doc_id and text
    are one document: one of them stays. Rows that share an id but not a text stay or go
    together. All columns as they are, in their order."""
    spark = docs.sparkSession
    found = near_duplicates(docs, words, percent)
    gone = stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    row = F.xxhash64("doc_id", "text")
    again = docs.groupBy(row.alias("row")).agg(F.count("*").alias("n")).where("n > 1")
    # Only rows that two fixed-size bitmaps mark can go; the others need no join.
    shared = spark.sparkContext.broadcast(bitmap(gone.select(cell_of("__gone")).unionByName(again.select(cell_of("row")))))
    cells = docs.select("*", cell_of("doc_id", "__a"), cell_of(row, "__b"))
    stay = cells.mapInArrow(tidy(sift(shared, False, 2)), docs.schema)
    doubted = cells.mapInArrow(tidy(sift(shared, True, 2)), docs.schema).dropDuplicates(["doc_id", "text"])
    return stay.unionByName(doubted.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").select(*docs.columns))
