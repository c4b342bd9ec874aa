"""The catalogue: each query as a DataFrame, and the SQL that any engine should agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.records import adapt, g9, in_contract, parent_of, record_size, safe_file_name
from .operators import sorting, trials, verify
from .plans import layout
from .plans.prefix import rank_by, sum_before
from .plans.staged import checkpointed, shared_root
from .sources import kvrec, logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RUNS, FAN, STRIPES, CHUNK = [1, 8, 9, 36, 64, 65, 144], 8, 4, 4096


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark, sf):
    return adapt(_table(spark, sf, "documents"), "doc_id", F.coalesce("text", F.lit("")), "doc_id")


def orders(spark, sf):
    return adapt(_table(spark, sf, "orders"), "o_orderkey", F.rpad("o_orderpriority", F.greatest(F.lit(8), F.length("o_orderpriority")), " "), "o_orderkey")


def events(spark, sf):
    return adapt(_table(spark, sf, "events"), "user_id", F.col("props"), "event_id")


_DOCS = "SELECT doc_id AS key, CAST(strlen(coalesce(text, '')) AS INT) AS len, coalesce(text, '') AS payload, doc_id AS seq FROM documents"
_ORDERS = "SELECT o_orderkey AS key, CAST(greatest(8, strlen(o_orderpriority)) AS INT) AS len, rpad(o_orderpriority, greatest(8, length(o_orderpriority))::INT, ' ') AS payload, o_orderkey AS seq FROM orders"
_EVENTS = "SELECT user_id AS key, CAST(strlen(props) AS INT) AS len, props AS payload, event_id AS seq FROM events"


def _placed(rec: str) -> str:
    return f"(SELECT *, CAST(12 + len AS BIGINT) AS size, CAST(sum(12 + len) OVER (ORDER BY seq) - (12 + len) AS BIGINT) AS pos, CAST(sum(12 + len) OVER () AS BIGINT) AS total FROM ({rec}))"


def _striped(rec: str, p: int) -> str:
    return f"(SELECT *, CAST(least({p} - 1, ((pos + 1) * {p} + total - 1) // total - 1) AS INT) AS stripe FROM {_placed(rec)})"


# ---------------------------------------------------------------- scans and contract
@query(f"SELECT key, len, 12 + len AS size FROM ({_DOCS})")
def record_scan(spark, sf):
    return documents(spark, sf).select("key", "len", record_size().cast("int").alias("size"))


@query(f"SELECT key, len FROM ({_DOCS}) WHERE len BETWEEN 8 AND 4096")
def len_contract_accept(spark, sf):
    return documents(spark, sf).where(in_contract()).select("key", "len")


@query(f"SELECT key, len FROM ({_DOCS}) WHERE NOT len BETWEEN 8 AND 4096")
def len_contract_reject(spark, sf):
    return documents(spark, sf).where(~in_contract()).select("key", "len")


@query(f"SELECT key, len, pos FROM {_striped(_DOCS, 4)} WHERE stripe = 1")
def range_scan(spark, sf):
    return layout.with_stripes(documents(spark, sf).drop("payload"), 4).where("stripe = 1").select("key", "len", "pos")


# ---------------------------------------------------------------- sorts
@query(f"SELECT key, len, rank() OVER (ORDER BY key) AS rank FROM ({_ORDERS})")
def global_sort_rank(spark, sf):
    # rows come out in order of key: range partitions, each sorted
    return rank_by(orders(spark, sf).select("key", "len", "seq"), "key").select("key", "len", "rank")


@query(f"SELECT key, count(*) AS n, min(r) AS min_rank FROM (SELECT key, rank() OVER (ORDER BY key) AS r FROM ({_EVENTS})) GROUP BY key")
def global_sort_ties(spark, sf):
    counts = events(spark, sf).groupBy("key").agg(F.count("*").alias("n"))
    return sum_before(counts, "key", "n", "lower").select("key", "n", (F.col("lower") + 1).alias("min_rank"))


_SORTED = f"SELECT key, rank() OVER (ORDER BY key) AS rank FROM ({_ORDERS})"


@query(_SORTED)
def sort_sorted_input(spark, sf):
    return rank_by(orders(spark, sf).sortWithinPartitions("key").select("key", "seq"), "key").select("key", "rank")


@query(_SORTED)
def sort_desc_input(spark, sf):
    return rank_by(orders(spark, sf).sortWithinPartitions(F.desc("key")).select("key", "seq"), "key").select("key", "rank")


@query(f"SELECT key, seq FROM ({_EVENTS}) ORDER BY key, seq LIMIT 10")
def top10_keys(spark, sf):
    return sorting.top_keys(events(spark, sf).select("key", "seq"), 10, "key", "seq")


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS overlaps FROM lineitem")
def range_partition_bounds(spark, sf):
    return sorting.range_overlaps(_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), 8)


# ---------------------------------------------------------------- stripes and chunks
@query(f"SELECT key, pos, stripe FROM {_striped(_DOCS, STRIPES)}")
def stripe_assignment(spark, sf):
    return layout.with_stripes(documents(spark, sf).drop("payload"), STRIPES).select("key", "pos", "stripe")


@query(
    "SELECT stripes, boundary, offset_ AS \"offset\" FROM ("
    + " UNION ALL ".join(
        f"SELECT CAST({p} AS INT) AS stripes, CAST(r AS INT) AS boundary, CAST(CASE WHEN r = 0 THEN 0 ELSE coalesce((SELECT min(pos) FROM {_placed(_DOCS)} WHERE pos >= total * r // {p}), (SELECT sum(12 + len) FROM ({_DOCS}))) END AS BIGINT) AS offset_ FROM range({p + 1}) t(r)"
        for p in (1, 3, 4, 8)
    )
    + ")"
)
def stripe_boundaries(spark, sf):
    return layout.stripe_bounds(documents(spark, sf), [1, 3, 4, 8])


@query(f"SELECT stripe, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM {_striped(_DOCS, STRIPES)} GROUP BY stripe")
def stripe_sizes(spark, sf):
    return layout.with_stripes(documents(spark, sf).drop("payload"), STRIPES).groupBy("stripe").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"))


_PACKED = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stripe ORDER BY seq) AS i FROM {_striped(_EVENTS, STRIPES)}),
f(stripe, i, used, run) AS (
  SELECT stripe, i, size, CAST(0 AS INT) FROM s WHERE i = 1
  UNION ALL
  SELECT s.stripe, s.i, CASE WHEN f.used + s.size > {CHUNK} THEN s.size ELSE f.used + s.size END, CASE WHEN f.used + s.size > {CHUNK} THEN f.run + 1 ELSE f.run END
  FROM f JOIN s ON s.stripe = f.stripe AND s.i = f.i + 1)
"""


def _packed(spark, sf):
    return layout.pack_chunks(events(spark, sf), CHUNK, STRIPES)


@query(_PACKED + "SELECT s.seq, s.stripe, f.run FROM f JOIN s USING (stripe, i)")
def chunk_assignment(spark, sf):
    return _packed(spark, sf).select("seq", "stripe", "run")


@query(_PACKED + "SELECT stripe, run, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes, min(key) AS min_key, max(key) AS max_key FROM f JOIN s USING (stripe, i) GROUP BY stripe, run")
def run_summary(spark, sf):
    return layout.run_summary(_packed(spark, sf))


@query(_PACKED + "SELECT stripe, run, seq, key, rank() OVER (PARTITION BY stripe, run ORDER BY key) AS rank FROM f JOIN s USING (stripe, i)")
def run_local_sort(spark, sf):
    from pyspark.sql import Window

    return sorting.local_sort(_packed(spark, sf), ["stripe", "run"]).select("stripe", "run", "seq", "key", F.rank().over(Window.partitionBy("stripe", "run").orderBy("key")).cast("long").alias("rank"))


@query(_PACKED + "SELECT count(*) AS n_runs FROM (SELECT DISTINCT stripe, run FROM f)")
def run_count_total(spark, sf):
    return _packed(spark, sf).groupBy("stripe").agg((F.max("run") + 1).alias("n")).agg(F.sum("n").alias("n_runs"))


@query(_PACKED + "SELECT s.stripe, f.run, s.seq, s.key, rank() OVER (ORDER BY s.key) AS rank FROM f JOIN s USING (stripe, i)")
def kway_merge(spark, sf):
    """Sorted runs, written, then merged: each record with its run and its rank in the
    merged order, which any tree of merges gives. The merge is one range shuffle of the
    union of all runs; rows come out in its order."""
    runs = checkpointed(sorting.local_sort(_packed(spark, sf), ["stripe", "run"])).select("stripe", "run", "seq", "key")
    return rank_by(runs, "key")


# ---------------------------------------------------------------- merge planning
_LEVELS = f"""WITH RECURSIVE l(runs, pass, runs_in, runs_out) AS (
  SELECT CAST(r AS INT), CAST(1 AS INT), CAST(r AS INT), CAST((r + {FAN - 1}) // {FAN} AS INT) FROM (VALUES {', '.join(f'({r})' for r in RUNS)}) t(r) WHERE r > 1
  UNION ALL
  SELECT runs, pass + 1, runs_out, CAST((runs_out + {FAN - 1}) // {FAN} AS INT) FROM l WHERE runs_out > 1)
"""


@query(_LEVELS + f"SELECT runs, pass, CAST(g AS INT) AS grp, CAST(g * {FAN} AS INT) AS first_run, CAST(least((g + 1) * {FAN}, runs_in) AS INT) AS end_run, CASE WHEN runs_out = 1 THEN 'output' ELSE 'run_p' || pass || '_' || g || '.bin' END AS writes FROM l, LATERAL (SELECT unnest(range(runs_out)) AS g)")
def merge_groups(spark, sf):
    return layout.merge_groups(spark, RUNS, FAN)


@query(_LEVELS + f"SELECT CAST(r AS INT) AS runs, CAST((SELECT count(*) FROM l WHERE l.runs = r) AS INT) AS passes FROM (VALUES {', '.join(f'({r})' for r in RUNS)}) t(r)")
def merge_pass_count(spark, sf):
    return layout.merge_pass_counts(spark, RUNS, FAN)


@query(_LEVELS + "SELECT runs, pass, runs_in, runs_out, pass > 1 AS deletes_sources FROM l")
def merge_plan_trace(spark, sf):
    return layout.merge_levels(spark, RUNS, FAN).withColumn("deletes_sources", F.col("pass") > 1)


@query("SELECT CAST(p AS INT) AS ranks, CAST(s AS INT) AS step, CAST(r AS INT) AS sender, CAST(r - s AS INT) AS receiver FROM (VALUES (1), (2), (3), (5), (8)) a(p), (VALUES (1), (2), (4), (8)) b(s), range(8) c(r) WHERE s < p AND r < p AND r % (2 * s) = s")
def tree_merge_schedule(spark, sf):
    return layout.tree_schedule(spark, [1, 2, 3, 5, 8])


@query("SELECT CAST(fan AS INT) AS fan, CAST(threads AS INT) AS threads, CAST(greatest(1, least(greatest(1, threads // 2), 512 // (fan + 1))) AS INT) AS workers FROM (VALUES (2), (8), (32), (64)) a(fan), (VALUES (1), (4), (16), (32), (400)) b(threads)")
def merge_worker_budget(spark, sf):
    grid = spark.createDataFrame([(f, t) for f in (2, 8, 32, 64) for t in (1, 4, 16, 32, 400)], "fan int, threads int")
    return grid.withColumn("workers", layout.worker_budget(F.col("fan"), F.col("threads")))


@query("SELECT CAST(c AS INT) AS chunk_mb, CAST(k AS INT) AS probes, CAST(p AS INT) AS payload_max, CAST((c::BIGINT * 1048576 * k) // (12 + (8 + p) // 2) AS BIGINT) AS records FROM (VALUES (16, 8, 64), (64, 8, 64), (64, 4, 512), (256, 8, 2048)) t(c, k, p)")
def weak_probe_size(spark, sf):
    df = spark.createDataFrame([(16, 8, 64), (64, 8, 64), (64, 4, 512), (256, 8, 2048)], "chunk_mb int, probes int, payload_max int")
    return df.withColumn("records", layout.probe_records(F.col("chunk_mb").cast("long"), F.col("probes"), F.col("payload_max")))


@query("SELECT CAST(n AS INT) AS nodes, CAST(t AS INT) AS threads, CAST(n * 1 AS INT) AS ranks, CAST(n * t AS INT) AS total_cores, CASE WHEN t > 1 THEN 'omp' ELSE 'serial' END AS local_merge, CASE WHEN n * t > 64 THEN 'NA' ELSE CAST(n * t AS VARCHAR) END AS runs_text FROM (VALUES (1), (2), (4), (8)) a(n), (VALUES (1), (4), (16), (32)) b(t)")
def sweep_matrix(spark, sf):
    df = spark.createDataFrame([(n, t) for n in (1, 2, 4, 8) for t in (1, 4, 16, 32)], "nodes int, threads int")
    cores = F.col("nodes") * F.col("threads")
    runs = F.when(cores > 64, 0).otherwise(cores)  # a run count of 0 is shown as NA
    return df.select("nodes", "threads", F.col("nodes").alias("ranks"), cores.alias("total_cores"), F.when(F.col("threads") > 1, "omp").otherwise("serial").alias("local_merge"), F.when(runs == 0, "NA").otherwise(runs.cast("string")).alias("runs_text"))


@query("""WITH RECURSIVE c(total_bytes, chunk_bytes, fan) AS (VALUES (2400000000, 67108864, 8), (9600279582, 67108864, 8), (536860963, 67108864, 8), (536883325, 67108864, 8), (1000, 67108864, 8)),
l AS (SELECT *, (total_bytes + chunk_bytes - 1) // chunk_bytes AS runs, (total_bytes + chunk_bytes - 1) // chunk_bytes AS r, 0 AS n FROM c UNION ALL SELECT total_bytes, chunk_bytes, fan, runs, (r + fan - 1) // fan, n + 1 FROM l WHERE r > 1)
SELECT CAST(total_bytes AS BIGINT) AS total_bytes, CAST(chunk_bytes AS BIGINT) AS chunk_bytes, CAST(fan AS INT) AS fan, CAST(runs AS BIGINT) AS runs, CAST(max(n) AS INT) AS merge_passes, CAST(total_bytes * (1 + max(n)) AS BIGINT) AS bytes_read, CAST(total_bytes * (1 + max(n)) AS BIGINT) AS bytes_written FROM l GROUP BY total_bytes, chunk_bytes, fan, runs""")
def cost_model(spark, sf):
    rows = [(t, 67108864, 8) for t in (2400000000, 9600279582, 536860963, 536883325, 1000)]
    return layout.cost_model(spark.createDataFrame(rows, "total_bytes long, chunk_bytes long, fan int"))


# ---------------------------------------------------------------- verification
@query(f"SELECT count(*) AS records, CAST(coalesce(sum(12 + len), 0) AS BIGINT) AS bytes, CAST(coalesce(min(key), 0) AS BIGINT) AS min_key, CAST(coalesce(max(key), 0) AS BIGINT) AS max_key FROM ({_DOCS})")
def file_stats(spark, sf):
    return verify.file_stats(documents(spark, sf))


@query(f"SELECT count(*) AS records, CAST(coalesce(sum(12 + len), 0) AS BIGINT) AS bytes, CAST(coalesce(min(key), 0) AS BIGINT) AS min_key, CAST(coalesce(max(key), 0) AS BIGINT) AS max_key FROM ({_DOCS}) WHERE key < 0")
def file_stats_empty(spark, sf):
    return verify.file_stats(documents(spark, sf).where("key < 0"))


_ERRORS = f"(SELECT seq, key, previous_key FROM (SELECT seq, key, lag(key) OVER (ORDER BY seq) AS previous_key FROM ({_EVENTS})) WHERE previous_key > key)"


@query(f"SELECT count(*) AS order_errors FROM {_ERRORS}")
def order_error_count(spark, sf):
    return verify.order_errors(events(spark, sf)).agg(F.count("*").alias("order_errors"))


@query(f"SELECT seq, key, previous_key FROM {_ERRORS} ORDER BY seq LIMIT 10")
def order_errors_first10(spark, sf):
    return verify.order_errors(events(spark, sf)).select("seq", "key", "previous_key").orderBy("seq").limit(10)


@query(f"SELECT count(*) AS records, CAST(sum(12 + len) AS BIGINT) AS bytes, CAST(sum(CAST(h AS HUGEINT)) % 1000000000000000003 AS BIGINT) AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT len, CAST('0x' || substr(md5(CAST(key AS VARCHAR) || '|' || payload), 1, 15) AS BIGINT) AS h FROM ({_DOCS}))")
def multiset_fingerprint(spark, sf):
    return verify.fingerprint(documents(spark, sf))


@query("SELECT true AS equal")
def permutation_check(spark, sf):
    rec = documents(spark, sf)
    return verify.same_multiset(rec, sorting.range_sort(rec, 8))


@query("SELECT false AS equal")
def permutation_check_negative(spark, sf):
    rec = documents(spark, sf)
    altered = rec.join(F.broadcast(rec.agg(F.max("key").alias("last")))).withColumn("payload", F.when(F.col("key") == F.col("last"), F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))).drop("last")
    return verify.same_multiset(rec, altered)


_BYTE = "CAST(('0x' || substr(h, 2 * i - 1, 2)) AS HUGEINT)"
_LE = lambda x, n: f"array_to_string(list_transform(range({n}), lambda k: printf('%02x', ({x} >> (8 * k)) & 255)), '')"
_FNV = f"""(SELECT len, list_reduce(list_prepend(CAST({0xCBF29CE484222325} AS HUGEINT), list_transform(range(1, length(h) // 2 + 1), lambda i: {_BYTE})),
lambda a, b: CAST(xor(CAST(a AS HUGEINT), CAST(b AS HUGEINT)) * {0x100000001B3} % 18446744073709551616 AS HUGEINT)) AS u FROM (SELECT len, {_LE('key', 8)} || {_LE('len', 4)} || lower(hex(encode(payload))) AS h FROM ({_DOCS})))"""


@query(f"SELECT count(*) AS records, CAST(sum(12 + len) AS BIGINT) AS bytes, CAST(sum(u) % 18446744073709551616 AS VARCHAR) AS hash_sum, bit_xor(CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT)) AS hash_xor FROM {_FNV}")
def fnv_fingerprint(spark, sf):
    return verify.fnv_fingerprint(documents(spark, sf))


# ---------------------------------------------------------------- analytics
_TRIALS = "(SELECT event_type AS impl, CAST(1 << CAST(user_id % 4 AS INT) AS INT) AS threads, event_id AS trial, CASE WHEN event_id % 97 = 0 THEN CAST('nan' AS DOUBLE) ELSE round(value, 6) + 1 END AS total_s, round(value, 6) / 2 AS sort_s, CASE WHEN event_id % 5 = 0 THEN CAST('nan' AS DOUBLE) ELSE round(value, 6) / 2 + 1 END AS merge_s FROM events)"


def _trials(spark, sf):
    e = _table(spark, sf, "events")
    nan = F.lit(float("nan"))
    v = F.round("value", 6)
    return e.select(F.col("event_type").alias("impl"), F.expr("shiftleft(1, cast(user_id % 4 as int))").alias("threads"), F.col("event_id").alias("trial"), F.when(F.expr("event_id % 97 = 0"), nan).otherwise(v + 1).alias("total_s"), (v / 2).alias("sort_s"), F.when(F.expr("event_id % 5 = 0"), nan).otherwise(v / 2 + 1).alias("merge_s"))


_SUMMARY = f"""(SELECT impl, threads, count(*) AS trials, avg(total_s) AS avg_total_s, min(total_s) AS min_total_s, max(total_s) AS max_total_s, coalesce(stddev_samp(total_s), 0) AS stdev_total_s, coalesce(avg(sort_s) FILTER (isfinite(sort_s)), CAST('nan' AS DOUBLE)) AS avg_sort_s, coalesce(avg(merge_s) FILTER (isfinite(merge_s)), CAST('nan' AS DOUBLE)) AS avg_merge_s
FROM (SELECT *, row_number() OVER (PARTITION BY impl, threads ORDER BY total_s DESC, trial) AS rn, count(*) OVER (PARTITION BY impl, threads) AS n FROM {_TRIALS} WHERE isfinite(total_s)) WHERE rn > 1 OR n < 3 GROUP BY impl, threads)"""


def _summary(spark, sf):
    return trials.summarize(_trials(spark, sf), ["impl", "threads"]).withColumn("threads", F.col("threads").cast("int"))


@query(f"SELECT impl, threads, trials, round(avg_total_s, 5) AS avg_total_s, round(min_total_s, 5) AS min_total_s, round(max_total_s, 5) AS max_total_s, round(stdev_total_s, 5) AS stdev_total_s, round(avg_sort_s, 5) AS avg_sort_s, round(avg_merge_s, 5) AS avg_merge_s FROM {_SUMMARY}")
def trial_summary(spark, sf):
    return _summary(spark, sf).select("impl", "threads", "trials", *[F.round(c, 5).alias(c) for c in ("avg_total_s", "min_total_s", "max_total_s", "stdev_total_s", "avg_sort_s", "avg_merge_s")])


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN isfinite({a}) AND isfinite({b}) AND {a} > 0 AND {b} > 0 THEN {a} / {b} ELSE CAST('nan' AS DOUBLE) END"


def _scaled(prefix: str, scale: str) -> str:
    """SQL of speedups, efficiencies and aliases of the phases of s against b."""
    out = []
    for phase, alias in (("total", "total"), ("sort", "phase1"), ("merge", "phase2")):
        name = prefix if phase == "total" else f"{prefix}{phase}_"
        speedup = _ratio(f"b.avg_{phase}_s", f"s.avg_{phase}_s")
        for column in (f"{name}speedup", f"{alias}_speedup"):
            out.append(f"round({speedup}, 5) AS {column}")
        for column in (f"{name}efficiency", f"{alias}_efficiency"):
            out.append(f"round({speedup} / {scale}, 5) AS {column}")
    return ", ".join(out)


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.round(c, 5).alias(c) for c, t in df.dtypes if t == "double" and c not in keys and not c.startswith(("avg_", "min_", "max_", "stdev_"))])


_BASE = ", ".join(f"round(coalesce(b.avg_{p}_s, CAST('nan' AS DOUBLE)), 5) AS baseline_{p}_s" for p in ("total", "sort", "merge"))


@query(f"SELECT s.impl, s.threads, {_BASE}, {_scaled('', 's.threads')} FROM {_SUMMARY} s LEFT JOIN {_SUMMARY} b ON b.impl = s.impl AND b.threads = 1")
def baseline_speedup(spark, sf):
    return _rounded(trials.thread_speedup(_summary(spark, sf), ["impl"]), "impl", "threads")


# One summary in four has no finite total, so that some baselines are not those of fewest nodes.
_NODES = f"(SELECT impl, threads AS nodes, CASE WHEN length(impl) % 2 = 0 AND threads = 1 THEN CAST('nan' AS DOUBLE) ELSE avg_total_s END AS avg_total_s, avg_sort_s, avg_merge_s FROM {_SUMMARY})"


def _nodes(spark, sf):
    total = F.when(F.expr("length(impl) % 2 = 0 and threads = 1"), F.lit(float("nan"))).otherwise(F.col("avg_total_s"))
    return _summary(spark, sf).select("impl", F.col("threads").alias("nodes"), total.alias("avg_total_s"), "avg_sort_s", "avg_merge_s")


@query(f"WITH n AS {_NODES}, b AS (SELECT * FROM n WHERE isfinite(avg_total_s) QUALIFY row_number() OVER (PARTITION BY impl ORDER BY nodes) = 1) SELECT s.impl, s.nodes, b.nodes AS baseline_nodes, {_scaled('strong_', '(s.nodes / b.nodes)')} FROM n s JOIN b ON b.impl = s.impl")
def strong_speedup(spark, sf):
    return _rounded(trials.node_speedup(_nodes(spark, sf), ["impl"]), "impl", "nodes", "baseline_nodes")


_CAP = f"""(SELECT *, total_gib / nodes AS gib_per_node, throughput_gib_s / nodes AS throughput_gib_node_s, throughput_gib_s * 180 AS capacity_total_gib, throughput_gib_s * 180 / nodes AS capacity_gib_per_node FROM (SELECT *, CAST(nodes * 0.5 AS DOUBLE) AS total_gib, CASE WHEN isfinite(avg_total_s) THEN nodes * 0.5 / avg_total_s ELSE CAST('nan' AS DOUBLE) END AS throughput_gib_s FROM {_NODES}))"""
_CAP_COLUMNS = ("total_gib", "gib_per_node", "throughput_gib_s", "throughput_gib_node_s", "capacity_total_gib", "capacity_gib_per_node")


@query(f"SELECT impl, nodes, {', '.join(f'round({c}, 5) AS {c}' for c in _CAP_COLUMNS)} FROM {_CAP}")
def weak_capacity(spark, sf):
    out = _capacity(spark, sf)
    return out.select("impl", "nodes", *[F.round(c, 5).alias(c) for c in _CAP_COLUMNS])


def _capacity(spark, sf):
    n = _nodes(spark, sf)
    return trials.capacity(n.select("*", F.col("avg_total_s").alias("total_s"), (F.col("nodes").cast("long") * 536870912).alias("input_bytes"), F.lit(180.0).alias("time_budget_s")))


_WEAK_SCALE, _WEAK_EFFICIENCY = _ratio("s.capacity_total_gib", "b.capacity_total_gib"), _ratio("s.capacity_gib_per_node", "b.capacity_gib_per_node")
_WEAK = _scaled("weak_", "1").replace(" AS total_speedup", " AS weak_total_speedup").replace(" AS total_efficiency", " AS weak_total_efficiency")


@query(f"""WITH n AS {_CAP}, b AS (SELECT * FROM n WHERE isfinite(avg_total_s) OR isfinite(capacity_total_gib) QUALIFY row_number() OVER (PARTITION BY impl ORDER BY nodes) = 1),
w AS (SELECT s.impl, s.nodes, b.nodes AS baseline_nodes, round({_WEAK_SCALE}, 5) AS weak_capacity_scale, round({_WEAK_EFFICIENCY}, 5) AS weak_capacity_efficiency,
round(CASE WHEN isfinite({_WEAK_SCALE}) THEN b.capacity_total_gib ELSE CAST('nan' AS DOUBLE) END, 5) AS baseline_capacity_total_gib, round(CASE WHEN isfinite({_WEAK_EFFICIENCY}) THEN b.capacity_gib_per_node ELSE CAST('nan' AS DOUBLE) END, 5) AS baseline_capacity_gib_per_node, {_WEAK} FROM n s JOIN b ON b.impl = s.impl)
SELECT * EXCLUDE (weak_total_speedup, weak_total_efficiency), CASE WHEN isfinite(weak_capacity_scale) AND isfinite(weak_capacity_efficiency) THEN weak_capacity_scale ELSE weak_total_speedup END AS total_speedup, CASE WHEN isfinite(weak_capacity_scale) AND isfinite(weak_capacity_efficiency) THEN weak_capacity_efficiency ELSE weak_total_efficiency END AS total_efficiency FROM w""")
def weak_speedup(spark, sf):
    df = _capacity(spark, sf).select("impl", "nodes", "avg_total_s", "avg_sort_s", "avg_merge_s", F.col("capacity_total_gib").alias("avg_capacity_total_gib"), F.col("capacity_gib_per_node").alias("avg_capacity_gib_per_node"))
    return _rounded(trials.weak_efficiency(df, ["impl"]), "impl", "nodes", "baseline_nodes")


@query("SELECT event_type AS impl, CAST(arg_min(1 << CAST(user_id % 4 AS INT), o) AS INT) AS merge_fan, CAST(arg_min(user_id // 4, o) AS INT) AS chunk_mb, min(value) AS total_s FROM (SELECT *, (value, 1 << CAST(user_id % 4 AS INT), user_id // 4) AS o FROM events) GROUP BY event_type")
def grid_search_best(spark, sf):
    e = _table(spark, sf, "events").select(F.col("event_type").alias("impl"), F.expr("shiftleft(1, cast(user_id % 4 as int))").alias("merge_fan"), F.expr("cast(user_id div 4 as int)").alias("chunk_mb"), F.col("value").alias("total_s"))
    return trials.grid_best(e, ["impl"])


# ---------------------------------------------------------------- strings and logs
@query("SELECT split_part(s, ':', 1) AS case_name, CAST(split_part(s, ':', 2) AS BIGINT) AS records, CAST(split_part(s, ':', 3) AS INT) AS payload_max, 'data/' || split_part(s, ':', 1) || '_' || split_part(s, ':', 2) || '_p' || split_part(s, ':', 3) || '.bin' AS path, 'data' AS folder, regexp_replace(s, '[^A-Za-z0-9._-]', '_', 'g') AS safe_name FROM (VALUES ('check:1000000:64'), ('manySmall50M:50000000:64'), ('largePayload2M:2000000:2048')) t(s)")
def case_spec_parse(spark, sf):
    specs = spark.createDataFrame([("check:1000000:64",), ("manySmall50M:50000000:64",), ("largePayload2M:2000000:2048",)], "s string")
    part = F.split("s", ":")
    path = F.format_string("data/%s_%s_p%s.bin", part[0], part[1], part[2])
    return specs.select(part[0].alias("case_name"), part[1].cast("long").alias("records"), part[2].cast("int").alias("payload_max"), path.alias("path"), parent_of(path).alias("folder"), safe_file_name(F.col("s")).alias("safe_name"))


_LOG = [("a", 0, "Fase 1 : sort 36 run generati in 14.5696 s"), ("a", 1, "Fase 2 : merge 20.1973 s"), ("a", 2, "Totale : 34.7669 s"), ("b", 0, "Fase 1 : sort 4.5 s"), ("b", 1, "Fase 1 : 144 run in 99.25 s"), ("c", 0, "nothing here")]
_LOG_SQL = "(VALUES " + ", ".join(f"('{f}', {i}, '{t}')" for f, i, t in _LOG) + ") t(file, line_id, line)"


def _lines(spark):
    return spark.createDataFrame(_LOG, "file string, line_id int, line string")


@query(f"SELECT file, coalesce(CAST(regexp_extract(arg_max(line, line_id) FILTER (contains(line, 'Fase 1')), '.*\\s([0-9.]+)(\\s|$)', 1) AS DOUBLE), CAST('nan' AS DOUBLE)) AS sort_s FROM {_LOG_SQL} GROUP BY file")
def log_phase_seconds(spark, sf):
    return logs.phase_seconds(_lines(spark), "Fase 1", "sort_s")


@query(f"SELECT file, coalesce(CAST(regexp_extract(arg_max(line, line_id) FILTER (contains(line, 'Fase 1') AND regexp_matches(line, '\\d+ run(\\s|$)')), '(\\d+) run(\\s|$)', 1) AS INT), 0) AS generated_runs FROM {_LOG_SQL} GROUP BY file")
def log_generated_runs(spark, sf):
    return logs.generated_runs(_lines(spark))


@query("SELECT format('{:.9g}', x) AS shown FROM (VALUES (34.7669), (1.311e-06), (0.0001), (1234567890.0), (20.197312345678), (100.0)) t(x)")
def number_rendering(spark, sf):
    return spark.createDataFrame([(34.7669,), (1.311e-06,), (0.0001,), (1234567890.0,), (20.197312345678,), (100.0,)], "x double").select(g9(F.col("x")).alias("shown"))


# ---------------------------------------------------------------- files and generator
@query(f"SELECT count(*) AS records, CAST(sum(12 + len) AS BIGINT) AS bytes, CAST(sum(CAST(h AS HUGEINT)) % 1000000000000000003 AS BIGINT) AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT len, CAST('0x' || substr(md5(CAST(key AS VARCHAR) || '|' || payload), 1, 15) AS BIGINT) AS h FROM ({_ORDERS}))")
def binary_roundtrip(spark, sf):
    """Written sorted as binary parts in the shared folder, read back by four aligned splits
    of each."""
    kvrec.register(spark)
    path = f"{shared_root(spark)}/orders-{uuid.uuid4().hex}"
    records = kvrec.to_records(orders(spark, sf))
    sorting.range_sort(records, spark.sparkContext.defaultParallelism, "sort_key").write.format("kvrec").mode("overwrite").save(path)
    back = spark.read.format("kvrec").option("partitions", "4").load(path)
    return verify.fingerprint(back.select(F.conv(F.hex("key"), 16, 10).cast("long").alias("key"), "len", F.col("payload").cast("string").alias("payload")))


@query("SELECT kind, CAST(20000 AS BIGINT) AS records, true AS in_bounds, true AS keys_distinct FROM (VALUES ('random'), ('sorted'), ('reverse')) t(kind)")
def generator_profile(spark, sf):
    out = None
    for kind in ("random", "sorted", "reverse"):
        df = kvrec.generate(spark, 20_000, 8, 64, 42, kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("records"), ((F.min("len") == 8) & (F.max("len") == 64)).alias("in_bounds"), (F.countDistinct("key") == 20_000).alias("keys_distinct"))
        out = df if out is None else out.unionByName(df)
    return out


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return global_sort_rank(spark, sf)
