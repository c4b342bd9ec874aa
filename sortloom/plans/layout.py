"""How an external sort lays out work: stripes, chunks, merge passes, tree merges, cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import HEADER_BYTES, MIB
from .prefix import sum_before


def positions(records: DataFrame) -> DataFrame:
    """records (seq, len) with size and pos, the bytes before each. All columns are written
    on the way: select those that are wanted first."""
    return sum_before(records.withColumn("size", (F.lit(HEADER_BYTES) + F.col("len")).cast("long")), "seq", "size", "pos")


def stripe_of(pos: str, total: str, stripes: Column | int) -> Column:
    """The stripe of the record that begins at pos: stripe r begins at the first record
    at or after floor(total * r / stripes)."""
    p = stripes if isinstance(stripes, Column) else F.lit(stripes)
    p = p.cast("decimal(20,0)")
    parts = (F.col(pos).cast("decimal(20,0)") + 1) * p + F.col(total) - 1
    return F.least(p.cast("int") - 1, F.floor((parts - parts % F.col(total)) / F.col(total)).cast("int") - 1)


def with_stripes(records: DataFrame, stripes: int) -> DataFrame:
    placed = positions(records)
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"))
    return placed.join(F.broadcast(total)).withColumn("stripe", stripe_of("pos", "total", stripes))  # one row


def stripe_bounds(records: DataFrame, counts: list[int]) -> DataFrame:
    """For each number of stripes, the offsets where stripes begin, and the end."""
    spark = records.sparkSession
    placed = positions(records.select("seq", "len"))
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"))
    wanted = spark.createDataFrame([(p,) for p in counts], "stripes int").select("stripes", F.explode(F.sequence(F.lit(0), F.col("stripes"))).alias("r"))
    each = F.array(*[F.struct(F.lit(p).alias("stripes"), stripe_of("pos", "total", p).alias("stripe")) for p in counts])
    dealt = placed.join(F.broadcast(total)).select("pos", F.explode(each).alias("s")).groupBy("s.stripes", "s.stripe").agg(F.min("pos").alias("begins"))
    # an empty stripe begins where the next one that has records does, or at the end
    later = wanted.join(dealt, (wanted.stripes == dealt.stripes) & (dealt.stripe >= wanted.r), "left").groupBy(wanted.stripes, wanted.r).agg(F.min("begins").alias("begins"))
    return later.join(F.broadcast(total)).select("stripes", F.col("r").alias("boundary"), F.when(F.col("r") == 0, F.lit(0).cast("long")).otherwise(F.coalesce("begins", "total")).alias("offset"))


def packer(chunk: int):
    """A fold over sizes in order, by stripe: the run of each record. It takes a step for
    each run: within one, the running sum tells where the chunk is full."""
    state = {"stripe": None, "used": 0, "run": 0}

    def pack(stripe: int, sizes: np.ndarray) -> np.ndarray:
        if stripe != state["stripe"]:
            state.update(stripe=stripe, used=0, run=0)
        upto = np.concatenate(([0], np.cumsum(sizes)))
        runs, at = np.empty(len(sizes), np.int32), 0
        while at < len(sizes):
            end = int(np.searchsorted(upto, chunk - state["used"] + upto[at], side="right")) - 1
            if end <= at:
                if state["used"]:
                    state.update(used=0, run=state["run"] + 1)
                    continue
                end = at + 1  # a record larger than the chunk has one of its own
            runs[at:end] = state["run"]
            state["used"] += int(upto[end] - upto[at])
            at = end
        return runs

    return pack


def pack_chunks(records: DataFrame, chunk: int, stripes: int) -> DataFrame:
    """Greedy packing of each stripe's records into chunks: a record that would overfill
    the chunk begins the next. A fold over each stripe in file order; stripes in parallel,
    rows streaming, with a few numbers of state."""
    rows = with_stripes(records.select("seq", "key", "len"), stripes).select("stripe", "seq", "key", "size", "pos")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = packer(chunk)
        for batch in batches:
            stripe, size = batch.column("stripe").to_numpy(), batch.column("size").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(stripe[1:] != stripe[:-1]) + 1, [len(stripe)]))
            runs = [pack(int(stripe[a]), size[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.empty(0, np.int32), *runs]))], names=[*batch.schema.names, "run"])

    dealt = rows.repartition(max(1, stripes), "stripe").sortWithinPartitions("stripe", "seq")
    return dealt.mapInArrow(fold, "stripe int, seq long, key long, size long, pos long, run int")


def run_summary(packed: DataFrame) -> DataFrame:
    return packed.groupBy("stripe", "run").agg(F.count("*").alias("records"), F.sum("size").alias("bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


# ---------------------------------------------------------------- merging
def merge_levels(spark: SparkSession, runs: list[int], fan: int) -> DataFrame:
    """runs, pass, and how many runs go in and come out, until one is left."""
    base = spark.createDataFrame([(r,) for r in runs], "runs int")
    # levels by integer division, as a pass deals them
    levels = F.expr(f"aggregate(sequence(1, 40), array(named_struct('pass', 0, 'runs_in', 0L, 'runs_out', cast(runs as bigint))), (a, i) -> if(element_at(a, -1).runs_out > 1, concat(a, array(named_struct('pass', i, 'runs_in', element_at(a, -1).runs_out, 'runs_out', (element_at(a, -1).runs_out + {fan - 1}) div {fan}))), a))")
    return base.select("runs", F.explode(F.slice(levels, 2, 40)).alias("l")).select("runs", F.col("l.pass").alias("pass"), F.col("l.runs_in").cast("int").alias("runs_in"), F.col("l.runs_out").cast("int").alias("runs_out"))


def merge_groups(spark: SparkSession, runs: list[int], fan: int) -> DataFrame:
    """Each pass's groups: contiguous runs, the last group maybe smaller."""
    levels = merge_levels(spark, runs, fan)
    return levels.select("*", F.explode(F.sequence(F.lit(0), F.col("runs_out") - 1)).alias("grp")).select(
        "runs", "pass", "grp", (F.col("grp") * fan).alias("first_run"), F.least((F.col("grp") + 1) * fan, F.col("runs_in")).alias("end_run"),
        F.when(F.col("runs_out") == 1, F.lit("output")).otherwise(F.format_string("run_p%d_%d.bin", "pass", "grp")).alias("writes"),
    )


def merge_pass_counts(spark: SparkSession, runs: list[int], fan: int) -> DataFrame:
    base = spark.createDataFrame([(r,) for r in runs], "runs int")
    return base.join(merge_levels(spark, runs, fan).groupBy("runs").agg(F.count("*").alias("n")), "runs", "left").select("runs", F.coalesce("n", F.lit(0)).cast("int").alias("passes"))


def tree_schedule(spark: SparkSession, ranks: list[int]) -> DataFrame:
    """Binary-tree reduction of P ranks: at step s = 1, 2, 4, ... rank r with
    r mod 2s = s sends to r - s."""
    base = spark.createDataFrame([(p,) for p in ranks], "ranks int")
    steps = base.select("ranks", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("k")).select("ranks", F.expr("shiftleft(1, k)").alias("step")).where("step < ranks")
    return steps.select("ranks", "step", F.explode(F.expr("sequence(step, ranks - 1, 2 * step)")).alias("sender")).withColumn("receiver", F.col("sender") - F.col("step"))


def worker_budget(fan: Column, threads: Column) -> Column:
    """Concurrent merges that half the threads and 512 open files allow."""
    return F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), F.floor(threads / 2).cast("int")), F.floor(F.lit(512) / (fan + 1)).cast("int"))).cast("int")


def probe_records(chunk: Column, probes: Column, payload_max: Column) -> Column:
    """Records that fill so many chunks, payloads being of middling length."""
    return F.floor(chunk * MIB * probes / (F.lit(HEADER_BYTES) + F.floor((F.lit(8) + payload_max) / 2))).cast("long")


def cost_model(df: DataFrame) -> DataFrame:
    """Passes and bytes moved of an external sort of total_bytes with chunk_bytes and fan:
    one pass that makes runs and one for each merge level, each reading and writing all."""
    runs = F.ceil(F.col("total_bytes") / F.col("chunk_bytes")).cast("long")
    df = df.withColumn("runs", runs)
    levels = F.expr("aggregate(sequence(1, 40), named_struct('r', runs, 'n', 0), (a, i) -> if(a.r > 1, named_struct('r', (a.r + fan - 1) div fan, 'n', a.n + 1), a), a -> a.n)")
    return df.withColumn("merge_passes", levels).withColumn("bytes_read", (F.col("total_bytes") * (1 + F.col("merge_passes"))).cast("long")).withColumn("bytes_written", F.col("bytes_read"))
