"""Benchmark analytics: trial summaries, baselines, speedups, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import finite

NAN = float("nan")


#: Means that a summary has where the trials have the measure.
METRICS = ("input_bytes", "total_gib", "gib_per_node", "time_budget_s", "capacity_total_gib", "capacity_gib_per_node", "throughput_gib_s", "throughput_gib_node_s")


def summarize(trials: DataFrame, keys: list[str], phases: tuple[str, ...] = ("sort_s", "merge_s"), drop_worst: bool = True) -> DataFrame:
    """Per group of keys (a missing one is ''): the slowest of three or more trials is
    dropped, then count, mean, least, greatest, sample deviation (0 for one) of total_s,
    means of the phases over finite values (NaN without any), and of those METRICS that the
    trials have (null without any finite value)."""
    metrics = [m for m in METRICS if m in trials.columns]
    have = set(trials.columns)
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) if k in have else F.lit("").alias(k) for k in keys]
    rows = trials.select(*named, "trial", "total_s", *phases, *metrics).where(finite(F.col("total_s")))
    worst = Window.partitionBy(*keys).orderBy(F.col("total_s").desc(), "trial")
    ranked = rows.withColumn("rn", F.row_number().over(worst)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    kept = ranked.where("rn > 1 or n < 3") if drop_worst else ranked
    mean = lambda c: F.avg(F.when(finite(F.col(c)), F.col(c)))
    return kept.groupBy(*keys).agg(
        F.count("*").alias("trials"), F.avg("total_s").alias("avg_total_s"), F.min("total_s").alias("min_total_s"), F.max("total_s").alias("max_total_s"),
        F.coalesce(F.stddev_samp("total_s"), F.lit(0.0)).alias("stdev_total_s"), *[F.coalesce(mean(p), F.lit(NAN)).alias(f"avg_{p}") for p in phases], *[mean(m).alias(f"avg_{m}") for m in metrics],
    )


def _over(a: Column, b: Column) -> Column:
    return F.when(finite(a) & finite(b) & (a > 0) & (b > 0), a / b).otherwise(F.lit(NAN))


#: Phase, the column of its mean time, and the name that both scalings share for it.
PHASES = (("total", "avg_total_s", "total"), ("sort", "avg_sort_s", "phase1"), ("merge", "avg_merge_s", "phase2"))


def _time(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(NAN)) if column in df.columns else F.lit(NAN)


def _times(df: DataFrame) -> list[Column]:
    return [_time(df, c).alias(phase) for phase, c, _ in PHASES]


def _phase_columns(df: DataFrame, prefix: str, scale: Column | None) -> list[Column]:
    """Speedup and efficiency of each phase against struct b of baseline times, and their
    aliases."""
    out = []
    for phase, column, alias in PHASES:
        name = prefix if phase == "total" else f"{prefix}{phase}_"
        speedup = _over(F.col(f"b.{phase}"), _time(df, column))
        efficiency = speedup if scale is None else F.when(finite(scale) & (scale > 0), speedup / scale).otherwise(F.lit(NAN))
        out += [speedup.alias(f"{name}speedup"), efficiency.alias(f"{name}efficiency"), speedup.alias(f"{alias}_speedup"), efficiency.alias(f"{alias}_efficiency")]
    return out


def thread_speedup(summary: DataFrame, keys: list[str], last: str | None = None) -> DataFrame:
    """Of each phase, against the one-thread row of the same keys; NaN without one. Of
    several such rows the one of greatest ``last`` counts, or of greatest times."""
    one = F.struct(*_times(summary))
    base = summary.where("threads = 1").groupBy(*keys).agg((F.max_by(one, F.col(last)) if last else F.max(one)).alias("b"))
    joined = summary.join(base, keys, "left")
    threads = F.col("threads").cast("double")
    shown = [F.coalesce(F.col(f"b.{phase}"), F.lit(NAN)).alias(f"baseline_{phase}_s") for phase, *_ in PHASES]
    return joined.select(*summary.columns, *shown, *_phase_columns(summary, "", threads))


def _fewest_nodes(rows: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """Per keys, b: the values of the row of fewest nodes (of least values, on ties)."""
    least = rows.where("nodes > 0").groupBy(*keys).agg(F.min(F.struct(F.col("nodes").alias("base_nodes"), *values)).alias("b"))
    return least


def node_speedup(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Of each phase, against the row of fewest nodes of the same keys that has a finite
    total; the efficiency is per node of that row. baseline_nodes is 0 without one."""
    base = _fewest_nodes(summary.where(finite(_time(summary, "avg_total_s"))), keys, *_times(summary))
    joined = summary.join(base, keys, "left")
    scale = F.when(F.col("nodes") > 0, F.col("nodes") / F.col("b.base_nodes"))
    return joined.select(*summary.columns, F.when(F.col("nodes") > 0, F.coalesce(F.col("b.base_nodes"), F.lit(0))).otherwise(0).alias("baseline_nodes"), *_phase_columns(summary, "strong_", F.coalesce(scale, F.lit(NAN))))


def capacity(df: DataFrame) -> DataFrame:
    """GiB, throughput, and what fits a time budget, in total and per node."""
    gib = F.col("input_bytes") / F.lit(2.0**30)
    df = df.withColumn("total_gib", gib).withColumn("gib_per_node", gib / F.col("nodes")).withColumn("throughput_gib_s", _over(gib, F.col("total_s"))).withColumn("capacity_total_gib", F.col("throughput_gib_s") * F.col("time_budget_s"))
    return df.withColumn("throughput_gib_node_s", F.col("throughput_gib_s") / F.col("nodes")).withColumn("capacity_gib_per_node", F.col("capacity_total_gib") / F.col("nodes"))


def weak_efficiency(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Against the row of fewest nodes of the same keys that has a finite total or capacity:
    speedup of each phase (the efficiency is the same, as work grows with nodes), and of
    avg_capacity_total_gib and avg_capacity_gib_per_node. total_speedup and total_efficiency
    are those of capacity where both are finite."""
    whole, node = _time(summary, "avg_capacity_total_gib"), _time(summary, "avg_capacity_gib_per_node")
    rows = summary.where(finite(_time(summary, "avg_total_s")) | finite(whole))
    base = _fewest_nodes(rows, keys, *_times(summary), whole.alias("whole"), node.alias("node"))
    scale, efficiency = _over(whole, F.col("b.whole")), _over(node, F.col("b.node"))
    shown = [F.when(finite(x), F.col(f"b.{c}")).otherwise(F.lit(NAN)).alias(n) for x, c, n in ((scale, "whole", "baseline_capacity_total_gib"), (efficiency, "node", "baseline_capacity_gib_per_node"))]
    out = summary.join(base, keys, "left").select(
        *summary.columns, F.coalesce(F.col("b.base_nodes"), F.lit(0)).alias("baseline_nodes"), *shown,
        scale.alias("weak_capacity_scale"), efficiency.alias("weak_capacity_efficiency"), *_phase_columns(summary, "weak_", None),
    )
    both = finite(F.col("weak_capacity_scale")) & finite(F.col("weak_capacity_efficiency"))
    for alias, of in (("total_speedup", "weak_capacity_scale"), ("total_efficiency", "weak_capacity_efficiency")):
        out = out.withColumn(alias, F.when(both, F.col(of)).otherwise(F.col(alias)))
    return out


def grid_best(df: DataFrame, keys: list[str]) -> DataFrame:
    """The chunk and fan of least time; ties to the lower fan, then the lower chunk."""
    best = df.groupBy(*keys).agg(F.min(F.struct("total_s", "merge_fan", "chunk_mb")).alias("b"))
    return best.select(*keys, F.col("b.chunk_mb").alias("chunk_mb"), F.col("b.merge_fan").alias("merge_fan"), F.col("b.total_s").alias("total_s"))
