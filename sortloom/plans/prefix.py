"""Totals over a total order, without a window over all rows.

One range shuffle puts rows in order: partitions are disjoint and rising, each sorted.
A pass over each partition adds what comes before a row within it; that is written. One
row for each partition then tells what comes before the partition, and is added. Results
come out in the order asked for.

Rows of a null order value come first. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staged import checkpointed


def _ranged(df: DataFrame, order: str, spread: bool) -> DataFrame:
    """Range partitions by order. spread: rows of one value may be dealt over several
    partitions, so a value that many rows have is no task of its own."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    by = [F.col(order), F.xxhash64(*df.columns)] if spread else [F.col(order)]
    return df.repartitionByRange(n, *by).sortWithinPartitions(order)


def _part() -> int:
    return TaskContext.get().partitionId()


def _with(batch: pa.RecordBatch, names: list[str], *more: tuple[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(a for _, a in more)], names=[*names, *(n for n, _ in more)])


def _schema(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in more)])


def sum_before(df: DataFrame, order: str, value: str, into: str) -> DataFrame:
    """df with the sum of value over all rows of lower order (ties in any order)."""
    rows = df.withColumn("__v", F.coalesce(F.col(value).cast("long"), F.lit(0).cast("long")))
    names = rows.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, _part()
        for batch in batches:
            v = batch.column("__v").to_numpy()
            upto = np.cumsum(v)
            yield _with(batch, names, ("__part", pa.array(np.full(len(v), part, np.int32))), ("__sum", pa.array(before + upto - v)))
            before += int(upto[-1]) if len(v) else 0

    placed = checkpointed(_ranged(rows, order, True).mapInArrow(add, _schema(rows, ("__part", T.IntegerType()), ("__sum", T.LongType()))))
    totals = placed.groupBy("__part").agg(F.sum("__v").alias("__total"))
    before = totals.select("__part", (F.sum("__total").over(Window.orderBy("__part")) - F.col("__total")).alias("__before"))
    # one row for each partition
    return placed.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__sum")).cast("long").alias(into))


def value_before(df: DataFrame, order: str, value: str, into: str) -> DataFrame:
    """df with the value of the row before, null for the first."""
    names, kind = df.columns, df.schema[value].dataType

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, part = None, 0, _part()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(value)
            head = pa.array([None], v.type) if last is None else last
            yield _with(batch, names, ("__part", pa.array(np.full(n, part, np.int32))), ("__at", pa.array(np.arange(at, at + n))), ("__prev", pa.concat_arrays([head, v.slice(0, n - 1)])))
            last, at = v.slice(n - 1, 1), at + n

    placed = checkpointed(_ranged(df, order, False).mapInArrow(shift, _schema(df, ("__part", T.IntegerType()), ("__at", T.LongType()), ("__prev", kind))))
    lasts = placed.groupBy("__part").agg(F.max_by(F.struct(F.col(value).alias("v")), "__at").alias("__last"))
    edge = lasts.select("__part", F.lag("__last").over(Window.orderBy("__part"))["v"].alias("__edge"))
    # one row for each partition
    joined = placed.join(F.broadcast(edge), "__part")
    return joined.select(*names, F.when(F.col("__at") == 0, F.col("__edge")).otherwise(F.col("__prev")).alias(into))


def rank_by(df: DataFrame, key: str, into: str = "rank") -> DataFrame:
    """df with rank() over (order by key): one more than the rows of lower key."""
    spark, names = df.sparkSession, df.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, first, part = None, 0, 0, _part()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = batch.column(key)
            prev = pa.concat_arrays([k.slice(0, 1) if last is None else last, k.slice(0, n - 1)])
            same = pc.or_(pc.fill_null(pc.equal(k, prev), False), pc.and_(pc.is_null(k), pc.is_null(prev))).to_numpy(zero_copy_only=False)
            starts = np.where(same, first, np.arange(at, at + n))
            firsts = np.maximum.accumulate(starts)
            yield _with(batch, names, ("__part", pa.array(np.full(n, part, np.int32))), ("__first", pa.array(firsts)))
            last, at, first = k.slice(n - 1, 1), at + n, int(firsts[-1])

    placed = checkpointed(_ranged(df, key, True).mapInArrow(number, _schema(df, ("__part", T.IntegerType()), ("__first", T.LongType()))))
    # One row for each partition: its rows, first and last key, and where its last key begins.
    whole = F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key"))
    parts = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min(whole).alias("lo"), F.max(whole).alias("hi"), F.max("__first").alias("tail")).orderBy("__part").collect()
    out, before, begins, last = [], 0, 0, None
    for p in parts:
        # a first key that ended the partition before began where it began there
        lead = begins if last is not None and p.lo == last else before
        out.append((p["__part"], lead, before))
        begins = lead if p.lo == p.hi else before + p.tail
        before, last = before + p.n, p.hi
    offsets = F.broadcast(spark.createDataFrame(out, "__part int, __lead long, __before long"))
    lower = F.when(F.col("__first") == 0, F.col("__lead")).otherwise(F.col("__before") + F.col("__first"))
    return placed.join(offsets, "__part").select(*names, (lower + 1).alias(into))
