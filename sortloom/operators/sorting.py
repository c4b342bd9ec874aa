"""Global and local sorts. One range shuffle and Spark's spilling sort do all the work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def global_sort(records: DataFrame, key: str = "key") -> DataFrame:
    """Records in order of key; ties in any order."""
    return records.orderBy(key)


def range_sort(records: DataFrame, partitions: int, key: str = "key") -> DataFrame:
    """Partitions that are disjoint and rising in key, each sorted: ordered part files."""
    return records.repartitionByRange(partitions, key).sortWithinPartitions(key)


def single_file(records: DataFrame, key: str = "key") -> DataFrame:
    """A global sort that writes one file."""
    return records.orderBy(key).coalesce(1)


def local_sort(packed: DataFrame, keys: list[str], key: str = "key") -> DataFrame:
    """Each run sorted on its own, runs spread by their keys."""
    return packed.repartition(*keys).sortWithinPartitions(*keys, key)


def top_keys(records: DataFrame, n: int, *order: str) -> DataFrame:
    return records.orderBy(*order).limit(n)


def range_overlaps(records: DataFrame, partitions: int, key: str = "key") -> DataFrame:
    """How many rows there are, and how many range partitions begin before another of
    lower number ends: none, if the partitions are in order."""
    parts = range_sort(records, partitions, key).withColumn("part", F.spark_partition_id())
    bounds = parts.groupBy("part").agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    other = bounds.select(F.col("part").alias("p2"), F.col("lo").alias("lo2"))  # a row per partition
    bad = bounds.join(other, (F.col("part") < F.col("p2")) & (F.col("hi") > F.col("lo2"))).agg(F.count("*").alias("overlaps"))
    return bounds.agg(F.sum("n").alias("n_rows")).join(F.broadcast(bad))
