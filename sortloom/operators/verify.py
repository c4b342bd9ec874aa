"""Verification: file statistics, order errors, multiset fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.records import HEADER_BYTES, fnv_record, md5_hash
from ..plans.prefix import value_before

TWO64 = "18446744073709551616"


def file_stats(records: DataFrame) -> DataFrame:
    """records, bytes, least and greatest key; zeros for an empty file."""
    return records.agg(F.count("*").alias("records"), *(F.coalesce(x, F.lit(0)).cast("long").alias(n) for n, x in (("bytes", F.sum(F.lit(HEADER_BYTES) + F.col("len"))), ("min_key", F.min("key")), ("max_key", F.max("key")))))


def order_errors(records: DataFrame) -> DataFrame:
    """Records whose key is below that of the record before, in file order (seq)."""
    return value_before(records.select("seq", "key"), "seq", "key", "previous_key").where("previous_key > key")


def fingerprint(records: DataFrame) -> DataFrame:
    """Count, bytes, and the sum and exclusive or of a 60-bit hash of each record: equal
    for equal multisets, in any order."""
    h = md5_hash(F.col("key").cast("string"), F.lit("|"), F.col("payload").cast("string"))
    sums = records.select("len", h.alias("h")).agg(F.count("*").alias("records"), F.coalesce(F.sum(F.lit(HEADER_BYTES) + F.col("len")), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("total"), F.coalesce(F.bit_xor("h"), F.lit(0)).cast("long").alias("hash_xor"))
    return sums.select("records", "bytes", F.expr("cast(total % 1000000000000000003 as bigint)").alias("hash_sum"), "hash_xor")


def fnv_fingerprint(records: DataFrame) -> DataFrame:
    """The same with FNV-1a over key, length and payload, the sum modulo 2**64."""
    hashed = records.select("len", fnv_record("key", F.col("payload").cast("binary")).alias("h"))
    unsigned = F.col("h").cast("decimal(38,0)") + F.when(F.col("h") < 0, F.lit(TWO64).cast("decimal(38,0)")).otherwise(0)
    return hashed.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.lit(HEADER_BYTES) + F.col("len")), F.lit(0)).cast("long").alias("bytes"), F.pmod(F.coalesce(F.sum(unsigned), F.lit(0)).cast("decimal(38,0)"), F.lit(TWO64).cast("decimal(38,0)")).cast("string").alias("hash_sum"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"))


def output_check(source: DataFrame, output: DataFrame) -> DataFrame:
    """One row: whether the output has as many bytes as its source, and more than none, as
    a cheap check after each run."""
    size = lambda d: d.agg(F.coalesce(F.sum(F.lit(HEADER_BYTES) + F.col("len")), F.lit(0)).cast("long").alias("bytes"))
    return size(source).alias("a").join(F.broadcast(size(output).alias("b"))).select(((F.col("a.bytes") == F.col("b.bytes")) & (F.col("b.bytes") > 0)).alias("ok"))  # one row each


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two record streams have equal fingerprints."""
    left, right = fingerprint(a), fingerprint(b)
    equal = None
    for c in left.columns:
        same = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        equal = same if equal is None else equal & same
    return left.alias("a").join(F.broadcast(right.alias("b"))).select(equal.alias("equal"))  # one row each
