"""The record contract: key, length, payload; sizes, the unsigned order, hashes, options."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER_BYTES, PAYLOAD_MIN, PAYLOAD_MAX = 12, 8, 4096
MIB = 1024 * 1024

#: key holds the 64 bits; sort_key is its order as a signed number.
RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.BinaryType(), False), T.StructField("sort_key", T.LongType(), False),
    T.StructField("len", T.IntegerType(), False), T.StructField("payload", T.BinaryType(), False), T.StructField("file_offset", T.LongType(), False),
])


def record_size(length: Column | str = "len") -> Column:
    return F.lit(HEADER_BYTES) + (F.col(length) if isinstance(length, str) else length)


def sort_key(bits: Column | str) -> Column:
    """Unsigned order of 64 bits held in a long, as a signed long: the top bit is flipped."""
    return F.expr("bigint(-9223372036854775808)").bitwiseXOR(F.col(bits) if isinstance(bits, str) else bits)


def in_contract(length: str = "len", payload_max: int = PAYLOAD_MAX) -> Column:
    return F.coalesce(F.col(length).between(PAYLOAD_MIN, payload_max), F.lit(False))


def checked(df: DataFrame, payload_max: int = PAYLOAD_MAX) -> DataFrame:
    """df, failing at the first record whose length breaks the contract."""
    message = F.concat(F.lit("record length out of range: "), F.coalesce(F.col("len").cast("string"), F.lit("null")))
    return df.withColumn("len", F.when(in_contract("len", payload_max), F.col("len")).otherwise(F.raise_error(message).cast("int")))


def adapt(df: DataFrame, key: str, payload: Column, seq: str) -> DataFrame:
    """Any table as a record stream in the order of an integer column seq."""
    return df.select(F.col(key).cast("long").alias("key"), F.octet_length(payload).alias("len"), payload.alias("payload"), F.col(seq).cast("long").alias("seq"))


FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(key_bits: int, payload: bytes) -> int:
    """FNV-1a, 64 bits, over key and length (little-endian) and payload."""
    h = FNV_OFFSET
    for b in (key_bits & (2**64 - 1)).to_bytes(8, "little") + len(payload).to_bytes(4, "little") + payload:
        h = (h ^ b) * FNV_PRIME & (2**64 - 1)
    return h


@F.pandas_udf(T.LongType())
def fnv_record(key: pd.Series, payload: pd.Series) -> pd.Series:
    """FNV-1a of each record, as the bits of a long; a batch advances byte by byte
    together, longest records last."""
    data = [p if p is not None else b"" for p in payload]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    order = np.argsort(-sizes, kind="stable")
    sizes_in_order = sizes[order]
    head = np.column_stack((key.to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8), sizes.astype("<u4").view(np.uint8).reshape(-1, 4)))[order]
    joined = np.frombuffer(b"".join(data[i] for i in order), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes_in_order)[:-1])) if len(data) else sizes_in_order
    h = np.full(len(data), FNV_OFFSET, np.uint64)
    prime = np.uint64(FNV_PRIME)
    for i in range(HEADER_BYTES):
        h = (h ^ head[:, i]) * prime
    for i in range(int(sizes_in_order[0]) if len(data) else 0):
        n = int(np.searchsorted(-sizes_in_order, -i, side="left"))  # records longer than i
        h[:n] = (h[:n] ^ joined[starts[:n] + i]) * prime
    out = np.empty(len(data), np.uint64)
    out[order] = h
    return pd.Series(out.view(np.int64))


def md5_hash(*columns: Column) -> Column:
    """60 bits of an MD5 digest, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(*columns)), 1, 15), 16, 10).cast("long")


# ---------------------------------------------------------------- options
def chunk_mib(value: int) -> int:
    """A chunk of 0 MiB means 1."""
    return 1 if value == 0 else value


def chunk_bytes(mib: int, payload_max: int = PAYLOAD_MAX) -> int:
    """A chunk in bytes; it has to hold one record of any allowed size."""
    n = chunk_mib(mib) * MIB
    check_chunk(n, payload_max)
    return n


def check_chunk(n: int, payload_max: int = PAYLOAD_MAX) -> None:
    if n < HEADER_BYTES + payload_max:
        raise ValueError(f"a chunk of {n} bytes can't hold a record of {HEADER_BYTES + payload_max}")


def merge_fan(value: int) -> int:
    return max(2, value)


def check_payload_bounds(least: int, most: int, payload_max: int = PAYLOAD_MAX) -> None:
    if not PAYLOAD_MIN <= least <= most <= payload_max:
        raise ValueError(f"payload bounds must be {PAYLOAD_MIN} <= min <= max <= {payload_max}")


def g9(x: Column) -> Column:
    """A number with nine significant digits, as C's %.9g writes it."""
    rounded = F.format_string("%.8e", x)
    exponent = F.regexp_extract(rounded, r"e([+-]\d+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(rounded, r"^(-?\d\.\d+)e", 1), "0+$", ""), r"\.$", "")
    scientific = F.concat(digits, F.lit("e"), F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    places = F.greatest(F.lit(0), F.lit(8) - exponent)
    plain = F.element_at(F.array(*[F.format_string(f"%.{d}f", x) for d in range(13)]), F.least(places, F.lit(12)) + 1)
    plain = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when(F.isnan(x), "nan").when(x == 0, "0").when((exponent < -4) | (exponent >= 9), scientific).otherwise(plain)


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def parent_of(c: Column) -> Column:
    """The folder of a path, or a dot."""
    found = F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    return F.when(c.contains("/"), F.when(found == "", "/").otherwise(found)).otherwise(".")


NUMBER = re.compile(r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")


def lenient_double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float("nan")))


def lenient_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
