"""The binary format, its contract, options, and the hash."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from sortloom.functions import records as R
from sortloom.operators import sorting, verify
from sortloom.plans import layout
from sortloom.sources import kvrec, logs

KEYS = [0, 2**63 - 1, 2**63, 2**64 - 1, 5, 5]


def write(path, rows):
    with open(path, "wb") as f:
        for key, payload in rows:
            f.write(struct.pack("<QI", key, len(payload)) + payload)


def read(spark, path, parts=3):
    kvrec.register(spark)
    return spark.read.format("kvrec").option("partitions", str(parts)).load(str(path))


def test_unsigned_order(spark, tmp_path):
    write(tmp_path / "a.bin", [(k, b"12345678" + bytes([i])) for i, k in enumerate(KEYS)])
    rows = sorting.global_sort(read(spark, tmp_path / "a.bin"), "sort_key").collect()
    assert [int.from_bytes(r.key, "big") for r in rows] == sorted(KEYS)


@pytest.mark.parametrize("parts", [1, 2, 3, 5, 20])
def test_splits_cover_all(spark, tmp_path, parts):
    rows = [(i, bytes(8 + i * 7 % 90)) for i in range(11)]
    write(tmp_path / "a.bin", rows)
    edges = kvrec.boundaries(str(tmp_path / "a.bin"), parts)
    starts = {at for at, _ in kvrec.walk(str(tmp_path / "a.bin"), 4096)} | {os.path.getsize(tmp_path / "a.bin")}
    assert len(edges) == parts + 1 and set(edges) <= starts and edges == sorted(edges)
    assert sorted(int.from_bytes(r.key, "big") for r in read(spark, tmp_path / "a.bin", parts).collect()) == list(range(11))


def test_empty_file(spark, tmp_path):
    write(tmp_path / "a.bin", [])
    df = read(spark, tmp_path / "a.bin")
    assert df.count() == 0
    stats = verify.file_stats(df.select(F.lit(0).alias("key"), "len")).first()
    assert tuple(stats) == (0, 0, 0, 0)


@pytest.mark.parametrize("size", [8, 4096])
def test_bounds_accepted(spark, tmp_path, size):
    write(tmp_path / "a.bin", [(1, bytes(size))])
    assert read(spark, tmp_path / "a.bin").first().len == size


@pytest.mark.parametrize("data", [struct.pack("<QI", 1, 7) + bytes(7), struct.pack("<QI", 1, 4097) + bytes(4097), struct.pack("<QI", 1, 9)[:7], struct.pack("<QI", 1, 9) + bytes(3)])
def test_bad_files_fail(spark, tmp_path, data):
    (tmp_path / "a.bin").write_bytes(struct.pack("<QI", 3, 8) + bytes(8) + data)
    with pytest.raises(Exception, match="length|cut short"):
        read(spark, tmp_path / "a.bin", 2).count()


def test_roundtrip_single_file(spark, tmp_path):
    kvrec.register(spark)
    df = kvrec.generate(spark, 3000, seed=7)
    out = str(tmp_path / "out.bin")
    sorting.range_sort(kvrec.to_records(df), 4, "sort_key").write.format("kvrec").mode("overwrite").option("singleFile", "true").save(out)
    keys = [struct.unpack_from("<Q", open(out, "rb").read(), at)[0] for at, _ in list(kvrec.walk(out, 4096))[:50]]
    assert keys == sorted(keys)
    assert os.path.getsize(out) == df.agg(F.sum(F.col("len") + 12)).first()[0]
    back = read(spark, out).select(F.conv(F.hex("key"), 16, -10).cast("long").alias("key"), "len", "payload")
    assert verify.fnv_fingerprint(back).first() == verify.fnv_fingerprint(df).first()


def test_empty_output(spark, tmp_path):
    kvrec.register(spark)
    out = str(tmp_path / "out.bin")
    kvrec.to_records(kvrec.generate(spark, 0)).write.format("kvrec").mode("overwrite").option("singleFile", "true").save(out)
    assert os.path.getsize(out) == 0


def test_fnv(spark):
    rows = [(1, b""), (-1, b"abc"), (2**62, b"x" * 300)]
    df = spark.createDataFrame(rows, "key long, payload binary").select("key", R.fnv_record("key", "payload").alias("h"))
    assert {r.key: r.h & (2**64 - 1) for r in df.collect()} == {k: R.fnv1a64(k, p) for k, p in rows}


def test_fingerprints_tell(spark, sf):
    df = kvrec.generate(spark, 200)
    assert verify.same_multiset(df, df.orderBy("key")).first()[0]
    dup = df.where("seq <> 3").unionByName(df.where("seq = 4"))
    assert not verify.same_multiset(df, dup).first()[0]
    swapped = df.withColumn("key", F.col("seq")).withColumn("seq", F.expr("case seq when 5 then 6 when 6 then 5 else seq end"))
    assert verify.order_errors(swapped).count() == 1


def test_checked(spark):
    good = spark.createDataFrame([(8,), (4096,)], "len int")
    assert R.checked(good).count() == 2
    with pytest.raises(Exception, match="out of range"):
        R.checked(spark.createDataFrame([(7,)], "len int")).collect()


def test_options():
    assert R.chunk_mib(0) == 1 and R.merge_fan(1) == 2 and R.chunk_bytes(64) == 64 * 2**20
    with pytest.raises(ValueError):
        R.check_chunk(4107)
    with pytest.raises(ValueError):
        R.check_payload_bounds(7, 64)


def test_greedy_packing(spark):
    sizes = [20, 30, 60, 10, 90, 5, 40, 41]
    df = spark.createDataFrame([(i, i, s - 12) for i, s in enumerate(sizes)], "key long, seq long, len int").withColumn("payload", F.lit(""))
    assert [r.run for r in layout.pack_chunks(df, 100, 1).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2, 3, 3]


def test_csv_and_logs(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"run_{k}").mkdir()
        (tmp_path / f"run_{k}" / "raw.csv").write_text(f"case,total_s,runs\na,nan,x\nb,{k}.5,7\n")
    df = logs.read_csv(spark, str(tmp_path), "raw.csv", ("total_s",), ("runs",))
    assert sorted((r.runs for r in df.collect())) == [0, 0, 7, 7]
    assert logs.read_csv(spark, str(tmp_path), "none.csv").count() == 0
    assert logs.newest_run(spark, str(tmp_path)).rsplit("/", 1)[1].startswith("run_")
    (tmp_path / "x.log").write_text("Fase 1 : 36 run in 4.5 s\nTotale 9.25 s\n")
    lines = logs.read_logs(spark, str(tmp_path / "x.log"))
    assert logs.phase_seconds(lines, "Totale", "t").first().t == 9.25 and logs.generated_runs(lines).first().generated_runs == 36
    logs.append_csv(df, str(tmp_path / "out"))
    logs.append_csv(df, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="header"):
        logs.append_csv(df.drop("runs"), str(tmp_path / "out"))
