"""Prefix sums, packing, the sink's options, and analytics on awkward data."""

import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sortloom.operators import sorting, trials, verify
from sortloom.plans import layout, prefix
from sortloom.sources import kvrec, logs

NAN = float("nan")


def ranks(keys):
    order = sorted(keys, key=lambda k: (k is not None, k or 0))
    return sorted((k, 1 + order.index(k)) for k in keys if k is not None), [1 + order.index(k) for k in keys if k is None]


@pytest.mark.parametrize("keys", [[], [5], [7] * 300, [None, None, 3, 3, 1], [random.Random(1).randrange(9) for _ in range(400)], [random.Random(2).randrange(-(2**63), 2**63) for _ in range(300)]])
def test_ranks(spark, keys):
    """Ties that span partitions, null keys, one key, none."""
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, seq long").repartition(3)
    got = prefix.rank_by(df, "key")
    rows = [(r.key, r["rank"]) for r in got.collect()]
    some, nulls = ranks(keys)
    assert sorted(r for r in rows if r[0] is not None) == some and [r[1] for r in rows if r[0] is None] == nulls
    assert [k for k, _ in rows if k is not None] == sorted(k for k in keys if k is not None)  # in order


def test_sums_and_neighbours(spark):
    r = random.Random(3)
    rows = [(i * i - 50, r.choice([None, 1, 5, 9])) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, v long").repartition(7)
    total, expected, last = 0, {}, None
    for s, v in sorted(rows):
        expected[s] = (total, last)
        total, last = total + (v or 0), v
    assert {x.seq: x.before for x in prefix.sum_before(df, "seq", "v", "before").collect()} == {s: e[0] for s, e in expected.items()}
    assert {x.seq: x.prev for x in prefix.value_before(df, "seq", "v", "prev").collect()} == {s: e[1] for s, e in expected.items()}


def test_plans_have_no_window_over_all_rows(spark):
    df = kvrec.generate(spark, 5_000).select("key", "seq")
    plan = prefix.rank_by(df, "key")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


@pytest.mark.parametrize("chunk", [1, 50, 100, 10_000])
def test_packing_by_runs(chunk):
    import numpy as np

    r = random.Random(chunk)
    sizes = [r.randrange(1, 120) for _ in range(300)]
    expected, used, run = [], 0, 0
    for s in sizes:
        if used and used + s > chunk:
            run, used = run + 1, 0
        used += s
        expected.append(run)
    pack = layout.packer(chunk)
    assert [x for a in range(0, 300, 37) for x in pack(0, np.array(sizes[a : a + 37])).tolist()] == expected
    assert pack(1, np.array([3])).tolist() == [0]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_parts_with_and_without_index(spark, tmp_path, parts, monkeypatch):
    kvrec.register(spark)
    df = kvrec.generate(spark, 4_000, 8, 900, seed=5)
    out = str(tmp_path / "parts")
    sorting.range_sort(kvrec.to_records(df), 3, "sort_key").write.format("kvrec").mode("overwrite").save(f"file://{out}")
    fold = lambda: verify.fnv_fingerprint(spark.read.format("kvrec").option("partitions", str(parts)).load(out).select(F.conv(F.hex("key"), 16, -10).cast("long").alias("key"), "len", "payload")).first()
    expected = verify.fnv_fingerprint(df).first()
    assert sum(n.endswith(".idx") for n in os.listdir(out)) == 3 and fold() == expected
    for n in os.listdir(out):
        if n.endswith((".idx", ".crc")):
            os.remove(f"{out}/{n}")
    assert fold() == expected


def test_splits_begin_where_the_rule_says(spark, tmp_path):
    kvrec.register(spark)
    out = str(tmp_path / "one.bin")
    kvrec.to_records(kvrec.generate(spark, 500)).coalesce(1).write.format("kvrec").mode("overwrite").option("singleFile", "true").option("keepRuns", "true").save(out)
    assert len([n for n in os.listdir(f"{out}.parts") if n.endswith(".bin")]) == 1
    edges = kvrec.boundaries(out, 4)
    got = spark.read.format("kvrec").option("partitions", "4").option("payload", "false").load(out).groupBy(F.spark_partition_id()).agg(F.min("file_offset").alias("a")).collect()
    assert sorted(r.a for r in got) == edges[:-1]
    with pytest.raises(Exception, match="one.bin|exists|Exists"):
        kvrec.to_records(kvrec.generate(spark, 5)).write.format("kvrec").mode("append").option("singleFile", "true").save(out)


def test_output_check(spark):
    df = kvrec.generate(spark, 50)
    assert verify.output_check(df, df.orderBy("key")).first().ok
    assert not verify.output_check(df, df.where("seq > 3")).first().ok
    assert not verify.output_check(df.where("seq < 0"), df.where("seq < 0")).first().ok


def test_csv_by_name(spark, tmp_path):
    for k, text in ((1, "runs,total_s\n7,2.5\n"), (2, "total_s,runs,extra\n4.5,9,x\n"), (3, "")):
        (tmp_path / f"run_{k}").mkdir()
        (tmp_path / f"run_{k}" / "raw.csv").write_text(text)
    got = logs.read_csv(spark, str(tmp_path), "raw.csv", ("total_s", "gib"), ("runs",)).orderBy("runs").collect()
    assert [(r.runs, r.total_s, r.extra) for r in got] == [(7, 2.5, None), (9, 4.5, "x")] and math.isnan(got[0].gib)
    none = logs.read_csv(spark, str(tmp_path), "none.csv", ("total_s",), ("runs",), ("case",))
    assert dict(none.dtypes) == {"case": "string", "total_s": "double", "runs": "int"} and none.count() == 0


def test_csv_written(spark, tmp_path):
    out = str(tmp_path / "out")
    logs.write_csv(spark.createDataFrame([("a", 34.7669000001234, 3), ("b", 1.311e-06, 4)], "case string, s double, n int"), out)
    (part,) = [n for n in os.listdir(out) if n.endswith(".csv")]
    assert open(f"{out}/{part}").read().split() == ["case,s,n", "a,34.7669,3", "b,1.311e-06,4"]
    logs.write_csv(spark.createDataFrame([], "case string, s double"), out)
    (part,) = [n for n in os.listdir(out) if n.endswith(".csv")]
    assert open(f"{out}/{part}").read().split() == ["case,s"]


def test_summary_of_metrics(spark):
    rows = [("a", i, t, 1.0, NAN, g, NAN) for i, (t, g) in enumerate([(2.0, 1.0), (3.0, NAN), (9.0, 5.0), (NAN, 7.0), (math.inf, 7.0)])]
    df = spark.createDataFrame(rows, "case string, trial int, total_s double, sort_s double, merge_s double, total_gib double, time_budget_s double")
    r = trials.summarize(df, ["case", "missing"]).first()
    assert (r.trials, r.avg_total_s, r.avg_total_gib, r.avg_time_budget_s, r.missing) == (2, 2.5, 1.0, None, "")
    assert math.isnan(r.avg_merge_s) and "avg_input_bytes" not in r.asDict()
    assert trials.summarize(df, ["case"], drop_worst=False).first().trials == 3


def test_baselines_are_finite(spark):
    df = spark.createDataFrame([("a", 1, NAN, 5.0, 6.0), ("a", 2, 8.0, 4.0, NAN), ("a", 4, 4.0, 1.0, 2.0), ("b", 1, NAN, 1.0, 1.0)], "case string, nodes int, avg_total_s double, avg_sort_s double, avg_merge_s double")
    got = {(r.case, r.nodes): r for r in trials.node_speedup(df, ["case"]).collect()}
    r = got["a", 4]
    assert (r.baseline_nodes, r.strong_speedup, r.strong_efficiency, r.strong_sort_speedup, r.phase1_efficiency, r.total_speedup) == (2, 2.0, 1.0, 4.0, 2.0, 2.0)
    assert math.isnan(r.strong_merge_speedup) and math.isnan(got["a", 1].strong_speedup) and got["b", 1].baseline_nodes == 0
    one = spark.createDataFrame([("a", 1, 8.0, 4.0, 4.0), ("a", 4, 4.0, 1.0, NAN), ("b", 2, 1.0, 1.0, 1.0)], "case string, threads int, avg_total_s double, avg_sort_s double, avg_merge_s double")
    got = {(r.case, r.threads): r for r in trials.thread_speedup(one, ["case"]).collect()}
    r = got["a", 4]
    assert (r.speedup, r.efficiency, r.sort_speedup, r.phase1_efficiency, r.total_efficiency, r.baseline_sort_s) == (2.0, 0.5, 4.0, 1.0, 0.5, 4.0)
    assert math.isnan(r.merge_speedup) and math.isnan(got["b", 2].speedup)


def test_weak_metrics(spark):
    schema = "case string, nodes int, avg_total_s double, avg_sort_s double, avg_merge_s double, avg_capacity_total_gib double, avg_capacity_gib_per_node double"
    df = spark.createDataFrame([("a", 1, NAN, 1.0, 1.0, NAN, NAN), ("a", 2, 4.0, 2.0, 2.0, 10.0, 5.0), ("a", 4, 5.0, 4.0, NAN, 16.0, 4.0), ("b", 1, 2.0, 1.0, 1.0, NAN, NAN), ("b", 2, 4.0, 1.0, 1.0, NAN, NAN)], schema)
    got = {(r.case, r.nodes): r for r in trials.weak_efficiency(df, ["case"]).collect()}
    r = got["a", 4]
    assert (r.baseline_nodes, r.weak_capacity_scale, r.weak_capacity_efficiency, r.total_speedup, r.total_efficiency) == (2, 1.6, 0.8, 1.6, 0.8)
    assert (r.weak_speedup, r.weak_efficiency, r.weak_sort_speedup) == (0.8, 0.8, 0.5) and math.isnan(r.phase2_speedup)
    assert (got["b", 2].total_speedup, got["b", 2].total_efficiency) == (0.5, 0.5)


def test_entry_without_the_subpackage(tmp_path):
    """A subpackage that can't be imported costs its own queries only."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
