"""Benchmark files: lenient CSV in, CSV out, phase logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import g9, lenient_double, lenient_int


def read_csv(spark: SparkSession, folder: str, name: str, doubles: tuple[str, ...] = (), ints: tuple[str, ...] = (), strings: tuple[str, ...] = ()) -> DataFrame:
    """A raw CSV of a folder, or of all its run_* folders together, joined by column name;
    none: no rows. Bad numbers become NaN or 0, and so do doubles and ints that a file
    lacks; strings that it lacks are null."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def found(pattern: str) -> list[str]:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        return sorted(s.getPath().toString() for s in path.getFileSystem(conf).globStatus(path) or [])

    files = found(f"{folder}/{name}") or found(f"{folder}/run_*/{name}")
    parts = [d for f in files if (d := spark.read.option("header", True).csv(f)).columns]
    wanted = (*strings, *doubles, *ints)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in wanted]))
    for c in wanted:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    for c in doubles:
        df = df.withColumn(c, lenient_double(F.col(c)))
    for c in ints:
        df = df.withColumn(c, lenient_int(F.col(c)))
    return df


def write_csv(df: DataFrame, folder: str) -> None:
    """A CSV with a header, numbers of nine significant digits; without rows the header
    alone."""
    shown = [g9(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    df.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def newest_run(spark: SparkSession, folder: str) -> str | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/run_*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return max(((s.getModificationTime(), s.getPath().toString()) for s in found), default=(0, None))[1]


def append_csv(df: DataFrame, folder: str) -> None:
    """Appends to a CSV folder if its header is the same; otherwise raises."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/*.csv")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
        held = spark.read.option("header", True).csv(folder).columns
        if held != df.columns:
            raise ValueError(f"the header differs: {held} and {df.columns}")
    df.write.mode("append").option("header", True).csv(folder)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their file and number."""
    lines = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    return lines.select("file", F.posexplode("lines").alias("line_id", "line"))


def phase_seconds(lines: DataFrame, label: str, into: str) -> DataFrame:
    """Per file, the last purely numeric word of the last line that has the label; NaN
    without one."""
    words = F.filter(F.split("line", r"\s+"), lambda w: w.rlike(r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
    value = F.try_element_at(words, F.lit(-1)).cast("double")
    last = F.max_by(value, F.when(F.col("line").contains(label), F.col("line_id")))
    return lines.groupBy("file").agg(F.coalesce(last, F.lit(float("nan"))).alias(into))


def generated_runs(lines: DataFrame, label: str = "Fase 1") -> DataFrame:
    """Per file, the number before the word run on the last line of the label; 0 without."""
    number = F.regexp_extract("line", r"(\d+) run(?:\s|$)", 1)
    hit = F.col("line").contains(label) & (number != "")
    return lines.groupBy("file").agg(F.coalesce(F.max_by(number, F.when(hit, F.col("line_id"))).try_cast("int"), F.lit(0)).alias("generated_runs"))
