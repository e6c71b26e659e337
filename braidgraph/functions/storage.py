"""Intermediates that all executors share, and global numbering of rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; an own one only where that is unset and the driver is the only executor, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="braidgraph-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Spark setting: a query's shuffle files go when the query has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors. Nothing reads its shuffles after that."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}/{tag}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the written intermediates that df reads. Nothing may read df, or them, after that."""
    root = shared_dir(spark)
    tables = {m[1] for f in df.inputFiles() if (m := re.search(r"/(table-[0-9a-f]{32})/", f))}
    for name in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def prefix_sums(spark: SparkSession, df: DataFrame, within: list[str], order: list[str], value: str, column: str, tag: str) -> DataFrame:
    """df with column = the sum of `value` over the rows before and up to each one, by `within` (may be empty) in the order of
    `order` (total there). Rows are range-partitioned, written once, summed inside each partition; what earlier partitions hold is added."""
    by = [*within, *order]
    ranged = materialize(spark, df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), tag)
    inside = F.sum(value).over(Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = ranged.groupBy("__part", *within).agg(F.sum(value).alias("__sum"))
    if not within:
        before, at = [], 0
        for r in sorted(totals.collect()):  # one row a partition
            before.append((r[0], at))
            at += r[1]
        base = spark.createDataFrame(before, "__part int, __base long")
    else:
        earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        base = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum")  # a row for each partition and group in it
    summed = ranged.withColumn(column, inside).join(base, ["__part", *within])
    return summed.withColumn(column, (F.col(column) + F.col("__base")).cast("long")).drop("__part", "__base")


def number_rows(spark: SparkSession, df: DataFrame, order: list[Column], column: str, tag: str) -> DataFrame:
    """df with column = 1, 2, ... in the given total order, without sorting everything in one task: rows are
    range-partitioned and sorted, written once, and each partition's offset is the number of rows before it."""
    position = F.monotonically_increasing_id()
    ranged = materialize(spark, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", position), tag)
    sizes = sorted((r.part, r.n) for r in ranged.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for part, n in sizes:
        before[part], total = total, total + n
    offsets = spark.createDataFrame(list(before.items()), "__part long, __before long")  # one row a partition
    local = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(offsets), "__part")
    return placed.withColumn(column, F.col("__before") + local + 1).drop("__at", "__part", "__before")


def clear_intermediates(spark: SparkSession) -> None:
    """Delete all written intermediates in the shared folder; results that still read them are lost
    (and `testgraph.forget()` has to follow)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "table-*")) or []:
        fs.delete(status.getPath(), True)
