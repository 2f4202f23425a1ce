"""File inventories and the guarded sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """Name and size of every file a path pattern matches, empty files included.

    Only the file listing is read, which is what the driver holds for any scan of the same folder;
    Spark's file sources would skip files without bytes.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(conf).globStatus(path) or []
    rows = [(f.getPath().getName(), f.getLen()) for f in found if f.isFile()]
    return spark.createDataFrame(rows, "name string, size_bytes bigint")


def inventory_changes(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Per file: same, resized, added or removed since the recorded inventory."""
    a, b = now.withColumnRenamed("size_bytes", "size_now"), recorded.withColumnRenamed("size_bytes", "size_then")
    state = (
        F.when(F.col("size_then").isNull(), "added")
        .when(F.col("size_now").isNull(), "removed")
        .when(F.col("size_now") != F.col("size_then"), "resized")
        .otherwise("same")
    )
    return a.join(b, "name", "full_outer").withColumn("state", state)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), gzip: bool = False) -> str:
    """Write once: an existing output stops the job instead of being replaced."""
    w = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    if gzip:
        w = w.option("compression", "gzip")
    w.save(path)
    return path
