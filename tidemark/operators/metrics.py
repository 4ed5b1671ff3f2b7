"""Percentiles as a benchmark takes them, and the size of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def floor_percentiles(df: DataFrame, value: str, by: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per group: count, mean, and the values at the sorted places floor(n * share), the last at most."""
    n = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    # equal values are counted once, so that a group is ranked by its distinct values
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("times"))
    up_to = F.sum("times").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("up_to", up_to).join(n, by)
    place = lambda s: F.least(F.floor(F.col("n") * F.lit(float(s))), F.col("n") - 1)
    picks = [F.min(F.when(F.col("up_to") > place(s), F.col(value))).alias(f"p{round(s * 100)}") for s in shares]
    return ranked.groupBy(by, "n", "mean").agg(*picks)


def folder_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder, on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
