"""Running totals over an ordered log without sending it all to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import entry_size

#: Sequence numbers per block. Totals of blocks are summed in one task: one row for so many of the log.
BLOCK = 1 << 16


def running_total(df: DataFrame, value: Column, order: str = "seq", name: str = "total", block: int = BLOCK, by: tuple[str, ...] = ()) -> DataFrame:
    """Add the sum of ``value`` over the rows up to and including each, by ``order``, in two phases: the totals of
    blocks, then within each block. ``order`` is a whole number; ``by`` restarts the sum."""
    df = df.withColumns({"__value": value, "__block": F.expr(f"`{order}` div {block}")})
    totals = df.groupBy(*by, "__block").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = df.withColumn("__within", F.sum("__value").over(within)).join(starts, [*by, "__block"])
    return summed.withColumn(name, F.col("__before") + F.col("__within")).drop("__value", "__block", "__within", "__before")


def size_changes(log: DataFrame) -> DataFrame:
    """Add ``change``: by how many bytes each mutation grows or shrinks the in-memory table."""
    sized = log.withColumn("bytes", entry_size(F.col("k"), F.col("op"), F.col("v")))
    replaced = F.lag("bytes").over(Window.partitionBy("k").orderBy("seq"))
    return sized.withColumn("change", F.col("bytes") - F.coalesce(replaced, F.lit(0)))


def running_size(log: DataFrame) -> DataFrame:
    """seq, k, change and total: the size of the in-memory table after each mutation, if it is never flushed."""
    return running_total(size_changes(log), F.col("change")).select("seq", "k", "change", "total")


def valid_prefix(records: DataFrame, bad: Column) -> DataFrame:
    """The records before the first bad one: replay stops there."""
    first_bad = records.where(bad).agg(F.min("seq").alias("first_bad"))
    return records.crossJoin(F.broadcast(first_bad)).where(F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad"))).drop("first_bad")  # one row
