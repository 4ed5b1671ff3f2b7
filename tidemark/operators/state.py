"""The state of a mutation log: the newest mutation of each key wins, and a tombstone hides what came before.

Every operator takes a log (seq, k, op, v) and aggregates with ``max_by``, which combines before the shuffle, so a
key with very many mutations costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import entry_size, op_name
from tidemark.model import PUT, TOMBSTONE


def latest(log: DataFrame, order: str = "seq", keys: tuple[str, ...] = ("k",)) -> DataFrame:
    """One row per key with its newest mutation, tombstones included."""
    newest = F.max_by(F.struct(order, "op", "v"), order).alias("newest")
    return log.groupBy(*keys).agg(newest).select(*keys, f"newest.{order}", "newest.op", "newest.v")


def snapshot(log: DataFrame) -> DataFrame:
    """The live keys and their values."""
    return latest(log).where(F.col("op") == PUT).select("k", "v", "seq")


def snapshot_by_rank(log: DataFrame) -> DataFrame:
    """The same as :func:`snapshot`, by ranking each key's mutations."""
    newest_first = Window.partitionBy("k").orderBy(F.desc("seq"))
    ranked = log.withColumn("rank", F.row_number().over(newest_first)).where("rank = 1")
    return ranked.where(F.col("op") == PUT).select("k", "v", "seq")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live state just after mutation ``seq``."""
    return snapshot(log.where(F.col("seq") <= seq))


def tombstones(log: DataFrame) -> DataFrame:
    """Keys whose newest mutation is a deletion."""
    return latest(log).where(F.col("op") == TOMBSTONE).select("k", "seq")


def get(log: DataFrame, key: str) -> DataFrame:
    """The newest mutation of one key, if any; the key is filtered before the aggregation."""
    return latest(log.where(F.col("k") == key)).select("k", op_name(F.col("op")).alias("status"), "v")


def multi_get(probes: DataFrame, log: DataFrame) -> DataFrame:
    """For each probe key VALUE, TOMBSTONE or ABSENT, and the value."""
    state = latest(log)
    found = probes.join(state, "k", "left")
    return found.select("k", op_name(F.col("op")).alias("status"), F.when(F.col("op") == PUT, F.col("v")).alias("v"))


def contains(probes: DataFrame, log: DataFrame) -> DataFrame:
    """Probe keys with any mutation, a deletion too."""
    return probes.join(log, "k", "left_semi")


def missing(probes: DataFrame, log: DataFrame) -> DataFrame:
    """Probe keys with no mutation."""
    return probes.join(log, "k", "left_anti")


def versions(log: DataFrame) -> DataFrame:
    """Every mutation with its version number within its key, and whether it was overwritten."""
    by_key = Window.partitionBy("k").orderBy("seq")
    after = F.lead("seq").over(by_key)
    return log.select("k", "seq", "op", "v", F.row_number().over(by_key).cast("long").alias("version"), after.alias("superseded_by"))


def resurrections(log: DataFrame) -> DataFrame:
    """Puts that follow a deletion of the same key."""
    before = F.lag("op").over(Window.partitionBy("k").orderBy("seq"))
    return log.withColumn("before", before).where((F.col("op") == PUT) & (F.col("before") == TOMBSTONE)).select("k", "seq", "v")


def range_scan(log: DataFrame, low: str, high: str) -> DataFrame:
    """Live keys from ``low`` up to but without ``high``, in order."""
    return snapshot(log.where((F.col("k") >= low) & (F.col("k") < high))).orderBy("k")


def memtable(log: DataFrame, from_seq: int) -> DataFrame:
    """The in-memory table: the newest mutation of each key from ``from_seq`` on, with its size."""
    tail = latest(log.where(F.col("seq") >= from_seq))
    return tail.withColumn("bytes", entry_size(F.col("k"), F.col("op"), F.col("v")))


def memtable_stats(log: DataFrame, from_seq: int, threshold: int) -> DataFrame:
    """One row: entries, bytes, and whether it is empty or full."""
    totals = memtable(log, from_seq).agg(F.count("*").alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return totals.withColumns({"is_empty": F.col("entries") == 0, "is_full": F.col("bytes") >= threshold})
