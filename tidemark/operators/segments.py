"""Immutable sorted segments: cutting a log into them, merging them, and what that saves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import entry_size, op_name
from tidemark.model import PUT, TOMBSTONE
from tidemark.operators.running import running_total
from tidemark.operators.state import latest


def assign_fixed(log: DataFrame, n_segments: int = 4) -> DataFrame:
    """Add ``seg_id``: equal stretches of the sequence, oldest first."""
    bounds = log.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    if bounds["low"] is None:
        return log.withColumn("seg_id", F.lit(0))
    each = max(1, -(-(bounds["high"] - bounds["low"] + 1) // n_segments))
    return log.withColumn("seg_id", F.expr(f"(seq - {bounds['low']}) div {each}").cast("int"))


def segment_contents(segmented: DataFrame) -> DataFrame:
    """The newest mutation of each key in each segment; tombstones stay."""
    return latest(segmented, keys=("seg_id", "k"))


def merge(segments: DataFrame) -> DataFrame:
    """Compaction: over all segments the newest wins (by seg_id), then tombstones go."""
    return latest(segments.select("seg_id", "k", "op", "v"), order="seg_id").where(F.col("op") == PUT).select("k", "v", "seg_id")


def merge_all(parts: list[DataFrame]) -> DataFrame:
    """Merge segments given as tables (k, op, v), oldest first."""
    numbered = [p.select(F.lit(i).alias("seg_id"), "k", "op", "v") for i, p in enumerate(parts)]
    return merge(reduce(DataFrame.unionByName, numbered))


def compaction_stats(segments: DataFrame) -> DataFrame:
    """One row: records in, superseded, tombstones purged, and out. The newest record of a key is the one with the
    greatest sequence number: a segment that is not deduplicated yet has many records of a key, which seg_id can't order."""
    newest = segments.groupBy("k").agg(F.count("*").alias("records"), F.max_by("op", "seq").alias("op"))
    count = lambda op: F.count_if(F.col("op") == op)
    records = F.coalesce(F.sum("records"), F.lit(0))
    return newest.agg(records.alias("records_in"), (records - F.count("*")).alias("superseded"), count(TOMBSTONE).alias("tombstones_purged"), count(PUT).alias("records_out"))


def read_trace(segments: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe the newest segment that holds it, what it finds there, and how many segments are looked at."""
    n = segments.agg((F.max("seg_id") + 1).alias("n"))
    newest = latest(segments.select("seg_id", "k", "op", "v"), order="seg_id")
    found = probes.join(newest, "k", "left").crossJoin(F.broadcast(n))  # one row
    return found.select("k", F.col("seg_id").alias("found_in"), op_name(F.col("op")).alias("status"), F.coalesce(F.col("n") - F.col("seg_id"), F.col("n")).cast("int").alias("segments_probed"))


def flush_bounds(log: DataFrame, threshold: int) -> DataFrame:
    """(seg_id, first, last): the seqs of every segment that size-triggered flushes cut; the tail stays in memory.

    A flush happens before the mutation that finds the table full, so the one that filled it is in. Sizes count a
    replaced key once, so the boundaries depend on one another: what each mutation replaces is found for all of the log
    at once, and one task folds the sorted numbers, with the state of one flush.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, total, seg_id = None, 0, 0
        for batch in batches:
            out = []
            for seq, size, before, replaced in zip(*(batch[c].tolist() for c in ("seq", "bytes", "before", "replaced")), strict=True):
                start = seq if start is None else start
                total += size - (replaced if before >= start else 0)
                if total >= threshold:
                    out.append((seg_id, start, seq))
                    start, total, seg_id = None, 0, seg_id + 1
            yield pd.DataFrame(out, columns=["seg_id", "first", "last"])

    same = Window.partitionBy("k").orderBy("seq")
    sized = log.select("seq", "k", entry_size(F.col("k"), F.col("op"), F.col("v")).alias("bytes"))
    lowest = F.lit(-(1 << 63)).cast("long")
    sized = sized.select("seq", "bytes", F.coalesce(F.lag("seq").over(same), lowest).alias("before"), F.coalesce(F.lag("bytes").over(same), F.lit(0).cast("long")).alias("replaced"))
    return sized.repartition(1).sortWithinPartitions("seq").mapInPandas(fold, "seg_id int, first long, last long")


def assign_by_size(log: DataFrame, threshold: int) -> DataFrame:
    """Add ``seg_id`` by size-triggered flushes; null for the tail that is still in memory. The flush of a mutation is
    the number of flushes that ended before it, a running total."""
    bounds = flush_bounds(log, threshold)
    ended = log.join(bounds.select(F.col("last").alias("seq"), F.lit(1).alias("__ends")), "seq", "left")
    numbered = running_total(ended, F.coalesce("__ends", F.lit(0)), name="__done")
    flushes = bounds.agg(F.count("*").alias("__flushes"))
    seg_id = (F.col("__done") - F.coalesce("__ends", F.lit(0))).cast("int")
    placed = numbered.crossJoin(F.broadcast(flushes)).withColumn("seg_id", F.when(seg_id < F.col("__flushes"), seg_id))  # one row
    return placed.select(*(F.col(f"`{c}`") for c in log.columns), "seg_id")
