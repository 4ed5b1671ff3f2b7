"""Sparse indexes and the physical layout of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import record_size

#: Bytes of a segment's header and footer; data starts after the header.
HEADER, FOOTER = 16, 64
#: Per index block and entry, and per filter block.
INDEX_BLOCK, INDEX_ENTRY, BLOOM_BLOCK = 8, 12, 12
#: Ranges of keys that a segment's records are numbered in, keys drawn for each to find them, and letters of a key kept.
BLOCKS, SAMPLE, LETTERS = 1024, 8, 32


def key_bounds(segments: DataFrame, blocks: int = BLOCKS) -> list[str]:
    """Keys, or first letters of keys, that split all keys into about ``blocks`` ranges: from the SAMPLE * blocks keys with
    the smallest hashes. Any bounds give the same offsets; these give ranges of about one size."""
    drawn = segments.select(F.substring("k", 1, LETTERS).alias("p"), F.xxhash64("k").alias("h")).orderBy("h", "p").limit(SAMPLE * blocks).collect()
    sample = sorted(r["p"] for r in drawn if r["p"] is not None)
    return sorted(set(sample[:: max(1, -(-len(sample) // blocks))]))


def _block(key: Column, bounds: list[str]) -> Column:
    """How many of the bounds are not above a key, by binary search."""
    if not bounds:
        return F.lit(0)
    table, steps = F.lit(bounds), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    ahead = lambda n, step: F.get(table, n + step - 1) <= key
    return F.aggregate(F.lit(steps), F.lit(0), lambda n, step: F.when(F.coalesce(ahead(n, step), F.lit(False)), n + step).otherwise(n))


def _size() -> Column:
    return record_size(F.col("k"), F.col("op"), F.col("v"))


def _placed(segments: DataFrame, bounds: list[str]) -> DataFrame:
    """Add ``pos``, ``off`` and the block: sums of blocks, then within each, so no task has a whole segment."""
    blocked = segments.withColumn("__block", _block(F.col("k"), bounds))
    earlier = Window.partitionBy("seg_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("seg_id", "__block").agg(F.count("*").alias("__n"), F.sum(_size()).alias("__bytes"))
    starts = sums.select("seg_id", "__block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__n", "__bytes")))
    in_order = Window.partitionBy("seg_id", "__block").orderBy("k")
    within = F.coalesce(F.sum(_size()).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = blocked.withColumns({"pos": F.row_number().over(in_order) - 1, "off": within}).join(starts, ["seg_id", "__block"])
    return numbered.withColumns({"pos": F.col("__n") + F.col("pos"), "off": (HEADER + F.col("__bytes") + F.col("off")).cast("long")}).drop("__n", "__bytes")


def offsets(segments: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Add ``pos`` (place in key order) and ``off`` (byte offset of the record) within each segment."""
    return _placed(segments, key_bounds(segments, blocks)).select(*(F.col(f"`{c}`") for c in segments.columns if c not in ("pos", "off")), "pos", "off")


def sparse_index(segments: DataFrame, interval: int = 16, blocks: int = BLOCKS) -> DataFrame:
    """(seg_id, k, off) of every ``interval``-th record."""
    return offsets(segments, blocks).where(F.col("pos") % interval == 0).select("seg_id", "k", "off")


def seek(probes: DataFrame, segments: DataFrame, interval: int = 16, blocks: int = BLOCKS) -> DataFrame:
    """For each probe and segment the bytes to scan: from the greatest index key not above it to the next index key.

    Index entries and probes are merged in key order (an as-of join by a window), not compared pair by pair: within
    blocks of keys, where what a block lacks at its ends comes from the blocks beside it. A probe before the first
    key gets an empty range.
    """
    bounds = key_bounds(segments, blocks)
    index = _placed(segments, bounds).where(F.col("pos") % interval == 0).select("seg_id", "__block", "k", "off")
    ends = segments.groupBy("seg_id").agg((F.lit(HEADER) + F.sum(_size())).cast("long").alias("data_end"))
    by_key = Window.partitionBy("seg_id", "__block").orderBy("k")
    by_block = Window.partitionBy("seg_id").orderBy("__block")
    inner = index.withColumn("end_off", F.lead("off").over(by_key))
    marks = inner.select("seg_id", "__block", "k", F.lit(0).alias("probe"), "off", "end_off")
    asked = probes.select("k").distinct().withColumn("__block", _block(F.col("k"), bounds)).crossJoin(F.broadcast(ends.select("seg_id")))  # one row per active segment
    asked = asked.select("seg_id", "__block", "k", F.lit(1).alias("probe"), F.lit(None).cast("long").alias("off"), F.lit(None).cast("long").alias("end_off"))
    every = marks.unionByName(asked)
    # of each block, one row: its first and last index entry, then those of the blocks before and after
    edges = every.groupBy("seg_id", "__block").agg(F.min("off").alias("first"), F.max("off").alias("last"))
    after = F.first("first", ignorenulls=True).over(by_block.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("last", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select("seg_id", "__block", before.alias("before"), after.alias("after"), "first").join(F.broadcast(ends), "seg_id")
    edges = edges.select("seg_id", "__block", "before", F.coalesce("after", "data_end").alias("after"), F.coalesce("first", "after", "data_end").alias("first"))
    so_far = by_key.orderBy("k", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = F.last(F.when(F.col("probe") == 0, F.struct("off", "end_off")), ignorenulls=True).over(so_far)
    found = every.withColumn("entry", entry).where("probe = 1").join(edges, ["seg_id", "__block"])
    nothing = F.lit(HEADER).cast("long")
    inside, earlier = F.col("entry").isNotNull(), F.col("before").isNotNull()
    start = F.when(inside, F.col("entry.off")).when(earlier, F.col("before")).otherwise(nothing)
    end = F.when(inside, F.coalesce("entry.end_off", "after")).when(earlier, F.col("first")).otherwise(nothing)
    return found.select("k", "seg_id", start.alias("start_off"), end.alias("end_off"))


def layout(segments: DataFrame, interval: int = 16, bits_per_key: int = 10) -> DataFrame:
    """Per segment the offsets and sizes of its regions, its records and its file size."""
    size = record_size(F.col("k"), F.col("op"), F.col("v"))
    indexed = F.when(F.col("pos") % interval == 0, INDEX_ENTRY + F.octet_length("k")).otherwise(0)
    n = F.col("record_count")
    bits = F.greatest(F.when(n == 0, 100).otherwise(n) * bits_per_key, F.lit(64))
    sums = offsets(segments).groupBy("seg_id").agg(F.count("*").alias("record_count"), F.sum(size).alias("data_size"), (INDEX_BLOCK + F.sum(indexed)).cast("long").alias("index_size"))
    sized = sums.withColumns({"data_off": F.lit(HEADER).cast("long"), "bloom_size": (BLOOM_BLOCK + F.floor((bits + 7) / 8)).cast("long")})
    placed = sized.withColumn("index_off", F.col("data_off") + F.col("data_size"))
    placed = placed.withColumn("bloom_off", F.col("index_off") + F.col("index_size"))
    return placed.select("seg_id", "record_count", "data_off", "data_size", "index_off", "index_size", "bloom_off", "bloom_size", (F.col("bloom_off") + F.col("bloom_size") + FOOTER).alias("file_size"))


def storage_overhead(segments: DataFrame, interval: int = 16, bits_per_key: int = 10) -> DataFrame:
    """One row: bytes of keys and values, bytes on disk, and their ratio."""
    logical = segments.agg(F.sum(F.octet_length("k") + F.octet_length("v")).alias("logical_bytes"))
    physical = layout(segments, interval, bits_per_key).agg(F.sum("file_size").alias("physical_bytes"))
    return logical.crossJoin(physical).withColumn("overhead", F.round(F.col("physical_bytes") / F.col("logical_bytes"), 6))
