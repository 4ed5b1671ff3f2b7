"""Bloom filters as tables of set bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import bloom_positions, bloom_size, fnv1a, one_at_a_time


def hashes(keys: DataFrame) -> DataFrame:
    """Add h1 and h2 of each key."""
    return keys.withColumns({"h1": fnv1a(F.col("k")), "h2": one_at_a_time(F.col("k"))})


def bits(keys: DataFrame, n_bits: int, n_hashes: int = 7) -> DataFrame:
    """The distinct bits that the keys set."""
    positions = bloom_positions(F.col("h1"), F.col("h2"), F.lit(n_bits).cast("long"), n_hashes)
    return hashes(keys.select("k").distinct()).select(F.explode(positions).alias("bit")).distinct()


def size(n: int, bits_per_key: int = 10) -> int:
    """Bits of a filter for n keys, in whole bytes."""
    return (max(64, (n or 64) * bits_per_key) + 7) // 8 * 8


def segment_bits(segments: DataFrame, bits_per_key: int = 10, n_hashes: int = 7) -> DataFrame:
    """The distinct bits of each segment's filter, with its size."""
    sizes = segments.groupBy("seg_id").agg(bloom_size(F.count("*"), bits_per_key).alias("n_bits"))
    keyed = hashes(segments.select("seg_id", "k")).join(sizes, "seg_id")
    return keyed.select("seg_id", "n_bits", F.explode(bloom_positions(F.col("h1"), F.col("h2"), F.col("n_bits"), n_hashes)).alias("bit")).distinct()


def probe(probes: DataFrame, set_bits: DataFrame, n_bits: int, n_hashes: int = 7) -> DataFrame:
    """For each distinct probe key whether the filter may hold it: all of its bits are set (relational division)."""
    positions = F.array_distinct(bloom_positions(F.col("h1"), F.col("h2"), F.lit(n_bits).cast("long"), n_hashes))
    asked = hashes(probes.select("k").distinct()).withColumn("positions", positions)
    wanted = asked.select("k", F.explode_outer("positions").alias("bit"))
    hits = wanted.join(set_bits.withColumn("is_set", F.lit(1)), "bit", "left")
    return hits.groupBy("k").agg((F.count("bit") == F.count("is_set")).alias("maybe"))
